"""Rule data: every value here is fixed, results depend on its exact text.

Lists are in application or display order.
"""

from __future__ import annotations

from typing import NamedTuple

# --- fixed values: incident source kept by the cleaning step ----------------
KEPT_ORIGIN = "webpage"


class PlaceOverride(NamedTuple):
    """Coordinates and name forced on the rows that carry this place name."""

    point: str
    longitude: float
    latitude: float
    nom: str


# --- fixed values: forced places --------------------------------------------
# The second `nom` looks like a slip for "Almoustarat". It is kept because
# results must agree; pass other rows to `apply_place_overrides` to change it.
PLACE_OVERRIDES = (
    PlaceOverride("Frontière Boulkessi", -1.0622, 15.1364, "Frontière Boulkessi"),
    PlaceOverride("Almoustarat", 0.087, 17.367, "Frontière Boulkessi"),
)

# --- fixed values: keywords and the group each one stands for ----------------
KEYWORD_RULES = (
    ("casque bleu", "MINUSMA"),
    ("MINUSMA", "MINUSMA"),
    ("soldat", "FAMA"),
    ("militaire", "FAMA"),
    ("policier", "FAMA"),
    ("douanier", "FAMA"),
    ("assaillant", "Assaillants"),
    ("djihadiste", "Assaillants"),
    ("terroriste", "Assaillants"),
    ("MNLA", "Assaillants"),
    ("CMA", "Assaillants"),
    ("civil", "Civils"),
    ("maire", "Civils"),
)
UNKNOWN = "ND"

# --- fixed values: French place types; a missing type has its own label ------
PLACE_TYPES_FR = (
    ("National Capital", "Capitale"),
    ("Admin1 Capital", "Chef-lieu de région"),
    ("Admin2 Capital", "Chef-lieu de cercle"),
    ("Admin3 Capital", "Chef-lieu de commune"),
)
MISSING_TYPE = "Other"
MISSING_TYPE_FR = "Autre"

# --- fixed values: stored incident classes and their display labels ----------
CATEGORY_LEVELS = (
    ("Total", "Total"),
    ("Point", "Point"),
    ("Ligne", "Line"),
    ("ND", "ND"),
    ("Attaque", "Attack"),
    ("Affrontement", "Clash"),
    ("Autre", "Other"),
    ("Not deadly", "Not deadly"),
    ("Deadly", "Deadly"),
)
VICTIM_LEVELS = (("Morts", "Morts"), ("Blessés", "Blessés"))

# --- fixed values: severity ids 1 to 4 in order, English ---------------------
SEVERITY_LABELS = (
    "Dead, Injured",
    "Dead, No injured",
    "No dead, Injured",
    "No dead, No injured",
)

# --- fixed values: English and French label pairs ----------------------------
LANGUAGES = ("en", "fr")
LABEL_PAIRS = (
    ("Year", "Année"),
    ("Region", "Région"),
    ("Severity", "Sévérité"),
    ("Map", "Carte"),
    ("Graph", "Graphique"),
    ("Number of incidents", "Nombre d'incidents"),
    ("Mapping the points, by severity", "Cartographie des points, par sévérité"),
    ("Agregating the incidents, by severity", "Agrégation des incidents, par sévérité"),
    ("Identifying the region", "Identifer la région"),
    ("Identifying the hotspots", "Identifer les points chauds"),
    ("Dead, Injured", "Morts, Bléssés"),
    ("Dead, No injured", "Morts, Pas de bléssés"),
    ("No dead, Injured", "Pas de morts, Bléssés"),
    ("No dead, No injured", "Pas de morts, Pas de bléssés"),
)
# The fifteenth pair is the credit line; its address is the caller's.
CREDIT_PAIR = ("Based on data from {source}", "A partir de données tirées de {source}")

# --- fixed values: map extent, (low, high) in degrees ------------------------
LONGITUDE_EXTENT = (-12.5, 4.5)
LATITUDE_EXTENT = (10.0, 25.0)


def label_pairs(source: str | None = None) -> tuple[tuple[str, str], ...]:
    """The label pairs, with the credit line filled in when a source is given."""
    if source is None:
        return LABEL_PAIRS
    return LABEL_PAIRS + (tuple(text.format(source=source) for text in CREDIT_PAIR),)


def translate(text: str, lang: str) -> str:
    """A label in the chosen language; unknown text stays as it is."""
    if lang not in LANGUAGES:
        raise ValueError(f"language must be one of {LANGUAGES}, not {lang!r}")
    return text if lang == "en" else dict(LABEL_PAIRS).get(text, text)
