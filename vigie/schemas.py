"""Declared schemas of the input and output tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from vigie.functions.scalars import to_number

VICTIM_KINDS = ("morts", "blesses")
VICTIM_SLOTS = (1, 2, 3)
STATUS_COLUMNS = [f"stat_{kind}_{slot}" for kind in VICTIM_KINDS for slot in VICTIM_SLOTS]
COUNT_COLUMNS = [f"count_{kind}_{slot}" for kind in VICTIM_KINDS for slot in VICTIM_SLOTS]


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
}


def _fields(text: str) -> T.StructType:
    """A schema from "name TYPE, ..."; works before a session exists."""
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


INCIDENTS_RAW = _fields(
    "no_liste BIGINT, annee DOUBLE, mois DOUBLE, jour DOUBLE, origin STRING,"
    " type_incident STRING, point_id STRING, point STRING, depart_id DOUBLE, depart STRING,"
    " arrivee_id STRING, arrivee STRING, nbr_morts DOUBLE, nbr_blesses DOUBLE, "
    + ", ".join(f"{name} STRING" for name in STATUS_COLUMNS)
)
# Counts may be numbers or text: their type is left as found.
INCIDENTS_RAW_UNTYPED = list(COUNT_COLUMNS)

LOCALITES_RAW = _fields(
    "id STRING, longitude DOUBLE, latitude DOUBLE, featureNam STRING, featureRef STRING,"
    " admin1Pcod STRING, admin1Name STRING, admin2Pcod STRING, admin2Name STRING,"
    " admin3Pcod STRING, admin3Name STRING, popPlace_1 STRING"
)
LOCALITE_COLUMNS = {
    "id": "id",
    "longitude": "longitude",
    "latitude": "latitude",
    "featureNam": "nom",
    "featureRef": "ref",
    "admin1Pcod": "adm1_cod",
    "admin1Name": "adm1_name",
    "admin2Pcod": "adm2_cod",
    "admin2Name": "adm2_name",
    "admin3Pcod": "adm3_cod",
    "admin3Name": "adm3_name",
    "popPlace_1": "type",
}

BOUNDARIES = _fields("level INT, Admin1_Nam STRING, wkt STRING")
DICTIONARY = "languages ARRAY<STRING>, translation ARRAY<STRUCT<en: STRING, fr: STRING>>"

_LOCALITE_ATTRIBUTES = (
    "longitude DOUBLE, latitude DOUBLE, nom STRING, ref STRING, adm1_cod STRING,"
    " adm1_name STRING, adm2_cod STRING, adm2_name STRING, adm3_cod STRING,"
    " adm3_name STRING, type STRING, type_fr STRING"
)
_LOCATED = (
    "no_liste BIGINT, annee DOUBLE, mois DOUBLE, jour DOUBLE, date DATE, type_incident STRING,"
    " id DOUBLE, point STRING, nbr_morts DOUBLE, nbr_blesses DOUBLE, " + _LOCALITE_ATTRIBUTES
)

# The tables a prepared folder holds, each with the columns later steps rely on.
PREPARED = {
    "localites": _fields("id DOUBLE, " + _LOCALITE_ATTRIBUTES),
    "incidents": T.StructType(INCIDENTS_RAW.fields + _fields("date DATE").fields),
    "incidents_point": _fields(_LOCATED),
    "incidents_line": _fields(_LOCATED + ", position STRING"),
    "victimes": _fields(
        "no_liste BIGINT, date DATE, categorie STRING, statut STRING, corps STRING, nombre DOUBLE"
    ),
    "boundaries": BOUNDARIES,
}
# Fact tables are laid out by year, the filter every dashboard uses.
PARTITIONED_BY = {"incidents": "annee", "incidents_point": "annee", "incidents_line": "annee"}


def _typed(df: DataFrame, field: T.StructField) -> Column:
    column, found = F.col(field.name), df.schema[field.name].dataType
    if found == field.dataType:
        return column
    if isinstance(found, T.StringType) and isinstance(field.dataType, T.NumericType):
        column = to_number(column)
    return column.try_cast(field.dataType).alias(field.name)


def conform(
    df: DataFrame,
    schema: T.StructType,
    *,
    untyped: list[str] | None = None,
    keep_extra: bool = False,
) -> DataFrame:
    """Declared columns first, in the declared types; a missing one is an error.

    Text that does not read as the declared type becomes NULL, as in the workbook.
    """
    untyped = untyped or []
    wanted = schema.fieldNames() + untyped
    missing = [name for name in wanted if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    columns = [_typed(df, field) for field in schema.fields]
    columns += [F.col(name) for name in untyped]
    if keep_extra:
        columns += [F.col(name) for name in df.columns if name not in wanted]
    return df.select(*columns)
