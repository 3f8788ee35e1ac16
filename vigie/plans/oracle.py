"""The named queries again as plain SQL, to check the results in another engine.

Only the mapping of the given tables is shared with the Spark code. The queries are
written apart from it on purpose: long forms, self joins and per-place kernel sums where
the library takes shorter ways, and fixed values of their own.
"""

from __future__ import annotations

from vigie.plans import inputs
from vigie.plans.catalog import REGION, SEVERITY, YEAR
from vigie.operators.trends import CRITERIA, MEASURES, STATISTICS, VARIABLES
from vigie.schemas import COUNT_COLUMNS, STATUS_COLUMNS, VICTIM_KINDS, VICTIM_SLOTS


# --- fixed values, written out again: not those of the library, which are checked against them ----
FORCED_PLACES = (
    ("Frontière Boulkessi", {"longitude": -1.0622, "latitude": 15.1364, "nom": "Frontière Boulkessi"}),
    ("Almoustarat", {"longitude": 0.087, "latitude": 17.367, "nom": "Frontière Boulkessi"}),
)
# In the order in which they are applied: the last one that matches stays.
ACTORS = (
    ("MINUSMA", ("casque bleu", "MINUSMA")),
    ("FAMA", ("soldat", "militaire", "policier", "douanier")),
    ("Assaillants", ("assaillant", "djihadiste", "terroriste", "MNLA", "CMA")),
    ("Civils", ("civil", "maire")),
)
FRENCH_PLACE_TYPES = (
    ("National Capital", "Capitale"), ("Admin1 Capital", "Chef-lieu de région"),
    ("Admin2 Capital", "Chef-lieu de cercle"), ("Admin3 Capital", "Chef-lieu de commune"),
)
SHOWN = (
    ("Total", "Total"), ("Point", "Point"), ("Ligne", "Line"), ("ND", "ND"), ("Attaque", "Attack"),
    ("Affrontement", "Clash"), ("Autre", "Other"), ("Not deadly", "Not deadly"), ("Deadly", "Deadly"),
)
SEVERITIES = {
    "en": ("Dead, Injured", "Dead, No injured", "No dead, Injured", "No dead, No injured"),
    "fr": ("Morts, Bléssés", "Morts, Pas de bléssés", "Pas de morts, Bléssés", "Pas de morts, Pas de bléssés"),
}
EXTENT_X, EXTENT_Y = (-12.5, 4.5), (10.0, 25.0)


def _quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _case(subject: str, pairs, otherwise: str | None = None) -> str:
    whens = " ".join(f"WHEN {key} THEN {value}" for key, value in pairs)
    return f"CASE {subject} {whens}{f' ELSE {otherwise}' if otherwise else ''} END"


def _mapped(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def _slot_columns(count: str = "cnt") -> str:
    columns, position = [], 0
    for kind in VICTIM_KINDS:
        first = position + 1
        for slot in VICTIM_SLOTS:
            position += 1
            for name, value in (("stat", "stat"), ("count", count)):
                columns.append(
                    f"max(CASE WHEN l_linenumber = {position} THEN {value} END)"
                    f" AS {name}_{kind}_{slot}"
                )
        columns.append(
            f"sum(CASE WHEN l_linenumber BETWEEN {first} AND {position} THEN cnt END)"
            f" AS nbr_{kind}"
        )
    return ", ".join(columns)


def _overridden(column: str) -> str:
    """A forced value on listed places; a missing place name gives a missing value."""
    whens = "".join(
        f" WHEN point = {_quote(point)} THEN "
        + (_quote(values["nom"]) if column == "nom" else f"CAST({values[column]} AS DOUBLE)")
        for point, values in FORCED_PLACES
    )
    return f"CASE WHEN point IS NULL THEN NULL{whens} ELSE {column} END"


ATTRIBUTES = (
    "ref, adm1_cod, adm1_name, adm2_cod, adm2_name, adm3_cod, adm3_name, type, type_fr"
)
FORCED = ", ".join(f"{_overridden(c)} AS {c}" for c in ("longitude", "latitude", "nom"))
VICTIM_COLUMNS = ", ".join(
    [name for pair in zip(STATUS_COLUMNS, COUNT_COLUMNS) for name in pair]
    + ["nbr_morts", "nbr_blesses"]
)
INCIDENT_COLUMNS = f"no_liste, annee, mois, jour, date, origin, type_incident, {VICTIM_COLUMNS}"

LOCATION = (
    "CASE WHEN point IS NOT NULL THEN 'Point'"
    " WHEN depart IS NOT NULL AND arrivee IS NOT NULL THEN 'Ligne' ELSE 'ND' END"
)
TYPE = (
    "CASE WHEN type_incident IN ('Attaque', 'Affrontement') THEN type_incident ELSE 'Autre' END"
)
DEADLY = "CASE WHEN nbr_morts > 0 THEN 'Deadly' ELSE 'Not deadly' END"
CLASSES = {"total": "'Total'", "location": LOCATION, "type": TYPE, "deadly": DEADLY}
SEVERITY_ID = """CASE
  WHEN coalesce(nbr_morts > 0, FALSE) AND coalesce(nbr_blesses > 0, FALSE) THEN 1
  WHEN coalesce(nbr_morts > 0, FALSE) AND coalesce(nbr_blesses = 0, TRUE) THEN 2
  WHEN coalesce(nbr_morts = 0, TRUE) AND coalesce(nbr_blesses > 0, FALSE) THEN 3
  WHEN coalesce(nbr_morts = 0, TRUE) AND coalesce(nbr_blesses = 0, TRUE) THEN 4 END"""
KEYWORDS = "CASE " + " ".join(
    f"WHEN contains(statut, {_quote(word)}) THEN {_quote(group)}"
    for group, words in reversed(ACTORS) for word in words
) + " ELSE 'ND' END"
MONTH = "make_date(CAST(year AS INTEGER), CAST(month AS INTEGER), 1)"


def _severity(lang: str = "en") -> str:
    return _case("sid", [(i + 1, _quote(label)) for i, label in enumerate(SEVERITIES[lang])])


def _display(column: str) -> str:
    labels = _case(column, [(_quote(a), _quote(b)) for a, b in SHOWN])
    order = _case(column, [(_quote(a), i + 1) for i, (a, _) in enumerate(SHOWN)])
    return f"{labels} AS category, CAST({order} AS INTEGER) AS category_order"


def _long(kind: str) -> str:
    """Six slots of one kind as rows."""
    names, value = {"Statut": ("stat", "statut"), "Nombre": ("count", "nombre")}[kind]
    return " UNION ALL ".join(
        f"SELECT no_liste, {_quote('Morts' if k == 'morts' else 'Blessés')} AS categorie,"
        f" {n} AS groupe, {names}_{k}_{n} AS {value} FROM incidents"
        for k in VICTIM_KINDS
        for n in VICTIM_SLOTS
    )


def _prefix(rough: bool = False) -> str:
    """The mapped tables; a rough list has counts as text, repeated and missing numbers, negative deaths."""
    orders = inputs.ORDER_SQL | inputs.ROUGH_SQL if rough else inputs.ORDER_SQL
    when, text = inputs.UNREADABLE
    dead = inputs.ROUGH_DEAD if rough else "nbr_morts"
    number = "TRY_CAST(nombre AS DOUBLE)" if rough else "nombre"
    return f"""WITH slots AS (
  SELECT l_orderkey, (l_linenumber - 1) % 6 + 1 AS l_linenumber, CAST(count(*) % 3 AS DOUBLE) AS cnt,
    CASE WHEN min(l_partkey) {when} THEN {_quote(text)} ELSE CAST(count(*) % 3 AS VARCHAR) END AS cnt_text,
    {inputs.pick('min(l_partkey)', inputs.STATUSES)} AS stat
  FROM lineitem GROUP BY l_orderkey, (lineitem.l_linenumber - 1) % 6 + 1),
wide AS (SELECT l_orderkey, {_slot_columns('cnt_text' if rough else 'cnt')} FROM slots GROUP BY l_orderkey),
incidents_numbered AS (
  SELECT o_orderkey AS order_number, {_mapped(orders)},
    {VICTIM_COLUMNS.replace('nbr_morts', dead + ' AS nbr_morts')}
  FROM orders LEFT JOIN wide ON o_orderkey = l_orderkey),
incidents_raw AS (SELECT * EXCLUDE (order_number) FROM incidents_numbered),
localites_raw AS (
  SELECT {_mapped(inputs.LOCALITE_SQL)}, c_custkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
localites AS (
  SELECT TRY_CAST(id AS DOUBLE) AS id, longitude, latitude, featureNam AS nom,
    featureRef AS ref, admin1Pcod AS adm1_cod, admin1Name AS adm1_name,
    admin2Pcod AS adm2_cod, admin2Name AS adm2_name, admin3Pcod AS adm3_cod,
    admin3Name AS adm3_name, coalesce(popPlace_1, 'Other') AS type,
    CASE WHEN popPlace_1 IS NULL THEN 'Autre' ELSE
      {_case('popPlace_1', [(_quote(a), _quote(b)) for a, b in FRENCH_PLACE_TYPES])}
      END AS type_fr
  FROM localites_raw),
incidents AS (
  SELECT * FROM (
    SELECT *, TRY_CAST(concat(CAST(CAST(annee AS INTEGER) AS VARCHAR), '-',
        lpad(CAST(CAST(mois AS INTEGER) AS VARCHAR), 2, '0'), '-',
        lpad(CAST(CAST(jour AS INTEGER) AS VARCHAR), 2, '0')) AS DATE) AS date
    FROM incidents_raw WHERE origin = 'webpage' AND jour IS NOT NULL)
  WHERE date IS NOT NULL),
incidents_point AS (
  SELECT {INCIDENT_COLUMNS}, TRY_CAST(point_id AS DOUBLE) AS id, point, {FORCED}, {ATTRIBUTES}
  FROM incidents LEFT JOIN localites
    ON TRY_CAST(point_id AS DOUBLE) IS NOT DISTINCT FROM localites.id
  WHERE point IS NOT NULL),
line_ends AS (
  SELECT {INCIDENT_COLUMNS}, depart_id AS id, depart AS point, 'départ' AS position
  FROM incidents WHERE depart IS NOT NULL
  UNION ALL
  SELECT {INCIDENT_COLUMNS}, TRY_CAST(arrivee_id AS DOUBLE), arrivee, 'arrivée'
  FROM incidents WHERE depart IS NOT NULL),
incidents_line AS (
  SELECT {INCIDENT_COLUMNS}, line_ends.id, point, position, {FORCED}, {ATTRIBUTES}
  FROM line_ends LEFT JOIN localites ON line_ends.id IS NOT DISTINCT FROM localites.id),
victim_status AS ({_long('Statut')}),
victim_counts AS ({_long('Nombre')}),
victims_paired AS (
  SELECT s.no_liste, s.categorie, statut, {number} AS nombre FROM victim_status s
  JOIN victim_counts c ON s.no_liste IS NOT DISTINCT FROM c.no_liste
    AND s.categorie = c.categorie AND s.groupe = c.groupe
  WHERE nombre IS NOT NULL),
victimes AS (
  SELECT p.no_liste, date, categorie, statut, {KEYWORDS} AS corps, nombre
  FROM victims_paired p LEFT JOIN incidents i ON p.no_liste IS NOT DISTINCT FROM i.no_liste),
boundaries AS (
  SELECT CAST(CASE g WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS level,
    adm1_name AS "Admin1_Nam",
    concat('POLYGON((', w, ' ', s, ', ', e, ' ', s, ', ', e, ' ', n, ', ', w, ' ', n, ', ',
      w, ' ', s, '))') AS wkt
  FROM (SELECT adm1_name, adm2_name, adm3_name,
      CAST(min(longitude) AS VARCHAR) AS w, CAST(max(longitude) AS VARCHAR) AS e,
      CAST(min(latitude) AS VARCHAR) AS s, CAST(max(latitude) AS VARCHAR) AS n,
      GROUPING(adm1_name, adm2_name, adm3_name) AS g
    FROM localites GROUP BY ROLLUP (adm1_name, adm2_name, adm3_name)) AS boxes),
months AS (
  SELECT annee AS year, mois AS month, 'Total' AS total, {LOCATION} AS location, {TYPE} AS type,
    {DEADLY} AS deadly FROM incidents),
severities AS (
  SELECT *, annee AS year, CAST({SEVERITY_ID} AS INTEGER) AS sid FROM incidents_point)
"""


NUMBER_TEXT = """CASE
  WHEN regexp_full_match(t, '[1-9]0{5,}')
    THEN concat(t[1:1], 'e+', lpad(CAST(length(t) - 1 AS VARCHAR), 2, '0'))
  WHEN regexp_full_match(t, '[1-9][0-9]*[1-9]0{6,}')
    THEN concat(t[1:1], '.', rtrim(t[2:], '0'), 'e+',
      lpad(CAST(length(t) - 1 AS VARCHAR), 2, '0'))
  ELSE t END"""

MEASURED = {
    "incidents": "CAST(count(*) AS DOUBLE)",
    "dead": "coalesce(sum(nbr_morts), 0e0)",
    "injured": "coalesce(sum(nbr_blesses), 0e0)",
}


def _monthly(variable: str, rollup: bool) -> str:
    groups = f"{MONTH}, {variable}" if rollup else "year, month, total, location, type, deadly"
    return f"""SELECT {MONTH} AS date, incidents, '{variable}' AS variable, {_display(variable)}
    FROM (SELECT {'any_value(year) AS year, any_value(month) AS month, ' + variable if rollup
                  else groups}, count(*) AS incidents
      FROM months GROUP BY {groups})"""


def _running(criterion: str, statistic: str) -> str:
    partitions = {"cumsum_year": "year, category", "cumsum_all": "category"}
    value = "incidents"
    if statistic in partitions:
        value = (
            f"CAST(sum(incidents) OVER (PARTITION BY {partitions[statistic]}"
            " ORDER BY year, month, location, type ROWS UNBOUNDED PRECEDING) AS BIGINT)"
        )
    return f"""SELECT year, month, {MONTH} AS date, '{criterion}' AS criterion, category,
      category_order, '{statistic}' AS variable, {value} AS nombre
    FROM (SELECT year, month, location, type, {_display(criterion)}, incidents
      FROM (SELECT year, month, total, location, type, count(*) AS incidents
        FROM months GROUP BY year, month, total, location, type))"""


def _cumulative(measure: str, by_week: bool) -> str:
    number = MEASURES.index(measure) + 1
    total = MEASURED[measure]
    if by_week:
        period = "annee AS year, CAST(floor((dayofyear(date) - 1) / 7e0) AS INTEGER) + 1 AS week"
        keys, over = "year, week", "PARTITION BY year ORDER BY week"
    else:
        period = (
            "make_date(CAST(annee AS INTEGER), CAST(mois AS INTEGER), 1) AS date"
        )
        keys, over = "date", "ORDER BY date"
    return f"""SELECT {keys}, '{measure}' AS variable, CAST({number} AS INTEGER) AS id, value,
      sum(value) OVER ({over} ROWS UNBOUNDED PRECEDING) AS cumsum
    FROM (SELECT {keys}, {total} AS value
      FROM (SELECT {period}, nbr_morts, nbr_blesses FROM incidents) GROUP BY {keys})"""


def _by_place(measure: str, table: str = "incidents_point") -> str:
    return f"""SELECT year, longitude, latitude, point, '{measure}' AS variable, value,
      concat(coalesce(point, 'NA'), ' - ', CAST(CAST(year AS BIGINT) AS VARCHAR), ' : ',
        {NUMBER_TEXT}, ' {measure}') AS label,
      CAST(CAST(year AS BIGINT) AS VARCHAR) AS year_key
    FROM (SELECT *, CAST(CAST(value AS BIGINT) AS VARCHAR) AS t
      FROM (SELECT annee AS year, longitude, latitude, point, {MEASURED[measure]} AS value
        FROM {table} GROUP BY annee, longitude, latitude, point) AS g WHERE value > 0)"""


def _severity_by_place(where: str = "TRUE", lang: str = "en") -> str:
    return f"""SELECT year, {_severity(lang)} AS severity, sid AS severity_order, point, latitude,
      longitude, count(*) AS n
    FROM severities WHERE {where} GROUP BY year, sid, point, latitude, longitude"""


def _severity_by_region(where: str = "TRUE", lang: str = "en") -> str:
    return f"""SELECT adm1_cod, adm1_name, year, {_severity(lang)} AS severity,
      sid AS severity_order, count(*) AS n
    FROM severities WHERE {where} GROUP BY adm1_cod, adm1_name, year, sid"""


CHOSEN = f"year = {YEAR} AND sid = {SEVERITIES['en'].index(SEVERITY) + 1}"


def _density(where: str, grid: int = 100) -> str:
    return f"""{_density_places(where)}
    SELECT cell_x, cell_y, round(longitude, 9) AS longitude, round(latitude, 9) AS latitude, round(density, 9) AS density
    FROM ({_density_rows(grid)})"""


def _density_places(where: str) -> str:
    def width(v: str) -> str:
        return (
            f"1.06e0 * least(stddev_samp({v}), (quantile_cont({v}, 0.75)"
            f" - quantile_cont({v}, 0.25)) / 1.34e0) * pow(count(*), -0.2e0)"
        )

    return f""", places AS (
      SELECT longitude AS x, latitude AS y FROM ({_severity_by_place(where)}) AS p
      WHERE longitude IS NOT NULL AND latitude IS NOT NULL),
    widths AS (SELECT count(*) AS m, {width('x')} AS hx, {width('y')} AS hy FROM places)"""


def _density_rows(grid: int = 100) -> str:
    def step(extent) -> str:
        return f"CAST({(extent[1] - extent[0]) / (grid - 1)!r} AS DOUBLE)"

    def line(number: str, extent) -> str:
        return f"(CAST({extent[0]} AS DOUBLE) + {number} * {step(extent)})"

    gx, gy = line("i", EXTENT_X), line("j", EXTENT_Y)
    return f"""SELECT CAST(i AS INTEGER) AS cell_x, CAST(j AS INTEGER) AS cell_y, {gx} AS longitude, {gy} AS latitude,
      sum(exp(-pow(({gx} - x) / hx, 2) / 2 - pow(({gy} - y) / hy, 2) / 2)
        / (2 * pi() * m * hx * hy)) AS density
    FROM places, widths, range({grid}) AS a(i), range({grid}) AS b(j)
    WHERE hx > 0 AND hy > 0 GROUP BY i, j"""


def _contour_parts(grid: int = 100) -> str:
    """Places, levels, cells and segments of the density, cell by cell."""
    corner = "SELECT cell_x AS i, cell_y AS j, longitude AS x, latitude AS y, density AS z FROM raster"

    def crossing(name: str, a: str, b: str) -> str:
        share = f"(level - {a}_z) / ({b}_z - {a}_z)"
        return (
            f"CASE WHEN ({a}_z >= level) <> ({b}_z >= level) THEN {{'e': {name}, 'x': {a}_x + {share} * ({b}_x - {a}_x),"
            f" 'y': {a}_y + {share} * ({b}_y - {a}_y)}} END"
        )

    bottom, right, top, left = (
        crossing("(i * 1000 + j) * 2", "a", "b"), crossing("((i + 1) * 1000 + j) * 2 + 1", "b", "c"),
        crossing("(i * 1000 + j + 1) * 2", "d", "c"), crossing("(i * 1000 + j) * 2 + 1", "a", "d"),
    )
    # Going round a cell anticlockwise, a line begins where the height rises through the level and
    # ends where it falls: the higher side is on its left.
    return f"""{_density_places(CHOSEN)}, raster AS ({_density_rows(grid)}),
    range_ AS (SELECT min(density) AS lo, max(density) AS hi FROM raster),
    base AS (SELECT lo, hi, (hi - lo) / 10 AS part, pow(10e0, floor(log10((hi - lo) / 10))) AS unit FROM range_ WHERE hi > lo),
    step AS (SELECT lo, hi, unit * CASE
        WHEN 10 * unit - part < 1.5e0 * (part - 5 * unit) THEN 10
        WHEN 5 * unit - part < 2.75e0 * (part - 2 * unit) THEN 5
        WHEN 2 * unit - part < 1.5e0 * (part - unit) THEN 2 ELSE 1 END AS step FROM base),
    levels AS (
      SELECT k - CAST(floor(lo / step + 1e-7) AS BIGINT) AS level_no, k * step AS level
      FROM step, range(CAST(floor(lo / step + 1e-7) AS BIGINT), CAST(ceil(hi / step - 1e-7) AS BIGINT) + 1) AS r(k)),
    corners AS ({corner}),
    cells AS (
      SELECT a.i, a.j, level_no, level, a.x AS a_x, a.y AS a_y, a.z AS a_z, b.x AS b_x, b.y AS b_y, b.z AS b_z,
        c.x AS c_x, c.y AS c_y, c.z AS c_z, d.x AS d_x, d.y AS d_y, d.z AS d_z
      FROM corners a JOIN corners b ON b.i = a.i + 1 AND b.j = a.j JOIN corners c ON c.i = a.i + 1 AND c.j = a.j + 1
        JOIN corners d ON d.i = a.i AND d.j = a.j + 1, levels
      WHERE level > least(a.z, b.z, c.z, d.z) AND level <= greatest(a.z, b.z, c.z, d.z)),
    crossings AS (
      SELECT i, j, level_no, level, a_z >= level AS a, b_z >= level AS b, c_z >= level AS c, d_z >= level AS d,
        (a_z + b_z + c_z + d_z) / 4 >= level AS middle,
        {bottom} AS s, {right} AS e, {top} AS n, {left} AS w
      FROM cells),
    segments AS (
      SELECT level_no, level, unnest(CASE
        WHEN a AND c AND NOT b AND NOT d THEN
          CASE WHEN middle THEN [{{'p': s, 'q': e}}, {{'p': n, 'q': w}}] ELSE [{{'p': s, 'q': w}}, {{'p': n, 'q': e}}] END
        WHEN b AND d AND NOT a AND NOT c THEN
          CASE WHEN middle THEN [{{'p': e, 'q': n}}, {{'p': w, 'q': s}}] ELSE [{{'p': e, 'q': s}}, {{'p': w, 'q': n}}] END
        ELSE [{{'p': CASE WHEN a AND NOT b THEN s WHEN b AND NOT c THEN e WHEN c AND NOT d THEN n ELSE w END,
               'q': CASE WHEN b AND NOT a THEN s WHEN c AND NOT b THEN e WHEN d AND NOT c THEN n ELSE w END}}] END) AS g
      FROM crossings)"""


def _segments() -> str:
    return _contour_parts() + """
    SELECT CAST(level_no AS INTEGER) AS level_no, round(level, 9) AS level, round(g.p.x, 9) AS from_longitude,
      round(g.p.y, 9) AS from_latitude, round(g.q.x, 9) AS to_longitude, round(g.q.y, 9) AS to_latitude FROM segments"""


def _contours() -> str:
    """Lines walked vertex by vertex from their first one: where none comes before, or the smallest."""
    return _contour_parts() + """,
    links AS (SELECT level_no, level, g.p.e AS v, g.q.e AS w, g.p.x AS x, g.p.y AS y FROM segments),
    ends AS (
      SELECT level_no, any_value(level) AS level, g.q.e AS v, any_value(g.q.x) AS x, any_value(g.q.y) AS y FROM segments
      WHERE (level_no, g.q.e) NOT IN (SELECT (level_no, v) FROM links) GROUP BY level_no, g.q.e),
    vertices AS (SELECT level_no, level, v, w, x, y FROM links UNION ALL SELECT level_no, level, v, NULL, x, y FROM ends),
    heads AS (SELECT level_no, v FROM vertices WHERE (level_no, v) NOT IN (SELECT (level_no, w) FROM links)),
    walk AS (
      WITH RECURSIVE walk AS (
        SELECT level_no, v AS head, v, 1 AS place FROM heads
        UNION ALL
        SELECT walk.level_no, head, w, place + 1 FROM walk JOIN links ON links.level_no = walk.level_no AND links.v = walk.v)
      SELECT * FROM walk),
    loops AS (
      WITH RECURSIVE loops AS (
        SELECT level_no, v AS head, v, 1 AS place FROM links WHERE (level_no, v) NOT IN (SELECT (level_no, v) FROM walk)
        UNION ALL
        SELECT loops.level_no, head, w, place + 1 FROM loops JOIN links ON links.level_no = loops.level_no AND links.v = loops.v
        WHERE w >= head AND (place = 1 OR loops.v <> head))
      SELECT * FROM loops),
    lines AS (
      SELECT *, FALSE AS closed FROM walk
      UNION ALL
      SELECT *, TRUE FROM loops WHERE (level_no, head) IN (SELECT (level_no, head) FROM loops WHERE place > 1 AND v = head)),
    rings AS (
      SELECT level_no, head, row_number() OVER (PARTITION BY level_no ORDER BY first, final) AS ring
      FROM (SELECT level_no, head, min(v) AS first, arg_max(v, place) AS final FROM lines GROUP BY level_no, head))
    SELECT round(level, 9) AS level, CAST(ring AS INTEGER) AS ring, closed, CAST(place AS INTEGER) AS vertex_no,
      round(x, 9) AS longitude, round(y, 9) AS latitude
    FROM lines JOIN rings USING (level_no, head) JOIN vertices USING (level_no, v)"""


def _localized(lang: str) -> str:
    pairs = dict(zip(SEVERITIES["en"], SEVERITIES["fr"]))
    text = "label"
    if lang == "fr":
        text = _case("label", [(_quote(a), _quote(b)) for a, b in pairs.items()], "label")
    return f"""SELECT label, {text} AS text, n FROM (
      SELECT label, count(*) AS n FROM (
        SELECT {_severity()} AS label FROM (SELECT {SEVERITY_ID} AS sid FROM incidents)
        UNION ALL SELECT {TYPE} FROM incidents) GROUP BY label)"""


def _roundtrip() -> str:
    totals = {
        "localites": "sum(id)",
        "incidents": "sum(annee)",
        "incidents_point": "sum(longitude)",
        "incidents_line": "sum(latitude)",
        "victimes": "sum(nombre)",
        "boundaries": "sum(CAST(level AS DOUBLE))",
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows, round({total}, 3) AS total FROM {name}"
        for name, total in totals.items()
    )


def _vertices() -> str:
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
    return " UNION ALL ".join(
        f"""SELECT CAST(c_custkey - 1 AS DOUBLE) AS region, 1 AS ring, {i + 1} AS position,
        longitude + {dx} * 0.25e0 AS longitude, latitude + {dy} * 0.25e0 AS latitude,
        featureNam AS nom, admin1Name AS adm1_name FROM localites_raw"""
        for i, (dx, dy) in enumerate(corners)
    )


def _boundary_vertices() -> str:
    """Every corner of every ring written out."""
    corners = [
        (number, p + 1, r + 1, str(r > 0).upper(), i + 1, dx, dy)
        for number, parts in inputs.OUTLINES.items()
        for p, rings in enumerate(parts)
        for r, points in enumerate(rings)
        for i, (dx, dy) in enumerate(points)
    ]
    values = ", ".join(str(corner).replace("'", "") for corner in corners)
    kinds = len(inputs.OUTLINES) + len(inputs.OTHER_OUTLINES)
    return f"""SELECT 3 AS level, featureNam AS nom, CAST(part AS INTEGER) AS part, CAST(ring AS INTEGER) AS ring, hole,
      CAST(position AS INTEGER) AS position, longitude + dx / 4e0 AS longitude, latitude + dy / 4e0 AS latitude
    FROM localites_raw JOIN (VALUES {values}) AS corners(number, part, ring, hole, position, dx, dy)
      ON c_custkey % {kinds} = number"""


def _rejected() -> str:
    """Each row under the first reason that drops it, and the kept ones by their unreadable cells."""
    counts = " OR ".join(f"count_{k}_{n} = {_quote(inputs.UNREADABLE[1])}" for k in VICTIM_KINDS for n in VICTIM_SLOTS)
    return f""", judged AS (
      SELECT *, CASE WHEN order_number {inputs.WIDE_LINES} THEN 'corrupt row'
        WHEN origin IS DISTINCT FROM 'webpage' THEN 'other origin'
        WHEN jour IS NULL THEN 'date part missing'
        WHEN TRY_CAST(concat(CAST(CAST(annee AS INTEGER) AS VARCHAR), '-', CAST(CAST(mois AS INTEGER) AS VARCHAR), '-',
          CAST(CAST(jour AS INTEGER) AS VARCHAR)) AS DATE) IS NULL THEN 'no such date' END AS reason
      FROM incidents_numbered)
    SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason
    UNION ALL SELECT 'unreadable point_id', count(*) FROM judged WHERE reason IS NULL AND point_id = 'ND'
    UNION ALL SELECT 'unreadable arrivee_id', 0
    UNION ALL SELECT 'unreadable count', count(*) FROM judged WHERE reason IS NULL AND ({counts})"""


def _all_monthly(rollup: bool) -> str:
    return " UNION ALL ".join(f"({_monthly(variable, rollup)})" for variable in VARIABLES)


def _all_running() -> str:
    return " UNION ALL ".join(
        f"({_running(criterion, statistic)})" for criterion in CRITERIA for statistic in STATISTICS)


def _severity_class(lang: str) -> str:
    return f"""SELECT no_liste, nbr_morts, nbr_blesses, {_severity(lang)} AS severity,
      sid AS severity_order
    FROM (SELECT *, CAST({SEVERITY_ID} AS INTEGER) AS sid FROM incidents)"""


def oracle_sql() -> dict[str, str]:
    point_columns = "point_id, point, depart_id, depart, arrivee_id, arrivee"
    named = {
        "localities": "SELECT * FROM localites",
        "clean_incidents": f"SELECT {INCIDENT_COLUMNS}, {point_columns} FROM incidents",
        "place_overrides": "SELECT no_liste, position, point, longitude, latitude, nom"
                           " FROM incidents_line",
        "point_incidents": "SELECT * FROM incidents_point",
        "line_incidents": "SELECT * FROM incidents_line",
        "victims_unpivot": """SELECT no_liste, categorie, groupe, 'Statut' AS type,
          statut AS value FROM victim_status UNION ALL
          SELECT no_liste, categorie, groupe, 'Nombre',
          CAST(CAST(nombre AS BIGINT) AS VARCHAR) FROM victim_counts""",
        "victims_paired": "SELECT * FROM victims_paired",
        "victims_paired_long": "SELECT * FROM victims_paired",
        "victims": "SELECT * FROM victimes",
        "victims_checked": "SELECT * FROM victimes",
        "victims_joined": "SELECT * FROM victimes",
        "victims_ordered": "SELECT *, CASE categorie WHEN 'Morts' THEN 1 ELSE 2 END"
                           " AS categorie_order FROM victimes",
        "keyword_class": f"SELECT *, {KEYWORDS} AS corps FROM victim_status",
        "location_class": f"SELECT no_liste, {LOCATION} AS location FROM incidents",
        "type_class": f"SELECT no_liste, {TYPE} AS type FROM incidents",
        "deadly_class": f"""SELECT no_liste, nbr_morts, {DEADLY} AS deadly,
          CASE WHEN nbr_morts > 0 THEN 2 ELSE 1 END AS deadly_order FROM incidents""",
        "ordered_category": f"SELECT no_liste, {_display('type_incident')} FROM incidents",
        "severity_class": _severity_class("en"),
        "severity_class_fr": _severity_class("fr"),
        "severity_by_place": _severity_by_place(CHOSEN),
        "severity_by_place_all": _severity_by_place(),
        "severity_by_region": _severity_by_region(
            f"year = {YEAR} AND adm1_name = {_quote(REGION)}"
        ),
        "severity_by_region_all": _severity_by_region(),
        "highlight_region": f"""SELECT *, "Admin1_Nam" = {_quote(REGION)} AS myfill
          FROM boundaries WHERE level = 1""",
        "boundary_levels": "SELECT * FROM boundaries",
        "severity_by_place_fr": _severity_by_place(CHOSEN, "fr"),
        "severity_by_region_fr": _severity_by_region(
            f"year = {YEAR} AND adm1_name = {_quote(REGION)}", "fr"
        ),
        "hotspot_density": _density(CHOSEN),
        "hotspot_density_all": _density("TRUE"),
        "hotspot_segments": _segments(),
        "hotspot_contours": _contours(),
        "polygon_vertices": _vertices(),
        "boundary_vertices": _boundary_vertices(),
        "point_incidents_bucketed": "SELECT * FROM incidents_point",
        "line_incidents_bucketed": "SELECT * FROM incidents_line",
        "monthly_all_dimensions": _all_monthly(rollup=False),
        "monthly_all_dimensions_rollup": _all_monthly(rollup=True),
        "running_all_splits": _all_running(),
        "tables_roundtrip": _roundtrip(),
        "localities_from_csv": "SELECT * FROM localites",
        "boundaries_from_csv": "SELECT * FROM boundaries",
        "victims_from_csv": "SELECT * FROM victimes",
        "localized_labels_json": _localized("fr"),
        "localized_labels_en": _localized("en"),
        "localized_labels_fr": _localized("fr"),
    }
    for variable in VARIABLES:
        named[f"monthly_{variable}"] = _monthly(variable, rollup=False)
        named[f"monthly_{variable}_rollup"] = _monthly(variable, rollup=True)
    for criterion in CRITERIA:
        for statistic in STATISTICS:
            named[f"running_{criterion}_{statistic}"] = _running(criterion, statistic)
    for measure in MEASURES:
        named[f"cumulative_month_{measure}"] = _cumulative(measure, by_week=False)
        named[f"cumulative_week_{measure}"] = _cumulative(measure, by_week=True)
        named[f"by_place_{measure}"] = _by_place(measure)
    rough = {
        "rough_victims": "SELECT * FROM victimes",
        "rough_victims_paired": "SELECT * FROM victims_paired",
        "rough_victims_joined": "SELECT * FROM victims_paired",
        "rough_victims_long": "SELECT * FROM victims_paired",
        "rough_severity_class": _severity_class("en"),
        "rough_line_places": _by_place("dead", "incidents_line"),
        "rejected_rows": _rejected(),
    }
    return {name: _prefix() + body for name, body in named.items()} | {
        name: _prefix(rough=True) + body for name, body in rough.items()
    }
