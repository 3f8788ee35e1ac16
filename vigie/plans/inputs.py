"""The library's input tables, built from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigie.operators.prepare import clean_incidents, prepare_localities
from vigie.schemas import VICTIM_KINDS, VICTIM_SLOTS

# Columns in use of the given tables. A declared schema spares a pass over file footers.
GIVEN = {
    "nation": "n_nationkey INT, n_name STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING,"
              " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT",
}

# --- fixed values of the mapping, by remainder from 0 ------------------------
REGIONS = (
    "Kayes", "Koulikouro", "Sikasso", "Segou", "Mopti", "Tombouctou", "Gao", "Kidal", "Bamako",
)
PLACE_TYPES = (
    "National Capital", "Admin1 Capital", "Admin2 Capital", "Admin3 Capital", "Village", None,
)
STATUSES = (
    "soldats", "militaires maliens", "policier", "casque bleu", "casques bleus",
    "soldats de la MINUSMA", "civils", "maire", "djihadistes", "ex-CMA et civil", "terroriste",
    "inconnus", "patrouille MINUSMA", "douaniers", "assaillants", "combattants MNLA", "membres CMA",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(number: str, values: tuple[str | None, ...]) -> str:
    """SQL for the value at ``number`` modulo the length."""
    whens = " ".join(
        f"WHEN {i} THEN " + ("NULL" if value is None else f"'{value}'")
        for i, value in enumerate(values)
    )
    return f"CASE ({number}) % {len(values)} {whens} END"


LOCALITE_SQL = {
    "id": "CASE WHEN c_custkey = 149 THEN NULL ELSE CAST(c_custkey AS STRING) END",
    "longitude": "-12e0 + (c_custkey % 33) / 2e0",
    "latitude": "10e0 + (c_custkey % 29) / 2e0",
    "featureNam": "c_name",
    "featureRef": "concat('ref-', CAST(c_custkey AS STRING))",
    "admin1Pcod": "concat('ML0', CAST(c_nationkey % 9 + 1 AS STRING))",
    "admin1Name": pick("c_nationkey", REGIONS),
    "admin2Pcod": "concat('ML0', CAST(c_nationkey AS STRING))",
    "admin2Name": "n_name",
    "admin3Pcod": "c_mktsegment",
    "admin3Name": "c_mktsegment",
    "popPlace_1": pick("c_custkey", PLACE_TYPES),
}

HAS_POINT = "(o_orderkey % 5 IN (0, 1, 2) OR o_orderkey % 10 = 4)"
HAS_LINE = "(o_orderkey % 5 = 3 OR o_orderkey % 10 = 4)"
PLACE = (
    "CASE o_custkey % 50 WHEN 7 THEN 'Frontière Boulkessi' WHEN 13 THEN 'Almoustarat'"
    " ELSE concat('Place ', CAST(o_custkey AS STRING)) END"
)
ORDER_SQL = {
    "no_liste": "o_orderkey",
    "annee": "CAST(year(o_orderdate) + 20 AS DOUBLE)",
    "mois": "CAST(month(o_orderdate) AS DOUBLE)",
    "jour": "CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 31e0"
            " ELSE CAST(day(o_orderdate) AS DOUBLE) END",
    "origin": "CASE WHEN o_orderpriority = '5-LOW' THEN 'press'"
              " WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 10 = 0 THEN NULL"
              " ELSE 'webpage' END",
    "type_incident": "CASE WHEN o_orderstatus = 'F' THEN 'Attaque'"
                     " WHEN o_orderstatus = 'O' THEN 'Affrontement'"
                     " WHEN o_orderkey % 2 = 0 THEN 'Enlèvement' END",
    "point_id": f"CASE WHEN {HAS_POINT} THEN CASE WHEN o_orderkey % 83 = 0 THEN 'ND'"
                " ELSE CAST(o_custkey AS STRING) END END",
    "point": f"CASE WHEN {HAS_POINT} THEN {PLACE} END",
    "depart_id": f"CASE WHEN {HAS_LINE} THEN CAST(o_custkey AS DOUBLE) END",
    "depart": f"CASE WHEN {HAS_LINE} THEN {PLACE} END",
    "arrivee_id": f"CASE WHEN {HAS_LINE} THEN CAST(o_custkey + 5 AS STRING) END",
    "arrivee": f"CASE WHEN {HAS_LINE} AND o_orderkey % 7 <> 0"
               " THEN concat('Place ', CAST(o_custkey + 5 AS STRING)) END",
}


# What a rough list does otherwise: numbers that occur several times, one of them often, or are missing;
# negative deaths; counts that are text and cannot always be read.
ROUGH_SQL = {
    "no_liste": "CASE WHEN o_orderkey BETWEEN 1 AND 120 AND o_orderkey % 3 = 0 THEN 0"
                " WHEN o_orderkey BETWEEN 201 AND 220 THEN NULL"
                " WHEN o_orderkey % 50 = 1 THEN o_orderkey + 1 ELSE o_orderkey END",
}
ROUGH_DEAD = "CASE WHEN o_orderkey % 11 = 0 THEN -1e0 ELSE nbr_morts END"
UNREADABLE = ("% 7 = 0", "plusieurs")

# The victim slot, 1 to 6, of every line.
SLOT = "((l_linenumber - 1) % 6 + 1)"


def _as(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def _expressions(texts: list[str]) -> list[Column]:
    return [F.expr(text) for text in texts]


def localites_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place per customer."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customers.join(nations, customers.c_nationkey == nations.n_nationkey).selectExpr(
        *_as(LOCALITE_SQL)
    )


def _count(slot: str, rough: bool) -> str:
    if not rough:
        return f"CAST(lines_{slot} % 3 AS DOUBLE)"
    when, text = UNREADABLE
    return f"CASE WHEN part_{slot} {when} THEN '{text}' ELSE CAST(lines_{slot} % 3 AS STRING) END"


def _casualties(spark: SparkSession, sf_dir: str, rough: bool = False) -> DataFrame:
    """Six victim slots and two totals per order, in one aggregation over the lines.

    Every line falls in a slot. A slot's lines may repeat: they are counted, and the lowest part names the status.
    """
    slots = [f"{kind}_{n}" for kind in VICTIM_KINDS for n in VICTIM_SLOTS]
    statuses = "array({})".format(", ".join(f"'{status}'" for status in STATUSES))
    found = [
        sql
        for line, slot in enumerate(slots, start=1)
        for sql in (
            f"count(CASE WHEN {SLOT} = {line} THEN 1 END) AS lines_{slot}",
            f"min(CASE WHEN {SLOT} = {line} THEN l_partkey END) AS part_{slot}",
        )
    ]
    values = [
        sql
        for slot in slots
        for sql in (
            f"get({statuses}, CAST(part_{slot} % {len(STATUSES)} AS INT)) AS stat_{slot}",
            f"CASE WHEN lines_{slot} > 0 THEN {_count(slot, rough)} END AS count_{slot}",
        )
    ]
    totals = []
    for kind in VICTIM_KINDS:
        lines = [f"lines_{kind}_{n}" for n in VICTIM_SLOTS]
        total = " + ".join(f"{name} % 3" for name in lines)
        totals.append(
            f"CASE WHEN {' + '.join(lines)} > 0 THEN CAST({total} AS DOUBLE) END AS nbr_{kind}"
        )
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(*_expressions(found))
        .selectExpr("l_orderkey", *values, *totals)
    )


def incidents_raw(
    spark: SparkSession, sf_dir: str, casualties: bool = True, rough: bool = False
) -> DataFrame:
    """One incident per order; victims from its lines.

    Without ``casualties`` the lines are not read: the rows are the same, the victim
    columns are left out. A ``rough`` list has what raw lists have, too (``ROUGH_SQL``).
    """
    columns = ORDER_SQL | ROUGH_SQL if rough else ORDER_SQL
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_as(columns))
    if casualties:
        victims = _casualties(spark, sf_dir, rough)
        orders = orders.join(victims, orders.o_orderkey == victims.l_orderkey, "left").drop("l_orderkey")
        if rough:
            orders = orders.withColumn("nbr_morts", F.expr(ROUGH_DEAD))
    return orders.drop("o_orderkey")


# Lines of the text file that have a cell too many, by the order's number.
WIDE_LINES = "% 37 = 5"


def incident_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The rough list as lines of text, some of a wrong width, and the names of its columns."""
    columns = ORDER_SQL | ROUGH_SQL
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_as(columns))
    victims = _casualties(spark, sf_dir, rough=True)
    rows = orders.join(victims, orders.o_orderkey == victims.l_orderkey, "left").drop("l_orderkey")
    names = [name for name in rows.columns if name != "o_orderkey"]
    line = F.to_csv(F.struct(*names))
    wide = F.expr(f"o_orderkey {WIDE_LINES}")
    return rows.select(F.when(wide, F.concat(line, F.lit(",one more"))).otherwise(line).alias("value")), names


def localites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_localities(localites_raw(spark, sf_dir))


def incidents(
    spark: SparkSession, sf_dir: str, casualties: bool = True, rough: bool = False
) -> DataFrame:
    return clean_incidents(incidents_raw(spark, sf_dir, casualties, rough))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around the places of each administrative unit, on three levels.

    The box around all places has no name, on level 1.
    """
    units = (
        localites_raw(spark, sf_dir)
        .groupBy("admin1Name", "admin2Name", "admin3Name")
        .agg(*_expressions([
            "min(longitude) AS west", "max(longitude) AS east",
            "min(latitude) AS south", "max(latitude) AS north",
        ]))
    )
    return (
        units.rollup("admin1Name", "admin2Name", "admin3Name")
        .agg(*_expressions([
            "CASE grouping_id() WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS level",
            "CAST(min(west) AS STRING) AS w", "CAST(max(east) AS STRING) AS e",
            "CAST(min(south) AS STRING) AS s", "CAST(max(north) AS STRING) AS n",
        ]))
        .selectExpr(
            "level",
            "admin1Name AS Admin1_Nam",
            "concat('POLYGON((', concat_ws(', ', concat_ws(' ', w, s), concat_ws(' ', e, s),"
            " concat_ws(' ', e, n), concat_ws(' ', w, n), concat_ws(' ', w, s)), '))') AS wkt",
        )
    )


# Outlines around a place, by the customer's number: parts of rings of corners, in quarters of a degree.
_OUTER, _HOLE, _ISLE = ((0, 0), (8, 0), (8, 8), (0, 8), (0, 0)), ((2, 2), (2, 4), (4, 4), (2, 2)), ((12, 0), (14, 0), (14, 2), (12, 0))
OUTLINES = {0: ((_OUTER,),), 1: ((_OUTER, _HOLE),), 2: ((_OUTER, _HOLE), (_ISLE,)), 3: ((_ISLE,), (_OUTER, _HOLE, _HOLE))}
# Further numbers have an empty outline, none, one of another kind and one that cannot be read.
OTHER_OUTLINES = {4: "'POLYGON EMPTY'", 5: "NULL", 6: "'LINESTRING(0 0, 1 1)'", 7: "'POLYGON((0 0, x 1, 1 1, 0 0))'"}


def outline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline text around each place, as boundaries of level 3: with holes, of several parts, or odd."""
    x, y = LOCALITE_SQL["longitude"], LOCALITE_SQL["latitude"]

    def corner(dx: int, dy: int) -> str:
        return f"concat_ws(' ', CAST({x} + {dx} * 0.25e0 AS STRING), CAST({y} + {dy} * 0.25e0 AS STRING))"

    def ring(corners) -> str:
        return "concat('(', concat_ws(', ', " + ", ".join(corner(*c) for c in corners) + "), ')')"

    def part(rings) -> str:
        return "concat('(', concat_ws(',', " + ", ".join(map(ring, rings)) + "), ')')"

    whens = []
    for number, parts in OUTLINES.items():
        text = f"concat('POLYGON', {part(parts[0])})" if len(parts) == 1 else (
            "concat('MULTIPOLYGON (', concat_ws(' , ', " + ", ".join(map(part, parts)) + "), ')')")
        whens.append(f"WHEN {number} THEN {text}")
    whens += [f"WHEN {number} THEN {text}" for number, text in OTHER_OUTLINES.items()]
    return table(spark, sf_dir, "customer").selectExpr(
        "3 AS level", "c_name AS nom", f"CASE c_custkey % {len(whens)} {' '.join(whens)} END AS wkt")


def outlines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A square ring around each place, numbered from 0, and attributes from 1."""
    customers = table(spark, sf_dir, "customer")
    corners = ", ".join(
        f"struct({LOCALITE_SQL['longitude']} + {dx} * 0.25e0 AS lon,"
        f" {LOCALITE_SQL['latitude']} + {dy} * 0.25e0 AS lat)"
        for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
    )
    shapes = customers.selectExpr(
        "CAST(c_custkey - 1 AS STRING) AS region", f"array(array({corners})) AS rings"
    )
    attributes = customers.selectExpr(
        "c_custkey AS OBJECTID", "c_name AS nom", f"{LOCALITE_SQL['admin1Name']} AS adm1_name"
    )
    return shapes, attributes
