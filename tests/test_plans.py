"""Invariants, and the physical plans that large data relies on."""

import contextlib
import io
from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from vigie.operators import places, prepare, trends, victims
from vigie.plans import catalog, inputs
from vigie.plans.batch import prepare_folder
from vigie.session import SETTINGS, cut_lineage

SF_DIR = "/root/testdata/sf0.001"
# These write tables or store rows as they are built.
EAGER = {
    "tables_roundtrip", "hotspot_segments", "hotspot_contours", "point_incidents_bucketed", "line_incidents_bucketed",
}
# The density kernel is a matrix product in Python.
KERNEL = {"hotspot_density", "hotspot_density_all"}


def plan(df, mode="simple"):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode=mode)
    return text.getvalue()


@contextlib.contextmanager
def settings(spark, **values):
    values = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@pytest.fixture(scope="module")
def incidents(spark):
    return cut_lineage(inputs.incidents(spark, SF_DIR))


@pytest.fixture(scope="module")
def points(spark, incidents):
    return cut_lineage(prepare.locate_points(incidents, inputs.localites(spark, SF_DIR)))


# --- invariants --------------------------------------------------------------
@pytest.mark.parametrize("variable", trends.VARIABLES)
def test_monthly_counts_add_up(incidents, variable):
    for rollup in (False, True):
        df = trends.monthly_by_dimension(incidents, variable, rollup)
        assert df.agg(F.sum("incidents")).first()[0] == incidents.count()


def test_unsummed_rows(incidents):
    frames = [trends.running_counts(incidents, c, "incidents") for c in trends.CRITERIA]
    rows = frames[0].unionByName(frames[1]).unionByName(frames[2])
    assert rows.count() == 1464
    assert rows.select("date", "criterion", "category").distinct().count() == 536


@pytest.mark.parametrize("criterion", trends.CRITERIA)
def test_running_counts_end_at_the_total(incidents, criterion):
    total = trends.running_counts(incidents, criterion, "incidents").groupBy("category").agg(
        F.sum("nombre"))
    last = trends.running_counts(incidents, criterion, "cumsum_all").groupBy("category").agg(
        F.max("nombre"))
    assert sorted(map(tuple, total.collect())) == sorted(map(tuple, last.collect()))


def test_running_counts_do_not_depend_on_partitions(spark, incidents):
    found = []
    for number in ("1", "200"):
        with settings(spark, spark__sql__shuffle__partitions=number,
                      spark__sql__adaptive__enabled="false"):
            df = trends.running_counts(incidents, "type", "cumsum_year")
            found.append(sorted(map(str, df.collect())))
    assert found[0] == found[1]


def test_six_slots_per_kind(incidents):
    found = victims.unpivot_victims(incidents).groupBy("no_liste", "type").count()
    assert {r["count"] for r in found.select("count").distinct().collect()} == {6}


def test_victim_forms_agree(incidents):
    one = victims.victims(incidents, True)
    for unique in (False, None):
        other = victims.victims(incidents, unique)
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_severity_counts_add_up(points):
    for df in (places.severity_by_place(points), places.severity_by_region(points, lang="fr")):
        assert df.agg(F.sum("n")).first()[0] == points.count()


def test_condensed_rows_give_the_same_counts(spark, incidents, points):
    localites = inputs.localites(spark, SF_DIR)
    for by_severity, count in (
        (False, lambda df: places.counts_by_place(df, "dead")),
        (False, lambda df: places.counts_by_place(df, "incidents")),
        (True, lambda df: places.severity_by_place(df, 2016)),
        (True, places.severity_by_region),
    ):
        condensed = prepare.locate_points(
            prepare.condense_points(incidents, by_severity), localites)
        one, other = count(points), count(condensed)
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


# --- plans -------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - EAGER - KERNEL))
def test_no_cross_join_no_python(spark, name):
    text = plan(catalog.queries()[name](spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapIn"):
        assert node not in text


@pytest.mark.parametrize("name", sorted(KERNEL))
def test_density_is_lazy(spark, name):
    """Nothing runs while the density is built, and nothing is paired with every cell."""
    tracker, group = spark.sparkContext.statusTracker(), f"building {name}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        df = catalog.queries()[name](spark, SF_DIR)
        assert len(tracker.getJobIdsForGroup(group)) == 0
    finally:
        spark.sparkContext.setJobGroup("", "")
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert text.count("MapInArrow") == 1


def test_unused_tables_and_columns_are_not_read(spark):
    text = plan(catalog.queries()["running_type_cumsum_all"](spark, SF_DIR), "formatted")
    assert "lineitem" not in text
    assert "o_orderpriority" in text and "o_totalprice" not in text
    text = plan(catalog.queries()["cumulative_month_dead"](spark, SF_DIR), "formatted")
    assert "lineitem" in text and "l_partkey" not in text and "o_custkey" not in text


def test_one_pass_victims_shuffle_nothing(spark, tmp_path):
    path = str(tmp_path / "incidents")
    inputs.incidents(spark, SF_DIR).write.parquet(path)
    stored = spark.read.parquet(path)
    assert "Exchange" not in plan(victims.victims(stored, unique_ids=True))
    # The search for repeated numbers is part of the query: it shuffles counted numbers, no rows.
    lines = plan(victims.victims(stored)).splitlines()
    shuffled = [after for line, after in zip(lines, lines[1:]) if "Exchange hashpartitioning" in line]
    assert shuffled and all("HashAggregate(keys=[no_liste" in line for line in shuffled)
    assert "Exchange" in plan(victims.victims(stored, unique_ids=False))


def test_a_year_reads_only_its_partition(spark, tmp_path):
    path = str(tmp_path / "tables")
    read = prepare_folder(
        inputs.incidents_raw(spark, SF_DIR), inputs.localites_raw(spark, SF_DIR),
        inputs.boundaries(spark, SF_DIR), path, unique_ids=True,
    )
    df = places.severity_by_place(read["incidents_point"], 2016, "Dead, Injured")
    text = plan(df, "formatted")
    assert "(annee" in text.split("PartitionFilters:")[1].split("\n")[0]
    schema = text.split("ReadSchema:")[1].split("\n")[0]
    assert "nom" not in schema and "adm1_name" not in schema and "nbr_morts" in schema


@pytest.mark.parametrize("name", ["point_incidents", "line_incidents", "place_overrides"])
def test_small_places_do_not_shuffle_the_facts(spark, name):
    text = plan(catalog.queries()[name](spark, "/root/testdata/sf0.1"))
    assert "BroadcastHashJoin [knownfloatingpointnormalized" in text
    assert "hashpartitioning(coalesce(" not in text


def test_pairing_reads_the_lines_once(spark):
    text = plan(catalog.queries()["victims_paired"](spark, SF_DIR))
    assert text.count("lineitem.parquet") == 1


@pytest.mark.parametrize("name", ["monthly_all_dimensions", "monthly_all_dimensions_rollup", "running_all_splits"])
def test_all_splits_read_the_facts_once(spark, name):
    """One scan and one shuffle of counts for all variables; what follows sees counts per month."""
    text = plan(catalog.queries()[name](spark, SF_DIR))
    assert text.count("orders.parquet") == 1
    lines = text.splitlines()
    scan = next(i for i, line in enumerate(lines) if "orders.parquet" in line)
    first = max(i for i, line in enumerate(lines[:scan]) if "partial_count" in line)
    # Nothing multiplies the facts before they are counted.
    assert not any("Expand" in line or "Generate" in line for line in lines[first:scan])


def test_all_splits_equal_the_single_ones(incidents):
    for rollup in (False, True):
        single = [trends.monthly_by_dimension(incidents, name, rollup) for name in trends.VARIABLES]
        both = trends.monthly_all_dimensions(incidents, rollup)
        union = reduce(DataFrame.unionByName, single)
        assert both.exceptAll(union).isEmpty() and both.count() == union.count()
    single = [trends.running_counts(incidents, c, s) for c in trends.CRITERIA for s in trends.STATISTICS]
    union, both = reduce(DataFrame.unionByName, single), trends.running_all(incidents)
    assert both.exceptAll(union).isEmpty() and both.count() == union.count()


def test_partial_sums_come_before_the_shuffle(spark):
    for name in ("by_place_dead", "monthly_type", "cumulative_week_injured"):
        assert "partial_" in plan(catalog.queries()[name](spark, SF_DIR))


def _hot_points(spark, rows=60_000):
    """A third of the rows at one place, another third at none that can be read."""
    hot = F.when(F.col("id") % 3 == 0, "5").when(F.col("id") % 3 == 1, "ND")
    return spark.range(0, rows, 1, 8).select(
        F.col("id").alias("no_liste"),
        F.lit(2016.0).alias("annee"),
        hot.otherwise((F.col("id") % 1000).cast("string")).alias("point_id"),
        F.lit("p").alias("point"),
        F.lit(1.0).alias("nbr_morts"),
        F.lit(0.0).alias("nbr_blesses"),
    )


def _many_places(spark):
    return spark.range(1000).select(
        F.col("id").cast("double").alias("id"),
        (F.col("id") / 10).alias("longitude"),
        F.lit(12.0).alias("latitude"),
        F.concat(F.lit("place "), "id").alias("nom"),
    )


def test_hot_places_are_split_when_the_places_are_too_large_to_broadcast(spark):
    assert SETTINGS["spark.sql.adaptive.skewJoin.enabled"] == "true"
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB",
    ):
        located = prepare.locate_points(_hot_points(spark), _many_places(spark)).select(
            "no_liste", "longitude"
        )
        rows = located.collect()
        assert "SortMergeJoin(skew=true)" in plan(located)
    assert len(rows) == 60_000
    assert sum(r.longitude == 0.5 for r in rows) >= 20_000
    assert sum(r.longitude is None for r in rows) == 20_000


def test_hot_places_reach_the_join_as_one_row(spark):
    condensed = prepare.condense_points(_hot_points(spark))
    hot = condensed.filter("point_id IN ('5', 'ND')").collect()
    assert len(hot) == 2 and all(r.n >= 20_000 for r in hot)
    counted = places.counts_by_place(
        prepare.locate_points(condensed, _many_places(spark)), "incidents")
    assert counted.agg(F.sum("value")).first()[0] == 60_000
