"""Rows and places laid out by place: the same rows, without an exchange."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from vigie.operators import prepare
from vigie.plans import inputs
from vigie.sources import layout

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def same(left, right):
    right = right.select(left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("kind", ("point", "line"))
def test_located_rows_are_equal_and_nothing_is_exchanged(spark, tmp_path, no_broadcast, kind):
    incidents, localites = inputs.incidents(spark, SF_DIR), inputs.localites(spark, SF_DIR)
    rows, locate = (prepare.point_rows, prepare.locate_points) if kind == "point" else (prepare.line_rows, prepare.locate_lines)
    layout.store_by_place(rows(incidents), localites, f"by_{kind}", str(tmp_path / kind), bucket_rows=100)
    found = layout.locate_stored(spark, f"by_{kind}")
    text = plan(found)
    assert "SortMergeJoin" in text and "Exchange" not in text and "Bucketed: true" in text
    wanted = locate(incidents, localites)
    assert "Exchange hashpartitioning" in plan(wanted)
    assert set(found.columns) == set(wanted.columns) and same(found, wanted)


def test_hot_and_missing_places_are_dealt_over_buckets(spark, tmp_path, no_broadcast):
    """A third of the rows at one place, a third at none; zeros of both signs are one place."""
    place = F.when(F.col("i") % 3 == 0, 5.0).when(F.col("i") % 3 == 1, F.lit(None)).when(F.col("i") % 30 == 2, -0.0)
    rows = spark.range(3000).withColumnRenamed("id", "i").select(
        F.col("i").alias("no_liste"), place.otherwise((F.col("i") % 50).cast("double")).alias("id"), F.lit("p").alias("point"))
    localites = spark.createDataFrame([(float(i), f"place {i}") for i in range(50)] + [(None, "nowhere"), (7.0, "again")], "id DOUBLE, nom STRING").select(
        "id", F.lit(1.0).alias("longitude"), F.lit(2.0).alias("latitude"), "nom")
    layout.store_by_place(rows, localites, "hot", str(tmp_path / "hot"), bucket_rows=200)
    found = layout.locate_stored(spark, "hot")
    assert "Exchange" not in plan(found)
    assert same(found, prepare._attach_places(rows, localites, prepare.rules.PLACE_OVERRIDES))
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 8 and max(r["count"] for r in tasks) < 3000 / 3
    keys = spark.table("hot_rows").groupBy(layout.KEY).count().collect()
    assert max(r["count"] for r in keys) <= 2 * 200


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "no_liste BIGINT, id DOUBLE, point STRING")
    localites = spark.createDataFrame([(1.0, 1.0, 2.0, "a")], "id DOUBLE, longitude DOUBLE, latitude DOUBLE, nom STRING")
    layout.store_by_place(none, localites, "nothing", str(tmp_path / "nothing"))
    assert layout.locate_stored(spark, "nothing").count() == 0
