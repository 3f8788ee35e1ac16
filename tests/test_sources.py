import json

import pytest
from pyspark.sql import functions as F, types as T

from rows import raw_incidents, raw_localites
from vigie import rules
from vigie.operators import prepare
from vigie.plans import inputs
from vigie.plans.batch import prepare_folder
from vigie.schemas import COUNT_COLUMNS, LOCALITES_RAW, PREPARED
from vigie.sources import tables

SF_DIR = "/root/testdata/sf0.001"


def same(left, right):
    names = left.columns
    assert set(names) == set(right.columns)
    right = right.select(names)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_csv_is_typed_by_name(spark, tmp_path):
    path = str(tmp_path / "incidents")
    raw = raw_incidents(
        spark,
        {"point": "Gao, ville", "point_id": "ND", "count_morts_1": "plusieurs", "nbr_morts": 3.0},
        counts_as=T.StringType(),
    )
    shuffled = raw.withColumn("note", F.lit("kept")).select("note", *reversed(raw.columns))
    shuffled.withColumns({
        "mois": F.lit("mars"), "annee": F.lit(" 2015 "), "no_liste": F.lit("1.0"),
        "jour": F.lit("5d"), "depart": F.lit("  "),
    }).write.csv(path, header=True)
    read = tables.read_incidents_raw(spark, path, "csv")
    assert read.columns[0] == "no_liste" and read.columns[-1] == "note"
    assert dict(read.dtypes)["annee"] == "double" and dict(read.dtypes)["no_liste"] == "bigint"
    row = read.first()
    assert (row.no_liste, row.point, row.nbr_morts) == (1, "Gao, ville", 3.0)
    assert (row.annee, row.mois, row.jour, row.depart) == (2015.0, None, None, None)
    assert row.count_morts_1 == "plusieurs"


def test_missing_columns_fail_early(spark, tmp_path):
    path = str(tmp_path / "places")
    raw_localites(spark, {"id": "1"}).drop("latitude", "featureRef").write.parquet(path)
    with pytest.raises(ValueError, match="latitude, featureRef"):
        tables.read_localites_raw(spark, path)


def test_localites_are_cut_to_their_columns(spark, tmp_path):
    path = str(tmp_path / "places")
    raw_localites(spark, {"id": "1"}).withColumn("more", F.lit(1)).write.parquet(path)
    assert tables.read_localites_raw(spark, path).columns == LOCALITES_RAW.fieldNames()


def test_dictionary_from_json(spark, tmp_path):
    path = tmp_path / "labels.json"
    pairs = [{"en": en, "fr": fr} for en, fr in rules.LABEL_PAIRS]
    path.write_text(json.dumps({"languages": ["en", "fr"], "translation": pairs}, indent=2),
                    encoding="utf-8")
    assert same(tables.read_dictionary(spark, str(path)), tables.built_in_dictionary(spark))


def test_boundaries(spark, tmp_path):
    path = str(tmp_path / "boundaries")
    inputs.boundaries(spark, SF_DIR).withColumn("code", F.lit("x")).write.parquet(path)
    read = tables.read_boundaries(spark, path)
    assert read.columns == ["level", "Admin1_Nam", "wkt", "code"]
    assert {r.level for r in read.select("level").distinct().collect()} == {1, 2, 3}


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("prepared") / "tables")
    read = prepare_folder(
        inputs.incidents_raw(spark, SF_DIR), inputs.localites_raw(spark, SF_DIR),
        inputs.boundaries(spark, SF_DIR), path, unique_ids=True,
    )
    return path, read


def test_read_tables_equal_written_ones(spark, prepared):
    path, read = prepared
    incidents, localites = inputs.incidents(spark, SF_DIR), inputs.localites(spark, SF_DIR)
    assert set(read) == set(PREPARED)
    assert same(read["localites"], localites)
    assert same(read["incidents"], incidents)
    assert same(read["incidents_point"], prepare.locate_points(incidents, localites))
    assert same(read["incidents_line"], prepare.locate_lines(incidents, localites))
    assert dict(read["incidents"].dtypes)["annee"] == "double"
    only = tables.read_tables(spark, path, ["victimes"])
    assert list(only) == ["victimes"] and same(only["victimes"], read["victimes"])


def test_large_places_give_the_same_tables(spark, tmp_path):
    raw = raw_incidents(
        spark, {"point": "p", "point_id": "1"}, {"depart": "d", "annee": 2016.0},
        {"no_liste": 1, "point": "q", "stat_morts_1": "civil", "count_morts_1": 2.0},
    )
    places, boundaries = raw_localites(spark, {"id": "1"}), inputs.boundaries(spark, SF_DIR)
    one = prepare_folder(raw, places, boundaries, str(tmp_path / "small"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = prepare_folder(raw, places, boundaries, str(tmp_path / "large"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    years = list((tmp_path / "large" / "incidents_point").glob("annee=*"))
    files = list((tmp_path / "large" / "incidents_point").glob("annee=*/part-*.parquet"))
    assert len(files) == len(years)
    for name in PREPARED:
        assert same(one[name], other[name])
    assert [one[name].count() for name in ("incidents_point", "incidents_line", "victimes")] == [
        2, 2, 4]


def test_existing_tables_are_not_overwritten(spark, prepared):
    path, read = prepared
    with pytest.raises(Exception, match="(?i)already exists"):
        tables.write_tables({"localites": read["localites"]}, path)


def test_probed_row_counts(spark, prepared):
    _, read = prepared
    assert read["incidents"].count() == 1168
    points = read["incidents_point"]
    assert points.count() == 813
    assert points.filter("nom IS NULL AND longitude IS NULL").count() == 5
    lines = read["incidents_line"].groupBy("position").count().collect()
    assert {r.position: r["count"] for r in lines} == {"départ": 353, "arrivée": 353}
    assert read["incidents_line"].filter(
        "point IS NULL AND adm1_name IS NOT NULL"
    ).count() == 49
    assert read["incidents"].select("annee", "mois").distinct().count() == 79
    assert {r["count"] for r in read["localites"].groupBy("type").count().collect()} == {25}
    assert set(COUNT_COLUMNS) <= set(read["incidents"].columns)
