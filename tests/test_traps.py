"""Hand-made rows for the semantics that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from rows import raw_incidents, raw_localites
from vigie import rules
from vigie.functions import scalars
from vigie.operators import classify, geometry, labels, places, prepare, trends, victims
from vigie.sources import tables

PLACE = {"id": "7", "longitude": 1.0, "latitude": 12.0, "featureNam": "Gao ville",
         "admin1Name": "Gao", "admin1Pcod": "ML07"}


def incidents(spark, *rows, **kwargs):
    return prepare.clean_incidents(raw_incidents(spark, *rows, **kwargs))


def localites(spark, *rows):
    return prepare.prepare_localities(raw_localites(spark, *rows))


def test_date_needs_three_valid_parts(spark):
    parts = [(2015, 2, 31), (2015, None, 3), (2016, 2, 29), (2015, 3.5, 1), (2015, 3, 1.5),
             (2015, 13, 1), (2015, 4, 0), (2015, 4, 31), (2015, 12, 31), (1900, 2, 29),
             (2015.5, 1, 1), (2015, 3, float("nan")), (float("nan"), 3, 1), (2015, 3, 1e30)]
    rows = [dict(zip(("annee", "mois", "jour"),
                     (None if p is None else float(p) for p in part))) for part in parts]
    found = {r.no_liste: r.date for r in incidents(spark, *rows).collect()}
    assert found == {
        3: dt.date(2016, 2, 29), 5: dt.date(2015, 3, 1), 9: dt.date(2015, 12, 31)
    }


def test_only_the_kept_origin_stays(spark):
    df = incidents(spark, {"origin": "press"}, {"origin": None}, {})
    assert [r.no_liste for r in df.collect()] == [3]


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("12",), (" 12.5 ",), ("ND",), ("1d",), ("2F",), ("",), (None,)],
                               "t STRING")
    found = [r[0] for r in df.select(scalars.to_number(F.col("t"))).collect()]
    assert found == [12.0, 12.5, None, None, None, None, None]


def test_infinite_and_hexadecimal_text(spark):
    df = spark.createDataFrame([("Inf",), (" -inf",), ("0x1F",), ("-0xa",), ("0x",), ("1f",), ("x1F",)],
                               "t STRING")
    found = [r[0] for r in df.select(scalars.to_number(F.col("t"))).collect()]
    assert found == [float("inf"), float("-inf"), 31.0, -10.0, None, None, None]


def test_unreadable_id_keeps_the_row_and_meets_a_place_without_id(spark):
    points = prepare.locate_points(
        incidents(spark, {"point_id": "ND", "point": "x"}, {"point_id": "7", "point": "y"},
                  {"point_id": "8", "point": "z"}),
        localites(spark, PLACE, {"id": None, "longitude": 2.0, "featureNam": "nowhere"}),
    )
    found = {r.point: (r.id, r.longitude, r.nom) for r in points.collect()}
    assert found == {"x": (None, 2.0, "nowhere"), "y": (7.0, 1.0, "Gao ville"),
                     "z": (8.0, None, None)}
    assert not set(prepare.LINE_COLUMNS) & set(points.columns)


def test_arrival_without_a_name_loses_its_coordinates(spark):
    lines = prepare.locate_lines(
        incidents(spark, {"depart_id": 7.0, "depart": "a", "arrivee_id": "7", "arrivee": None}),
        localites(spark, PLACE),
    )
    found = {r.position: (r.point, r.longitude, r.latitude, r.nom, r.adm1_name)
             for r in lines.collect()}
    assert found == {"départ": ("a", 1.0, 12.0, "Gao ville", "Gao"),
                     "arrivée": (None, None, None, None, "Gao")}


def test_forced_places(spark):
    points = prepare.locate_points(
        incidents(spark, {"point_id": "7", "point": "Almoustarat"},
                  {"point_id": "99", "point": "Frontière Boulkessi"}),
        localites(spark, PLACE),
    )
    found = {r.point: (r.longitude, r.latitude, r.nom) for r in points.collect()}
    assert found == {"Almoustarat": (0.087, 17.367, "Frontière Boulkessi"),
                     "Frontière Boulkessi": (-1.0622, 15.1364, "Frontière Boulkessi")}


def test_other_overrides_and_none(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, "n"), (None, 1.0, 2.0, "n")],
                               "point STRING, longitude DOUBLE, latitude DOUBLE, nom STRING")
    later = [rules.PlaceOverride("a", 5.0, 6.0, "x"), rules.PlaceOverride("a", 7.0, 8.0, "y")]
    found = {tuple(r) for r in prepare.apply_place_overrides(df, later).collect()}
    assert found == {("a", 7.0, 8.0, "y"), (None, None, None, None)}
    assert prepare.apply_place_overrides(df, ()).collect() == df.collect()


def test_sum_of_nothing_is_zero(spark):
    df = incidents(spark, {"nbr_morts": None}, {"mois": 4.0, "nbr_morts": 2.0})
    found = {r.date.month: (r.value, r["cumsum"])
             for r in trends.cumulative_by_month(df, "dead").collect()}
    assert found == {3: (0.0, 0.0), 4: (2.0, 2.0)}


def test_week_counts_from_new_year(spark):
    days = [dt.date(2016, 1, 1), dt.date(2015, 1, 7), dt.date(2015, 1, 8), dt.date(2016, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d DATE")
    weeks = [r[0] for r in df.select(scalars.week_of_year(F.col("d"))).collect()]
    assert weeks == [1, 1, 2, 53]


def _mixed_months(spark):
    point = {"point": "p", "jour": 1.0}
    january = [{**point, "mois": 1.0, "type_incident": "Attaque"}] * 2
    other = [{**point, "mois": 1.0}]
    february = [{**point, "mois": 2.0, "type_incident": "Attaque"}] * 4
    return incidents(spark, *january, *other, *february)


def test_running_sum_passes_through_every_row(spark):
    df = trends.running_counts(_mixed_months(spark), "location", "cumsum_all")
    assert sorted(r.nombre for r in df.collect()) == [2, 3, 7]
    df = trends.running_counts(_mixed_months(spark), "type", "cumsum_year")
    assert sorted((r.category, r.month, r.nombre) for r in df.collect()) == [
        ("Attack", 1.0, 2), ("Attack", 2.0, 6), ("Other", 1.0, 1)]


def test_months_are_summed_only_on_request(spark):
    df = trends.monthly_by_dimension(_mixed_months(spark), "total")
    assert sorted((r.date.month, r.incidents) for r in df.collect()) == [(1, 1), (1, 2), (2, 4)]
    df = trends.monthly_by_dimension(_mixed_months(spark), "total", rollup=True)
    assert sorted((r.date.month, r.incidents) for r in df.collect()) == [(1, 3), (2, 4)]


def test_location_class(spark):
    df = classify.classify_location(incidents(
        spark,
        {"point": "p", "depart": "d", "arrivee": "a"},
        {"depart": "d"},
        {},
        {"depart": "d", "arrivee": "a"},
    ))
    found = {r.no_liste: r.location for r in df.collect()}
    assert found == {1: "Point", 2: "ND", 3: "ND", 4: "Ligne"}


def test_type_and_deadly_class(spark):
    df = classify.classify_deadly(classify.classify_type(incidents(
        spark,
        {"type_incident": "Attaque", "nbr_morts": 1.0},
        {"type_incident": "Enlèvement", "nbr_morts": 0.0},
        {"type_incident": None},
    )))
    found = {r.no_liste: (r.type, r.deadly, r.deadly_order) for r in df.collect()}
    assert found == {1: ("Attaque", "Deadly", 2), 2: ("Autre", "Not deadly", 1),
                     3: ("Autre", "Not deadly", 1)}


def test_last_keyword_wins(spark):
    texts = ["casque bleu", "casques bleus", "soldats de la MINUSMA", "ex-CMA et civil", "Soldat",
             None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    found = [r.corps for r in classify.classify_by_keywords(df, "t").collect()]
    assert found == ["MINUSMA", "ND", "FAMA", "Civils", "ND", "ND"]
    found = classify.classify_by_keywords(df, "t", (("bleu", "B"),), "?", "out").collect()
    assert [r.out for r in found] == ["B", "B", "?", "?", "?", "?"]


def test_missing_counts_go_and_unreadable_ones_stay(spark):
    df = incidents(
        spark,
        {"stat_morts_1": "a", "count_morts_1": "3", "stat_morts_2": "b", "count_morts_2": "0",
         "stat_morts_3": "c", "count_morts_3": "plusieurs", "stat_blesses_1": "d"},
        counts_as=T.StringType(),
    )
    wanted = {("a", 3.0), ("b", 0.0), ("c", None)}
    paired = victims.pair_victims(victims.unpivot_victims(df, "Statut"),
                                  victims.unpivot_victims(df, "Nombre"))
    assert {(r.statut, r.nombre) for r in paired.collect()} == wanted
    for unique in (True, False, None):
        found = victims.victims(df, unique)
        assert found.columns == ["no_liste", "date", "categorie", "statut", "corps", "nombre"]
        assert {(r.statut, r.nombre) for r in found.collect()} == wanted


@pytest.mark.parametrize("unique", [False, None])
def test_repeated_incident_numbers_multiply(spark, unique):
    rows = [
        {"no_liste": 1, "jour": 1.0, "stat_morts_1": "a", "count_morts_1": 3.0},
        {"no_liste": 1, "jour": 2.0, "stat_morts_1": "b", "count_morts_1": 4.0},
        {"no_liste": None, "stat_morts_1": "c", "count_morts_1": 5.0},
        {"no_liste": 2, "stat_morts_1": "d", "count_morts_1": 6.0},
        {"no_liste": 3, "stat_morts_1": "e"},
        {"no_liste": 3, "jour": 6.0, "count_morts_1": 7.0},
    ]
    df = incidents(spark, *rows)
    found = sorted((r.statut or "", r.nombre, r.date.day)
                   for r in victims.victims(df, unique).collect())
    twice = [(s, n, d) for s in "ab" for n in (3.0, 4.0) for d in (1, 2)]
    mixed = [(s, 7.0, d) for s in ("", "e") for d in (5, 6)]
    assert found == sorted(twice + mixed + [("c", 5.0, 5), ("d", 6.0, 5)])


def test_place_types(spark):
    found = {r.id: (r.type, r.type_fr) for r in localites(
        spark, {"id": "1", "popPlace_1": "Village"}, {"id": "2"},
        {"id": "3", "popPlace_1": "Admin1 Capital"}, {"id": "4", "popPlace_1": "Other"},
    ).collect()}
    assert found == {1.0: ("Village", None), 2.0: ("Other", "Autre"),
                     3.0: ("Admin1 Capital", "Chef-lieu de région"), 4.0: ("Other", None)}


def test_severity(spark):
    numbers = [(1, 2), (1, None), (0, 3), (None, 0), (-1, 0), (None, None), (2, -1)]
    df = incidents(spark, *[
        {name: None if n is None else float(n) for name, n in zip(("nbr_morts", "nbr_blesses"), pair)}
        for pair in numbers
    ])
    found = {r.no_liste: r.severity_order for r in classify.classify_severity(df).collect()}
    assert [found[n] for n in range(1, 8)] == [1, 2, 3, 4, None, 4, None]
    french = {r.severity_order: r.severity for r in classify.classify_severity(df, "fr").collect()}
    assert french[1] == "Morts, Bléssés" and french[None] is None


def test_place_label(spark):
    schema = "annee DOUBLE, longitude DOUBLE, latitude DOUBLE, point STRING"
    df = spark.createDataFrame([(2015.0, 1.0, 2.0, p) for p in ("Gao", None) for _ in range(3)],
                               schema)
    found = {r.label for r in places.counts_by_place(df, "incidents").collect()}
    assert found == {"Gao - 2015 : 3 incidents", "NA - 2015 : 3 incidents"}


@pytest.mark.parametrize("number, text", [
    (3.0, "3"), (0.0, "0"), (99999.0, "99999"), (100000.0, "1e+05"), (120000.0, "120000"),
    (1200000.0, "1200000"), (12000000.0, "1.2e+07"), (-300000.0, "-3e+05"), (2.5, "2.5"),
    (123456789.0, "123456789"), (1e10, "1e+10"), (None, "NA"),
    (1e15, "1e+15"), (1e-4, "1e-04"), (1 / 3, "0.333333333333333"), (-0.001, "-0.001"),
    (0.1 + 0.2, "0.3"), (1234567.25, "1234567.25"), (1.5e-10, "1.5e-10"), (1e300, "1e+300"),
    (1234567890123456.0, "1234567890123456"), (float("inf"), "Inf"), (float("nan"), "NaN"),
])
def test_number_text(spark, number, text):
    df = spark.createDataFrame([(number,)], "n DOUBLE")
    assert df.select(scalars.number_text("n")).first()[0] == text


def test_an_incident_may_have_a_point_and_a_line_or_neither(spark):
    df = incidents(spark, {"point": "p", "depart": "d"}, {})
    assert prepare.locate_points(df, localites(spark, PLACE)).count() == 1
    assert prepare.locate_lines(df, localites(spark, PLACE)).count() == 2


def test_two_places_with_one_id_double_the_incident(spark):
    df = incidents(spark, {"point": "p", "point_id": "7"})
    two = localites(spark, PLACE, {**PLACE, "longitude": 3.0})
    assert prepare.locate_points(df, two).count() == 2
    condensed = prepare.locate_points(prepare.condense_points(df), two)
    counted = places.counts_by_place(condensed, "incidents").collect()
    assert sorted((r.longitude, r.value) for r in counted) == [(1.0, 1.0), (3.0, 1.0)]


def test_missing_months_are_not_filled(spark):
    df = incidents(spark, {"mois": 1.0}, {"mois": 3.0})
    assert trends.cumulative_by_month(df, "incidents").count() == 2


def test_slots_from_column_names(spark):
    df = incidents(spark, {"stat_morts_1": "a", "count_blesses_2": 4.0, "stat_blesses_3": "b"})
    status = {(r.statut, r.categorie, r.groupe)
              for r in victims.unpivot_victims(df, "Statut").collect() if r.statut}
    counts = {(r.nombre, r.categorie, r.groupe)
              for r in victims.unpivot_victims(df, "Nombre").collect() if r.nombre}
    assert status == {("a", "Morts", 1), ("b", "Blessés", 3)}
    assert counts == {(4.0, "Blessés", 2)}
    both = {(r.type, r.value) for r in victims.unpivot_victims(df).collect() if r.value}
    assert both == {("Statut", "a"), ("Statut", "b"), ("Nombre", "4")}
    assert victims.unpivot_victims(df, "Nombre").count() == 6


def test_display_category(spark):
    df = spark.createDataFrame([("Ligne",), ("xyz",), (None,)], "category STRING")
    found = [tuple(r) for r in classify.display_category(df).collect()]
    assert found == [("Line", 3), (None, None), (None, None)]


def test_labels(spark):
    df = spark.createDataFrame([("Region",), ("no such text",), (None,)], "label STRING")
    dictionary = tables.built_in_dictionary(spark)
    found = {r.label for r in labels.localize_labels(df, "label", dictionary, "fr").collect()}
    assert found == {"Région", "no such text", None}
    twice = dictionary.union(dictionary)
    assert labels.localize_labels(df, "label", twice, "fr").count() == 3
    assert labels.localize_labels(df, "label", dictionary, "en").collect() == df.collect()
    with pytest.raises(ValueError):
        labels.localize_labels(df, "label", dictionary, "de")


def test_credit_line(spark):
    pairs = {r.en: r.fr for r in tables.built_in_dictionary(spark, "http://x.org/").collect()}
    assert len(pairs) == 15
    french = "A partir de données tirées de http://x.org/"
    assert pairs["Based on data from http://x.org/"] == french


def test_severity_filters_take_text_and_translated_labels(spark):
    df = incidents(spark, {"point": "p", "point_id": "7", "nbr_morts": 1.0, "nbr_blesses": 1.0},
                   {"point": "p", "point_id": "7"}, {"annee": 2016.0, "point": "p"})
    points = prepare.locate_points(df, localites(spark, PLACE))
    for year, label, lang in ((2015, "Dead, Injured", "en"), ("2015", "Morts, Bléssés", "fr")):
        rows = places.severity_by_place(points, year, label, lang).collect()
        assert [(r.severity, r.n) for r in rows] == [(label, 1)]
    assert places.severity_by_place(points, 2015, "no such label").count() == 0
    rows = places.severity_by_region(points, "2015", "Gao").collect()
    assert sorted((r.severity_order, r.n) for r in rows) == [(1, 1), (4, 1)]


def test_highlight_keeps_unknown_names_unknown(spark):
    df = spark.createDataFrame([(1, "Gao"), (1, "Kayes"), (1, None), (2, "Gao")],
                               "level INT, Admin1_Nam STRING")
    found = [tuple(r)[1:] for r in places.highlight_region(df, "Gao").collect()]
    assert found == [("Gao", True), ("Kayes", False), (None, None)]


def test_polygon_vertices(spark):
    shapes = spark.createDataFrame(
        [("0", [[(0.0, 0.0), (1.0, 0.0)], [(5.0, 5.0)]]), ("9", [[(2.0, 2.0)]])],
        "region STRING, rings ARRAY<ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>>")
    attributes = spark.createDataFrame([(1, "first")], "OBJECTID INT, name STRING")
    found = [tuple(r) for r in geometry.polygon_vertices(shapes, attributes)
             .orderBy("region", "ring", "position").collect()]
    assert found == [(0.0, 1, 1, 0.0, 0.0, "first"), (0.0, 1, 2, 1.0, 0.0, "first"),
                     (0.0, 2, 1, 5.0, 5.0, "first"), (9.0, 1, 1, 2.0, 2.0, None)]


def test_unknown_parameters_are_errors(spark):
    df = incidents(spark, {})
    for call in (
        lambda: trends.monthly_by_dimension(df, "colour"),
        lambda: trends.running_counts(df, "deadly", "incidents"),
        lambda: trends.running_counts(df, "total", "mean"),
        lambda: trends.cumulative_by_month(df, "missing"),
        lambda: victims.unpivot_victims(df, "x"),
        lambda: rules.translate("Map", "de"),
        lambda: classify.ordered_category(df, "point", ("a", "b"), ("c",)),
    ):
        with pytest.raises(ValueError):
            call()


def test_severity_counts_dated_incidents_only(spark):
    df = raw_incidents(spark, {"point": "p"}, {"point": "p"}).withColumn(
        "date", F.when(F.col("no_liste") == 1, F.lit("2015-03-05").cast("date")))
    places_table = localites(spark, PLACE)
    row_level = prepare.locate_points(df, places_table)
    condensed = prepare.locate_points(prepare.condense_points(df, True), places_table)
    for points in (row_level, condensed):
        assert [r.n for r in places.severity_by_place(points).collect()] == [1]
    assert [r.value for r in places.counts_by_place(row_level, "incidents").collect()] == [2.0]
