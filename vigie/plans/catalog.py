"""The named queries: each takes a session and a folder of given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigie import rules
from vigie.operators import (
    classify, contours, density, geometry, labels, places, prepare, rejects, trends, victims,
)
from vigie.plans import inputs
from vigie.plans.batch import publish_folder
from vigie.session import fresh_folder, stored
from vigie.sources import layout, tables

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the dashboard queries.
YEAR = 2016
SEVERITY = "Dead, Injured"
REGION = "Gao"
SOURCE = "https://example.org/incidents"


def _needs_casualties(measure: str) -> bool:
    return measure != "incidents"


# --- preparation -------------------------------------------------------------
def _stored_localites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places as a stored table, whose true size tells Spark whether to broadcast them."""
    return stored(inputs.localites(spark, sf_dir), "localites")


def localities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.localites(spark, sf_dir)


def clean_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.incidents(spark, sf_dir)


def place_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of line incidents, first with the coordinates of their place ids."""
    rows = inputs.incidents(spark, sf_dir, casualties=False)
    ends = prepare.locate_lines(rows, _stored_localites(spark, sf_dir), overrides=())
    return prepare.apply_place_overrides(
        ends.select("no_liste", "position", "point", "longitude", "latitude", "nom")
    )


def point_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.locate_points(
        inputs.incidents(spark, sf_dir), _stored_localites(spark, sf_dir)
    )


def line_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.locate_lines(inputs.incidents(spark, sf_dir), _stored_localites(spark, sf_dir))


def _bucketed(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Located through tables that are laid out by place."""
    path = fresh_folder(spark, "by_place")
    name = path.rpartition("/")[2].replace("-", "_")
    layout.store_by_place(rows, inputs.localites(spark, sf_dir), name, path, bucket_rows=50_000)
    return layout.locate_stored(spark, name)


def point_incidents_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(spark, sf_dir, prepare.point_rows(inputs.incidents(spark, sf_dir)))


def line_incidents_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(spark, sf_dir, prepare.line_rows(inputs.incidents(spark, sf_dir)))


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From lines of text, some of them too wide."""
    lines, names = inputs.incident_lines(spark, sf_dir)
    path = fresh_folder(spark, "lines")
    lines.write.text(path)
    return rejects.rejected_rows(tables.read_incidents_raw(spark, path, "csv", names, rejects.CORRUPT))


# --- victims -----------------------------------------------------------------
def victims_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return victims.unpivot_victims(inputs.incidents(spark, sf_dir))


def _unique(spark: SparkSession, sf_dir: str) -> bool | None:
    """True if a look at the numbers says that one pass is enough; else the general form is to look itself."""
    return victims.unique_numbers(inputs.incidents(spark, sf_dir, casualties=False)) or None


def victims_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return victims.paired_victims(inputs.incidents(spark, sf_dir), _unique(spark, sf_dir))


def victims_paired_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the two unpivoted tables."""
    rows = inputs.incidents(spark, sf_dir)
    return victims.pair_victims(
        victims.unpivot_victims(rows, "Statut"), victims.unpivot_victims(rows, "Nombre")
    )


def all_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return victims.victims(inputs.incidents(spark, sf_dir), _unique(spark, sf_dir))


def victims_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a look for repeated numbers first."""
    return victims.victims(inputs.incidents(spark, sf_dir))


def victims_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general form, which does not rely on unique keys."""
    return victims.victims(inputs.incidents(spark, sf_dir), unique_ids=False)


def victims_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.victim_category(all_victims(spark, sf_dir))


def rough_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and missing numbers, one of them hot, and counts that cannot be read."""
    return victims.victims(inputs.incidents(spark, sf_dir, rough=True))


def rough_victims_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return victims.paired_victims(inputs.incidents(spark, sf_dir, rough=True))


def rough_victims_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return victims.paired_victims(inputs.incidents(spark, sf_dir, rough=True), unique_ids=False)


def rough_victims_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.incidents(spark, sf_dir, rough=True)
    return victims.pair_victims(
        victims.unpivot_victims(rows, "Statut"), victims.unpivot_victims(rows, "Nombre")
    )


def rough_severity_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative deaths give no severity."""
    rows = classify.classify_severity(inputs.incidents(spark, sf_dir, rough=True))
    return rows.select("no_liste", "nbr_morts", "nbr_blesses", "severity", "severity_order")


def rough_line_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals without a name among the places, and sums with negative numbers."""
    ends = prepare.locate_lines(inputs.incidents(spark, sf_dir, rough=True), _stored_localites(spark, sf_dir))
    return places.counts_by_place(ends, "dead")


def keyword_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = victims.unpivot_victims(inputs.incidents(spark, sf_dir), "Statut")
    return classify.classify_by_keywords(status, "statut")


# --- classes -----------------------------------------------------------------
def location_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.incidents(spark, sf_dir, casualties=False)
    return classify.classify_location(rows).select("no_liste", "location")


def type_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.incidents(spark, sf_dir, casualties=False)
    return classify.classify_type(rows).select("no_liste", "type")


def deadly_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.classify_deadly(inputs.incidents(spark, sf_dir))
    return rows.select("no_liste", "nbr_morts", "deadly", "deadly_order")


def severity_class(spark: SparkSession, sf_dir: str, lang: str = "en") -> DataFrame:
    rows = classify.classify_severity(inputs.incidents(spark, sf_dir), lang)
    return rows.select("no_liste", "nbr_morts", "nbr_blesses", "severity", "severity_order")


def ordered_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw incident types as display categories; other types fall outside the domain."""
    rows = inputs.incidents(spark, sf_dir, casualties=False)
    return classify.display_category(
        rows.select("no_liste", F.col("type_incident").alias("category"))
    )


# --- trends ------------------------------------------------------------------
def monthly(spark: SparkSession, sf_dir: str, variable: str, rollup: bool = False) -> DataFrame:
    casualties = variable == "deadly" or not rollup
    return trends.monthly_by_dimension(
        inputs.incidents(spark, sf_dir, casualties), variable, rollup
    )


def running(spark: SparkSession, sf_dir: str, criterion: str, statistic: str) -> DataFrame:
    rows = inputs.incidents(spark, sf_dir, casualties=False)
    return trends.running_counts(rows, criterion, statistic)


def monthly_all(spark: SparkSession, sf_dir: str, rollup: bool = False) -> DataFrame:
    return trends.monthly_all_dimensions(inputs.incidents(spark, sf_dir), rollup)


def running_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.running_all(inputs.incidents(spark, sf_dir, casualties=False))


def cumulative_month(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    rows = inputs.incidents(spark, sf_dir, _needs_casualties(measure))
    return trends.cumulative_by_month(rows, measure)


def cumulative_week(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    rows = inputs.incidents(spark, sf_dir, _needs_casualties(measure))
    return trends.cumulative_by_week(rows, measure)


# --- places ------------------------------------------------------------------
def _condensed_points(
    spark: SparkSession, sf_dir: str, by_severity: bool = False, casualties: bool = True
) -> DataFrame:
    """Located points, summed up before the join with the places."""
    rows = inputs.incidents(spark, sf_dir, casualties)
    return prepare.locate_points(
        prepare.condense_points(rows, by_severity), inputs.localites(spark, sf_dir)
    )


def by_place(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    points = _condensed_points(spark, sf_dir, casualties=_needs_casualties(measure))
    return places.counts_by_place(points, measure)


def severity_by_place(
    spark: SparkSession,
    sf_dir: str,
    year: float | None = YEAR,
    severity: str | None = SEVERITY,
    lang: str = "en",
) -> DataFrame:
    points = _condensed_points(spark, sf_dir, by_severity=True)
    return places.severity_by_place(points, year, severity, lang)


def severity_by_region(
    spark: SparkSession,
    sf_dir: str,
    year: float | None = YEAR,
    region: str | None = REGION,
    lang: str = "en",
) -> DataFrame:
    points = _condensed_points(spark, sf_dir, by_severity=True)
    return places.severity_by_region(points, year, region, lang)


def highlight_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.highlight_region(inputs.boundaries(spark, sf_dir), REGION)


def boundary_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.boundaries(spark, sf_dir)


def hotspot_density(
    spark: SparkSession,
    sf_dir: str,
    grid: int = 100,
    year: float | None = YEAR,
    severity: str | None = SEVERITY,
) -> DataFrame:
    raster = density.hotspot_density(severity_by_place(spark, sf_dir, year, severity), grid)
    return raster.withColumns({
        name: F.round(name, 9) for name in ("longitude", "latitude", "density")
    })


def _stored_raster(spark: SparkSession, sf_dir: str, grid: int) -> DataFrame:
    """The density, computed once: its range gives the levels, its cells the lines."""
    return stored(density.hotspot_density(severity_by_place(spark, sf_dir), grid), "raster")


def hotspot_segments(spark: SparkSession, sf_dir: str, grid: int = 100) -> DataFrame:
    """Where the level lines of the density cut the cells of the grid."""
    raster = _stored_raster(spark, sf_dir, grid)
    found = contours.contour_segments(raster).drop("edge_a", "edge_b")
    return found.select("level_no", *[F.round(name, 9).alias(name) for name in found.columns[1:]])


def hotspot_contours(spark: SparkSession, sf_dir: str, grid: int = 100) -> DataFrame:
    """The level lines of the density as ordered rings."""
    found = contours.hotspot_contours(_stored_raster(spark, sf_dir, grid))
    return found.withColumns({name: F.round(name, 9) for name in ("level", "longitude", "latitude")})


def boundary_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From outline texts with holes and several parts."""
    return geometry.boundary_vertices(inputs.outline_texts(spark, sf_dir))


def polygon_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.polygon_vertices(*inputs.outlines(spark, sf_dir))


# --- labels and tables -------------------------------------------------------
def _json_dictionary(spark: SparkSession) -> DataFrame:
    """The label pairs, read from the JSON form dictionaries are kept in."""
    path = fresh_folder(spark, "labels")
    pairs = F.collect_list(F.struct("en", "fr")).alias("translation")
    languages = F.array(*map(F.lit, rules.LANGUAGES)).alias("languages")
    tables.built_in_dictionary(spark, SOURCE).agg(pairs).select(languages, "translation").write.json(path)
    return tables.read_dictionary(spark, path)


def localized_labels(
    spark: SparkSession, sf_dir: str, lang: str, from_json: bool = False
) -> DataFrame:
    """Incidents per severity, and per incident type, which the dictionary lacks."""
    rows = inputs.incidents(spark, sf_dir)
    counted = (
        classify.classify_type(classify.classify_severity(rows))
        .groupBy("severity", "type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    both = counted.select(F.inline(F.array(
        F.struct(F.col("severity").alias("label"), F.col("n")),
        F.struct(F.col("type").alias("label"), F.col("n")),
    ))).groupBy("label").agg(F.sum("n").alias("n"))
    return labels.localize_labels(
        both,
        "label",
        _json_dictionary(spark) if from_json else tables.built_in_dictionary(spark, SOURCE),
        lang,
        output="text",
    )


def _as_csv(df: DataFrame, name: str) -> str:
    path = fresh_folder(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


def localities_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _as_csv(inputs.localites_raw(spark, sf_dir), "localites-csv")
    return prepare.prepare_localities(tables.read_localites_raw(spark, path, "csv"))


def boundaries_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_boundaries(spark, _as_csv(inputs.boundaries(spark, sf_dir), "boundaries-csv"), "csv")


def victims_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw incidents in text cells: even the counts are text."""
    path = _as_csv(inputs.incidents_raw(spark, sf_dir), "incidents-csv")
    rows = prepare.clean_incidents(tables.read_incidents_raw(spark, path, "csv"))
    return victims.victims(rows, _unique(spark, sf_dir))


def tables_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish all prepared tables as a set, read them back, and sum up what was read."""
    read = publish_folder(
        inputs.incidents_raw(spark, sf_dir),
        inputs.localites_raw(spark, sf_dir),
        inputs.boundaries(spark, sf_dir),
        fresh_folder(spark, "tables"),
    )
    total = {
        "localites": F.sum("id"),
        "incidents": F.sum("annee"),
        "incidents_point": F.sum("longitude"),
        "incidents_line": F.sum("latitude"),
        "victimes": F.sum("nombre"),
        "boundaries": F.sum(F.col("level").cast("double")),
    }
    summaries = [
        read[name].agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.round(total[name], 3).alias("total"),
        )
        for name in total
    ]
    return reduce(DataFrame.unionByName, summaries)


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {
        "localities": localities,
        "clean_incidents": clean_incidents,
        "place_overrides": place_overrides,
        "point_incidents": point_incidents,
        "line_incidents": line_incidents,
        "victims_unpivot": victims_unpivot,
        "victims_paired": victims_paired,
        "victims_paired_long": victims_paired_long,
        "victims": all_victims,
        "victims_checked": victims_checked,
        "victims_joined": victims_joined,
        "victims_ordered": victims_ordered,
        "rough_victims": rough_victims,
        "rough_victims_paired": rough_victims_paired,
        "rough_victims_joined": rough_victims_joined,
        "rough_victims_long": rough_victims_long,
        "rough_severity_class": rough_severity_class,
        "rough_line_places": rough_line_places,
        "keyword_class": keyword_class,
        "location_class": location_class,
        "type_class": type_class,
        "deadly_class": deadly_class,
        "ordered_category": ordered_category,
        "severity_by_place": severity_by_place,
        "severity_by_place_all": partial(severity_by_place, year=None, severity=None),
        "severity_by_region": severity_by_region,
        "severity_by_region_all": partial(severity_by_region, year=None, region=None),
        "highlight_region": highlight_region,
        "boundary_levels": boundary_levels,
        "severity_by_place_fr": partial(
            severity_by_place, severity=rules.translate(SEVERITY, "fr"), lang="fr"
        ),
        "severity_by_region_fr": partial(severity_by_region, lang="fr"),
        "hotspot_density": hotspot_density,
        "hotspot_density_all": partial(hotspot_density, year=None, severity=None),
        "hotspot_segments": hotspot_segments,
        "hotspot_contours": hotspot_contours,
        "polygon_vertices": polygon_vertices,
        "boundary_vertices": boundary_vertices,
        "point_incidents_bucketed": point_incidents_bucketed,
        "line_incidents_bucketed": line_incidents_bucketed,
        "rejected_rows": rejected_rows,
        "monthly_all_dimensions": monthly_all,
        "monthly_all_dimensions_rollup": partial(monthly_all, rollup=True),
        "running_all_splits": running_all,
        "tables_roundtrip": tables_roundtrip,
        "localities_from_csv": localities_from_csv,
        "boundaries_from_csv": boundaries_from_csv,
        "victims_from_csv": victims_from_csv,
        "localized_labels_json": partial(localized_labels, lang="fr", from_json=True),
    }
    for variable in trends.VARIABLES:
        named[f"monthly_{variable}"] = partial(monthly, variable=variable)
        named[f"monthly_{variable}_rollup"] = partial(monthly, variable=variable, rollup=True)
    for criterion in trends.CRITERIA:
        for statistic in trends.STATISTICS:
            named[f"running_{criterion}_{statistic}"] = partial(
                running, criterion=criterion, statistic=statistic
            )
    for measure in trends.MEASURES:
        named[f"cumulative_month_{measure}"] = partial(cumulative_month, measure=measure)
        named[f"cumulative_week_{measure}"] = partial(cumulative_week, measure=measure)
        named[f"by_place_{measure}"] = partial(by_place, measure=measure)
    for lang in rules.LANGUAGES:
        named[f"severity_class_{lang}"] = partial(severity_class, lang=lang)
        named[f"localized_labels_{lang}"] = partial(localized_labels, lang=lang)
    named["severity_class"] = named.pop("severity_class_en")
    return named
