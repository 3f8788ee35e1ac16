"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of given tables, BENCH_CPUS the number of cores. Every
query is built, planned and run to its last row; the best of three passes counts.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from vigie.plans.catalog import queries
from vigie.session import build_session

HEADLINE = (
    "localities",
    "clean_incidents",
    "point_incidents",
    "line_incidents",
    "victims_unpivot",
    "victims_paired",
    "victims",
    "victims_checked",
    "victims_joined",
    "keyword_class",
    "severity_class",
    "monthly_type",
    "monthly_type_rollup",
    "monthly_deadly_rollup",
    "running_location_cumsum_year",
    "running_type_cumsum_all",
    "cumulative_month_dead",
    "cumulative_week_injured",
    "by_place_incidents",
    "by_place_dead",
    "severity_by_place",
    "severity_by_place_all",
    "severity_by_region",
    "highlight_region",
    "hotspot_density",
    "hotspot_segments",
    "hotspot_contours",
    "monthly_all_dimensions",
    "running_all_splits",
    "rough_victims",
    "boundary_vertices",
    "point_incidents_bucketed",
    "rejected_rows",
    "localized_labels_fr",
    "polygon_vertices",
    "tables_roundtrip",
)


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    named = queries()
    passes = [{name: run(named[name], spark, sf_dir) for name in HEADLINE} for _ in range(3)]
    seconds = {name: round(min(times[name] for times in passes), 3) for name in HEADLINE}
    spark.stop()
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(Path(sf_dir).name.removeprefix("sf")),
    }))


if __name__ == "__main__":
    main()
