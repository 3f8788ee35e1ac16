"""The batch preparation: raw incidents and places to a folder of prepared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vigie.operators import prepare, victims
from vigie.schemas import PREPARED
from vigie.sources.sets import publish, read_set
from vigie.sources.tables import read_tables, write_tables


def prepare_folder(
    raw_incidents: DataFrame,
    raw_localites: DataFrame,
    boundaries: DataFrame,
    path: str,
    unique_ids: bool | None = None,
) -> dict[str, DataFrame]:
    """Write all prepared tables to ``path`` and return them as read back.

    Incidents and places are stored first; the located incidents and the victims are
    then derived from the stored tables, so the raw data is cleaned once. Located rows are
    rebalanced by year again, so the number of files does not hang on how the places were joined.
    """
    spark = raw_incidents.sparkSession
    write_tables(
        {
            "localites": prepare.prepare_localities(raw_localites),
            "incidents": prepare.clean_incidents(raw_incidents),
            "boundaries": boundaries,
        },
        path,
    )
    stored = read_tables(spark, path, ["localites", "incidents"])
    incidents, localites = stored["incidents"], stored["localites"]
    write_tables(
        {
            "incidents_point": prepare.locate_points(incidents, localites),
            "incidents_line": prepare.locate_lines(incidents, localites),
            "victimes": victims.victims(incidents, unique_ids),
        },
        path,
    )
    return read_tables(spark, path)


def publish_folder(
    raw_incidents: DataFrame,
    raw_localites: DataFrame,
    boundaries: DataFrame,
    root: str,
    unique_ids: bool | None = None,
) -> dict[str, DataFrame]:
    """As ``prepare_folder``, as the next committed set of ``root``: readers see all tables or none.

    Dashboards that read the set before keep their tables; ``sets.read_set`` gives the new ones.
    """
    spark = raw_incidents.sparkSession

    def write(path: str) -> list[str]:
        prepare_folder(raw_incidents, raw_localites, boundaries, path, unique_ids)
        return list(PREPARED)

    manifest = publish(spark, root, write)
    return read_set(spark, root, number=manifest["number"])
