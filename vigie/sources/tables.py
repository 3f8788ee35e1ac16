"""Raw inputs, prepared tables and the label dictionary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vigie import rules
from vigie.schemas import (
    BOUNDARIES,
    DICTIONARY,
    INCIDENTS_RAW,
    INCIDENTS_RAW_UNTYPED,
    LOCALITES_RAW,
    PARTITIONED_BY,
    PREPARED,
    conform,
)


def _scan(
    spark: SparkSession, path: str, format: str, columns: Sequence[str] | None = None, corrupt: str | None = None
) -> DataFrame:
    """CSV columns are read as text and typed by name; nothing is inferred from values.

    As in a workbook, blanks around a cell do not count and an empty cell is missing. Without
    ``columns`` the first line of each file names them. ``corrupt`` names a column that holds the
    whole line where it has too few or too many cells.
    """
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.options(
            header=columns is None, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
        )
        if columns is not None or corrupt is not None:
            names = list(columns) if columns is not None else reader.load(path).columns
            fields = [T.StructField(name, T.StringType()) for name in names]
            if corrupt is not None:
                fields.append(T.StructField(corrupt, T.StringType()))
                # The width of a line is only seen when all its cells are read.
                reader = reader.options(
                    mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt, columnPruning=False)
            reader = reader.schema(T.StructType(fields))
    return reader.load(path)


def read_incidents_raw(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    columns: Sequence[str] | None = None,
    corrupt: str | None = None,
) -> DataFrame:
    """The raw incident list; further columns are kept.

    For CSV files without a first line of names ``columns`` gives them, and ``corrupt`` a column for
    lines of a wrong width (``rejects.CORRUPT``).
    """
    return conform(
        _scan(spark, path, format, columns, corrupt),
        INCIDENTS_RAW,
        untyped=INCIDENTS_RAW_UNTYPED,
        keep_extra=True,
    )


def read_localites_raw(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """The raw place list, cut to the columns in use."""
    return conform(_scan(spark, path, format), LOCALITES_RAW)


def read_boundaries(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Boundaries of all three levels; outlines are passed through as WKT text."""
    return conform(_scan(spark, path, format), BOUNDARIES, keep_extra=True)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Label pairs from a JSON dictionary, one row each."""
    return (
        spark.read.schema(DICTIONARY)
        .option("multiLine", True)
        .json(path)
        .select(F.inline("translation"))
    )


def built_in_dictionary(spark: SparkSession, source: str | None = None) -> DataFrame:
    """The label pairs of the library, one row each."""
    pairs = [
        F.struct(F.lit(english).alias("en"), F.lit(french).alias("fr"))
        for english, french in rules.label_pairs(source)
    ]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def write_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write each table as parquet to its own folder; an existing one is an error.

    Fact tables are laid out by year. Rows are rebalanced by year first: adaptive
    execution splits a large year over many tasks and files, and merges small ones.
    """
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        by = PARTITIONED_BY.get(name)
        if by is None:
            df.write.mode("errorifexists").parquet(target)
        else:
            rows = df.hint("rebalance", by)
            rows.write.mode("errorifexists").partitionBy(by).parquet(target)


def read_tables(
    spark: SparkSession, path: str, names: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Prepared tables by name, checked against their declared columns."""
    names = list(PREPARED) if names is None else names
    return {
        name: conform(_table(spark, f"{path.rstrip('/')}/{name}", name), PREPARED[name], keep_extra=True)
        for name in names
    }


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table; one laid out by year that has no rows has no files, only its declared columns."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.read.schema(PREPARED[name]).parquet(path)
