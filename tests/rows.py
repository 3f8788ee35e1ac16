"""Small hand-made input tables."""

from pyspark.sql import types as T

from vigie.schemas import COUNT_COLUMNS, INCIDENTS_RAW, LOCALITES_RAW


def _table(spark, schema, rows):
    names = schema.fieldNames()
    unknown = {name for row in rows for name in row} - set(names)
    assert not unknown, unknown
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def raw_incidents(spark, *rows, counts_as=T.DoubleType()):
    """Rows default to 5 March 2015 from the kept origin."""
    schema = T.StructType(
        INCIDENTS_RAW.fields + [T.StructField(name, counts_as) for name in COUNT_COLUMNS]
    )
    base = {"annee": 2015.0, "mois": 3.0, "jour": 5.0, "origin": "webpage"}
    return _table(
        spark, schema, [{"no_liste": i, **base, **row} for i, row in enumerate(rows, start=1)]
    )


def raw_localites(spark, *rows):
    return _table(spark, LOCALITES_RAW, list(rows))
