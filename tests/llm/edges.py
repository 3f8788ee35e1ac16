"""Rows that any operator on documents must stand, and how to build them."""

import datetime  # noqa: F401

SCHEMA = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT,"
    " fp STRING, root STRING, key STRING, size STRING, spans STRING, hash STRING, words STRING, items STRING"
)
CLASH = ("x",) * 8
PASSAGE = " ".join(f"passage{i} wörd" for i in range(30))
TEXTS = [
    (1, "One two three four five six seven eight nine ten eleven twelve.", "src1"),
    (1, "One two three four five six seven eight nine ten eleven twelve.", "src1"),
    (2, None, "src1"), (3, "", None), (4, "   \n\t ", "src2"), (5, "word", None),
    (None, "a null key and " + PASSAGE, "src2"), (None, None, None),
    (6, "six " + PASSAGE + " tail", "src3"), (7, "seven " + PASSAGE, "src3"),
    (8, "a" * 1500, "src3"), (9, "ab " * 40_000, "src1"), (10, "Ünï çødé 日本語 テキスト " * 20, "src4"),
    (11, "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE.", "src4"),
    (1, "same key, other text", "src1"),
]


def documents(spark, texts=TEXTS):
    rows = [(key, text, None, source, None if text is None else len(text), *CLASH) for key, text, source in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def given_rows(sf_dir, table, *columns):
    import pyarrow.parquet as pq

    found = pq.read_table(f"{sf_dir}/{table}.parquet", columns=list(columns)).to_pydict()
    return list(zip(*(found[c] for c in columns)))
