"""Dropped rows and unreadable cells by reason, counted beside the work or by themselves."""

from pyspark.sql import Observation, functions as F, types as T

from rows import raw_incidents
from vigie.operators import prepare, rejects
from vigie.sources import tables


def counts(df):
    return {r.reason: r.n for r in df.collect()}


def rough(spark):
    return raw_incidents(
        spark,
        {"point": "p", "point_id": "12", "count_morts_1": "3"},
        {"origin": "press", "annee": None}, {"origin": None},
        {"annee": None}, {"mois": None, "jour": 40.0}, {"jour": None},
        {"mois": 2.0, "jour": 30.0}, {"mois": 2.5}, {"mois": 13.0, "point": "p", "point_id": "ND"},
        {"point": "p", "point_id": "ND", "count_morts_1": "plusieurs", "count_blesses_2": "?"},
        {"point_id": "ND"}, {"depart": "d", "arrivee_id": "x"}, {"depart": "d", "arrivee_id": "4"},
        counts_as=T.StringType(),
    )


WANTED = {
    "corrupt row": 0, "other origin": 2, "date part missing": 3, "no such date": 3, "unreadable point_id": 1,
    "unreadable arrivee_id": 1, "unreadable count": 1,
}


def test_reasons(spark):
    raw = rough(spark)
    found = counts(rejects.rejected_rows(raw))
    assert found == WANTED
    dropped = sum(found[name] for name in ("corrupt row", "other origin", "date part missing", "no such date"))
    assert raw.count() - dropped == prepare.clean_incidents(raw).count()
    assert counts(rejects.rejected_rows(raw.limit(0))) == dict.fromkeys(WANTED, 0)
    assert counts(rejects.rejected_rows(raw, origin="press"))["other origin"] == 12


def test_counted_beside_the_work(spark, tmp_path):
    """Writing the clean rows fills the observation: no second pass."""
    observation = Observation("raw")
    raw = rough(spark)
    prepare.clean_incidents(rejects.observe_rejects(raw, observation)).write.parquet(str(tmp_path / "clean"))
    assert observation.get == {"rows": raw.count(), **WANTED}


def test_lines_of_a_wrong_width(spark, tmp_path):
    raw = rough(spark)
    path = str(tmp_path / "lines")
    line = F.to_csv(F.struct(*raw.columns))
    odd = F.when(F.col("no_liste") == 1, F.concat(line, F.lit(",more"))).when(F.col("no_liste") == 2, F.lit("2,2015.0"))
    raw.select(odd.otherwise(line)).write.text(path)
    read = tables.read_incidents_raw(spark, path, "csv", raw.columns, rejects.CORRUPT)
    found = counts(rejects.rejected_rows(read))
    assert found == WANTED | {"corrupt row": 2, "other origin": 1}
    # Whatever columns are asked for, a line's width is judged by all its cells.
    few = read.select("origin", F.col(rejects.CORRUPT).isNotNull().alias("odd")).collect()
    assert sum(r.odd for r in few) == 2 and sum(r.origin is None for r in few) == 2
    kept = read.filter(F.col(rejects.CORRUPT).isNull()).drop(rejects.CORRUPT)
    assert prepare.clean_incidents(kept).count() == 4


def test_corrupt_lines_with_a_header(spark, tmp_path):
    raw = rough(spark).limit(3)
    path = tmp_path / "list.csv"
    lines = [r[0] for r in raw.select(F.to_csv(F.struct(*raw.columns))).collect()]
    path.write_text("\n".join([",".join(raw.columns), lines[0], lines[1] + ",x", lines[2]]) + "\n", encoding="utf-8")
    read = tables.read_incidents_raw(spark, str(path), "csv", corrupt=rejects.CORRUPT)
    assert counts(rejects.rejected_rows(read))["corrupt row"] == 1
    plain = tables.read_incidents_raw(spark, str(path), "csv")
    assert rejects.CORRUPT not in plain.columns and plain.count() == 3
