"""Published sets: whole or not at all, whoever reads or fails meanwhile."""

import pytest

from rows import raw_incidents, raw_localites
from vigie.plans import inputs
from vigie.plans.batch import prepare_folder, publish_folder
from vigie.schemas import PREPARED
from vigie.sources import sets, tables

SF_DIR = "/root/testdata/sf0.001"


def places(spark, *ids):
    return prepare(spark, raw_localites(spark, *[{"id": str(i)} for i in ids]))


def prepare(spark, raw):
    from vigie.operators.prepare import prepare_localities

    return prepare_localities(raw)


def write_places(spark, *ids):
    def write(path):
        tables.write_tables({"localites": places(spark, *ids)}, path)
        return ["localites"]

    return write


def ids(read):
    return sorted(row.id for row in read["localites"].collect())


def test_readers_follow_the_last_manifest(spark, tmp_path):
    root = str(tmp_path / "root")
    with pytest.raises(sets.NoSet):
        sets.read_set(spark, root)
    assert sets.publish(spark, root, write_places(spark, 1))["number"] == 1
    before = sets.read_set(spark, root)
    assert sets.publish(spark, root + "/", write_places(spark, 2, 3))["number"] == 2
    assert ids(before) == [1.0] and ids(sets.read_set(spark, root)) == [2.0, 3.0]
    assert ids(sets.read_set(spark, root, number=1)) == [1.0]
    with pytest.raises(sets.NoSet):
        sets.committed(spark, root, 7)
    with pytest.raises(ValueError, match="victimes"):
        sets.read_set(spark, root, ["victimes"])


def test_a_failure_between_two_tables_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    raw = raw_incidents(spark, {"point": "p", "point_id": "1"})
    given = (raw, raw_localites(spark, {"id": "1"}), inputs.boundaries(spark, SF_DIR))
    first = publish_folder(*given, root)
    assert set(first) == set(PREPARED)

    from vigie.operators import prepare as operators

    def fails(*_):
        raise RuntimeError("a place is on fire")

    monkeypatch.setattr(operators, "locate_lines", fails)
    more = raw_incidents(spark, {"point": "p"}, {"point": "q"})
    with pytest.raises(RuntimeError, match="fire"):
        publish_folder(more, *given[1:], root)
    # Some of its tables are there, and nobody sees them.
    assert len(list((tmp_path / "root" / "sets").iterdir())) == 2
    assert sets.committed(spark, root)["number"] == 1
    read = sets.read_set(spark, root)
    assert {name: df.count() for name, df in read.items()} == {name: df.count() for name, df in first.items()}
    monkeypatch.undo()
    assert publish_folder(more, *given[1:], root)["incidents"].count() == 2
    assert first["incidents"].count() == 1


def test_a_table_that_was_not_written_is_an_error(spark, tmp_path):
    root = str(tmp_path / "root")
    with pytest.raises(ValueError, match="victimes"):
        sets.publish(spark, root, lambda path: [*write_places(spark, 1)(path), "victimes"])
    with pytest.raises(ValueError):
        sets.publish(spark, root, lambda path: [])
    with pytest.raises(sets.NoSet):
        sets.committed(spark, root)


def test_writers_that_finish_together_get_numbers_of_their_own(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    sets.publish(spark, root, write_places(spark, 1))
    look, seen = sets._numbers, []

    def stale(session, path):
        """The first look does not see the other writer's manifest yet."""
        found = look(session, path)
        if not seen:
            seen.append(found)
            sets.publish(spark, root, write_places(spark, 2))
        return found

    monkeypatch.setattr(sets, "_numbers", stale)
    manifest = sets.publish(spark, root, write_places(spark, 3))
    monkeypatch.undo()
    assert manifest["number"] == 3 and ids(sets.read_set(spark, root)) == [3.0]
    assert ids(sets.read_set(spark, root, number=2)) == [2.0]


def test_old_sets_are_removed_on_request(spark, tmp_path):
    root = str(tmp_path / "root")
    for i in range(4):
        sets.publish(spark, root, write_places(spark, i))
    with pytest.raises(ZeroDivisionError):
        sets.publish(spark, root, lambda path: write_places(spark, 9)(path) and 1 / 0)
    assert len(sets.remove_old(spark, root, keep=2)) == 3
    assert ids(sets.read_set(spark, root)) == [3.0] and ids(sets.read_set(spark, root, number=3)) == [2.0]
    with pytest.raises(sets.NoSet):
        sets.committed(spark, root, 1)
    with pytest.raises(ValueError):
        sets.remove_old(spark, root, keep=0)


def test_a_published_set_equals_a_prepared_folder(spark, tmp_path):
    given = (inputs.incidents_raw(spark, SF_DIR), inputs.localites_raw(spark, SF_DIR), inputs.boundaries(spark, SF_DIR))
    one = prepare_folder(*given, str(tmp_path / "plain"))
    other = publish_folder(*given, str(tmp_path / "root"))
    for name in PREPARED:
        assert one[name].exceptAll(other[name]).isEmpty() and one[name].count() == other[name].count()
