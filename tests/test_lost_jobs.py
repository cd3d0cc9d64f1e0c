"""Writes and queues that a lost job leaves half done are finished by the next call."""

from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parley.sources import sinks
from parley.sources.folders import folder_values
from parley.streaming import sinks as queues

SCHEMA = "id long, text string, processed_at timestamp, day date"


def table(spark, path):
    return spark.read.schema(SCHEMA).parquet(path)


def rows(frame):
    return sorted((r.id, r.text, str(r.day)) for r in frame.collect())


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "t")
    made = [(i, f"t{i}", None, date(2024, 1, 1 + i // 3)) for i in range(12)]
    sinks.write_by_date(spark.createDataFrame(made, SCHEMA), path, "day")
    return path


MOVED = [(0, "new", None, date(2024, 1, 4)), (1, "new", None, date(2024, 1, 9)), (2, "new", None, date(2024, 1, 9))]
WANT = sorted([(0, "new", "2024-01-04"), (1, "new", "2024-01-09"), (2, "new", "2024-01-09")] + [(i, f"t{i}", f"2024-01-0{1 + i // 3}") for i in range(3, 12)])


class Lost(Exception):
    pass


def lose(*_):
    raise Lost


@pytest.mark.parametrize("step", ["remove_folder", "move_folder", "_apply_change"])
@pytest.mark.parametrize("calls", [0, 1])
def test_a_declared_change_is_finished(spark, stored, monkeypatch, step, calls):
    """Rows change their day and a day is left empty; the job is lost at the first or second use of a step."""
    kept, used = getattr(sinks, step), []

    def lost(*arguments):
        used.append(arguments)
        return lose() if len(used) > calls else kept(*arguments)

    with monkeypatch.context() as patch:
        patch.setattr(sinks, step, lost)
        if step == "_apply_change" and calls:
            sinks.upsert_days(stored, table(spark, stored), spark.createDataFrame(MOVED, SCHEMA), ["id"])
        else:
            with pytest.raises(Lost):
                sinks.upsert_days(stored, table(spark, stored), spark.createDataFrame(MOVED, SCHEMA), ["id"])
    none = spark.createDataFrame([], SCHEMA)
    sinks.upsert_days(stored, table(spark, stored), none, ["id"])
    assert rows(table(spark, stored)) == WANT
    assert sorted(folder_values(spark, stored, "day")) == ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-09"]
    assert not list(Path(stored).glob("_change-*"))


def test_a_change_that_was_not_declared_is_dropped(spark, stored, monkeypatch):
    before = rows(table(spark, stored))
    with monkeypatch.context() as patch:
        patch.setattr(spark, "createDataFrame", lose)
        with pytest.raises(Lost):
            sinks.replace_days(stored, table(spark, stored).where("id > 3"), [date(2024, 1, 1), date(2024, 1, 2)])
    assert rows(table(spark, stored)) == before and list(Path(stored).glob("_change-*"))
    assert sinks.finish_changes(spark, stored) == 0
    assert rows(table(spark, stored)) == before and not list(Path(stored).glob("_change-*"))


def test_patching_and_expiring_finish_what_was_lost(spark, stored, monkeypatch):
    for number, call in enumerate((
        lambda: sinks.patch_days(stored, table(spark, stored), spark.createDataFrame([(5, f"p{number}")], "id long, text string"), ["text"], F.lit(datetime(2024, 2, 1))),
        lambda: sinks.expire_days(stored, table(spark, stored).withColumn("expires_at", F.lit(datetime(2030, 1, 1))), datetime(2024, 2, 1)),
    )):
        change = spark.createDataFrame([(7, f"lost{number}", None, date(2024, 1, 3))], SCHEMA)
        with monkeypatch.context() as patch:
            patch.setattr(sinks, "_apply_change", lose)
            with pytest.raises(Lost):
                sinks.upsert_days(stored, table(spark, stored), change, ["id"])
        call()
        assert (7, f"lost{number}", "2024-01-03") in rows(table(spark, stored))
    assert (5, "p0", "2024-01-02") in rows(table(spark, stored))


@pytest.fixture
def arriving(spark, tmp_path):
    source = tmp_path / "source"

    def add(name, ids):
        spark.createDataFrame([(i, f"m{i}") for i in ids], "id long, text string").coalesce(1).write.parquet(str(source / name))

    def stream():
        return spark.readStream.schema("id long, text string").option("recursiveFileLookup", True).parquet(str(source))

    return add, stream


def keys(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_a_message_that_stays_open_costs_its_row_alone(spark, tmp_path, arriving):
    add, stream = arriving
    folder = str(tmp_path / "queue")
    add("a", range(100))
    assert queues.drain_open(stream(), folder, keys(spark, [])).count() == 100
    for turn in range(3):
        add(f"b{turn}", [1000 + turn])
        found = queues.drain_open(stream(), folder, keys(spark, [i for i in range(100) if i != 7] + [1000 + t for t in range(turn)]))
        assert sorted(r.id for r in found.collect()) == [7, 1000 + turn]
        assert folder_values(spark, f"{folder}/rows", "batch") == [] and len(folder_values(spark, f"{folder}/open", "upto")) == 1
        kept = folder_values(spark, f"{folder}/open", "upto")[0]
        assert spark.read.parquet(f"{folder}/open/upto={kept}").count() == 2
    assert queues.drain_open(stream(), folder, keys(spark, range(2000))).count() == 0  # nothing new: filtered as it is read
    assert queues.drain_open(stream(), folder, keys(spark, [7])).count() == 1


def test_a_queue_that_was_lost_loses_and_repeats_nothing(spark, tmp_path, arriving, monkeypatch):
    add, stream = arriving
    folder = str(tmp_path / "queue")
    add("a", [1, 2, 3])
    with monkeypatch.context() as patch:  # batches written, the table of open rows not
        patch.setattr(queues, "folder_values", lose)
        with pytest.raises(Lost):
            queues.drain_open(stream(), folder, keys(spark, []))
    add("b", [4, 5])
    with monkeypatch.context() as patch:  # the table written, the batches not dropped
        patch.setattr(queues, "remove_folder", lose)
        with pytest.raises(Lost):
            queues.drain_open(stream(), folder, keys(spark, [2]))
    assert sorted(r.id for r in queues.drain_open(stream(), folder, keys(spark, [2])).collect()) == [1, 3, 4, 5]
    add("c", [6])
    with monkeypatch.context() as patch:  # a table of open rows half written
        patch.setattr(queues, "written_whole", lambda spark, path: not path.endswith("=2") and Path(path, "_SUCCESS").exists())
        patch.setattr(queues, "remove_folder", lambda *a: None)
        queues.drain_open(stream(), folder, keys(spark, [2]))
        assert sorted(r.id for r in queues.drain_open(stream(), folder, keys(spark, [2, 4])).collect()) == [1, 3, 5, 6]
    assert sorted(r.id for r in queues.drain_open(stream(), folder, keys(spark, [2, 4, 6])).collect()) == [1, 3, 5]
