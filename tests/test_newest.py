"""Newest rows of a stored table: only the days needed are opened, and the rows are those of the whole table."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parley.operators import filters, newest
from parley.schema import MESSAGES
from parley.sources.readers import stored_form
from parley.sources.sinks import read_days, table_days, write_by_date

DAYS = 12


@pytest.fixture
def table(spark, tmp_path):
    rows = []
    for d in range(DAYS):
        for i in range(5):
            at = datetime(2024, 3, 1) + timedelta(days=d, hours=i // 2)  # ties within a day
            kind = "customer" if i % 2 else "admin"
            rows.append((d * 10 + i, f"c{d}", "u", f"text {d} {i}", kind, at, at if d > 3 else None))
    rows.append((999, "c", "u", "no time", "customer", None, None))
    frame = spark.createDataFrame(rows, "id long, conversation_id string, user_id string, message string, sender_type string, timestamp timestamp, processed_at timestamp")
    path = str(tmp_path / "messages")
    write_by_date(stored_form(frame), path, "day")
    return path


def spoil(path, before):
    """Files of the days before ``before`` can no longer be read."""
    count = 0
    for file in Path(path).glob("day=*/*.parquet"):
        day = file.parent.name.removeprefix("day=")
        if day.startswith("__") or day < before:
            file.write_bytes(b"not a parquet file")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            count += 1
    assert count


def ids(frame):
    return [r.id for r in frame.select("id").collect()]


def test_days_are_known_from_folder_names(spark, table):
    days = table_days(spark, table)
    assert len(days) == DAYS + 1 and None in days
    spoil(table, "2025")
    assert table_days(spark, table) == days


def test_only_the_days_needed_are_opened(spark, table):
    whole = read_days(spark, table, MESSAGES)
    want = ids(filters.newest(whole, 8))
    few = ids(filters.latest_customer_messages(whole, 3))
    spoil(table, "2024-03-09")  # 8 rows lie in 2 days; 1 + 2 days and one more are read
    assert ids(newest.newest_stored(spark, table, MESSAGES, 8)) == want
    assert ids(newest.latest_customer_messages(spark, table, MESSAGES, 3)) == few
    assert newest.recent_messages(spark, table, MESSAGES, 10).count() == 10
    with pytest.raises(Exception):
        ids(newest.newest_stored(spark, table, MESSAGES, 40))


def test_the_filter_decides_how_far_back(spark, table):
    whole = read_days(spark, table, MESSAGES)
    for limit in (1, 4, 7, 100):
        want = ids(filters.unprocessed_messages(whole, limit))
        assert ids(newest.unprocessed_messages(spark, table, MESSAGES, limit)) == want


def test_fewer_rows_than_asked_for(spark, table):
    found = newest.newest_stored(spark, table, MESSAGES, 1000)
    assert ids(found) == ids(filters.newest(read_days(spark, table, MESSAGES), 1000)) and found.count() == DAYS * 5 + 1
    assert ids(found)[-1] == 999  # without a time: last


def test_no_days_and_no_rows(spark, table, tmp_path):
    empty = str(tmp_path / "empty")
    read_days(spark, table, MESSAGES).limit(0).write.partitionBy("day").parquet(empty)
    assert newest.newest_stored(spark, empty, MESSAGES, 5).count() == 0
    assert newest.newest_stored(spark, table, MESSAGES, 0).count() == 0


def test_a_day_off_by_the_zone_is_read_too(spark, table):
    """A row that another session zone put into the day before is still among the newest."""
    late = read_days(spark, table, MESSAGES).where("id = 114").withColumns({"id": F.lit(5000).cast("long"), "day": F.lit("2024-03-11").cast("date")})
    late.write.mode("append").partitionBy("day").parquet(table)
    assert ids(newest.newest_stored(spark, table, MESSAGES, 3))[0] == 5000
