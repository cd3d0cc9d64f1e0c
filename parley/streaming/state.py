"""The state store that keyed state with timers needs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The RocksDB store for streams that start within; the session's choice comes back after."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def needs_state_store(spark: SparkSession) -> None:
    """An error before anything runs, should the caller not have chosen it."""
    if spark.conf.get(STATE_STORE, None) != ROCKS:
        raise ValueError(f"set {STATE_STORE} to {ROCKS} before this stream is built and started")
