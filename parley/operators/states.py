"""Tables that follow their source: partial aggregates of each arrival, merged instead of recomputed.

A state is what a group's rows come to so far: counts, sums, first and last moments. States of different
arrivals merge by the same sums and extremes, so arrivals may come in any order and split a
conversation anywhere. An arrival is known by its name: stored again it replaces itself, so a repeated delivery
counts once. Only the conversations of an arrival are merged and written to the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.lexicons import TOPICS, Lexicon
from parley.operators.conversations import conversation_states, merged_conversations, summaries_of
from parley.operators.mutations import upsert
from parley.operators.topics import (
    conversation_topics,
    dictionary_of,
    dictionary_states,
    merged_conversation_topics,
    merged_dictionary,
)
from parley.sources.folders import folder_values, remove_folder, table_exists
from parley.sources.sinks import days_of, finish_changes, replace_days, write_by_date

#: The column that names an arrival, and the folder its states lie in.
ARRIVAL = "arrival"
MERGED = "merged-"

LEDGER = T.StructType([T.StructField("into", T.StringType(), False), T.StructField("arrival", T.StringType(), False)])


class StateTable:
    """The states of all arrivals of one kind, a folder for each, and a ledger of which were merged into one.

    ``merge`` takes states of any number of arrivals and gives one state per group, of the same columns.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.merge = spark, path, schema, merge

    def _folder(self, arrival: str) -> str:
        return f"{self.path}/states/{ARRIVAL}={arrival}"

    def _merged(self) -> dict[str, str]:
        """Arrivals that were merged, and the name they now lie under."""
        path = f"{self.path}/ledger"
        if not table_exists(self.spark, path):
            return {}
        return {r["arrival"]: r["into"] for r in self.spark.read.schema(LEDGER).parquet(path).collect()}

    def arrivals(self) -> list[str]:
        """The names whose states count: none that was merged, no merge that was not finished."""
        merged = self._merged()
        there = folder_values(self.spark, f"{self.path}/states", ARRIVAL)
        return sorted(a for a in there if a not in merged and (not a.startswith(MERGED) or a in merged.values()))

    def store(self, states: DataFrame, arrival: str) -> bool:
        """Keep an arrival's states; the same arrival again replaces them. False if they were merged already."""
        if arrival.startswith(MERGED) or not arrival.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not the name of an arrival: {arrival!r}")
        if arrival in self._merged():
            return False
        states.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self._folder(arrival))
        return True

    def read(self, arrivals: Sequence[str] | None = None) -> DataFrame:
        """States of the arrivals named, by default of all that count."""
        chosen = self.arrivals() if arrivals is None else list(arrivals)
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._folder(a) for a in chosen])

    def compact(self) -> None:
        """Merge all states into one folder.

        The merged states count from the moment the ledger names them, which is one append of one file; until then the old ones do. A
        job lost in between leaves folders that nobody reads. A late repeat of an arrival that was merged changes nothing.
        """
        old = self.arrivals()
        if len(old) < 2:
            return
        into = MERGED + uuid.uuid4().hex
        self.merge(self.read(old)).select(*self.schema.fieldNames()).write.parquet(self._folder(into))
        origins = [a for a, name in self._merged().items() if name in old]
        entries = self.spark.createDataFrame([(into, a) for a in [*old, *origins]], LEDGER)
        entries.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        for arrival in old:
            remove_folder(self.spark, self._folder(arrival))


class SummaryFollower:
    """The summary table of all conversations, kept up to date arrival by arrival.

    ``messages`` gives the types of the columns that states are made of.
    """

    def __init__(self, path: str, messages: DataFrame, lexicon: Lexicon = TOPICS):
        spark, none = messages.sparkSession, messages.limit(0)
        self.spark, self.path, self.lexicon = spark, path, lexicon
        self.counts = StateTable(spark, f"{path}/counts", conversation_states(none).schema, merged_conversations)
        self.topics = StateTable(spark, f"{path}/topics", conversation_topics(none, lexicon).schema, merged_conversation_topics)
        self.schema = summaries_of(conversation_states(none), conversation_topics(none, lexicon), datetime(2000, 1, 1)).schema

    def _summaries(self, arrivals: Sequence[str], wanted: DataFrame, as_of: datetime) -> DataFrame:
        counts = self.counts.read(arrivals).join(wanted, "conversation_id", "left_semi")
        topics = self.topics.read(self.topics.arrivals()).join(wanted, "conversation_id", "left_semi")
        return summaries_of(counts, topics, as_of)

    def table(self) -> DataFrame:
        path = f"{self.path}/table"
        if not table_exists(self.spark, path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path)

    def arrive(self, messages: DataFrame, arrival: str, as_of: datetime) -> None:
        """Take in the messages of an arrival and rewrite the days of the table that hold its conversations.

        The days follow from the states alone: those the conversations began on before, and those they begin on now.
        """
        self.topics.store(conversation_topics(messages, self.lexicon), arrival)
        self.counts.store(conversation_states(messages), arrival)
        wanted = self.counts.read([a for a in self.counts.arrivals() if a == arrival]).select("conversation_id").distinct()
        if wanted.isEmpty():
            return
        before = [a for a in self.counts.arrivals() if a != arrival]
        fresh = self._summaries(self.counts.arrivals(), wanted, as_of)
        finish_changes(self.spark, f"{self.path}/table", "start_date")
        stored = self.table()
        starts = merged_conversations(self.counts.read(before).join(wanted, "conversation_id", "left_semi"))
        began = starts.groupBy("conversation_id").agg(F.min("_start").alias("start")).select(F.to_date("start").alias("start_date"))
        path = f"{self.path}/table"
        if not table_exists(self.spark, path):
            write_by_date(fresh, path, "start_date")
            return
        days = sorted({*days_of(began, "start_date"), *days_of(fresh, "start_date")})
        some = stored.where(F.col("start_date").isin(days))
        created = some.select("conversation_id", F.col("created_at").alias("first_written"))
        dated = fresh.join(created, "conversation_id", "left").withColumn("created_at", F.coalesce("first_written", "created_at"))
        replace_days(path, upsert(some, dated.drop("first_written").select(*some.columns), ["conversation_id"]), days, "start_date")


    def rebuild(self, as_of: datetime) -> None:
        """Write the whole table anew from the states, no message read; for a table that a lost job left behind."""
        write_by_date(summaries_of(self.counts.read(), self.topics.read(), as_of), f"{self.path}/table", "start_date")


class TopicFollower:
    """The topic dictionary, kept up to date arrival by arrival."""

    def __init__(self, path: str, messages: DataFrame, dimensions: int | None = None, lexicon: Lexicon = TOPICS):
        none = messages.limit(0)
        self.dimensions, self.lexicon = dimensions, lexicon
        schema = dictionary_states(none, dimensions, lexicon).schema
        self.states = StateTable(messages.sparkSession, path, schema, lambda states: merged_dictionary(states, dimensions))

    def arrive(self, messages: DataFrame, arrival: str) -> None:
        self.states.store(dictionary_states(messages, self.dimensions, self.lexicon), arrival)

    def table(self, as_of: datetime | None = None) -> DataFrame:
        """The dictionary as of the arrivals so far: a row per topic from a row per topic and arrival."""
        return dictionary_of(self.states.read(), self.dimensions, as_of)
