"""Mixing sources to target weights: budgets through a tree, shortages to siblings first, seeded epochs.

Built-in functions only. The tree of totals is small; what a document needs to know is one row of its leaf:
how often it is taken in full and up to which hash in the epoch that is taken in part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed_row, unpacked, words, written

#: Documents of a leaf that share the leading hex digits of their hash, about.
BUCKET_ROWS = 4096


def path_key(levels: Sequence[str], depth: int) -> Column:
    """The node a document passes at a depth, as text; NULL is a value of its own."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in levels[:depth]]), {"ignoreNullFields": "false"})


def place_in_epoch(seed: int, epoch: Column, text_hash: Column) -> Column:
    """Where a document stands in an epoch: hex digits, in which order is order of text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_hash))


def filled(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``nodes`` plus ``given``: each parent's ``budget`` poured over its children by weight, none above its ``capacity``.

    Children that fill up soonest, by capacity per weight, come first; what they cannot take raises the
    level for their siblings. The level at which a child stops being full follows from sums over the
    children before and behind it, so a whole family is settled in one pass.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), "node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(behind)
    leveled = nodes.withColumn("level", level.cast("double"))
    open_ = F.col("level") * F.col("weight") < F.col("capacity")
    # the first child that is not filled sets the level for itself and all behind it
    first = F.min(F.when(open_, F.struct(F.col("capacity") / F.col("weight"), "node", "level"))).over(Window.partitionBy(*parent))
    water = first["level"]
    given = F.when(water.isNull() | (F.col("capacity") <= water * F.col("weight")), F.col("capacity")).otherwise(
        F.floor(water * F.col("weight"))
    )
    return leveled.withColumn("given", given.cast("long")).drop("level")


def leaf_budgets(
    totals: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], share: float, epochs: int
) -> DataFrame:
    """``leaf, tokens, docs, budget`` from the totals per leaf (``levels``, ``leaf``, ``tokens``, ``docs``)."""
    frame = totals.withColumn("capacity", F.col("tokens") * epochs)
    whole = Window.partitionBy()
    frame = frame.withColumn("budget", F.floor(F.sum("tokens").over(whole) * share).cast("long"))
    for depth, named in enumerate(weights, 1):
        parent = [path_key(levels, depth - 1).alias("parent")] if depth > 1 else [F.lit("[]").alias("parent")]
        keyed = frame.withColumns({"parent": parent[0], "node": path_key(levels, depth)})
        value = F.col(levels[depth - 1]).cast("string")
        weight = F.lit(1)
        for name, w in named.items():
            weight = F.when(value == name, F.lit(w)).otherwise(weight)
        nodes = keyed.groupBy("parent", "node").agg(
            F.sum("capacity").alias("capacity"), F.max("budget").alias("budget"), F.max(weight).alias("weight")
        )
        settled = filled(nodes, ["parent"]).select("node", "given")
        frame = keyed.drop("parent").join(settled, "node").drop("node", "budget").withColumnRenamed("given", "budget")
    return frame.select("leaf", "tokens", "docs", "budget")


def epoch_plan(counted: DataFrame, budgets: DataFrame, seed: int, epochs: int) -> DataFrame:
    """``leaf, full, last, taken``: whole epochs, then documents up to the hash ``last``, of which that one in part.

    Tokens are summed per leading hex digits first; only the one bucket in which a leaf's
    budget ends is put in order.
    """
    full = F.when(F.col("tokens") > 0, F.least(F.lit(epochs), F.expr("budget div tokens"))).otherwise(0).cast("int")
    leaves = written(
        budgets.withColumn("full", full).select(
            "leaf", "full", (F.col("budget") - F.col("full") * F.col("tokens")).alias("rest"),
            F.greatest(F.lit(1), F.ceil(F.log2(F.col("docs") / BUCKET_ROWS) / 4)).cast("int").alias("digits"),
        ), "mix-leaves",
    )
    open_ = leaves.where((F.col("rest") > 0) & (F.col("full") < epochs))
    placed = counted.join(open_, "leaf").withColumn("place", place_in_epoch(seed, F.col("full"), F.col("text_hash")))
    placed = placed.withColumn("bucket", F.expr("substring(place, 1, digits)"))
    sums = placed.groupBy("leaf", "bucket", "rest").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0))).where("before < rest")
    ends = ends.groupBy("leaf").agg(F.max(F.struct("bucket", "before")).alias("end"))
    edge = placed.join(ends.select("leaf", F.col("end.bucket").alias("bucket"), "end.before"), ["leaf", "bucket"])
    inside = Window.partitionBy("leaf", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    last = edge.where("start < rest").groupBy("leaf").agg(
        F.max(F.struct("place", F.least("n_tokens", F.col("rest") - F.col("start")).alias("taken"))).alias("last")
    )
    return written(
        leaves.join(last, "leaf", "left").select("leaf", "full", F.col("last.place").alias("last"), F.col("last.taken").alias("taken")),
        "mix-plan",
    )


def drawn(keyed: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``keyed (.., doc_id, leaf, text_hash, n_tokens)`` once per epoch it is drawn in, with ``epoch`` and ``n_taken``."""
    ready = keyed.join(plan.withColumnRenamed("leaf", "_leaf"), F.col("leaf") == F.col("_leaf")).withColumn(
        "_place", F.when(F.col("last").isNotNull(), place_in_epoch(seed, F.col("full"), F.col("text_hash")))
    )
    times = F.col("full") + F.coalesce((F.col("_place") <= F.col("last")).cast("int"), F.lit(0))
    ready = ready.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    taken = F.when((F.col("epoch") == F.col("full")) & (F.col("_place") == F.col("last")), F.col("taken")).otherwise(F.col("n_tokens"))
    return ready.withColumn("n_taken", taken).drop("_leaf", "full", "last", "taken", "_place")


def with_leaf(documents: DataFrame, levels: Sequence[str]) -> DataFrame:
    """``documents`` plus ``leaf``, ``text_hash`` and ``n_tokens`` (words split at white space)."""
    return documents.withColumns({
        "leaf": path_key(levels, len(levels)),
        "text_hash": F.md5(F.coalesce(F.col("text"), F.lit(""))),
        "n_tokens": F.size(words(F.col("text"))).cast("long"),
    })


def plan_mixture(
    documents: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]],
    share: float = 0.6, epochs: int = 4, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """``(counted, plan)``: the narrow written table of documents with leaf and tokens, and a row per leaf."""
    counted = written(
        with_leaf(documents, levels).select("doc_id", *levels, "leaf", "text_hash", "n_tokens"), "mix-counted"
    )
    totals = counted.groupBy(*levels, "leaf").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    budgets = written(leaf_budgets(totals, levels, weights, share, epochs), "mix-budgets")
    return counted, epoch_plan(counted, budgets, seed, epochs)


def mix_documents(
    documents: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]],
    share: float = 0.6, epochs: int = 4, seed: int = 7,
) -> DataFrame:
    """Draws ``share`` of all tokens with the weights of a tree: ``doc_id, levels, epoch, n_tokens, n_taken``.

    ``levels`` are the columns from the root's children to the leaves; ``weights`` has, per level, whole numbers by
    value (1 where none is given). A node's budget goes to its children by weight; a child can take no more than
    ``epochs`` times the tokens under it, and what it cannot take goes to its siblings. As a
    node's own capacity is all that lies under it, a budget leaves a subtree only when that is exhausted.

    A leaf takes its documents in the order of a hash of seed, epoch, id and text, epoch after epoch, until its
    budget ends; ``n_taken`` is less than ``n_tokens`` for the one document in which it ends. Documents without words
    have no tokens and come with the whole epochs. NULL in a level is a value; rows that repeat id and text
    stand at one place and are drawn together. No text is shuffled; a leaf of any size is summed, not sorted.
    """
    counted, plan = plan_mixture(documents, levels, weights, share, epochs, seed)
    return drawn(counted, plan, seed).select("doc_id", *levels, "epoch", "n_tokens", "n_taken")


def keep_drawn(
    documents: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]],
    share: float = 0.6, seed: int = 7, columns: Sequence[str] | None = None,
) -> DataFrame:
    """The documents that one epoch draws, whole, with their own columns (or ``columns``)."""
    _, plan = plan_mixture(documents, levels, weights, share, 1, seed)
    kept = documents.select(
        packed_row(documents), "doc_id", path_key(levels, len(levels)).alias("leaf"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")
    )
    ready = kept.join(plan, "leaf")
    chosen = ready.where((F.col("full") > 0) | (place_in_epoch(seed, F.col("full"), F.col("text_hash")) <= F.col("last")))
    return unpacked(chosen, documents if columns is None else documents.select(*columns))
