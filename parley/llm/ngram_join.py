"""N-gram Jaccard join: MinHash banding, shuffles on band hashes, verification on full n-gram sets.

Equal texts are one node. Nodes that share a band form a bucket; a bucket is cut into blocks and every
pair of its blocks is a tile, so that a hot bucket becomes many tasks of bounded size. A pair of nodes
that meets in several bands belongs to the first of them. Tiles count verified links and
return a row per member, never a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, likely_in, packed_row, unpacked, written

#: Members of a block; a tile compares at most twice as many.
BLOCK = 256

NODE = ["n1", "n2"]
TILE = ["place", "band", "low", "high"]


def band_plan(threshold: float, recall: float, hashes: int = 128) -> tuple[int, int]:
    """``(bands, rows)``: as many rows as ``hashes`` allow with ``recall`` for pairs right at the threshold."""
    best = None
    for rows in range(1, hashes + 1):
        chance = threshold**rows
        if chance * hashes < 1e-6:
            break
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{hashes} hashes cannot reach recall {recall}")
    return best


class _WordHashes(dict):
    """Hash of each word; starts afresh when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """64-bit hashes of a text's word n-grams: lower case, words split at ASCII white space."""

    def __init__(self, n: int):
        self.n = n
        self.word = _WordHashes()
        self.factors = [np.uint64(xxhash.xxh64_intdigest(f"place {i}") | 1) for i in range(n)]

    def __call__(self, text: str | None) -> np.ndarray:
        """Every n-gram in order; a shorter text is one n-gram of all its words, one without words has none."""
        parts = (text or "").lower().encode("utf-8", "surrogatepass").split()
        if not parts:
            return np.empty(0, dtype=np.uint64)
        hashes = np.fromiter(map(self.word.__getitem__, parts), dtype=np.uint64, count=len(parts))
        width = min(self.n, len(parts))
        total = np.full(len(parts) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            total += hashes[i: len(parts) - width + 1 + i] * self.factors[i]
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(29)
        return total


class Signer:
    """Band hashes of an n-gram set."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        draw = np.random.default_rng(20)
        self.factor = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = draw.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max)
        for at in range(0, len(grams), 2048):
            least = np.minimum(least, (grams[at: at + 2048, None] * self.factor).min(axis=0))
        least ^= least >> np.uint64(31)
        bands = (least.reshape(self.bands, self.rows) * self.mix).sum(axis=1, dtype=np.uint64) + self.salt
        bands ^= bands >> np.uint64(30)
        return (bands * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def sign_batches(n: int, bands: int, rows: int):
    """A ``mapInArrow`` function: ``n1, n2, doc_id, text`` -> the first three and ``bands`` (NULL: no words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, signer = Shingler(n), Signer(bands, rows)
        for batch in batches:
            found = []
            for text in batch.column(3):
                grams = shingle(text.as_py())
                found.append(signer(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["n1", "n2", "doc_id", "bands"]
            )

    return sign


def _owned(bands: np.ndarray, block: np.ndarray, place: int, low: int, high: int) -> np.ndarray:
    """Which pairs of a tile's members are compared here: their first common band is the tile's."""
    mine = np.ones((len(bands), len(bands)), dtype=bool)
    for at in range(place):
        mine &= bands[:, None, at] != bands[None, :, at]
    if low == high:
        return np.triu(mine, 1)
    return mine & ((block[:, None] == low) & (block[None, :] == high))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal tile columns, across batches; the rows come sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = np.column_stack([table.column(c).to_numpy() for c in TILE])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for begin, end in zip(cuts, cuts[1:]):
            key = tuple(keys[begin])
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(begin, end - begin))
            last = key
    if held:
        yield pa.concat_tables(held)


def _unique(tile: pa.Table) -> pa.Table:
    """One row per node, should a node have come twice."""
    nodes = np.column_stack([tile.column(c).to_numpy() for c in NODE])
    _, first = np.unique(nodes, axis=0, return_index=True)
    return tile if len(first) == len(nodes) else tile.take(pa.array(np.sort(first)))


def _key(tile: pa.Table) -> tuple[int, int, int]:
    return tuple(tile.column(c)[0].as_py() for c in ("place", "low", "high"))


def _matrix(tile: pa.Table) -> np.ndarray:
    return np.stack([np.array(b, dtype=np.int64) for b in tile.column("bands").to_pylist()])


def own_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of tiles -> those with a pair to compare there."""
    names = [*TILE, *NODE, "block"]
    for tile in _tiles(batches):
        if tile.num_rows < 2:
            continue
        mine = _owned(_matrix(tile), tile.column("block").to_numpy(), *_key(tile))
        rows = np.flatnonzero(mine.any(axis=0) | mine.any(axis=1))
        if len(rows):
            yield from tile.select(names).take(pa.array(rows)).combine_chunks().to_batches()


def common_counts(sets: list[np.ndarray], wide: int = 8192) -> np.ndarray:
    """How many n-grams every two sets share: products of 0/1 matrices over the n-grams that occur twice."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams = np.concatenate(sets)
    values, index, count = np.unique(grams, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[index] > 1
    owner, column = owner[keep], number[index[keep]]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for begin in range(0, int(number[-1]) + 1 if len(number) else 0, wide):
        a, b = np.searchsorted(column, [begin, begin + wide])
        held = np.zeros((len(sets), min(wide, int(number[-1]) + 1 - begin)), dtype=np.float32)
        held[owner[a:b], column[a:b] - begin] = 1
        common += held @ held.T
    return common


def verify_batches(n: int, threshold: float):
    """A ``mapInArrow`` function: tiles with texts -> per member its verified links and the tile's root it hangs on."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for tile in _tiles(batches):
            tile = _unique(tile)
            if tile.num_rows < 2:
                continue
            mine = _owned(_matrix(tile), tile.column("block").to_numpy(), *_key(tile))
            sets = [np.unique(shingle(t.as_py())) for t in tile.column("text")]
            size = np.array([len(s) for s in sets], dtype=np.float64)
            common = common_counts(sets)
            union = size[:, None] + size[None, :] - common
            linked = mine & (common >= threshold * union - 1e-9)
            linked |= linked.T
            rows = np.flatnonzero(linked.any(axis=1))
            if not len(rows):
                continue
            links = linked @ tile.column("copies").to_numpy()
            root = np.arange(len(sets))
            while True:  # least index among a member's neighbours, until all of a component agree
                least = np.minimum(root, np.where(linked, root[None, :], len(sets)).min(axis=1))
                if (least == root).all():
                    break
                root = least
            n1, n2 = (tile.column(c).to_numpy() for c in NODE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (n1[rows], n2[rows], n1[root[rows]], n2[root[rows]], links[rows])],
                names=["n1", "n2", "r1", "r2", "links"],
            )

    return verify


def text_node(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("n1"), F.xxhash64(F.lit(42), text).alias("n2")]


def similar_classes(
    documents: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999999, hashes: int = 128
) -> DataFrame:
    """One row per document: ``doc_id, n1, n2, copies, root, has_ngrams, class_id, n_links``.

    ``n_links`` is the number of other documents whose n-gram sets have a Jaccard similarity of
    ``threshold`` or more with its own, equal texts included; ``class_id`` is the least doc_id that
    links lead to (``root``: the least text). ``n1, n2`` stand for the text, ``copies`` documents have it.

    Words are compared in lower case. A text of fewer than ``n`` words is one n-gram; NULL texts and
    texts without words have no n-grams and no links (their ``class_id`` is their own id). Rows that
    repeat id and text are documents of their own. NULL ids count as documents; a class has a NULL ``class_id`` only
    if all its ids are. Extra columns are not read.
    """
    bands, rows = band_plan(threshold, recall, hashes)
    text = F.coalesce(F.col("text"), F.lit(""))
    source = documents.select(*text_node(text), F.col("doc_id").cast("long"), text.alias("text"))
    signed = written(
        source.mapInArrow(sign_batches(n, bands, rows), "n1 long, n2 long, doc_id long, bands array<long>"), "join-signed"
    )
    nodes = written(
        signed.groupBy(*NODE).agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.any_value("bands").alias("bands")
        ), "join-nodes",
    )
    # nodes that share a band with another node; the two ends of a bucket tell whether it has two
    banded = nodes.select(*NODE, F.posexplode("bands").alias("place", "band"))
    ends = banded.groupBy("place", "band").agg(
        *[f(c).alias(f"{f.__name__}_{c}") for c in NODE for f in (F.min, F.max)], F.count("*").alias("members")
    ).where("min_n1 <> max_n1 or min_n2 <> max_n2")
    members = banded.join(ends.select("place", "band", "members"), ["place", "band"])
    blocks = members.withColumn("blocks", F.expr(f"cast((members + {BLOCK} - 1) div {BLOCK} as int)")).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(7), *NODE), "blocks").cast("int")
    )
    tiles = written(
        blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            *NODE, "place", "band", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
        ), "join-tiles",
    )

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.repartition(*TILE).sortWithinPartitions(*TILE)

    owned = written(
        dealt(tiles.join(nodes.select(*NODE, "bands"), NODE)).mapInArrow(
            own_batches, "place int, band long, low int, high int, n1 long, n2 long, block int"
        ), "join-owned",
    )
    wanted = owned.select(*NODE).distinct()
    near = likely_in(source, [F.col(c) for c in NODE], wanted, [F.col(c) for c in NODE]).where("_likely")
    texts = near.drop("_likely").join(wanted, NODE, "left_semi").groupBy(*NODE).agg(F.any_value("text").alias("text"))
    compared = owned.join(texts, NODE).join(nodes.select(*NODE, "copies", "bands"), NODE)
    found = written(
        dealt(compared).mapInArrow(verify_batches(n, threshold), "n1 long, n2 long, r1 long, r2 long, links long"),
        "join-links",
    )
    roots = components(
        found.select(F.struct(*NODE).alias("a"), F.struct(F.col("r1").alias("n1"), F.col("r2").alias("n2")).alias("b")),
        "join-components",
    )
    links = found.groupBy(*NODE).agg(F.sum("links").alias("links"))
    placed = (
        nodes.drop("bands").join(roots.select("node.n1", "node.n2", "root"), NODE, "left")
        .join(links, NODE, "left").withColumn("root", F.coalesce("root", F.struct(*NODE)))
    )
    least = placed.groupBy("root").agg(F.min("least_id").alias("class_id"))
    of_node = written(
        placed.join(least, "root").select(*NODE, "copies", "root", "class_id", F.coalesce("links", F.lit(0)).alias("links")),
        "join-classes",
    )
    some = F.col("bands").isNotNull()
    return signed.join(of_node, NODE).select(
        "doc_id", *NODE, "copies", "root", some.alias("has_ngrams"),
        F.when(some, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(some, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(documents: DataFrame, **settings) -> DataFrame:
    """The documents, with one of each class of similar ones: that of the least id, with its own columns.

    Documents without words belong to no class and stay. Of rows that repeat id and text one stays.
    """
    classes = written(similar_classes(documents, **settings), "join-kept")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *NODE)).alias("first")
    chosen = classes.where("has_ngrams").groupBy("root").agg(first).select("first.doc_id", "first.n1", "first.n2")
    stay = written(
        chosen.union(classes.where("not has_ngrams").select("doc_id", *NODE).distinct()), "join-stay"
    )
    keyed = documents.select(
        packed_row(documents), *text_node(F.coalesce(F.col("text"), F.lit(""))), F.col("doc_id").cast("long").alias("id")
    )
    same = keyed["id"].eqNullSafe(stay["doc_id"]) & (keyed["n1"] == stay["n1"]) & (keyed["n2"] == stay["n2"])
    kept = keyed.join(stay, same, "left_semi")
    repeated = classes.groupBy("doc_id", *NODE).agg(F.count("*").alias("rows")).where("rows > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["id", *NODE])
    return unpacked(kept, documents)
