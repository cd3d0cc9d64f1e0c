"""Near-duplicates by one-permutation hashing, densified signatures, banded buckets and star-shaped candidates.

One hash per shingle fills all bins of a signature: its high bits choose the bin, the least hash in a bin is the
bin's value. An empty bin takes the value of the first filled one in an order of its own that is the same for every
document (optimal densification). Members of a bucket are held against one of them only, so candidates are at
most one per member and band. What the stars leave open (buckets whose members lie in several components) is
compared in tiles of bounded size, and every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, likely_in, written

#: Members that are held against one head, or two sides of a tile, in one go.
BLOCK = 256
#: Bits of a sketch, which tells pairs apart that cannot be similar.
SKETCH = 1024
NODE = "decimal(38,0)"


def node_of(text: Column) -> Column:
    """124 bits that stand for a text, as one number: minima of it are hash aggregates."""
    half = F.lit(2**62 - 1)
    high, low = (F.xxhash64(F.lit(seed), text).bitwiseAND(half).cast("decimal(19,0)") for seed in (1, 2))
    return (high * F.lit(2**62).cast("decimal(19,0)") + low).cast(NODE)


class Shingles:
    """The sorted distinct hashes of a text's ``n``-word shingles; only A-Z are lower-cased, words end at ASCII white space."""

    def __init__(self, n: int):
        self.n, self.known = n, {}
        self.factors = np.array([xxhash.xxh64_intdigest(f"word {i} of {n}") | 1 for i in range(n)], dtype=np.uint64)

    def _word(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 1 << 19:
                self.known.clear()
            found = self.known[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            return np.empty(0, dtype=np.uint64)
        words = np.fromiter(map(self._word, parts), dtype=np.uint64, count=len(parts))
        width = min(self.n, len(parts))
        mixed = np.full(len(parts) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            mixed += words[i: len(words) - width + 1 + i] * self.factors[i]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed ^= mixed >> np.uint64(shift)
            mixed *= np.uint64(factor)
        return np.unique(mixed ^ (mixed >> np.uint64(31)))


class Signer:
    """Band hashes and the odd sketch of a shingle set."""

    def __init__(self, bins: int, rows: int):
        if bins & (bins - 1) or bins % rows:
            raise ValueError("bins must be a power of two and a multiple of rows")
        self.bins, self.rows = bins, rows
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        draw = np.random.default_rng(11)
        #: The order in which an empty bin asks the others.
        self.orders = np.stack([draw.permutation(bins) for _ in range(bins)])
        self.mix = draw.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = np.arange(bins // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The densified minima per bin of a sorted, non-empty set."""
        bin_of = (shingles >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])
        filled = np.zeros(self.bins, dtype=bool)
        filled[bin_of[first]] = True
        least = np.zeros(self.bins, dtype=np.uint64)
        least[bin_of[first]] = shingles[first]
        empty = np.flatnonzero(~filled)
        if len(empty):
            asked = self.orders[empty]
            least[empty] = least[asked[np.arange(len(empty)), filled[asked].argmax(axis=1)]]
        return least

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        mixed = (self.signature(shingles).reshape(-1, self.rows) * self.mix).sum(axis=1, dtype=np.uint64) + self.salt
        mixed ^= mixed >> np.uint64(30)
        return (mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)

    @staticmethod
    def sketch(shingles: np.ndarray) -> np.ndarray:
        """A bit is set where an odd number of shingles falls, so what two sets share cancels out."""
        odd = np.bincount((shingles & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_recall(similarity: float, bins: int, rows: int) -> float:
    """The chance that two sets of a similarity agree on a whole band."""
    return 1 - (1 - similarity**rows) ** (bins // rows)


def sign_batches(n: int, bins: int, rows: int):
    """A ``mapInArrow`` function: ``doc_id, node, text`` -> ``doc_id, node, n, bands, sketch``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signer = Shingles(n), Signer(bins, rows)
        for batch in batches:
            sizes, bands, sketches = [], [], []
            for text in batch.column(2):
                held = shingles(text.as_py())
                sizes.append(len(held))
                bands.append(signer.bands(held) if len(held) else None)
                sketches.append(signer.sketch(held) if len(held) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(bands, longs), pa.array(sketches, longs)],
                names=["doc_id", "node", "n", "bands", "sketch"],
            )

    return sign


def most_apart(threshold: float) -> float:
    """What share of both sizes may lie in one set only: every sketch bit that differs takes one such shingle."""
    return (1 - threshold) / (1 + threshold)


def compare_batches(n: int, threshold: float):
    """A ``mapInArrow`` function: rows ``head, salt, role, node, text``, sorted, a head's own row first -> links ``a, b``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, key, own = Shingles(n), None, None
        for batch in batches:
            linked = []
            heads, salts, roles = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = batch.column(4)
            for at, head in enumerate(heads.to_pylist()):
                if roles[at] == 0:
                    key, own = (head, salts[at]), shingles(texts[at].as_py())
                    continue
                if key != (head, salts[at]):
                    raise ValueError("a member came without its head")
                other = shingles(texts[at].as_py())
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both >= threshold * (len(own) + len(other) - both) - 1e-9:
                    linked.append(at)
            rows = pa.array(linked, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(rows), heads.take(rows)], names=["a", "b"])

    return compare


def tile_batches(threshold: float):
    """A ``mapInArrow`` function: tiles of open buckets, sorted -> pairs ``a, b`` (a > b) that may be similar.

    Rows: ``band, low, high, minor, node, root, n, sketch``. Minor members meet all of the tile's others that lie in another component.
    """

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows).combine_chunks()
        minor = table.column("minor").to_numpy()
        nodes = table.column("node").to_pylist()
        roots = np.unique(np.array(table.column("root").to_pylist(), dtype=object), return_inverse=True)[1]
        size = table.column("n").to_numpy().astype(np.float64)
        sketch = np.stack(table.column("sketch").to_numpy()).view(np.uint64)  # signed numbers would be counted by their absolute value
        left, right = np.flatnonzero(minor), np.flatnonzero(~minor)
        pairs = set()
        for at in left:
            apart = np.bitwise_count(sketch[right] ^ sketch[at]).sum(axis=1)
            both = size[right] + size[at]
            near = (roots[right] != roots[at]) & (apart <= most_apart(threshold) * both + 1e-9)
            near &= np.minimum(size[right], size[at]) >= threshold * np.maximum(size[right], size[at]) - 1e-9
            pairs.update((max(nodes[at], nodes[i]), min(nodes[at], nodes[i])) for i in right[near])
        if not pairs:
            return None
        a, b = zip(*sorted(pairs))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.decimal128(38, 0)), pa.array(b, pa.decimal128(38, 0))], names=["a", "b"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for begin, end in zip(cuts, cuts[1:]):
                key = tuple(keys[begin])
                if held and key != last:
                    if (found := flush(held)) is not None:
                        yield found
                    held = []
                held.append(batch.slice(begin, end - begin))
                last = key
        if held and (found := flush(held)) is not None:
            yield found

    return tiles


class _Links:
    """Confirms candidate pairs of nodes on the full shingle sets of their texts."""

    def __init__(self, source: DataFrame, nodes: DataFrame, n: int, threshold: float):
        self.source, self.n, self.threshold = source, n, threshold
        self.marks = nodes.select("node", "n", "sketch")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b`` without those whose sizes or sketches rule out the threshold."""
        left = pairs.join(self.marks.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
        both = left.join(self.marks.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")
        bits = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        sizes = F.least("n_a", "n_b") >= self.threshold * F.greatest("n_a", "n_b") - 1e-9
        return both.where(sizes).where(bits <= most_apart(self.threshold) * (F.col("n_a") + F.col("n_b")) + 1e-9).select("a", "b")

    def confirmed(self, pairs: DataFrame, label: str) -> DataFrame:
        """The links among distinct pairs ``a, b``. A head that many are held against is dealt to as many tasks as it needs."""
        pairs = written(pairs, f"{label}-pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        near = likely_in(self.source.select("node", "text"), [F.col("node")], wanted, [F.col("node")])
        texts = written(
            near.where("_likely").groupBy("node").agg(F.any_value("text").alias("text")).join(wanted, "node", "left_semi"),
            f"{label}-texts",
        )
        salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
        dealt = pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64(F.lit(3), "a"), "salts").cast("int").alias("salt"))
        members = dealt.select(F.col("b").alias("head"), "salt", F.lit(1).alias("role"), F.col("a").alias("node"))
        heads = dealt.select("b", "salt").distinct().select("b", "salt", F.lit(0), "b")
        rows = members.union(heads).join(texts, "node").select("head", "salt", "role", "node", "text")
        ordered = rows.repartition("head", "salt").sortWithinPartitions("head", "salt", "role")
        return written(ordered.mapInArrow(compare_batches(self.n, self.threshold), f"a {NODE}, b {NODE}"), f"{label}-links")


def open_pairs(shared: DataFrame, roots: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` that share a bucket, lie in different components and may be similar.

    Per open bucket the members outside its largest component are held against all others, in tiles of ``BLOCK`` by ``BLOCK``.
    """
    placed = shared.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("band", "root").agg(F.count("*").alias("rows")).groupBy("band").agg(
        F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.count("*").alias("parts"),
        F.max_by("root", F.struct("rows", "root")).alias("major"),
    ).where("parts > 1")
    blocks = lambda rows: F.ceil(rows / BLOCK).cast("int")
    drawn = lambda count, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), count).cast("int")
    tile = lambda low, high, minor: F.struct(low.alias("low"), high.alias("high"), F.lit(minor).alias("minor"))
    upto = lambda count: F.sequence(F.lit(0), count - 1)
    sized = several.select("band", "major", blocks(F.col("rows")).alias("wide"), blocks(F.col("rows") - F.col("most")).alias("tall"))
    place, own = F.transform(upto(F.col("tall")), lambda low: tile(low, drawn(F.col("wide"), 5), False)), F.col("root") != F.col("major")
    both = F.when(own, F.concat(place, F.transform(upto(F.col("wide")), lambda high: tile(drawn(F.col("tall"), 6), high, True)))).otherwise(place)
    dealt = placed.join(sized, "band").select("band", F.explode(both).alias("tile"), "node", "root").select("band", "tile.*", "node", "root")
    tiles = dealt.join(nodes.select("node", "n", "sketch"), "node").select("band", "low", "high", "minor", "node", "root", "n", "sketch")
    ordered = tiles.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    return ordered.mapInArrow(tile_batches(threshold), f"a {NODE}, b {NODE}").distinct()


def near_duplicates(
    documents: DataFrame, n: int = 4, threshold: float = 0.8, bins: int = 128, rows: int = 4
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents whose sets of ``n``-word shingles have a Jaccard similarity of ``threshold`` or more are linked;
    ``component_id`` is the least doc_id that links lead to, ``kept`` is true where it is the document's own. Of
    ``bins / rows`` bands one at least agrees for all but 5 of 10^8 pairs right at 0.8 with the defaults (``band_recall``).

    Words are split at ASCII white space and only A-Z are lower-cased. A text of fewer than ``n`` words is one shingle of
    all of them; NULL texts and those without words have none, link with nothing and stay. Rows that repeat id and
    text are documents of their own. NULL ids count as documents: a component has a NULL ``component_id`` only if all
    its ids are, and a row with a NULL id is kept only there. Extra columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), node_of(text).alias("node"), text.alias("text"))
    signed = written(
        source.mapInArrow(sign_batches(n, bins, rows), f"doc_id long, node {NODE}, n long, bands array<long>, sketch array<long>"),
        "near-signed",
    )
    nodes = written(
        signed.where("n > 0").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"),
            F.any_value("sketch").alias("sketch"),
        ), "near-nodes",
    )
    links = _Links(source, nodes, n, threshold)
    banded = nodes.select("node", F.explode("bands").alias("band"))
    ends = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("top"), F.count("*").alias("size"))
    shared = written(banded.join(ends.where("low <> top").select("band", "size"), "band"), "near-shared")
    # the head of a bucket is the member whose buckets are largest: what copies were made from, not one of the copies
    known = shared.join(shared.groupBy("node").agg(F.sum("size").alias("met")), "node").select("band", F.struct("met", "node").alias("member"))
    heads = known.groupBy("band").agg(F.max("member").alias("head"))
    star = shared.join(heads, "band").select(F.col("node").alias("a"), F.col("head.node").alias("b")).where("a <> b").distinct()
    found = links.confirmed(links.likely(star), "near-star")
    roots = components(found, "near-components")
    # what the stars leave open
    late = links.confirmed(open_pairs(shared, roots, nodes, threshold), "near-late")
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    parts = late.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")
    )
    merged = components(parts, "near-merged").select(F.col("node").alias("part"), F.col("root").alias("whole"))
    own = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("part"))
    roots = own.join(merged, "part", "left").select("node", F.coalesce("whole", "part").alias("root"))
    placed = nodes.select("node", "least").join(roots, "node")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = written(placed.join(least, "root").select("node", "component_id"), "near-classes")
    out = signed.select("doc_id", "node", "n").join(of_node, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )
