"""Quality rules: base rules and robust outliers per language and source, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed_row, unpacked, words, written

#: The counts of a text, in the order of ``text_counts``.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Transformed statistics in units of 1/1024, and the standard deviation by which each is widened: its square is
#: added to the variance. In a group that never varies each statistic alone must be able to pass the cut-off, so the
#: spread of one that ends at m is below m / sqrt(CUTOFF): m is 1 for duplicate lines, sqrt(0.2) for repeats.
SCALE = 1024
SPREADS = {"length": 0.6, "word_length": 0.04, "symbols": 0.03, "dup_lines": 0.08, "repeats": 0.06}
STATISTICS = tuple(SPREADS)

#: The median of the chi-squared distribution with five degrees of freedom, and its 1 - 1e-8 quantile.
CHI_MEDIAN = 4.351
CUTOFF = 45.1
#: Distances are ranked by eighths of their binary logarithm, from 2^-20 to 2^44.
BINS_PER_OCTAVE, LOWEST, HIGHEST = 8, -160, 352


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(word: Column, window: int = 5) -> Column:
    """How many words lie in windows that occur twice or more in the text, first occurrences included.

    Windows are compared by a 64-bit hash. Most texts repeat none, which the number of distinct
    hashes tells; only the others sort their windows by hash and add up the places covered.
    """

    def covered(place: Column) -> Column:
        steps = F.transform(
            place,
            lambda at, j: F.coalesce(F.least(F.lit(window), F.get(place, j + 1) - at), F.lit(window)),
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def places(ranked: Column) -> Column:
        again = F.filter(
            ranked,
            lambda x, j: (x["hash"] == F.get(ranked, j + 1)["hash"]).eqNullSafe(True)
            | ((j > 0) & (x["hash"] == F.get(ranked, F.greatest(j - 1, F.lit(0)))["hash"])),
        )
        return bound(F.sort_array(F.transform(again, lambda x: x["at"])), covered)

    def count(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, j: F.struct(h.alias("hash"), j.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bound(ranked, places))

    starts = F.sequence(F.lit(0), F.size(word) - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(window)]))
    return F.when(F.size(word) < window + 1, F.lit(0)).otherwise(bound(hashes, count)).cast("long")


def text_counts(documents: DataFrame) -> DataFrame:
    """``documents`` plus the columns ``COUNTS`` of each whole text (a NULL counts as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    word = words(text)
    of_words = bound(word, lambda w: F.struct(
        F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeated_words(w).alias("r")
    ))
    of_lines = bound(lines, lambda a: F.struct(
        F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("d")
    ))
    counted = documents.withColumns({
        "of_words": of_words,
        "of_lines": of_lines,
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
    })
    return counted.withColumns({
        "n_words": F.col("of_words.n"), "word_chars": F.col("of_words.c"), "n_repeat_words": F.col("of_words.r"),
        "n_lines": F.col("of_lines.n"), "n_dup_lines": F.col("of_lines.d"),
    }).drop("of_words", "of_lines")


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    return (n < 10) | (100 * repeats > 20 * n)


def statistics() -> list[Column]:
    """The transformed statistics, smoothed so that short texts do not scatter, as whole 1/1024ths.

    Whole numbers make every sum exact, so the estimates do not depend on the order of rows.
    """
    n, chars, symbols, lines, dups, repeats = (F.col(c) for c in COUNTS)
    values = [
        F.log(n + 1.0),
        F.log((chars + 250.0) / (n + 50.0)),
        F.sqrt(symbols / (chars + 100.0)),
        F.sqrt(dups / (lines + 10.0)),
        F.sqrt(repeats / (n + 50.0)),
    ]
    return [F.round(v * SCALE).cast("long").alias(s) for v, s in zip(values, STATISTICS)]


def cells(rows: DataFrame, least_rows: int) -> DataFrame:
    """``lang, source, cell, teaches``: whose estimates judge a group, and which estimates its rows are part of.

    A group is judged by its own estimates if large enough, else by those of its language's small groups together, or,
    where these are too few, of its whole language; else by those of all that is left of the table, or of the whole table.
    """
    small = F.col("rows") < least_rows
    of_lang = Window.partitionBy("lang")
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    pooled = sizes.withColumns({
        "pool": F.sum(F.when(small, F.col("rows"))).over(of_lang), "all": F.sum("rows").over(of_lang)
    })
    name = lambda *parts: F.to_json(F.array(*parts))
    placed = written(pooled.select(
        "lang", "source", "rows",
        F.when(~small, name("lang", "source")).when(F.col("all") >= least_rows, name("lang"))
        .otherwise(F.lit("[]")).alias("cell"),
        F.when((F.col("pool") < least_rows) & (F.col("all") >= least_rows), name("lang")).alias("whole"),
    ), "quality-cells")
    left = placed.where("cell = '[]'").agg(F.sum("rows")).first()[0]
    table = F.lit("[]" if left and left < least_rows else None).cast("string")
    return placed.select(
        "lang", "source", "cell", F.array_distinct(F.array_compact(F.array("cell", "whole", table))).alias("teaches")
    )


def distance(values: Sequence[Column], mean: Sequence[Column], factor: Sequence[Sequence[Column]]) -> Column:
    """The squared Mahalanobis distance, by forward substitution through the factor."""
    solved: list[Column] = []
    for i, (value, centre) in enumerate(zip(values, mean)):
        rest = value - centre
        for k in range(i):
            rest = rest - factor[i][k] * solved[k]
        solved.append(rest / factor[i][i])
    total = solved[0] * solved[0]
    for s in solved[1:]:
        total = total + s * s
    return total


def _columns() -> tuple[list[Column], list[list[Column]]]:
    p = len(STATISTICS)
    return [F.col(f"m{i}") for i in range(p)], [[F.col(f"f{i}_{j}") for j in range(i + 1)] for i in range(p)]


def _factored(moments: DataFrame, scale: Column) -> DataFrame:
    """``cell, m*, f*`` from exact sums; ``scale`` widens the covariance of the central rows.

    One entry of the factor is one column and builds on the columns before it.
    """
    p = len(STATISTICS)
    floors = [(SPREADS[s] * SCALE) ** 2 for s in STATISTICS]
    n = F.col("n").cast("double")
    frame = moments.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(p)})
    frame = frame.withColumns({
        f"c{i}_{j}": scale * (F.col(f"q{i}_{j}") / n - F.col(f"m{i}") * F.col(f"m{j}"))
        + (floors[i] if i == j else 0.0)
        for i in range(p) for j in range(i + 1)
    })
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"f{i}_{k}") * F.col(f"f{j}_{k}")
            frame = frame.withColumn(f"f{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"f{j}_{j}"))
    names = [f"m{i}" for i in range(p)] + [f"f{i}_{j}" for i in range(p) for j in range(i + 1)]
    return frame.select("cell", *names)


def robust_estimates(rows: DataFrame, least_rows: int, share: float = 0.75, steps: int = 6) -> DataFrame:
    """Minimum-covariance-determinant estimates per cell: ``cell, m0.., f0_0..`` (centre and factor).

    ``rows``: ``cell`` and the statistics. It starts from coordinate-wise medians and deviations; each
    concentration step ranks the rows of a cell by distance, keeps the nearest ``share`` of them
    and estimates again, which never raises the determinant. One step is one pass over the narrow table:
    moments are summed per cell and distance class with map-side combine, and the classes are
    then accumulated up to the share, so that no cell, however large, is sorted or collected. After the
    last step the covariance is scaled so that the median distance is that of a normal sample.
    Cells with fewer than ``least_rows`` rows get no estimate.
    """
    p = len(STATISTICS)
    values = [F.col(s) for s in STATISTICS]
    mean, factor = _columns()
    middle = rows.groupBy("cell").agg(
        F.count("*").alias("rows"),
        *[F.percentile_approx(v, F.lit(0.5), F.lit(10_000)).alias(f"m{i}") for i, v in enumerate(values)],
        *[F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000)).alias(f"r{i}") for i, v in enumerate(values)],
    ).where(F.col("rows") >= least_rows)
    floors = [SPREADS[s] * SCALE for s in STATISTICS]
    wide = [F.greatest((F.col(f"r{i}")[1] - F.col(f"r{i}")[0]) / 1.349, F.lit(floors[i])) for i in range(p)]
    estimate = written(middle.select(
        "cell", *[F.col(f"m{i}").cast("double").alias(f"m{i}") for i in range(p)],
        *[(wide[i] if i == j else F.lit(0.0)).alias(f"f{i}_{j}") for i in range(p) for j in range(i + 1)],
    ), "quality-start")
    sums = [f"s{i}" for i in range(p)] + [f"q{i}_{j}" for i in range(p) for j in range(i + 1)]
    upto = Window.partitionBy("cell").orderBy("class")
    for step in range(steps + 1):
        level = F.log2(distance(values, mean, factor) + 1e-9) * BINS_PER_OCTAVE
        classed = rows.join(estimate, "cell").withColumn(
            "class", F.least(F.greatest(F.floor(level), F.lit(LOWEST)), F.lit(HIGHEST)).cast("int")
        )
        summed = written(classed.groupBy("cell", "class").agg(
            F.count("*").alias("n"),
            *[F.sum(v).alias(f"s{i}") for i, v in enumerate(values)],
            *[F.sum(values[i] * values[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i + 1)],
        ), "quality-classes")
        ranked = summed.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn(
            "all", F.sum("n").over(Window.partitionBy("cell"))
        )
        if step == steps:
            # the class in which the median lies, as a distance
            middle = ranked.where(F.col("before") * 2 < F.col("all")).groupBy("cell").agg(F.max("class").alias("class"))
            return written(estimate.join(middle.select(
                "cell", F.sqrt(F.greatest(F.pow(F.lit(2.0), (F.col("class") + 0.5) / BINS_PER_OCTAVE) / CHI_MEDIAN, F.lit(1.0))).alias("wider")
            ), "cell").select(
                "cell", *[f"m{i}" for i in range(p)],
                *[(F.col(f"f{i}_{j}") * F.col("wider")).alias(f"f{i}_{j}") for i in range(p) for j in range(i + 1)],
            ), "quality-estimates")
        inner = ranked.where(F.col("before") < F.ceil(F.col("all") * share))
        moments = inner.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])
        estimate = written(_factored(moments, F.lit(1.0)), "quality-step")


def fit(counted: DataFrame, least_rows: int = 200) -> tuple[DataFrame, DataFrame]:
    """Cells and estimates from ``lang, source`` and ``COUNTS`` of documents that pass the base rules."""
    passed = counted.where(~base_failed())
    group = cells(passed, least_rows)
    rows = passed.select("lang", "source", *statistics())
    same = rows["lang"].eqNullSafe(group["lang"]) & rows["source"].eqNullSafe(group["source"])
    rows = written(rows.join(group, same).select(F.explode("teaches").alias("cell"), *STATISTICS), "quality-rows")
    return group, robust_estimates(rows, least_rows)


def judged(counted: DataFrame, group: DataFrame, estimates: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``counted`` plus ``base_failed``, ``distance`` (NULL without an estimate) and ``kept``.

    Cells and estimates are one row per language and source, written so that Spark knows their size: it
    broadcasts a small table instead of shuffling the rows that are judged, texts included.
    """
    mean, factor = _columns()
    model = written(group.join(estimates, "cell", "left").select(
        F.col("lang").alias("_cell_lang"), F.col("source").alias("_cell_source"),
        F.struct(*mean, *[c for row in factor for c in row]).alias("_model"),
    ), "quality-model")
    same = F.col("lang").eqNullSafe(F.col("_cell_lang")) & F.col("source").eqNullSafe(F.col("_cell_source"))
    p = len(STATISTICS)
    far = distance(
        statistics(), [F.col(f"_model.m{i}") for i in range(p)],
        [[F.col(f"_model.f{i}_{j}") for j in range(i + 1)] for i in range(p)],
    )
    out = counted.join(model, same, "left").withColumns({
        "base_failed": base_failed(), "distance": far,
    })
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.withColumn("kept", kept).drop("_cell_lang", "_cell_source", "_model")


def quality_verdicts(documents: DataFrame, least_rows: int = 200, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``base_failed``, ``distance``, ``kept``.

    A document that fails no base rule is kept unless its statistics lie further than ``cutoff`` from the
    robust centre of its language and source. NULL languages and sources are groups of their own; groups
    under ``least_rows`` pool with the small ones of their language, then with the rest of the table; a pool
    that is still too small is judged by its whole language or the whole table. Only a table that
    has fewer rows than that altogether rejects nothing. A NULL or empty text has no words and fails the base rules.
    Repeated rows are judged each; extra columns are not read.
    """
    counted = written(text_counts(documents.select("doc_id", "lang", "source", "text")).drop("text"), "quality-counts")
    group, estimates = fit(counted, least_rows)
    return judged(counted, group, estimates, cutoff).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"
    )


def keep_good(documents: DataFrame, least_rows: int = 200, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that ``quality_verdicts`` keeps, with their own columns.

    The documents are written once beside their counts, so that no text is counted twice and none is shuffled.
    """
    packed = documents.select("lang", "source", "text", packed_row(documents))
    counted = written(text_counts(packed).drop("text"), "quality-counted")
    group, estimates = fit(counted.drop("row"), least_rows)
    return unpacked(judged(counted, group, estimates, cutoff).where("kept"), documents)
