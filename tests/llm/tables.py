"""Small tables with every awkward case: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "ant bee cat dog elk fox gnu hen ibis jay kite lark mole newt owl pug quail rat seal toad".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    made = [draw.choice(WORDS) + draw.choice(WORDS) for _ in range(words)]
    return "\n".join(" ".join(made[i: i + 12]) for i in range(0, words, 12))


def changed(text: str, seed: int, times: int = 1) -> str:
    draw, parts = random.Random(seed), text.split(" ")
    for _ in range(times):
        parts[draw.randrange(len(parts))] = "changed" + str(draw.randrange(10**6))
    return " ".join(parts)


def rows() -> list[tuple]:
    base = prose(1, 120)
    found = [(i, prose(i, 20 + 7 * i), "en" if i % 3 else "de", f"src{i % 4}", 0) for i in range(30)]
    found += [(100 + i, changed(base, i, 1 + i % 4), "en", "src0", 0) for i in range(24)]  # near copies
    found += [(200 + i, base, "en", "src0", 0) for i in range(6)]  # exact copies
    found += [(300, None, "en", "src1", None), (301, "", None, None, 0), (302, " \n\t ", "fr", "src1", 3)]
    found += [(303, "one", "en", None, 3), (304, "One", None, "src2", 3), (305, "a b c d", "en", "src2", 7)]
    found += [(None, prose(77, 40), "en", "src3", 0), (None, prose(78, 40), None, "src3", 0), (None, None, None, None, None)]
    found += [(400, prose(50, 30), "de", "src1", 0)] * 3  # repeated rows
    found += [(400, prose(51, 30), "de", "src1", 0)]  # an id twice, with another text
    found += [(500, prose(9, 9000), "en", "src0", 0)]  # long
    found += [(501, "x" * 30_000, "en", "src0", 0)]  # one long word
    found += [(502, "same line here, all of it\n" * 40 + "ein Wort €🙂 più", "de", "src2", 0)]
    found += [(503, "sym%%% bol&&& jun### kkk$$$ " * 30, "en", "src1", 0)]
    return found


def documents(spark: SparkSession, extra: bool = True) -> DataFrame:
    frame = spark.createDataFrame(rows(), SCHEMA)
    if extra:  # names that operators use inside
        for name in ("n1", "n2", "root", "place", "part", "leaf", "line", "key", "size", "n_words", "kept", "_text", "node",
                     "n_tokens", "band", "cell", "level", "d", "t", "l1", "bucket", "text_hash", "shard", "domain"):
            frame = frame.withColumn(name, F.lit(name))
    return frame


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
