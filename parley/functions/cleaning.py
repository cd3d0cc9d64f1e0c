"""Text cleaning as chained regular expressions.

Flags: ``d`` makes ``\\n`` the only line break, ``m`` lets ``^`` match at line starts, ``U`` makes
``\\d`` cover all decimal digits. Each step is a projection of its own, so a chain that several
later expressions refer to is evaluated once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels to strip, words that need no opening, wording and lengths.
REPLY_LABELS = ("คำตอบ:", "ตอบ:")
REPLY_OPENERS = ("สวัสดี", "ขอบคุณ", "ตาม")
REPLY_PREFIX = "ตามข้อมูลที่มี "
REPLY_MAX = 2000
REPLY_KEEP = 1950
REPLY_NOTICE = "...\n\n(คำตอบถูกตัดทอนเนื่องจากยาวเกินไป)"

# Decorated terms.
MARKS = (
    ("สถิติ", "📊 สถิติ"),
    ("ความรู้สึก", "😊 ความรู้สึก"),
    ("หัวข้อ", "🏷️ หัวข้อ"),
    ("เวลาตอบกลับ", "⏱️ เวลาตอบกลับ"),
    ("ข้อเสนอแนะ", "💡 ข้อเสนอแนะ"),
)

# White space: the Unicode spaces and the four separator controls, as a character class and as
# the characters themselves.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE_CHARS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def clean_reply(
    frame: DataFrame,
    text: str = "reply",
    labels: Sequence[str] = REPLY_LABELS,
    openers: Sequence[str] = REPLY_OPENERS,
    prefix: str = REPLY_PREFIX,
    longest: int = REPLY_MAX,
    keep: int = REPLY_KEEP,
    notice: str = REPLY_NOTICE,
) -> DataFrame:
    """Clean the column in place: strip labels at line starts, open politely, shorten, trim."""
    body = F.col(text)
    for label in labels:
        body = F.regexp_replace(body, rf"(?dm)^{SPACE}*{re.escape(label)}{SPACE}*", "")
    opened = F.lit(False)
    for opener in openers:
        opened = opened | F.col(text).startswith(opener)
    polite = F.when(opened, F.col(text)).otherwise(F.concat(F.lit(prefix), F.col(text)))
    short = F.when(
        F.length(text) > longest, F.concat(F.left(F.col(text), F.lit(keep)), F.lit(notice))
    ).otherwise(F.col(text))
    return frame.withColumn(text, body).withColumn(text, polite).withColumn(text, strip_space(short))


def display_markup(text: Column, marks: Sequence[tuple[str, str]] = MARKS) -> Column:
    """Bold and italic marks to tags, list marks to bullets, known terms decorated."""
    out = F.regexp_replace(text, r"(?d)\*\*(.*?)\*\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"(?d)\*(.*?)\*", "<em>$1</em>")
    out = F.regexp_replace(out, rf"(?Udm)^\d+\.{SPACE}+", "• ")
    out = F.regexp_replace(out, rf"(?Udm)^-{SPACE}+", "• ")
    for term, decorated in marks:
        out = F.replace(out, F.lit(term), F.lit(decorated))
    return out
