"""Keyword lists, reply categories and wording that decide results.

A lexicon is an ordered mapping ``label -> keywords``; the order of the labels breaks ties.
All operators take one as a parameter, so every list here can be replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

Lexicon = Mapping[str, Sequence[str]]

# ---------------------------------------------------------------------------
# Default keyword lists.
# ---------------------------------------------------------------------------
SENTIMENT: Lexicon = {
    "positive": (
        "ดี", "เยี่ยม", "สุดยอด", "ชอบ", "พอใจ", "ประทับใจ", "ขอบคุณ", "สวย", "เก่ง",
        "ใช่", "โอเค", "ตกลง", "ยอดเยี่ยม", "เจ๋ง", "เลิศ", "perfect", "good", "great",
        "excellent", "amazing", "wonderful", "fantastic", "awesome", "love", "like",
    ),
    "negative": (
        "แย่", "ไม่ดี", "เสีย", "ชัง", "เกลียด", "โกรธ", "ผิดหวัง", "น่าเบื่อ", "แปลก",
        "ไม่", "อย่า", "หยุด", "ปัญหา", "ข้อผิดพลาด", "เสียใจ", "bad", "terrible",
        "awful", "hate", "angry", "disappointed", "problem", "error", "wrong",
    ),
}

TOPICS: Lexicon = {
    "การสั่งซื้อ": ("สั่ง", "ซื้อ", "order", "buy", "purchase", "เก็บเงิน", "จ่าย", "ชำระ"),
    "การจัดส่ง": ("จัดส่ง", "ส่ง", "delivery", "ship", "ขนส่ง", "รับ", "ได้รับ"),
    "สินค้า": ("สินค้า", "ของ", "product", "item", "คุณภาพ", "เสียหาย", "ใหม่"),
    "ราคา": ("ราคา", "เงิน", "price", "cost", "แพง", "ถูก", "ค่า", "บาท"),
    "การคืนสินค้า": ("คืน", "เปลี่ยน", "return", "refund", "exchange", "แลก"),
    "บริการ": ("บริการ", "service", "ช่วย", "help", "สอบถาม", "แนะนำ"),
    "โปรโมชั่น": ("โปร", "ลด", "promotion", "discount", "sale", "แถม"),
    "การร้องเรียน": ("ร้องเรียน", "complaint", "แจ้ง", "ปัญหา", "เรื่อง"),
}

INTENTS: Lexicon = {
    "analytics": ("สถิติ", "วิเคราะห์", "จำนวน", "กราฟ", "ข้อมูล", "รายงาน"),
    "sentiment": ("ความรู้สึก", "พอใจ", "ไม่พอใจ", "โกรธ", "ดีใจ", "sentiment"),
    "topics": ("หัวข้อ", "เรื่อง", "ปัญหา", "topic", "ร้องเรียน"),
    "performance": ("ประสิทธิภาพ", "เร็ว", "ช้า", "ตอบกลับ", "response time"),
    "suggestions": ("แนะนำ", "ปรับปรุง", "พัฒนา", "ช่วย", "ควร"),
}

REPLY_CATEGORIES: Lexicon = {
    "greeting": ("สวัสดี", "ว", "hello", "hi"),
    "price_inquiry": ("ราคา", "เท่าไหร่", "price", "cost"),
    "shipping": ("จัดส่ง", "ส่ง", "delivery", "ship"),
    "complaint": ("ร้องเรียน", "ปัญหา", "เสีย", "แย่", "ไม่ดี"),
    "thanks": ("ขอบคุณ", "thank", "ขอบใจ"),
}
OTHER_REPLY = "general"
OTHER_INTENT = "general"

# Reply templates: the confidences are fixed values, the wording is our own.
REPLIES: Mapping[str, Sequence[tuple[str, float]]] = {
    "greeting": (("Hello, thanks for writing to us. How can we help?", 0.9),),
    "price_inquiry": (
        ("Please tell us which item you mean and we will look up its price.", 0.85),
        ("Prices depend on the model; send us the details you have.", 0.8),
    ),
    "shipping": (
        ("Parcels usually arrive within a few working days; express is available.", 0.9),
        ("The delivery fee depends on the address and the carrier you choose.", 0.85),
    ),
    "complaint": (
        ("We are sorry about this. Please send a photo or a short description.", 0.9),
        ("We regret the trouble and will look into it as soon as we have the details.", 0.85),
    ),
    "thanks": (
        ("You are welcome. Write to us whenever you need anything.", 0.95),
        ("Our pleasure, and thank you for choosing us.", 0.9),
    ),
    "general": (("Could you give us a little more detail so we can answer properly?", 0.6),),
}

# Lexicons with entries that do occur in the invented text of the test tables.
PROBE_SENTIMENT: Lexicon = {"positive": ("the", "ing", "ment"), "negative": ("le", "de", "ung")}
PROBE_TOPICS: Lexicon = {
    "en": ("the", "ing", "tion", "ly"),
    "fr": ("le", "que", "ment"),
    "de": ("die", "ung", "keit"),
    "mix": ("de", "en"),
}
PROBE_INTENTS: Lexicon = {
    "reading": ("the", "of", "and", "that", "is"),
    "lecture": ("les", "que", "dans", "avec"),
    "lesen": ("der", "die", "und", "nicht"),
}
PROBE_REPLIES: Lexicon = {
    "greeting": ("hahaha", "guten"),
    "price_inquiry": ("preis", "coût"),
    "shipping": ("ship", "envoi"),
    "complaint": ("hate", "que"),
    "thanks": ("ung", "the"),
}


def lexicon_frame(spark: SparkSession, name: str, lexicon: Lexicon) -> DataFrame:
    """One row per keyword: (lexicon, label, label_order, keyword, label_size)."""
    rows = [
        (name, label, order, keyword, len(keywords))
        for order, (label, keywords) in enumerate(lexicon.items(), 1)
        for keyword in keywords
    ]
    schema = "lexicon string, label string, label_order int, keyword string, label_size int"
    return spark.createDataFrame(rows, schema)


def lexicon_from_frame(frame: DataFrame) -> Lexicon:
    """Read a lexicon kept as a table. It becomes part of the expression, so it is meant for keyword
    lists a person maintains."""
    lexicon: dict[str, list[str]] = {}
    for row in frame.select("label", "label_order", "keyword").orderBy("label_order").collect():
        lexicon.setdefault(row["label"], []).append(row["keyword"])
    return lexicon
