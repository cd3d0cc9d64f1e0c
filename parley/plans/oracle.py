"""Pieces of SQL shared by the checks of the registered queries."""

from __future__ import annotations

from parley.lexicons import PROBE_SENTIMENT, PROBE_TOPICS, Lexicon

MESSAGE_VIEW = """
j AS (
  SELECT c.conv_id*8 + c.turn AS id, c.conv_id, c.turn, c.role, c.text, e.ts, e.event_type, e.props
  FROM conversations c JOIN events e ON e.event_id = c.conv_id*48 + c.turn),
u AS (
  SELECT d.conv_id, e.user_id
  FROM (SELECT DISTINCT conv_id FROM conversations) d JOIN events e ON e.event_id = d.conv_id*48),
l AS (
  SELECT j.*, lag(role) OVER w AS prev_role, lag(ts) OVER w AS prev_ts
  FROM j WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
v AS (
  SELECT l.id, l.conv_id AS conversation_id, u.user_id, l.text AS message,
         CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'image' WHEN 'signup' THEN 'sticker'
                         WHEN 'error' THEN 'file' ELSE 'location' END AS message_type,
         CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'admin' ELSE 'system' END AS sender_type,
         l.ts AS "timestamp", l.props AS metadata,
         CASE WHEN role = 'assistant' AND prev_role = 'user'
              THEN CAST(floor(epoch(ts) - epoch(prev_ts)) AS INT) END AS response_time
  FROM l JOIN u USING (conv_id))"""


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def hits(text: str, keywords) -> str:
    listed = ", ".join(text_literal(k) for k in keywords)
    return f"len(list_filter([{listed}], lambda k: contains(lower({text}), k)))"


def sentiment_columns(p: str, n: str) -> tuple[str, str]:
    label = f"CASE WHEN {p} > {n} THEN 'positive' WHEN {n} > {p} THEN 'negative' WHEN {p} = {n} THEN 'neutral' END"
    score = (
        f"CASE WHEN {p} > {n} THEN least(0.8::DOUBLE, 0.5::DOUBLE + ({p}-{n})*0.1::DOUBLE)"
        f" WHEN {n} > {p} THEN greatest(-0.8::DOUBLE, -0.5::DOUBLE - ({n}-{p})*0.1::DOUBLE)"
        f" WHEN {p} = {n} THEN 0.0::DOUBLE END"
    )
    return label, f"round({score}, 2)"


def scored(source: str, text: str, lexicon: Lexicon = PROBE_SENTIMENT) -> str:
    """``source`` with p, n, label and score."""
    label, score = sentiment_columns("p", "n")
    return (
        f"SELECT *, {label} AS label, {score} AS score FROM (SELECT *, "
        f"{hits(text, lexicon['positive'])} AS p, {hits(text, lexicon['negative'])} AS n FROM {source})"
    )


def with_messages(body: str, lexicon: Lexicon = PROBE_SENTIMENT) -> str:
    """``v``: the plain message view; ``m``: with sentiment on two rows of three."""
    return f"""WITH {MESSAGE_VIEW},
s AS ({scored('v', 'message', lexicon)}),
m AS (SELECT * EXCLUDE (p, n, label, score),
             CASE WHEN id % 3 <> 0 THEN label END AS sentiment,
             CASE WHEN id % 3 <> 0 THEN score END AS sentiment_score,
             CASE WHEN id % 3 <> 0 THEN "timestamp" END AS processed_at FROM s)
{body}"""


def lexicon_values(lexicon: Lexicon) -> str:
    rows = ", ".join(
        f"({text_literal(label)}, {order}, {text_literal(keyword)}, {len(keywords)})"
        for order, (label, keywords) in enumerate(lexicon.items(), 1)
        for keyword in keywords
    )
    return f"(VALUES {rows}) AS k(label, label_order, keyword, label_size)"


def ranked_labels(source: str, key: str, text: str, lexicon: Lexicon = PROBE_TOPICS, factor: int = 2) -> str:
    """(key, label, hits, confidence, rank) of the best three labels."""
    return f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY confidence DESC, label_order) AS rank
  FROM (SELECT {key}, label, label_order, count(*) AS hits,
               least(1.0::DOUBLE, count(*)::DOUBLE / max(label_size) * {factor}) AS confidence
        FROM {source}, {lexicon_values(lexicon)}
        WHERE contains(lower({text}), keyword) GROUP BY {key}, label, label_order)) WHERE rank <= 3"""


def topics_of_messages(limit: int | None = None, lexicon: Lexicon = PROBE_TOPICS) -> str:
    """CTE body list defining ``c`` (customer messages) and ``t`` (their topics)."""
    cut = f' ORDER BY "timestamp" DESC, id DESC LIMIT {limit}' if limit else ""
    return (
        f", c AS (SELECT * FROM m WHERE sender_type = 'customer'{cut}),"
        f" t AS (SELECT r.*, c.conversation_id, c.\"timestamp\", c.message FROM ({ranked_labels('c', 'id', 'message', lexicon)}) r"
        f" JOIN c USING (id))"
    )


CENTRES = """centres AS (
  SELECT label, list(x ORDER BY pos) AS centre FROM (
    SELECT label, pos, avg(x::DOUBLE) AS x FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label)"""


def cosine(a: str, b: str) -> str:
    a, b = f"{a}::DOUBLE[]", f"{b}::DOUBLE[]"
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"
