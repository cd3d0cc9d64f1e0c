"""The same mixture in SQL, for the comparison: levels, weights, share, epochs and seed as in the query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def mixture_sql(source: str, levels: Sequence[str], weights: Sequence[Mapping[str, int]], share: float, epochs: int, seed: int) -> str:
    """DuckDB SQL for ``mix_documents`` over ``source``, a SELECT that gives doc_id, text and the levels."""
    parts = [
        f"docs AS ({source})",
        "counted AS (SELECT doc_id, " + ", ".join(levels)
        + r", md5(coalesce(text, '')) AS text_hash, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM docs)",
        f"f0 AS (SELECT {', '.join(levels)}, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {epochs} AS capacity, "
        f"floor((SELECT sum(n_tokens) FROM counted)::DOUBLE * {share})::BIGINT AS budget FROM counted GROUP BY {', '.join(levels)})",
    ]
    for depth, named in enumerate(weights, 1):
        above, here = list(levels[: depth - 1]), list(levels[:depth])
        weight = "CASE " + " ".join(f"WHEN {levels[depth - 1]} = '{v}' THEN {w}" for v, w in named.items()) + " ELSE 1 END" if named else "1"
        part = f"PARTITION BY {', '.join(above)} " if above else ""
        order = f"{part}ORDER BY capacity / weight, {levels[depth - 1]}"
        parts += [
            f"n{depth} AS (SELECT {', '.join(here)}, sum(capacity)::BIGINT AS capacity, max(budget) AS budget, max({weight}) AS weight "
            f"FROM f{depth - 1} GROUP BY {', '.join(here)})",
            f"l{depth} AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE "
            f"/ sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, "
            f"row_number() OVER ({order}) AS nth FROM n{depth})",
            f"w{depth} AS (SELECT *, first_value(CASE WHEN level * weight < capacity THEN level END IGNORE NULLS) "
            f"OVER ({part}ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS water FROM l{depth})",
            f"f{depth} AS (SELECT f.* EXCLUDE (budget), (CASE WHEN water IS NULL OR w.capacity <= water * weight THEN w.capacity "
            f"ELSE floor(water * weight) END)::BIGINT AS budget FROM f{depth - 1} f JOIN w{depth} w ON "
            + " AND ".join(f"f.{c} IS NOT DISTINCT FROM w.{c}" for c in here) + ")",
        ]
    same = " AND ".join(f"c.{c} IS NOT DISTINCT FROM p.{c}" for c in levels)
    place = f"md5(concat_ws('|', '{seed}', e.epoch::VARCHAR, coalesce(c.doc_id::VARCHAR, ''), c.text_hash))"
    parts += [
        f"steps AS (SELECT c.*, e.epoch, p.tokens, p.budget, {place} AS place FROM counted c JOIN f{len(levels)} p ON {same} "
        f"CROSS JOIN (SELECT unnest(range({epochs})) AS epoch) e)",
        f"runs AS (SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY {', '.join(levels)}, epoch ORDER BY place "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM steps)",
    ]
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {', '.join(levels)}, epoch::INTEGER AS epoch, n_tokens::BIGINT AS n_tokens, "
        "least(n_tokens, budget - start)::BIGINT AS n_taken FROM runs WHERE tokens > 0 AND (start < budget OR (epoch + 1) * tokens <= budget)"
    )
