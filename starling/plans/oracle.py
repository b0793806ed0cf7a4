"""DuckDB twins of the fixture views, as CTE text.

``with_views("scored", "probs")`` returns a ``WITH`` clause defining the named
views (and whatever they depend on) over the pre-registered driver tables.
Keep these in step with ``starling.plans.fixtures``.
"""

from __future__ import annotations

from starling.domain import VALID_RATINGS
from starling.functions.text import trim_pattern


def rating_case(expr: str) -> str:
    """0..3 -> 1, 2, 4, 5 as a CASE."""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(VALID_RATINGS))
    return f"CAST(CASE {expr} {whens} END AS BIGINT)"


def sql_trim(expr: str) -> str:
    pat = trim_pattern().replace("'", "''")
    return f"regexp_replace({expr}, '{pat}', '', 'g')"


_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "reviews": ((), f"""
        SELECT CAST(doc_id AS BIGINT) AS row_id, text AS review,
               {rating_case('doc_id % 4')} AS rating,
               'source_file' AS target_origin
        FROM documents"""),
    "scored": ((), f"""
        SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, l.l_quantity,
               l.l_extendedprice, l.l_discount, l.l_tax, o.label,
               CAST(CASE WHEN l.l_quantity > 25 THEN o.label ELSE {rating_case('l.l_partkey % 4')} END AS BIGINT) AS pred_a,
               CAST(CASE WHEN l.l_quantity > 40 THEN o.label ELSE {rating_case('l.l_suppkey % 4')} END AS BIGINT) AS pred_b,
               CAST(o.label AS DOUBLE) + l.l_discount AS pred_c
        FROM lineitem l
        JOIN (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS label FROM orders) o
          ON l.l_orderkey = o.o_orderkey
        WHERE o.label <> 3"""),
    "probs_raw": (("scored",), """
        SELECT l_orderkey, l_linenumber, label,
               l_quantity / 10.0 AS x1, l_extendedprice / 30000.0 AS x2,
               l_discount * 20.0 AS x3, l_tax * 20.0 AS x4
        FROM scored"""),
    "probs_max": (("probs_raw",), """
        SELECT *, greatest(x1, x2, x3, x4) AS xm FROM probs_raw"""),
    "probs_exp": (("probs_max",), """
        SELECT l_orderkey, l_linenumber, label,
               exp(x1 - xm) AS e1, exp(x2 - xm) AS e2, exp(x3 - xm) AS e3, exp(x4 - xm) AS e4
        FROM probs_max"""),
    "probs": (("probs_exp",), """
        SELECT l_orderkey, l_linenumber, label,
               e1 / (e1 + e2 + e3 + e4) AS p1, e2 / (e1 + e2 + e3 + e4) AS p2,
               e3 / (e1 + e2 + e3 + e4) AS p3, e4 / (e1 + e2 + e3 + e4) AS p4
        FROM probs_exp"""),
    "head": ((), """
        SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS model_id, CAST(label % 4 AS BIGINT) AS rank,
               CASE WHEN label < 5 THEN 0.5 ELSE -0.5 END AS b,
               list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * ((i - 1) % 5 - 2) / 2.0)) AS z
        FROM embeddings"""),
    "logits": (("head",), "SELECT vec_id, model_id, z + b AS l1, z AS l2, z - b AS l3, rank FROM head"),
    "vectors": ((), """
        SELECT CAST(label AS BIGINT) AS group_id, CAST(vec_id AS BIGINT) AS vec_id, embedding,
               CASE WHEN vec_id % 3 <> 0 THEN 1.0 ELSE 0.0 END AS mask
        FROM embeddings"""),
    "runs": ((), """
        SELECT event_type AS run, ts, CAST(event_id AS BIGINT) AS event_id,
               CAST(value AS DOUBLE) AS eval_mae,
               CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS epoch
        FROM events"""),
    "train_text": ((), f"""
        SELECT CAST(d.doc_id AS BIGINT) AS row_id, d.text AS review,
               {rating_case('l.quality * 2 + (1 - l.toxic)')} AS rating,
               'source_file' AS target_origin
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
}


def add_view(name: str, deps: tuple[str, ...], body: str) -> None:
    _VIEWS[name] = (deps, body)


def with_views(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause for the named views, dependencies first; ``extra`` appended."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({_VIEWS[n][1]})" for n in order]
    for n, body in (extra or {}).items():
        parts.append(f"{n} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
