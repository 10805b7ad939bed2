"""DuckDB text of the metric formulas, for the oracle twins of the queries.

``cells`` names a CTE with ``(group..., true_class, predicted_class, n)``.
"""

from __future__ import annotations


def _g(group_cols):
    return "".join(f"{c}, " for c in group_cols)


def metric_ctes(cells: str, group_cols=(), prefix: str = "m") -> str:
    g = _g(group_cols)
    by = ", ".join([*group_cols, "class"])
    gby = f"GROUP BY {', '.join(group_cols)}" if group_cols else ""
    return f"""
{prefix}_cc AS (SELECT {g}class, sum(sup) AS support, sum(prd) AS predicted, sum(tp) AS tp FROM (
    SELECT {g}true_class AS class, n AS sup, 0 AS prd,
           CASE WHEN true_class = predicted_class THEN n ELSE 0 END AS tp FROM {cells}
    UNION ALL SELECT {g}predicted_class AS class, 0 AS sup, n AS prd, 0 AS tp FROM {cells}) GROUP BY {by}),
{prefix}_pc AS (SELECT {g}class,
    CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
    CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall,
    CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * CAST(tp AS DOUBLE) / (support + predicted) END AS f1,
    CAST(support AS BIGINT) AS support FROM {prefix}_cc),
{prefix}_acc AS (SELECT {g}CAST(sum(CASE WHEN true_class = predicted_class THEN n ELSE 0 END) AS DOUBLE) / sum(n) AS accuracy,
    CAST(sum(n) AS BIGINT) AS n_samples FROM {cells} {gby}),
{prefix}_mac AS (SELECT {g}avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro
    FROM {prefix}_pc {gby}),
{prefix}_sum AS (SELECT {"".join(f"a.{c}, " for c in group_cols)}a.accuracy, m.precision_macro, m.recall_macro,
    m.f1_macro, a.n_samples FROM {prefix}_acc a
    {"JOIN " + prefix + "_mac m USING (" + ", ".join(group_cols) + ")" if group_cols else ", " + prefix + "_mac m"})"""


def long_metrics(summary: str, group_cols=()) -> str:
    g = _g(group_cols)
    parts = [f"SELECT {g}'{m}' AS metric, {m} AS value FROM {summary}"
             for m in ("accuracy", "precision_macro", "recall_macro", "f1_macro")]
    return "\n    UNION ALL ".join(parts)


def md5_u32(expr: str) -> str:
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


def dense_index(src: str, key: str) -> str:
    """Row index ordered by (md5_u32(key), key), as ``bootstrap.dense_index``."""
    return f"(SELECT *, row_number() OVER (ORDER BY {md5_u32(key)}, {key}) - 1 AS row_idx FROM {src})"


def row_draws(n_iter: int, seed: int, idx: str) -> str:
    """``(iteration, draw, row_idx)`` over the dense index CTE ``idx`` — draw j
    of iteration b picks row md5_u32('seed:b:j') mod n."""
    h = md5_u32(f"'{seed}:' || CAST(it.i AS VARCHAR) || ':' || CAST(d.j AS VARCHAR)")
    return (f"(SELECT it.i AS iteration, d.j AS draw, {h} % (SELECT count(*) FROM {idx}) AS row_idx "
            f"FROM range({n_iter}) it(i), (SELECT row_idx AS j FROM {idx}) d)")
