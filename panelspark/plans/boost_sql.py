"""DuckDB SQL of the boosted trees: every level and round as CTEs."""

from __future__ import annotations

from .boost_queries import DEPTH, EDGES, FEATURES, PENALTY, RATE, ROUNDS
from .oracle import SQL


LINE_ITEMS = """
li AS MATERIALIZED (SELECT row_number() OVER () AS i, l_orderkey, l_linenumber, true AS train, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount,
    CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) AS DOUBLE) AS ship_month, CAST(l_extendedprice / 1000 AS DOUBLE) AS price, l_returnflag AS flag FROM lineitem)"""


def boosted(classes: bool, li: str = LINE_ITEMS, columns: list[str] = FEATURES, edges: list[list[float]] = EDGES) -> str:
    """CTEs that end in ``state``: (i, id, line, k, t, b, m) with the margin m of every row and class; rows of ``train`` decide."""
    bins = ", ".join(f"len(list_filter({e}, lambda e: {c} > e))" for c, e in zip(columns, edges, strict=True))
    out = f"""{li},
kinds AS (SELECT {"flag AS k FROM li WHERE flag IS NOT NULL GROUP BY flag" if classes else "'' AS k"}),
state0 AS MATERIALIZED (SELECT i, train, l_orderkey, l_linenumber, k, [{bins}] AS b,
    {"CASE WHEN flag = k THEN 1e0 ELSE 0e0 END AS t, 0e0 AS m" if classes else "price AS t, (SELECT avg(price) FROM li WHERE train) AS m"} FROM li, kinds)"""
    for r in range(ROUNDS):
        if classes:
            grad = """greatest(2 * p * (1 - p), 1e-16) AS h, p - t AS g FROM (SELECT *, exp(m - top) / sum(exp(m - top)) OVER one AS p
        FROM (SELECT *, max(m) OVER (PARTITION BY i) AS top FROM state{r}) WINDOW one AS (PARTITION BY i))""".replace("{r}", str(r))
        else:
            grad = f"1e0 AS h, m - t AS g FROM state{r}"
        out += f""",
n{r}_0 AS MATERIALIZED (SELECT i, train, l_orderkey, l_linenumber, k, b, t, m, 0 AS node, {grad})"""
        for d in range(DEPTH):
            p = f"n{r}_{d}"
            out += f""",
hist{r}_{d} AS (SELECT k, node, f, b[f] AS bin, sum(g) AS g, sum(h) AS h FROM {p}, range(1, {len(edges) + 1}) AS x(f) WHERE train GROUP BY ALL),
cum{r}_{d} AS (SELECT k, node, f, bin, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER a AS gt, sum(h) OVER a AS ht
    FROM hist{r}_{d} WINDOW o AS (PARTITION BY k, node, f ORDER BY bin), a AS (PARTITION BY k, node, f)),
best{r}_{d} AS (SELECT k, node, f, bin FROM (SELECT *, gl * gl / (hl + {PENALTY}) + (gt - gl) * (gt - gl) / (ht - hl + {PENALTY}) - gt * gt / (ht + {PENALTY}) AS gain FROM cum{r}_{d})
    WHERE hl >= 1 AND ht - hl >= 1 AND gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, bin) = 1),
n{r}_{d + 1} AS MATERIALIZED (SELECT n.* REPLACE (CASE WHEN s.f IS NULL THEN n.node ELSE n.node * 2 + 1 + CAST(b[s.f] > s.bin AS INT) END AS node)
    FROM {p} n LEFT JOIN best{r}_{d} s ON n.k = s.k AND n.node = s.node)"""
        out += f""",
w{r} AS (SELECT k, node, -{RATE} * sum(g) / (sum(h) + {PENALTY}) AS w FROM n{r}_{DEPTH} WHERE train GROUP BY k, node),
state{r + 1} AS MATERIALIZED (SELECT i, train, l_orderkey, l_linenumber, n.k, b, t, m + coalesce(w, 0) AS m FROM n{r}_{DEPTH} n LEFT JOIN w{r} ON n.k = w{r}.k AND n.node = w{r}.node)"""
    return out + f",\nstate AS (SELECT * FROM state{ROUNDS})"


SQL["boost_regress"] = f"WITH {boosted(False)} SELECT l_orderkey, l_linenumber, round(m * 1e4) / 1e4 AS prediction FROM state"
SQL["boost_classify"] = f"""WITH {boosted(True)},
scored AS (SELECT *, exp(m) / sum(exp(m)) OVER (PARTITION BY i) AS p FROM state)
SELECT l_orderkey, l_linenumber, arg_max(k, (m, -ascii(k))) AS predicted_flag, round(min_by(p, k) * 1e4) / 1e4 AS p_first FROM scored GROUP BY i, l_orderkey, l_linenumber"""
