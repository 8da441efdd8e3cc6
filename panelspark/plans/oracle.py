"""DuckDB oracle SQL for the registered queries (same tables, same column names).

Shared CTEs restate the driver-table roles of ``driver_tables`` in SQL.
Doubles are rounded to 4 digits on both sides.
"""

from __future__ import annotations

BASE = """
base AS (
  SELECT o.o_custkey AS entity,
         CASE o.o_orderstatus WHEN 'F' THEN c.c_name WHEN 'O' THEN lower(c.c_name)
              ELSE c.c_name || ' (P)' END AS entity_name,
         CAST(year(o.o_orderdate) AS INTEGER) AS time,
         CASE o.o_orderstatus WHEN 'F' THEN 'worldbank' WHEN 'O' THEN 'oecd' ELSE 'eurostat' END AS source,
         o.o_orderstatus AS st, o.o_totalprice AS price, o.o_orderpriority AS prio
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
),
long AS (
  SELECT entity, entity_name, time,
         CASE st WHEN 'F' THEN 'gini_index' WHEN 'O' THEN 'gini_index_oecd' ELSE 'gini_index_eurostat' END AS indicator,
         (CASE WHEN st = 'O' THEN price / 1e6 ELSE price / 1e4 END)
           * (CASE WHEN source = 'oecd' THEN 1e2 ELSE 1e0 END) AS value,
         source
  FROM base
  UNION ALL
  SELECT entity, entity_name, time, 'priority_level', TRY_CAST(substr(prio, 1, 1) AS DOUBLE), source FROM base
  UNION ALL
  SELECT entity, entity_name, time, 'urgent_share',
         CASE WHEN starts_with(prio, '1-') THEN 1e0 ELSE 0e0 END, source FROM base
)"""

PIVOT = (
    BASE
    + """,
pivoted AS (
  SELECT entity, time,
         avg(value) FILTER (WHERE indicator = 'priority_level') AS priority_level,
         avg(value) FILTER (WHERE indicator = 'urgent_share') AS urgent_share,
         avg(value) FILTER (WHERE indicator = 'gini_index') AS gini_index,
         avg(value) FILTER (WHERE indicator = 'gini_index_oecd') AS gini_index_oecd,
         avg(value) FILTER (WHERE indicator = 'gini_index_eurostat') AS gini_index_eurostat
  FROM long
  WHERE value IS NOT NULL AND entity IS NOT NULL AND time IS NOT NULL
    AND indicator IN ('priority_level', 'urgent_share', 'gini_index', 'gini_index_oecd', 'gini_index_eurostat')
  GROUP BY entity, time
),
coalesced AS (
  SELECT entity, time, priority_level, urgent_share,
         coalesce(gini_index, gini_index_oecd, gini_index_eurostat) AS gini_index,
         CASE WHEN gini_index IS NOT NULL THEN 'gini_index'
              WHEN gini_index_oecd IS NOT NULL THEN 'gini_index_oecd'
              WHEN gini_index_eurostat IS NOT NULL THEN 'gini_index_eurostat' END AS gini_source
  FROM pivoted
),
names AS (
  SELECT entity,
         arg_min(entity_name, (CASE source WHEN 'worldbank' THEN 0 WHEN 'oecd' THEN 1 WHEN 'eurostat' THEN 2
                                           WHEN 'wid' THEN 3 ELSE 4 END, time, entity_name)) AS entity_name
  FROM long WHERE entity_name IS NOT NULL AND entity IS NOT NULL
  GROUP BY entity
),
dim AS (
  SELECT c.c_custkey AS entity, n.n_name AS income_group, r.r_name AS region, c.c_acctbal AS acctbal
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
                  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
panel AS (
  SELECT p.*, nm.entity_name, d.income_group, d.region,
         lag(d.income_group) OVER (PARTITION BY p.entity ORDER BY p.time) AS income_group_lag1,
         lag(p.gini_index) OVER (PARTITION BY p.entity ORDER BY p.time) AS gini_index_lag1,
         d.acctbal
  FROM coalesced p LEFT JOIN names nm ON p.entity = nm.entity LEFT JOIN dim d ON p.entity = d.entity
)"""
)

SQL: dict[str, str] = {}

SQL["long_observations"] = (
    "WITH"
    + BASE
    + """
SELECT entity, entity_name, time, indicator, round((value) * 1e4) / 1e4 AS value, source
FROM long WHERE value IS NOT NULL"""
)

SQL["pivot_mean"] = (
    "WITH"
    + PIVOT
    + """
SELECT entity, time, round((priority_level) * 1e4) / 1e4 AS priority_level, round((urgent_share) * 1e4) / 1e4 AS urgent_share,
       round((gini_index) * 1e4) / 1e4 AS gini_index, round((gini_index_oecd) * 1e4) / 1e4 AS gini_index_oecd,
       round((gini_index_eurostat) * 1e4) / 1e4 AS gini_index_eurostat
FROM pivoted"""
)

SQL["coalesce_provenance"] = (
    "WITH"
    + PIVOT
    + """
SELECT entity, time, round((gini_index) * 1e4) / 1e4 AS gini_index, gini_source FROM coalesced"""
)

SQL["first_by_priority"] = "WITH" + PIVOT + "\nSELECT entity, entity_name FROM names"

SQL["panel_dims"] = (
    "WITH"
    + PIVOT
    + """
SELECT entity, time, entity_name, round((gini_index) * 1e4) / 1e4 AS gini_index, gini_source, income_group, region,
       income_group_lag1, round((gini_index_lag1) * 1e4) / 1e4 AS gini_index_lag1, round((acctbal) * 1e4) / 1e4 AS acctbal
FROM panel"""
)

SQL["latest_nonnull"] = (
    "WITH"
    + PIVOT
    + """
SELECT entity,
       round((arg_max(gini_index, time) FILTER (WHERE gini_index IS NOT NULL)) * 1e4) / 1e4 AS gini_index,
       round((arg_max(gini_index_oecd, time) FILTER (WHERE gini_index_oecd IS NOT NULL)) * 1e4) / 1e4 AS gini_index_oecd,
       round((arg_max(gini_index_eurostat, time) FILTER (WHERE gini_index_eurostat IS NOT NULL)) * 1e4) / 1e4
         AS gini_index_eurostat
FROM pivoted GROUP BY entity"""
)

SQL["outer_panel"] = (
    "WITH"
    + PIVOT
    + """,
li AS (
  SELECT o.o_custkey AS entity, CAST(year(l.l_shipdate) AS INTEGER) AS time,
         avg(l.l_quantity) AS avg_quantity, count(*) AS n_lines
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY 1, 2
)
SELECT coalesce(c.entity, li.entity) AS entity, coalesce(c.time, li.time) AS time,
       round((c.gini_index) * 1e4) / 1e4 AS gini_index, round((li.avg_quantity) * 1e4) / 1e4 AS avg_quantity, li.n_lines
FROM coalesced c FULL OUTER JOIN li ON c.entity = li.entity AND c.time = li.time"""
)

SQL["coverage_filter"] = (
    "WITH"
    + PIVOT
    + """,
ranged AS (SELECT * FROM coalesced WHERE time BETWEEN 1995 AND 2000),
keep AS (SELECT entity FROM ranged GROUP BY entity HAVING count(DISTINCT time) >= 5)
SELECT entity, time, round((gini_index) * 1e4) / 1e4 AS gini_index
FROM ranged WHERE entity IN (SELECT entity FROM keep)"""
)


def r4(expr: str) -> str:
    """SQL twin of ``catalog.rounded``: round(x * 1e4) / 1e4."""
    return f"round(({expr}) * 1e4) / 1e4"


SQL["real_entities"] = """
SELECT o_custkey AS entity, count(*) AS n_orders
FROM orders
WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)
GROUP BY o_custkey"""

CODES = """
WITH raw AS (
  SELECT c_custkey,
         CASE WHEN c_acctbal < 0 THEN 'AGG' || CAST(c_nationkey AS VARCHAR) ELSE CAST(c_nationkey AS VARCHAR) END AS code
  FROM customer
),
std AS (SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS entity FROM nation WHERE n_regionkey <> 0),
ovr AS (SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name || '_OVR' AS entity FROM nation WHERE n_regionkey <= 1),
mapped AS (
  SELECT raw.c_custkey, raw.code, coalesce(ovr.entity, std.entity) AS entity
  FROM raw LEFT JOIN std ON raw.code = std.code LEFT JOIN ovr ON raw.code = ovr.code
)"""

SQL["code_map"] = CODES + "\nSELECT c_custkey, code, entity FROM mapped WHERE entity IS NOT NULL"
SQL["code_map_dropped"] = CODES + "\nSELECT code, count(*) AS n_rows FROM mapped WHERE entity IS NULL GROUP BY code"

CHECKED = """
WITH t AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_quantity,
         l_discount * 100.0 AS discount_pct, l_extendedprice, CAST(l_linenumber AS VARCHAR) AS linenumber_text
  FROM lineitem
),
f AS (
  SELECT *, list_filter([
      CASE WHEN l_returnflag IS NULL OR NOT (length(l_returnflag) BETWEEN 1 AND 1) THEN 'key_length' END,
      CASE WHEN ship_year IS NULL OR NOT (ship_year BETWEEN 1995 AND 2000) THEN 'year_range' END,
      CASE WHEN l_quantity IS NOT NULL AND NOT (l_quantity BETWEEN 1 AND 45) THEN 'quantity_range' END,
      CASE WHEN discount_pct IS NOT NULL AND NOT (discount_pct BETWEEN 0 AND 100) THEN 'discount_pct_range' END,
      CASE WHEN l_extendedprice IS NOT NULL AND NOT (l_extendedprice >= 0) THEN 'price_nonneg' END,
      CASE WHEN linenumber_text IS NOT NULL AND (TRY_CAST(linenumber_text AS DOUBLE) IS NULL
                OR NOT (TRY_CAST(linenumber_text AS DOUBLE) >= 0)) THEN 'linenumber_numeric' END
    ], lambda x: x IS NOT NULL) AS failed
  FROM t
)"""

SQL["quality_kept"] = CHECKED + "\nSELECT l_orderkey, l_linenumber, l_quantity FROM f WHERE len(failed) = 0"

SQL["quality_failures"] = (
    CHECKED
    + """
SELECT rule, l_orderkey, l_linenumber,
       CASE rule WHEN 'key_length' THEN l_returnflag
                 WHEN 'year_range' THEN CAST(ship_year AS VARCHAR)
                 WHEN 'quantity_range' THEN CAST(l_quantity AS VARCHAR)
                 WHEN 'discount_pct_range' THEN CAST(discount_pct AS VARCHAR)
                 WHEN 'price_nonneg' THEN CAST(l_extendedprice AS VARCHAR)
                 WHEN 'linenumber_numeric' THEN linenumber_text END AS value
FROM (SELECT *, unnest(failed) AS rule FROM f WHERE len(failed) > 0)"""
)

SQL["leakage_share"] = (
    "WITH"
    + PIVOT
    + f"""
SELECT 'income_group_lag1' AS feature, 'income_group' AS target,
       {r4("avg(CASE WHEN income_group_lag1 IS NOT DISTINCT FROM income_group THEN 1.0 ELSE 0.0 END)")} AS share_equal,
       count(*) AS n_rows
FROM panel"""
)

IMPUTED = (
    "WITH"
    + PIVOT
    + """,
base_panel AS (SELECT entity, time, gini_index, gini_index_oecd, gini_index_eurostat,
                      CAST(NULL AS DOUBLE) AS missing_feature FROM pivoted),
filled1 AS (
  SELECT entity, time,
         coalesce(gini_index, median(gini_index) OVER (PARTITION BY entity)) AS gini_index,
         coalesce(gini_index_oecd, median(gini_index_oecd) OVER (PARTITION BY entity)) AS gini_index_oecd,
         coalesce(gini_index_eurostat, median(gini_index_eurostat) OVER (PARTITION BY entity)) AS gini_index_eurostat,
         coalesce(missing_feature, median(missing_feature) OVER (PARTITION BY entity)) AS missing_feature
  FROM base_panel
),
g AS (SELECT median(gini_index) AS m1, median(gini_index_oecd) AS m2, median(gini_index_eurostat) AS m3,
             median(missing_feature) AS m4 FROM filled1),
filled AS (
  SELECT entity, time, coalesce(gini_index, m1) AS gini_index, coalesce(gini_index_oecd, m2) AS gini_index_oecd,
         coalesce(gini_index_eurostat, m3) AS gini_index_eurostat, coalesce(missing_feature, m4) AS missing_feature
  FROM filled1, g
)"""
)

SQL["impute_two_level"] = (
    IMPUTED
    + f"""
SELECT entity, time, {r4("gini_index")} AS gini_index, {r4("gini_index_oecd")} AS gini_index_oecd,
       {r4("gini_index_eurostat")} AS gini_index_eurostat, {r4("missing_feature")} AS missing_feature
FROM filled"""
)

SQL["medians"] = (
    IMPUTED
    + f"""
SELECT feature, {r4("median")} AS median FROM (
  SELECT 'gini_index' AS feature, coalesce(median(gini_index), 0.0) AS median FROM filled
  UNION ALL SELECT 'gini_index_oecd', coalesce(median(gini_index_oecd), 0.0) FROM filled
  UNION ALL SELECT 'gini_index_eurostat', coalesce(median(gini_index_eurostat), 0.0) FROM filled
  UNION ALL SELECT 'missing_feature', coalesce(median(missing_feature), 0.0) FROM filled)"""
)

SQL["encode_categories"] = (
    "WITH"
    + PIVOT
    + """,
cats AS (
  SELECT DISTINCT 'region' AS feature, coalesce(region, 'UNKNOWN') AS category FROM panel
  UNION
  SELECT DISTINCT 'income_group_lag1', coalesce(income_group_lag1, 'UNKNOWN') FROM panel
)
SELECT feature, category, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY category) - 1 AS INTEGER) AS code
FROM cats"""
)

SQL["encode_unseen"] = """
WITH train AS (
  SELECT DISTINCT coalesce(nullif(c_mktsegment, 'HOUSEHOLD'), 'UNKNOWN') AS category FROM customer WHERE c_acctbal >= 0
),
m AS (SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS code FROM train),
s AS (
  SELECT c_custkey,
         coalesce(nullif(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, ''), 'UNKNOWN') AS category
  FROM customer
)
SELECT s.c_custkey, s.category, coalesce(m.code, -1) AS code FROM s LEFT JOIN m ON s.category = m.category"""

SQL["label_codes"] = """
SELECT c_custkey, c_mktsegment,
       CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS label_code
FROM customer"""

SQL["group_split"] = (
    "WITH"
    + PIVOT
    + """,
sided AS (
  SELECT entity,
         CASE WHEN (('0x' || substr(md5('42:' || CAST(entity AS VARCHAR)), 1, 8))::BIGINT % 10000) < 2000
              THEN 'test' ELSE 'train' END AS side
  FROM panel WHERE gini_index_lag1 IS NOT NULL
)
SELECT side, count(DISTINCT entity) AS n_entities, count(*) AS n_rows FROM sided GROUP BY side"""
)

PRICE = """
WITH m AS (SELECT l_quantity, avg(l_extendedprice) AS prediction FROM lineitem GROUP BY l_quantity),
s AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag, l.l_extendedprice, l.l_shipdate, m.prediction
  FROM lineitem l JOIN m ON l.l_quantity = m.l_quantity
)"""

SQL["regression_metrics"] = (
    PRICE
    + f"""
SELECT l_returnflag AS target,
       {r4("avg(abs(l_extendedprice - prediction))")} AS mae,
       {r4("1 - sum((l_extendedprice - prediction) * (l_extendedprice - prediction)) / (var_pop(l_extendedprice) * count(*))")} AS r2,
       {r4("stddev_pop(l_extendedprice - prediction)")} AS residual_std,
       count(*) AS n_test,
       count(*) >= 20 AS support_ok
FROM s GROUP BY l_returnflag"""
)

STATUS = """
WITH s AS (
  SELECT o_orderstatus AS y,
         CASE WHEN year(o_orderdate) <= 1997 THEN 'F'
              WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'O' ELSE 'P' END AS p
  FROM orders
),
cm AS (SELECT y, p, count(*) AS n FROM s WHERE y IS NOT NULL GROUP BY y, p),
classes AS (SELECT y AS cls FROM cm UNION SELECT p FROM cm),
rep AS (
  SELECT c.cls,
         coalesce((SELECT sum(n) FROM cm WHERE y = c.cls AND p = c.cls), 0) AS tp,
         coalesce((SELECT sum(n) FROM cm WHERE y = c.cls), 0) AS support,
         coalesce((SELECT sum(n) FROM cm WHERE p = c.cls), 0) AS n_pred
  FROM classes c
),
rep2 AS (
  SELECT cls, support,
         CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
  FROM rep
),
rep3 AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM rep2
)"""

SQL["class_report"] = (
    STATUS
    + f"""
SELECT cls, {r4("precision")} AS precision, {r4("recall")} AS recall, {r4("f1")} AS f1, CAST(support AS BIGINT) AS support
FROM rep3"""
)

SQL["class_metrics"] = (
    STATUS
    + f"""
SELECT {r4("(SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM s WHERE y IS NOT NULL)")} AS accuracy,
       (SELECT count(*) FROM s WHERE y IS NOT NULL) AS n_test,
       {r4("avg(f1)")} AS macro_f1
FROM rep3"""
)

SQL["interval"] = (
    PRICE
    + f""",
sd AS (SELECT l_returnflag, stddev_pop(l_extendedprice - prediction) AS residual_std FROM s GROUP BY l_returnflag)
SELECT l_orderkey, l_linenumber, {r4("prediction")} AS prediction,
       {r4("prediction - 1.28 * residual_std")} AS lo, {r4("prediction + 1.28 * residual_std")} AS hi
FROM s JOIN sd USING (l_returnflag)"""
)

SQL["score_impute"] = f"""
WITH med AS (
  SELECT median(l_discount) AS md, median(l_tax) AS mt FROM lineitem WHERE year(l_shipdate) <= 1998
)
SELECT l_orderkey, l_linenumber,
       {r4("coalesce(nullif(l_discount, 0.0), md, 0.0)")} AS discount,
       {r4("coalesce(nullif(l_tax, 0.0), mt, 0.0)")} AS tax,
       0.0 AS missing_col
FROM lineitem, med WHERE year(l_shipdate) > 1998"""

SQL["null_drop_pooled"] = """
SELECT l_orderkey, l_linenumber, nullif(l_quantity, 1.0) AS quantity
FROM lineitem
WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND nullif(l_quantity, 1.0) IS NOT NULL"""

SQL["run_report"] = (
    "WITH"
    + PIVOT
    + """
SELECT 'time_range' AS step, 'out_of_range' AS reason, CAST(time AS VARCHAR) AS key, count(*) AS n
FROM coalesced WHERE NOT (time BETWEEN 1995 AND 2000) GROUP BY time
UNION ALL
SELECT 'coverage', 'too_few_times', CAST(entity AS VARCHAR), count(DISTINCT time)
FROM coalesced WHERE time BETWEEN 1995 AND 2000 GROUP BY entity HAVING count(DISTINCT time) < 5"""
)

SQL["split_text_fields"] = """
SELECT page_id, lower(trim(split_part(url, ':', 1))) AS scheme, starts_with(url, 'https') AS is_https,
       split_part(url, '/', 3) AS host
FROM pages"""

DRIFT = """
WITH s AS (
  SELECT CASE WHEN year(l_shipdate) <= 1998 THEN 'reference' ELSE 'current' END AS side,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
  FROM lineitem
),
st AS (
  SELECT side, 'l_quantity' AS feature, CAST(l_quantity AS DOUBLE) AS x, CAST(NULL AS VARCHAR) AS cat FROM s
  UNION ALL SELECT side, 'l_extendedprice', l_extendedprice, NULL FROM s
  UNION ALL SELECT side, 'l_discount', l_discount, NULL FROM s
  UNION ALL SELECT side, 'l_tax', l_tax, NULL FROM s
  UNION ALL SELECT side, 'l_returnflag', NULL, l_returnflag FROM s
  UNION ALL SELECT side, 'l_linestatus', NULL, l_linestatus FROM s
),
st2 AS (SELECT * FROM st WHERE x IS NOT NULL OR cat IS NOT NULL),
rng AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM st2 WHERE x IS NOT NULL GROUP BY feature),
b AS (
  SELECT st2.side, st2.feature,
         CASE WHEN st2.x IS NOT NULL THEN CAST(
           CASE WHEN rng.hi - rng.lo > 0
                THEN greatest(least(CAST(floor((st2.x - rng.lo) / (rng.hi - rng.lo) * CAST(10 AS DOUBLE)) AS INTEGER), 9), 0)
                ELSE 0 END AS VARCHAR)
         ELSE st2.cat END AS bin
  FROM st2 LEFT JOIN rng ON st2.feature = rng.feature
),
c AS (SELECT side, feature, bin, count(*) AS n FROM b GROUP BY side, feature, bin),
sh AS (SELECT side, feature, bin, n / sum(n) OVER (PARTITION BY side, feature) AS share FROM c),
j AS (
  SELECT coalesce(r.feature, cu.feature) AS feature,
         greatest(coalesce(cu.share, 0.0), 1e-4) AS p, greatest(coalesce(r.share, 0.0), 1e-4) AS q
  FROM (SELECT * FROM sh WHERE side = 'reference') r
  FULL OUTER JOIN (SELECT * FROM sh WHERE side = 'current') cu ON r.feature = cu.feature AND r.bin = cu.bin
),
ps AS (SELECT feature, sum((p - q) * ln(p / q)) AS psi FROM j GROUP BY feature),
ds AS (
  SELECT CAST(count(*) AS INTEGER) AS n_columns,
         CAST(sum(CASE WHEN psi >= 0.2 THEN 1 ELSE 0 END) AS INTEGER) AS n_drifted,
         avg(CASE WHEN psi >= 0.2 THEN 1.0 ELSE 0.0 END) AS share
  FROM ps
)"""

SQL["psi_columns"] = DRIFT + f"\nSELECT feature, {r4('psi')} AS psi, psi >= 0.2 AS drifted FROM ps"

SQL["psi_dataset"] = (
    DRIFT
    + f"""
SELECT n_columns, n_drifted, {r4('share')} AS share_of_drifted_columns,
       coalesce(share >= 0.5, false) AS dataset_drift
FROM ds"""
)

SQL["drift_on_demand"] = (
    DRIFT
    + f"""
SELECT 'drift_report_' || strftime((SELECT max(l_shipdate) FROM lineitem WHERE year(l_shipdate) > 1998),
                                   '%Y%m%dT%H%M%SZ') || '.html' AS report_name,
       (SELECT count(*) FROM lineitem WHERE year(l_shipdate) > 1998) AS n_current,
       n_columns, n_drifted, {r4('share')} AS share_of_drifted_columns,
       coalesce(share >= 0.5, false) AS dataset_drift
FROM ds"""
)

SQL["drift_eligible"] = """
WITH t AS (
  SELECT year(l_shipdate) <= 1998 AS is_ref, l_quantity, l_discount,
         CASE WHEN year(l_shipdate) <= 1998 THEN l_tax END AS old_tax
  FROM lineitem
),
ref AS (SELECT count(l_quantity) AS a, count(l_discount) AS b, count(old_tax) AS c FROM t WHERE is_ref),
cur AS (SELECT count(l_quantity) AS a, count(l_discount) AS b, count(old_tax) AS c FROM t WHERE NOT is_ref)
SELECT 'l_quantity' AS feature, ref.a AS n_reference, cur.a AS n_current, ref.a > 0 AND cur.a > 0 AS eligible FROM ref, cur
UNION ALL SELECT 'l_discount', ref.b, cur.b, ref.b > 0 AND cur.b > 0 FROM ref, cur
UNION ALL SELECT 'old_tax', ref.c, cur.c, ref.c > 0 AND cur.c > 0 FROM ref, cur"""

BIN_VALUE = (
    "CAST(CASE WHEN hi - lo > 0 THEN greatest(least(CAST(floor((value - lo) / (hi - lo) * CAST(10 AS DOUBLE))"
    " AS INTEGER), 9), 0) ELSE 0 END AS VARCHAR)"
)

REPORTS = f"""
WITH ev AS (
  SELECT ts, value, event_type,
         date_diff('day', (SELECT min(date_trunc('day', ts)) FROM events), date_trunc('day', ts)) AS d
  FROM events
),
ref AS (SELECT * FROM ev WHERE d < 7),
cur AS (SELECT * FROM ev WHERE d >= 7),
rng AS (SELECT min(value) AS lo, max(value) AS hi FROM ref),
rb AS (
  SELECT 'value' AS feature, {BIN_VALUE} AS bin FROM ref, rng WHERE value IS NOT NULL
  UNION ALL SELECT 'event_type', event_type FROM ref WHERE event_type IS NOT NULL
),
rs AS (
  SELECT feature, bin, greatest(count(*) / sum(count(*)) OVER (PARTITION BY feature), 1e-4) AS q
  FROM rb GROUP BY feature, bin
),
cb AS (
  SELECT d, 'value' AS feature, {BIN_VALUE} AS bin FROM cur, rng WHERE value IS NOT NULL
  UNION ALL SELECT d, 'event_type', event_type FROM cur WHERE event_type IS NOT NULL
),
cs AS (
  SELECT d, feature, bin, greatest(count(*) / sum(count(*)) OVER (PARTITION BY d, feature), 1e-4) AS p
  FROM cb GROUP BY d, feature, bin
),
grid AS (SELECT DISTINCT d FROM cs),
allbins AS (SELECT g.d, rs.feature, rs.bin FROM grid g, rs UNION SELECT d, feature, bin FROM cs),
j AS (
  SELECT a.d, a.feature, coalesce(cs.p, 1e-4) AS p, coalesce(rs.q, 1e-4) AS q
  FROM allbins a
  LEFT JOIN cs ON a.d = cs.d AND a.feature = cs.feature AND a.bin = cs.bin
  LEFT JOIN rs ON a.feature = rs.feature AND a.bin = rs.bin
),
psi AS (SELECT d, feature, sum((p - q) * ln(p / q)) AS psi FROM j GROUP BY d, feature),
rep AS (
  SELECT d, CAST(count(*) AS INTEGER) AS n_columns,
         CAST(sum(CASE WHEN psi >= 0.2 THEN 1 ELSE 0 END) AS INTEGER) AS n_drifted,
         avg(CASE WHEN psi >= 0.2 THEN 1.0 ELSE 0.0 END) AS share
  FROM psi GROUP BY d
),
stp AS (SELECT d, max(ts) AS report_ts, count(*) AS n_current FROM cur GROUP BY d),
reports AS (
  SELECT stp.report_ts, 'drift_report_' || strftime(stp.report_ts, '%Y%m%dT%H%M%SZ') || '.html' AS report_name,
         n_current, n_columns, n_drifted, share AS share_of_drifted_columns, share >= 0.5 AS dataset_drift
  FROM rep JOIN stp ON rep.d = stp.d
)"""

SQL["drift_gauges"] = (
    REPORTS
    + f"""
SELECT {r4('share_of_drifted_columns')} AS drift_share_of_columns,
       CAST(dataset_drift AS INTEGER) AS drift_dataset_detected, report_name
FROM reports ORDER BY report_ts DESC, report_name DESC LIMIT 1"""
)

SQL["report_retention"] = (
    REPORTS
    + f"""
SELECT report_name, rank, n_current, {r4('share_of_drifted_columns')} AS share_of_drifted_columns FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY report_ts DESC, report_name DESC) AS INTEGER) AS rank FROM reports
) WHERE rank <= 10"""
)

SQL["scored_log"] = f"""
WITH per AS (SELECT event_type, count(*) AS n_target, avg(value) AS mean_latency FROM events GROUP BY event_type)
SELECT e.event_id, e.event_type, per.n_target, {r4('per.mean_latency')} AS mean_latency
FROM events e JOIN per ON e.event_type = per.event_type"""

WINDOWS = """
WITH w AS (
  SELECT date_trunc('minute', ts) - to_minutes(CAST(k AS BIGINT)) AS ws, event_type, value
  FROM events CROSS JOIN range(0, 5) t(k)
)"""

SQL["rate_5m"] = (
    WINDOWS
    + f"""
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n,
       {r4('count(*) / CAST(300 AS DOUBLE)')} AS rate
FROM w GROUP BY ws, event_type"""
)

SQL["p95_5m"] = (
    WINDOWS
    + f"""
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       {r4('quantile_cont(value, 0.95)')} AS p95, quantile_cont(value, 0.95) > 2.0 AS breach
FROM w GROUP BY ws, event_type"""
)

ERR = (
    WINDOWS
    + """,
er AS (
  SELECT ws, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_error, count(*) AS n
  FROM w GROUP BY ws
)"""
)

SQL["error_ratio_5m"] = (
    ERR
    + f"""
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, n_error, n, {r4('n_error / n')} AS error_ratio,
       n_error / n > 0.1 AS breach
FROM er"""
)

SQL["sustained_alert"] = (
    ERR
    + """,
ev AS (SELECT ws + to_minutes(CAST(k AS BIGINT)) AS e FROM er CROSS JOIN range(0, 5) t(k) WHERE n_error / n > 0.1),
f AS (SELECT e, count(*) AS n_consecutive FROM ev GROUP BY e HAVING count(*) = 5)
SELECT strftime(e, '%Y-%m-%d %H:%M:%S') AS eval_start, n_consecutive,
       NOT EXISTS (SELECT 1 FROM f f2 WHERE f2.e = f.e - INTERVAL 1 MINUTE) AS alert_start
FROM f"""
)

SQL["absence"] = f"""
WITH n AS (SELECT event_type, ts, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS nxt FROM events)
SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS gap_start, strftime(nxt, '%Y-%m-%d %H:%M:%S') AS gap_end,
       {r4('(epoch_us(nxt) - epoch_us(ts)) / 1e6')} AS gap_seconds
FROM n WHERE nxt IS NOT NULL AND epoch_us(nxt) - epoch_us(ts) > 180000000"""

REGISTRY = (
    PRICE
    + """,
reg AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'gini' WHEN 'N' THEN 'mobility' ELSE 'mobility_rank' END AS target,
         CAST(year(l_shipdate) AS INTEGER) AS run, l_extendedprice AS y, prediction AS p
  FROM s
),
regm AS (
  SELECT target, run, avg(abs(y - p)) AS mae,
         1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2,
         stddev_pop(y - p) AS residual_std, count(*) AS n_test
  FROM reg GROUP BY target, run
),
tot AS (SELECT target, count(*) AS n_all FROM reg GROUP BY target),
regm2 AS (SELECT regm.*, tot.n_all - regm.n_test AS n_train FROM regm JOIN tot ON regm.target = tot.target),
os AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS run, o_orderstatus AS y,
         CASE WHEN year(o_orderdate) <= 1997 THEN 'F'
              WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'O' ELSE 'P' END AS p
  FROM orders
),
cm AS (SELECT run, y, p, count(*) AS n FROM os WHERE y IS NOT NULL GROUP BY run, y, p),
classes AS (SELECT run, y AS cls FROM cm UNION SELECT run, p FROM cm),
crep AS (
  SELECT c.run, c.cls,
         coalesce((SELECT sum(n) FROM cm WHERE cm.run = c.run AND y = c.cls AND p = c.cls), 0) AS tp,
         coalesce((SELECT sum(n) FROM cm WHERE cm.run = c.run AND y = c.cls), 0) AS support,
         coalesce((SELECT sum(n) FROM cm WHERE cm.run = c.run AND p = c.cls), 0) AS n_pred
  FROM classes c
),
crep2 AS (
  SELECT run, cls,
         CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS pr,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc
  FROM crep
),
macro AS (
  SELECT run, avg(CASE WHEN pr + rc > 0 THEN 2.0 * pr * rc / (pr + rc) ELSE 0.0 END) AS macro_f1
  FROM crep2 GROUP BY run
),
clsm AS (
  SELECT a.run, a.accuracy, a.n_test, (SELECT count(*) FROM orders) - a.n_test AS n_train, macro.macro_f1
  FROM (SELECT run, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n_test
        FROM os WHERE y IS NOT NULL GROUP BY run) a
  LEFT JOIN macro ON a.run = macro.run
),
metrics AS (
  SELECT target, run AS version, 'r2' AS metric, r2 AS value FROM regm2
  UNION ALL SELECT target, run, 'mae', mae FROM regm2
  UNION ALL SELECT target, run, 'residual_std', residual_std FROM regm2
  UNION ALL SELECT target, run, 'n_test', CAST(n_test AS DOUBLE) FROM regm2
  UNION ALL SELECT target, run, 'n_train', CAST(n_train AS DOUBLE) FROM regm2
  UNION ALL SELECT 'income_group', run, 'accuracy', accuracy FROM clsm
  UNION ALL SELECT 'income_group', run, 'macro_f1', macro_f1 FROM clsm
  UNION ALL SELECT 'income_group', run, 'n_test', CAST(n_test AS DOUBLE) FROM clsm
  UNION ALL SELECT 'income_group', run, 'n_train', CAST(n_train AS DOUBLE) FROM clsm
),
gates AS (
  SELECT * FROM (VALUES ('gini', 'r2', CAST(0.4 AS DOUBLE)), ('mobility', 'r2', CAST(0.15 AS DOUBLE)),
                        ('mobility_rank', 'r2', CAST(0.15 AS DOUBLE)),
                        ('income_group', 'accuracy', CAST(0.7 AS DOUBLE))) t(target, gate_metric, gate_min)
),
versions AS (SELECT DISTINCT target, version FROM metrics),
vg AS (
  SELECT v.target, v.version, g.gate_metric, g.gate_min, m.value AS metric_value
  FROM versions v LEFT JOIN gates g ON v.target = g.target
  LEFT JOIN metrics m ON m.target = v.target AND m.version = v.version AND m.metric = g.gate_metric
),
vp AS (SELECT *, coalesce(metric_value >= gate_min, false) AS passed FROM vg),
stages AS (
  SELECT target, 'panel_' || target AS registered_name, CAST(version AS INTEGER) AS version,
         CASE WHEN passed AND coalesce(max(CAST(passed AS INTEGER)) OVER (
                PARTITION BY target ORDER BY version ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1
              THEN 'Archived' WHEN passed THEN 'Production' ELSE 'Staging' END AS stage,
         gate_metric AS metric, metric_value, gate_min, passed
  FROM vp
)"""
)

SQL["gate_stage"] = (
    REGISTRY
    + f"""
SELECT target, registered_name, version, stage, metric, {r4('metric_value')} AS metric_value,
       {r4('gate_min')} AS gate_min, passed
FROM stages"""
)

SQL["status_upsert"] = (
    REGISTRY
    + f""",
nw AS (SELECT *, max(version) OVER (PARTITION BY target) AS newest FROM stages),
before AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY version DESC) AS rn
    FROM nw WHERE version < newest
  ) WHERE rn = 1
),
new_rows AS (SELECT * FROM nw WHERE version = newest AND target = 'gini'),
upserted AS (
  SELECT target, version, stage, metric_value FROM before WHERE target NOT IN (SELECT target FROM new_rows)
  UNION ALL SELECT target, version, stage, metric_value FROM new_rows
)
SELECT target, version, stage, {r4('metric_value')} AS metric_value FROM upserted"""
)

SQL["run_status"] = (
    REGISTRY
    + """,
outcomes AS (
  SELECT s.version AS run, s.target,
         s.metric_value IS NOT NULL AND coalesce(m.value, 0.0) >= 20 AS ok
  FROM stages s LEFT JOIN metrics m ON m.target = s.target AND m.version = s.version AND m.metric = 'n_test'
)
SELECT run, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n_ok, count(*) AS n_targets,
       CASE WHEN sum(CASE WHEN ok THEN 1 ELSE 0 END) = count(*) THEN 'success'
            WHEN sum(CASE WHEN ok THEN 1 ELSE 0 END) > 0 THEN 'partial_success' ELSE 'failed' END AS status
FROM outcomes GROUP BY run"""
)

SQL["performance_view"] = (
    REGISTRY
    + f""",
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY version DESC) AS rn FROM stages)
  WHERE rn = 1
),
wide AS (
  SELECT target, version,
         max(CASE WHEN metric = 'mae' THEN value END) AS mae,
         max(CASE WHEN metric = 'macro_f1' THEN value END) AS macro_f1,
         CAST(max(CASE WHEN metric = 'n_train' THEN value END) AS BIGINT) AS n_train,
         CAST(max(CASE WHEN metric = 'n_test' THEN value END) AS BIGINT) AS n_test
  FROM metrics GROUP BY target, version
)
SELECT l.target, l.version, l.stage, l.metric, {r4('l.metric_value')} AS metric_value,
       {r4('coalesce(w.mae, w.macro_f1)')} AS second_metric,
       CASE WHEN w.mae IS NOT NULL THEN 'mae' WHEN w.macro_f1 IS NOT NULL THEN 'macro_f1' END AS second_metric_name,
       w.n_train, w.n_test, {r4('l.gate_min')} AS gate_min, l.metric_value < l.gate_min AS quality_alert
FROM latest l LEFT JOIN wide w ON l.target = w.target AND l.version = w.version"""
)

SQL["entity_series"] = (
    "WITH"
    + PIVOT
    + f""",
top AS (SELECT entity FROM coalesced GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 8)
SELECT entity, time, {r4('gini_index')} AS gini_index FROM coalesced WHERE entity IN (SELECT entity FROM top)"""
)

ORDERS_NAMED = "orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"

SQL["flatten_paged"] = f"""
SELECT CAST(o.o_custkey AS VARCHAR) AS entity, c.c_name AS entity_name, CAST(year(o.o_orderdate) AS INTEGER) AS time,
       {r4('o.o_totalprice')} AS value
FROM {ORDERS_NAMED}
WHERE o.o_orderpriority <> '5-LOW' AND o.o_custkey IS NOT NULL AND o.o_totalprice IS NOT NULL"""

SQL["flatten_sdmx"] = f"""
SELECT CAST(o.o_custkey AS VARCHAR) AS entity, c.c_name AS entity_name, o.o_orderstatus AS status,
       CAST(year(o.o_orderdate) AS INTEGER) AS time, {r4('avg(o.o_totalprice)')} AS value
FROM {ORDERS_NAMED}
GROUP BY o.o_custkey, c.c_name, o.o_orderstatus, year(o.o_orderdate)"""

SQL["flatten_jsonstat"] = f"""
SELECT CAST(o.o_custkey AS VARCHAR) AS entity, c.c_name AS entity_name,
       CAST(year(o.o_orderdate) AS INTEGER) AS time, {r4('avg(o.o_totalprice)')} AS value
FROM {ORDERS_NAMED}
GROUP BY o.o_custkey, c.c_name, year(o.o_orderdate)"""

SQL["long_roundtrip"] = SQL["long_observations"]

SQL["panel_roundtrip"] = (
    "WITH"
    + PIVOT
    + f"""
SELECT entity, time, {r4('priority_level')} AS priority_level, {r4('urgent_share')} AS urgent_share,
       {r4('gini_index')} AS gini_index, gini_source
FROM coalesced"""
)

SQL["absent_source"] = (
    "WITH"
    + BASE
    + f"""
SELECT source, count(*) AS n_rows, {r4('sum(value)')} AS total_value FROM long GROUP BY source"""
)

SQL["entity_dimension"] = """
SELECT c.c_custkey AS entity, c.c_name AS entity_name, n.n_name AS income_group, r.r_name AS region
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE c.c_acctbal >= 0"""

SQL["sniffed_csv"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"

SQL["cohort_csv"] = f"""
SELECT n.n_name AS entity,
       {r4('arg_max(c.c_acctbal / 1e4, c.c_custkey)')} AS intergen_income_elasticity,
       {r4('arg_max(c.c_acctbal / 2e4, c.c_custkey)')} AS intergen_rank_correlation
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE c.c_mktsegment <> 'AUTOMOBILE'
GROUP BY n.n_name"""

SQL["stream_rate"] = (
    WINDOWS
    + f"""
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n,
       {r4('count(*) / CAST(300 AS DOUBLE)')} AS rate
FROM w
WHERE ws + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
GROUP BY ws, event_type"""
)

SQL["stream_sustained"] = f"""
SELECT eval_start, n_consecutive FROM ({SQL["sustained_alert"]})
WHERE strptime(eval_start, '%Y-%m-%d %H:%M:%S') + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""

SQL["stream_sessions"] = """
WITH e AS (
  SELECT event_type, ts,
         CASE WHEN lag(ts) OVER (PARTITION BY event_type ORDER BY ts) IS NULL
                OR ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 3 MINUTE
              THEN 1 ELSE 0 END AS new_session
  FROM events
),
g AS (
  SELECT event_type, ts,
         sum(new_session) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid
  FROM e
),
s AS (
  SELECT event_type, sid, min(ts) AS st, max(ts) + INTERVAL 3 MINUTE AS en, count(*) AS n
  FROM g GROUP BY event_type, sid
)
SELECT event_type, strftime(st, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(en, '%Y-%m-%d %H:%M:%S') AS session_end,
       n AS n_events
FROM s WHERE en <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""

SQL["open_absence"] = f"""
WITH last AS (SELECT event_type, max(ts) AS last_ts FROM events GROUP BY event_type)
SELECT event_type, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_seen,
       {r4("(epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_ts)) / 1e6")} AS silent_seconds
FROM last WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_ts) > 180000000"""

SQL["latency_alert"] = (
    WINDOWS
    + """,
pw AS (SELECT ws, quantile_cont(value, 0.95) AS p95 FROM w GROUP BY ws),
ev AS (SELECT ws + to_minutes(CAST(k AS BIGINT)) AS e FROM pw CROSS JOIN range(0, 5) t(k) WHERE p95 > 2.0),
f AS (SELECT e, count(*) AS n_consecutive FROM ev GROUP BY e HAVING count(*) = 5)
SELECT strftime(e, '%Y-%m-%d %H:%M:%S') AS eval_start, n_consecutive,
       NOT EXISTS (SELECT 1 FROM f f2 WHERE f2.e = f.e - INTERVAL 1 MINUTE) AS alert_start
FROM f"""
)


def _psi_bin(alias: str) -> str:
    return f"""CASE WHEN {alias}.x IS NOT NULL THEN CAST(
           CASE WHEN rng.hi - rng.lo > 0
                THEN greatest(least(CAST(floor(({alias}.x - rng.lo) / (rng.hi - rng.lo) * CAST(10 AS DOUBLE)) AS INTEGER), 9), 0)
                ELSE 0 END AS VARCHAR)
         ELSE {alias}.cat END"""


# T4 + D4: a report per 20 rows in (ts, event_id) order against the first week; bins from the reference
SQL["stream_drift_20"] = f"""
WITH ev AS (SELECT event_id, ts, value, event_type FROM events),
fd AS (SELECT min(date_trunc('day', ts)) AS d FROM ev),
ref AS (SELECT value, event_type FROM ev, fd WHERE date_diff('day', fd.d, date_trunc('day', ev.ts)) < 7),
rst AS (
  SELECT 'value' AS feature, CAST(value AS DOUBLE) AS x, CAST(NULL AS VARCHAR) AS cat FROM ref
  UNION ALL SELECT 'event_type', NULL, event_type FROM ref
),
rs AS (SELECT * FROM rst WHERE x IS NOT NULL OR cat IS NOT NULL),
rng AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM rs WHERE x IS NOT NULL GROUP BY feature),
rb AS (SELECT rs.feature, {_psi_bin("rs")} AS bin FROM rs LEFT JOIN rng ON rs.feature = rng.feature),
rc AS (SELECT feature, bin, count(*) AS n FROM rb GROUP BY feature, bin),
rq AS (SELECT feature, bin, greatest(n / sum(n) OVER (PARTITION BY feature), 1e-4) AS q FROM rc),
aa AS (SELECT feature, sum((1e-4 - q) * ln(1e-4 / q)) AS absent_all FROM rq GROUP BY feature),
num AS (SELECT value, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM ev),
cur AS (
  SELECT CAST(floor(seq / 20) AS BIGINT) AS block, value, event_type FROM num
  WHERE floor(seq / 20) < (SELECT count(*) // 20 FROM ev)
),
cst AS (
  SELECT block, 'value' AS feature, CAST(value AS DOUBLE) AS x, CAST(NULL AS VARCHAR) AS cat FROM cur
  UNION ALL SELECT block, 'event_type', NULL, event_type FROM cur
),
cs AS (SELECT * FROM cst WHERE x IS NOT NULL OR cat IS NOT NULL),
cb AS (SELECT cs.block, cs.feature, {_psi_bin("cs")} AS bin FROM cs LEFT JOIN rng ON cs.feature = rng.feature),
cc AS (SELECT block, feature, bin, count(*) AS n FROM cb GROUP BY block, feature, bin),
cp AS (SELECT block, feature, bin, greatest(n / sum(n) OVER (PARTITION BY block, feature), 1e-4) AS p FROM cc),
per AS (
  SELECT cp.block, cp.feature,
         sum((cp.p - coalesce(rq.q, 1e-4)) * ln(cp.p / coalesce(rq.q, 1e-4))) AS present,
         sum(coalesce((1e-4 - rq.q) * ln(1e-4 / rq.q), 0.0)) AS absent_seen
  FROM cp LEFT JOIN rq ON cp.feature = rq.feature AND cp.bin = rq.bin
  GROUP BY cp.block, cp.feature
),
ps AS (SELECT per.block, per.present + aa.absent_all - per.absent_seen >= 0.2 AS drifted
       FROM per LEFT JOIN aa ON per.feature = aa.feature)
SELECT block AS report_no, CAST(20 AS INTEGER) AS n_rows, CAST(count(*) AS INTEGER) AS n_columns,
       CAST(sum(CAST(drifted AS INTEGER)) AS INTEGER) AS n_drifted,
       {r4("avg(CAST(drifted AS DOUBLE))")} AS share_of_drifted_columns,
       avg(CAST(drifted AS DOUBLE)) >= 0.5 AS dataset_drift
FROM ps GROUP BY block"""

# T2 stream: percentile_approx(value, 0.95, 10000) keeps every value while a group holds fewer than
# 5,000 of them (no sketch compression below 2 * count / 10000 < 1), and then returns the value at
# 1-based rank ceil(0.95 * n); the windows of the test scales are far below that size.
SQL["stream_p95"] = (
    WINDOWS
    + f""",
closed AS (
  SELECT * FROM w WHERE ws + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
),
g AS (SELECT ws, event_type, count(value) AS n FROM closed GROUP BY ws, event_type),
r AS (
  SELECT ws, event_type, value, row_number() OVER (PARTITION BY ws, event_type ORDER BY value) AS rn
  FROM closed WHERE value IS NOT NULL
)
SELECT strftime(g.ws, '%Y-%m-%d %H:%M:%S') AS window_start, g.event_type, {r4('r.value')} AS p95
FROM g LEFT JOIN r
  ON r.ws = g.ws AND r.event_type = g.event_type
 AND r.rn = greatest(CAST(ceil(CAST(0.95 AS DOUBLE) * g.n) AS BIGINT), 1)"""
)


# The same SQL over a table in which the cells that hold NaN on the Spark side are null.
SQL["registry_state"] = SQL["status_upsert"]
SQL["psi_nan"] = (
    "WITH li AS (SELECT CASE WHEN l_orderkey % 3 = 0 OR (l_orderkey % 3 = 1 AND year(l_shipdate) <= 1998) THEN NULL ELSE l_tax END AS x, year(l_shipdate) <= 1998 AS ref FROM lineitem),\n"
    "r AS (SELECT min(x) AS lo, max(x) AS hi, count(x) FILTER (ref) AS nq, count(x) FILTER (NOT ref) AS np FROM li),\n"
    "b AS (SELECT greatest(least(floor((x - lo) / (hi - lo) * 10.0), 9), 0) AS bin, ref, nq, np FROM li, r WHERE x IS NOT NULL),\n"
    "s AS (SELECT bin, greatest(count(*) FILTER (NOT ref) / any_value(np), 0.0001) AS p, greatest(count(*) FILTER (ref) / any_value(nq), 0.0001) AS q "
    "FROM b GROUP BY bin),\n"
    "t AS (SELECT sum((p - q) * ln(p / q)) AS psi FROM s)\n"
    f"SELECT 'l_tax' AS feature, {r4('psi')} AS psi, psi >= 0.2 AS drifted FROM t"
)
SQL["p95_null_key"] = (
    "WITH events AS (SELECT * REPLACE (nullif(event_type, 'view') AS event_type, "
    "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value) FROM events)\n" + SQL["p95_5m"].lstrip().replace("WITH ", ", ", 1)
    if SQL["p95_5m"].lstrip().startswith("WITH ")
    else "WITH events AS (SELECT * REPLACE (nullif(event_type, 'view') AS event_type, "
    "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value) FROM events)\n" + SQL["p95_5m"]
)
SQL["nan_panel"] = (
    "WITH p AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS time, "
    "avg(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END) AS price FROM orders GROUP BY ALL),\n"
    "k AS (SELECT * FROM p WHERE price IS NULL OR price >= 50000),\n"
    "f AS (SELECT entity, time, coalesce(price, median(price) OVER (PARTITION BY entity)) AS price FROM k)\n"
    f"SELECT entity, time, {r4('coalesce(price, (SELECT median(price) FROM f))')} AS price FROM f"
)
