"""Equivalent SQL for every query whose result SQL can state."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["scan_profile"] = """
SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids, min(o_orderkey) AS min_id,
max(o_orderkey) AS max_id, count(DISTINCT o_orderpriority) AS n_categories FROM orders
"""

ORACLE_SQL["label_split"] = """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS label
FROM orders WHERE o_orderkey % 5 <> 0
"""

ORACLE_SQL["drop_columns"] = """
SELECT event_id, user_id, event_type, value FROM events
"""

ORACLE_SQL["feature_ratio"] = """
SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_tax, 0.0E0) AS ratio FROM lineitem
"""

ORACLE_SQL["feature_rate"] = """
SELECT l_orderkey, l_linenumber, l_quantity / (l_linenumber + 1) AS rate FROM lineitem
"""

ORACLE_SQL["feature_flag"] = """
SELECT l_orderkey, l_linenumber, CAST(l_discount > 0.08E0 AS INT) AS late_flag FROM lineitem
"""

ORACLE_SQL["feature_interaction"] = """
SELECT l_orderkey, l_linenumber, l_quantity * l_discount AS interaction FROM lineitem
"""

ORACLE_SQL["category_index"] = """
WITH d AS (SELECT c, CAST(row_number() OVER (ORDER BY c) - 1 AS INT) AS i FROM (SELECT DISTINCT
CAST(o_custkey AS STRING) AS c FROM orders WHERE o_orderkey % 5 <> 0) q), n AS (SELECT
CAST(count(*) AS INT) AS k FROM d) SELECT o.o_orderkey AS id, coalesce(d.i, n.k) AS category_idx
FROM orders o CROSS JOIN n LEFT JOIN d ON CAST(o.o_custkey AS STRING) = d.c
"""

ORACLE_SQL["one_hot"] = """
WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN ''
ELSE o_orderpriority END AS c FROM orders WHERE o_orderkey % 5 = 0) SELECT id,
CAST(c = '1-URGENT' AS INT) AS "priority_1-URGENT", CAST(c = '2-HIGH' AS INT) AS
"priority_2-HIGH", CAST(c = '3-MEDIUM' AS INT) AS "priority_3-MEDIUM", CAST(c = '4-NOT SPECIFIED' AS INT) AS "priority_4-NOT SPECIFIED", CAST(c = '5-LOW' AS INT) AS "priority_5-LOW"
FROM t
"""

ORACLE_SQL["one_hot_align"] = """
WITH a AS (SELECT DISTINCT CAST(o_custkey AS STRING) AS c FROM orders WHERE o_orderkey % 5 <>
0), b AS (SELECT DISTINCT CAST(o_custkey AS STRING) AS c FROM orders WHERE o_orderkey % 5 = 0)
SELECT coalesce(a.c, b.c) AS category, CASE WHEN b.c IS NULL THEN 'zero_fill' WHEN a.c IS NULL
THEN 'drop' ELSE 'keep' END AS action FROM a FULL OUTER JOIN b ON a.c = b.c
"""

ORACLE_SQL["ordered_target_stat"] = """
WITH t AS (SELECT o_orderkey, CAST(o_custkey AS STRING) AS c, CASE WHEN o_orderstatus = 'F' THEN
1 ELSE 0 END AS y, md5(concat('96:', CAST(o_orderkey AS STRING))) AS h FROM orders WHERE
o_orderkey % 5 <> 0) SELECT o_orderkey AS id, (coalesce(sum(y) OVER (PARTITION BY c ORDER BY h,
o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5E0) / (count(y) OVER
(PARTITION BY c ORDER BY h, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1) AS
stat FROM t
"""

ORACLE_SQL["target_stat_apply"] = """
WITH g AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS s, count(*)
AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_custkey) SELECT o.o_orderkey AS id,
(coalesce(g.s, 0) + 0.5E0) / (coalesce(g.n, 0) + 1) AS stat FROM orders o LEFT JOIN g ON
o.o_custkey = g.o_custkey WHERE o.o_orderkey % 5 = 0
"""

ORACLE_SQL["stratified_folds"] = """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
md5(concat('96:', CAST(o_orderkey AS STRING))) AS h FROM orders) SELECT o_orderkey AS id,
CAST((row_number() OVER (ORDER BY y, h, o_orderkey) - 1) % 5 AS INT) AS fold FROM t
"""

ORACLE_SQL["fold_class_counts"] = """
WITH t AS (SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS y,
md5(concat('96:', CAST(o_orderkey AS STRING))) AS h FROM orders), f AS (SELECT y,
CAST((row_number() OVER (ORDER BY y, h, o_orderkey) - 1) % 5 AS INT) AS fold FROM t) SELECT
fold, y AS label, count(*) AS n FROM f GROUP BY fold, y
"""

ORACLE_SQL["fold_split"] = """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
md5(concat('96:', CAST(o_orderkey AS STRING))) AS h FROM orders), f AS (SELECT
CAST((row_number() OVER (ORDER BY y, h, o_orderkey) - 1) % 5 AS INT) AS fold FROM t) SELECT
k.fold AS fold, CAST(sum(CASE WHEN f.fold <> k.fold THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
CAST(sum(CASE WHEN f.fold = k.fold THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM f CROSS JOIN
(SELECT DISTINCT fold FROM f) k GROUP BY k.fold
"""

ORACLE_SQL["roc_auc"] = """
WITH s AS (SELECT (o_orderkey * 37 % 101) / 101.0E0 AS s, CASE WHEN o_orderstatus = 'F' THEN 1
ELSE 0 END AS y FROM orders), g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY s), c
AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1
PRECEDING), 0) AS b FROM g) SELECT round(sum(p * (b + 0.5E0 * n)) / (CAST(sum(p) AS DOUBLE) *
CAST(sum(n) AS DOUBLE)), 6) AS auc FROM c
"""

ORACLE_SQL["roc_auc_by_fold"] = """
WITH t AS (SELECT (o_orderkey * 37 % 101) / 101.0E0 AS s, o_orderkey, CASE WHEN o_orderstatus =
'F' THEN 1 ELSE 0 END AS y, md5(concat('96:', CAST(o_orderkey AS STRING))) AS h FROM orders), f
AS (SELECT s, y, CAST((row_number() OVER (ORDER BY y, h, o_orderkey) - 1) % 5 AS INT) AS fold
FROM t), g AS (SELECT fold, s, sum(y) AS p, sum(1 - y) AS n FROM f GROUP BY fold, s), c AS
(SELECT fold, p, n, coalesce(sum(n) OVER (PARTITION BY fold ORDER BY s ROWS BETWEEN UNBOUNDED
PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT fold, round(sum(p * (b + 0.5E0 * n)) /
(CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)), 6) AS auc FROM c GROUP BY fold
"""

ORACLE_SQL["cv_summary"] = """
WITH t AS (SELECT (o_orderkey * 37 % 101) / 101.0E0 AS s, o_orderkey, CASE WHEN o_orderstatus =
'F' THEN 1 ELSE 0 END AS y, md5(concat('96:', CAST(o_orderkey AS STRING))) AS h FROM orders), f
AS (SELECT s, y, CAST((row_number() OVER (ORDER BY y, h, o_orderkey) - 1) % 5 AS INT) AS fold
FROM t), g AS (SELECT fold, s, sum(y) AS p, sum(1 - y) AS n FROM f GROUP BY fold, s), c AS
(SELECT fold, p, n, coalesce(sum(n) OVER (PARTITION BY fold ORDER BY s ROWS BETWEEN UNBOUNDED
PRECEDING AND 1 PRECEDING), 0) AS b FROM g), a AS (SELECT fold, sum(p * (b + 0.5E0 * n)) /
(CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS auc FROM c GROUP BY fold) SELECT
round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc FROM a
"""

ORACLE_SQL["ensemble_mean"] = """
WITH a AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 101) / 101.0E0 AS p FROM orders), b AS
(SELECT o_orderkey AS id, (o_orderkey * 53 % 97) / 97.0E0 AS p FROM orders WHERE o_orderkey % 10
<> 3) SELECT a.id AS id, (a.p + b.p) / 2 AS p FROM a JOIN b ON a.id = b.id
"""

ORACLE_SQL["id_coverage"] = """
WITH b AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> 3) SELECT o_orderkey AS
id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM b)
"""

ORACLE_SQL["linear_score"] = """
SELECT doc_id AS id, round(1.0E0 / (1.0E0 + exp(-(0.5E0 - 0.001E0 * n_chars))), 9) AS p FROM
documents
"""

ORACLE_SQL["run_leaderboard"] = """
WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, (o_orderkey * 37 % 101)
/ 101.0E0 AS a, (o_orderkey * 53 % 97) / 97.0E0 AS b FROM orders), r AS (SELECT 'a' AS run, y, a
AS s FROM s UNION ALL SELECT 'b', y, b FROM s UNION ALL SELECT 'blend', y, round((a + b) / 2, 9)
FROM s), g AS (SELECT run, s, sum(y) AS p, sum(1 - y) AS n FROM r GROUP BY run, s), c AS (SELECT
run, p, n, coalesce(sum(n) OVER (PARTITION BY run ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
AND 1 PRECEDING), 0) AS b FROM g) SELECT run, round(sum(p * (b + 0.5E0 * n)) / (CAST(sum(p) AS
DOUBLE) * CAST(sum(n) AS DOUBLE)), 6) AS auc FROM c GROUP BY run
"""

ORACLE_SQL["logistic_base_rate"] = """
SELECT round(avg(CAST(quality AS DOUBLE)), 3) AS mean_p FROM labels
"""

ORACLE_SQL["importance_control"] = """
SELECT 'constant_one' AS feature, CAST(0 AS DOUBLE) AS importance
"""

ORACLE_SQL["csv_scan"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders
"""

ORACLE_SQL["bundle_check"] = """
SELECT 'train' AS role, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids, count(*) -
count(o_orderkey) AS n_null_ids, CAST(0 AS BIGINT) AS n_wrong_labels, '' AS missing_columns, ''
AS extra_columns FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'test', count(*),
count(DISTINCT o_orderkey), count(*) - count(o_orderkey), CAST(0 AS BIGINT), '', '' FROM orders
WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'sample', count(*), count(DISTINCT o_orderkey),
count(*) - count(o_orderkey), CAST(0 AS BIGINT), '', '' FROM orders WHERE o_orderkey % 5 = 0
"""

ORACLE_SQL["prediction_join"] = """
WITH a AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 101) / 101.0E0 AS p FROM orders), b AS
(SELECT o_orderkey AS id, (o_orderkey * 53 % 97) / 97.0E0 AS p FROM orders WHERE o_orderkey % 10
<> 3) SELECT a.id AS id, a.p AS p, b.p AS p_lgb FROM a JOIN b ON a.id = b.id
"""

ORACLE_SQL["submission_sink"] = """
SELECT doc_id AS id, round(1.0E0 / (1.0E0 + exp(-(0.5E0 - 0.001E0 * n_chars))), 9) AS p FROM
documents
"""

ORACLE_SQL["stump_score"] = """
WITH t AS (SELECT l.doc_id AS id, d.n_chars > 1000 AS long, CAST(l.quality AS DOUBLE) AS y FROM
labels l JOIN documents d ON l.doc_id = d.doc_id), g AS (SELECT long, avg(y) AS rate FROM t
GROUP BY long) SELECT t.id AS id, round(1.0E0 / (1.0E0 + exp(-2.0E0 * (2.0E0 * g.rate -
1.0E0))), 9) AS p FROM t JOIN g ON t.long = g.long
"""

ORACLE_SQL["table_shape"] = """
SELECT c.position, c."column", c.dtype, count(*) AS n_rows FROM orders, (VALUES (0,
'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'), (3,
'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority',
'string')) c(position, "column", dtype) GROUP BY ALL
"""

ORACLE_SQL["duplicate_ids"] = """
SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
"""

ORACLE_SQL["fold_target_stats"] = """
WITH t AS (SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS c, CASE WHEN o_orderstatus =
'F' THEN 1 ELSE 0 END AS y, md5(concat('96:', CAST(o_orderkey AS STRING))) AS h FROM orders), f
AS (SELECT id, c, y, h, CAST((row_number() OVER (ORDER BY y, h, id) - 1) % 5 AS INT) AS fold
FROM t), k AS (SELECT DISTINCT fold AS held_out FROM f), x AS (SELECT id, c, h, fold, held_out,
CASE WHEN fold <> held_out THEN y ELSE 0 END AS s, CASE WHEN fold <> held_out THEN 1 ELSE 0 END
AS n FROM f CROSS JOIN k), w AS (SELECT id, fold, held_out, sum(s) OVER (PARTITION BY held_out,
c) AS s_all, sum(n) OVER (PARTITION BY held_out, c) AS n_all, coalesce(sum(s) OVER (PARTITION BY
held_out, c ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_run,
coalesce(sum(n) OVER (PARTITION BY held_out, c ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING
AND 1 PRECEDING), 0) AS n_run FROM x) SELECT id, held_out, CASE WHEN fold = held_out THEN (s_all
+ 0.5E0) / (n_all + 1) ELSE (s_run + 0.5E0) / (n_run + 1) END AS stat FROM w
"""

ORACLE_SQL["one_hot_rate"] = """
SELECT d.lang AS lang, round(avg(CAST(l.quality AS DOUBLE)), 5) AS mean_p FROM labels l JOIN
documents d ON l.doc_id = d.doc_id GROUP BY d.lang
"""

ORACLE_SQL["nominal_stump_score"] = """
WITH t AS (SELECT l.doc_id AS id, d.lang AS lang, 2.0E0 * l.quality - 1.0E0 AS y FROM labels l
JOIN documents d ON l.doc_id = d.doc_id), g AS (SELECT lang, count(*) AS n, sum(y) AS s FROM t
GROUP BY lang), o AS (SELECT lang, n, s, row_number() OVER (ORDER BY s / n, lang) AS place FROM
g), c AS (SELECT place, sum(n) OVER (ORDER BY place) AS nl, sum(s) OVER (ORDER BY place) AS sl,
sum(n) OVER () AS nt, sum(s) OVER () AS st FROM o), b AS (SELECT place AS cut FROM c WHERE nl <
nt ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC LIMIT 1), m AS (SELECT o.place
<= b.cut AS below, sum(o.s) / sum(o.n) AS mean FROM o CROSS JOIN b GROUP BY o.place <= b.cut)
SELECT t.id AS id, round(1.0E0 / (1.0E0 + exp(-2.0E0 * m.mean)), 9) AS p FROM t JOIN o ON t.lang
= o.lang CROSS JOIN b JOIN m ON m.below = (o.place <= b.cut)
"""

ORACLE_SQL["out_of_fold_stump"] = """
WITH t AS (SELECT l.doc_id AS id, CAST(l.quality AS INT) AS y, CAST(d.n_chars > 1000 AS INT) AS
long, CAST(d.lang = 'en' AS INT) AS english, md5(concat('96:', CAST(l.doc_id AS STRING))) AS h
FROM labels l JOIN documents d ON l.doc_id = d.doc_id), f AS (SELECT id, y, long, english,
CAST((row_number() OVER (ORDER BY y, h, id) - 1) % 5 AS INT) AS fold FROM t), k AS (SELECT
DISTINCT fold FROM f), r AS (SELECT k.fold AS fold, f.long AS long, avg(CAST(f.y AS DOUBLE)) AS
rate FROM f CROSS JOIN k WHERE f.fold <> k.fold GROUP BY k.fold, f.long) SELECT f.id AS id,
f.fold AS fold, f.y AS label, round(1.0E0 / (1.0E0 + exp(-2.0E0 * (2.0E0 * r.rate - 1.0E0))), 9)
AS p FROM f JOIN r ON f.fold = r.fold AND f.long = r.long
"""

ORACLE_SQL["cv_gbt"] = """
WITH t AS (SELECT l.doc_id AS id, CAST(l.quality AS INT) AS y, CAST(d.n_chars > 1000 AS INT) AS
long, CAST(d.lang = 'en' AS INT) AS english, md5(concat('96:', CAST(l.doc_id AS STRING))) AS h
FROM labels l JOIN documents d ON l.doc_id = d.doc_id), f AS (SELECT id, y, long, english,
CAST((row_number() OVER (ORDER BY y, h, id) - 1) % 5 AS INT) AS fold FROM t), k AS (SELECT
DISTINCT fold FROM f), r AS (SELECT k.fold AS fold, f.long AS long, avg(CAST(f.y AS DOUBLE)) AS
rate FROM f CROSS JOIN k WHERE f.fold <> k.fold GROUP BY k.fold, f.long), s AS (SELECT f.fold AS
fold, f.y AS y, r.rate AS s FROM f JOIN r ON f.fold = r.fold AND f.long = r.long), g AS (SELECT
fold, s, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY fold, s), c AS (SELECT fold, p, n,
coalesce(sum(n) OVER (PARTITION BY fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1
PRECEDING), 0) AS b FROM g) SELECT fold, round(sum(p * (b + 0.5E0 * n)) / (CAST(sum(p) AS
DOUBLE) * CAST(sum(n) AS DOUBLE)), 6) AS auc FROM c GROUP BY fold
"""

ORACLE_SQL["ablation"] = """
WITH t AS (SELECT l.doc_id AS id, CAST(l.quality AS INT) AS y, CAST(d.n_chars > 1000 AS INT) AS
long, CAST(d.lang = 'en' AS INT) AS english, md5(concat('96:', CAST(l.doc_id AS STRING))) AS h
FROM labels l JOIN documents d ON l.doc_id = d.doc_id), f AS (SELECT id, y, long, english,
CAST((row_number() OVER (ORDER BY y, h, id) - 1) % 5 AS INT) AS fold FROM t), k AS (SELECT
DISTINCT fold FROM f), v AS (SELECT id, fold, y, 'long' AS flag, long AS x FROM f UNION ALL
SELECT id, fold, y, 'english', english FROM f), r AS (SELECT k.fold AS fold, v.flag AS flag, v.x
AS x, count(*) AS n, avg(CAST(v.y AS DOUBLE)) AS rate FROM v CROSS JOIN k WHERE v.fold <> k.fold
GROUP BY k.fold, v.flag, v.x), q AS (SELECT fold, flag, sum(n * rate * rate) AS fit FROM r GROUP
BY fold, flag), best AS (SELECT fold, flag FROM (SELECT fold, flag, row_number() OVER (PARTITION
BY fold ORDER BY fit DESC) AS i FROM q) z WHERE i = 1), u AS (SELECT 'both - english' AS run,
fold, 'long' AS flag FROM k UNION ALL SELECT 'both - long', fold, 'english' FROM k UNION ALL
SELECT 'both', fold, flag FROM best), s AS (SELECT u.run AS run, v.fold AS fold, v.y AS y,
r.rate AS s FROM u JOIN v ON u.fold = v.fold AND u.flag = v.flag JOIN r ON r.fold = v.fold AND
r.flag = v.flag AND r.x = v.x), g AS (SELECT run, fold, s, sum(y) AS p, sum(1 - y) AS n FROM s
GROUP BY run, fold, s), c AS (SELECT run, fold, p, n, coalesce(sum(n) OVER (PARTITION BY run,
fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g), a AS (SELECT
run, fold, sum(p * (b + 0.5E0 * n)) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS auc
FROM c GROUP BY run, fold) SELECT run, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6)
AS std_auc FROM a GROUP BY run
"""

ORACLE_SQL["feature_trial"] = """
WITH t AS (SELECT l.doc_id AS id, CAST(l.quality AS INT) AS y, CAST(d.n_chars > 1000 AS INT) AS
long, CAST(d.lang = 'en' AS INT) AS english, md5(concat('96:', CAST(l.doc_id AS STRING))) AS h
FROM labels l JOIN documents d ON l.doc_id = d.doc_id), f AS (SELECT id, y, long, english,
CAST((row_number() OVER (ORDER BY y, h, id) - 1) % 5 AS INT) AS fold FROM t), k AS (SELECT
DISTINCT fold FROM f), v AS (SELECT id, fold, y, 'long' AS flag, long AS x FROM f UNION ALL
SELECT id, fold, y, 'english', english FROM f), r AS (SELECT k.fold AS fold, v.flag AS flag, v.x
AS x, count(*) AS n, avg(CAST(v.y AS DOUBLE)) AS rate FROM v CROSS JOIN k WHERE v.fold <> k.fold
GROUP BY k.fold, v.flag, v.x), q AS (SELECT fold, flag, sum(n * rate * rate) AS fit FROM r GROUP
BY fold, flag), best AS (SELECT fold, flag FROM (SELECT fold, flag, row_number() OVER (PARTITION
BY fold ORDER BY fit DESC) AS i FROM q) z WHERE i = 1), u AS (SELECT 'english' AS run, fold,
'english' AS flag FROM k UNION ALL SELECT 'english + is_long', fold, flag FROM best), s AS
(SELECT u.run AS run, v.fold AS fold, v.y AS y, r.rate AS s FROM u JOIN v ON u.fold = v.fold AND
u.flag = v.flag JOIN r ON r.fold = v.fold AND r.flag = v.flag AND r.x = v.x), g AS (SELECT run,
fold, s, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY run, fold, s), c AS (SELECT run, fold, p,
n, coalesce(sum(n) OVER (PARTITION BY run, fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND
1 PRECEDING), 0) AS b FROM g), a AS (SELECT run, fold, sum(p * (b + 0.5E0 * n)) / (CAST(sum(p)
AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS auc FROM c GROUP BY run, fold) SELECT run,
round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc FROM a GROUP BY run
"""

ORACLE_SQL["boosted_stump_score"] = """
WITH t AS (SELECT l.doc_id AS id, d.n_chars > 1000 AS long, 2.0E0 * l.quality - 1.0E0 AS y FROM
labels l JOIN documents d ON l.doc_id = d.doc_id), a AS (SELECT long, avg(y) AS f FROM t GROUP
BY long), r AS (SELECT t.long AS long, avg(4.0E0 * t.y / (1.0E0 + exp(2.0E0 * t.y * a.f))) AS g
FROM t JOIN a ON t.long = a.long GROUP BY t.long) SELECT t.id AS id, round(1.0E0 / (1.0E0 +
exp(-2.0E0 * (a.f + 0.3E0 * r.g))), 9) AS p FROM t JOIN a ON t.long = a.long JOIN r ON t.long =
r.long
"""

ORACLE_SQL["sweep"] = """
WITH t AS (SELECT l.doc_id AS id, CAST(l.quality AS INT) AS y, CAST(d.n_chars > 1000 AS INT) AS
long, CAST(d.lang = 'en' AS INT) AS english, md5(concat('96:', CAST(l.doc_id AS STRING))) AS h
FROM labels l JOIN documents d ON l.doc_id = d.doc_id), f AS (SELECT id, y, long, english,
CAST((row_number() OVER (ORDER BY y, h, id) - 1) % 5 AS INT) AS fold FROM t), k AS (SELECT
DISTINCT fold FROM f), z AS (SELECT id, fold, long, y, 2.0E0 * y - 1.0E0 AS e FROM f), x AS
(SELECT k.fold AS fold, z.long AS long, avg(z.e) AS f1 FROM z CROSS JOIN k WHERE z.fold <>
k.fold GROUP BY k.fold, z.long), r AS (SELECT x.fold AS fold, x.long AS long, x.f1 AS f1,
avg(4.0E0 * z.e / (1.0E0 + exp(2.0E0 * z.e * x.f1))) AS g FROM x JOIN z ON z.long = x.long AND
z.fold <> x.fold GROUP BY x.fold, x.long, x.f1), u AS (SELECT '1 round' AS run, 0.0E0 AS step
UNION ALL SELECT '2 rounds, step 0.3', 0.3E0 UNION ALL SELECT '2 rounds, step 0.9', 0.9E0), s AS
(SELECT u.run AS run, z.fold AS fold, z.y AS y, r.f1 + u.step * r.g AS s FROM z JOIN r ON z.fold
= r.fold AND z.long = r.long CROSS JOIN u), g AS (SELECT run, fold, s, sum(y) AS p, sum(1 - y)
AS n FROM s GROUP BY run, fold, s), c AS (SELECT run, fold, p, n, coalesce(sum(n) OVER
(PARTITION BY run, fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
FROM g), a AS (SELECT run, fold, sum(p * (b + 0.5E0 * n)) / (CAST(sum(p) AS DOUBLE) *
CAST(sum(n) AS DOUBLE)) AS auc FROM c GROUP BY run, fold) SELECT run, round(avg(auc), 6) AS
mean_auc, round(stddev_pop(auc), 6) AS std_auc FROM a GROUP BY run
"""

ORACLE_SQL["submission"] = """
WITH t AS (SELECT l.doc_id AS id, d.n_chars > 1000 AS long, CAST(l.quality AS DOUBLE) AS y FROM
labels l JOIN documents d ON l.doc_id = d.doc_id), r AS (SELECT long, avg(y) AS rate FROM t
WHERE id % 5 <> 0 GROUP BY long) SELECT t.id AS id, round(1.0E0 / (1.0E0 + exp(-2.0E0 * (2.0E0 *
r.rate - 1.0E0))), 9) AS p FROM t JOIN r ON t.long = r.long WHERE t.id % 5 = 0
"""

ORACLE_SQL["label_split_features"] = """
SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS customer, o_orderpriority AS priority FROM
orders WHERE o_orderkey % 5 <> 0
"""

ORACLE_SQL["blend_two_files"] = """
SELECT o_orderkey AS id, round(((o_orderkey * 37 % 101) / 101.0E0 + (o_orderkey * 53 % 97) /
97.0E0) / 2, 9) AS p FROM orders WHERE o_orderkey % 10 <> 3
"""

ORACLE_SQL["bundle_folder"] = ORACLE_SQL["bundle_check"]
for _name in ("category_index", "ordered_target_stat", "target_stat_apply", "fold_target_stats"):
    ORACLE_SQL[f"{_name}_split"] = ORACLE_SQL[_name]

ORACLE_SQL["importance_table"] = """
WITH t AS (SELECT CAST(l.quality AS DOUBLE) AS y, CAST(d.n_chars > 1000 AS INT) AS long,
CAST(d.lang = 'en' AS INT) AS english FROM labels l JOIN documents d ON l.doc_id = d.doc_id), v
AS (SELECT 'long' AS feature, long AS x, y FROM t UNION ALL SELECT 'english', english, y FROM
t), g AS (SELECT feature, x, count(*) AS n, avg(y) AS rate FROM v GROUP BY feature, x), q AS
(SELECT feature, sum(n * rate * rate) AS fit FROM g GROUP BY feature), r AS (SELECT feature,
CAST(row_number() OVER (ORDER BY fit DESC) AS INT) AS rank FROM q) SELECT 'both' AS run,
feature, CASE WHEN rank = 1 THEN 100.0E0 ELSE 0.0E0 END AS importance, rank FROM r
"""

ORACLE_SQL["leafwise_score"] = ORACLE_SQL["boosted_stump_score"].replace("0.3E0", "0.05E0")

ORACLE_SQL["cv_logistic"] = """
WITH t AS (SELECT l.doc_id AS id, CAST(l.quality AS INT) AS y, d.lang AS lang,
md5(concat('96:', CAST(l.doc_id AS STRING))) AS h FROM labels l JOIN documents d ON l.doc_id =
d.doc_id), f AS (SELECT id, y, lang, CAST((row_number() OVER (ORDER BY y, h, id) - 1) % 5 AS
INT) AS fold FROM t), k AS (SELECT DISTINCT fold FROM f), r AS (SELECT k.fold AS fold, f.lang AS
lang, round(avg(CAST(f.y AS DOUBLE)), 6) AS rate FROM f CROSS JOIN k WHERE f.fold <> k.fold
GROUP BY k.fold, f.lang), s AS (SELECT f.fold AS fold, f.y AS y, r.rate AS s FROM f JOIN r ON
f.fold = r.fold AND f.lang = r.lang), g AS (SELECT fold, s, sum(y) AS p, sum(1 - y) AS n FROM s
GROUP BY fold, s), c AS (SELECT fold, p, n, coalesce(sum(n) OVER (PARTITION BY fold ORDER BY s
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT fold, round(sum(p * (b
+ 0.5E0 * n)) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)), 6) AS auc FROM c GROUP BY
fold
"""

ORACLE_SQL["cv_target_stat"] = """
WITH t AS (SELECT l.doc_id AS id, CAST(l.quality AS INT) AS y, d.source AS c, md5(concat('96:',
CAST(l.doc_id AS STRING))) AS h FROM labels l JOIN documents d ON l.doc_id = d.doc_id), f AS
(SELECT id, c, y, h, CAST((row_number() OVER (ORDER BY y, h, id) - 1) % 5 AS INT) AS fold FROM
t), k AS (SELECT DISTINCT fold AS held_out FROM f), x AS (SELECT id, c, h, y, fold, held_out,
CASE WHEN fold <> held_out THEN y ELSE 0 END AS s, CASE WHEN fold <> held_out THEN 1 ELSE 0 END
AS n FROM f CROSS JOIN k), w AS (SELECT id, y, fold, held_out, sum(s) OVER (PARTITION BY
held_out, c) AS s_all, sum(n) OVER (PARTITION BY held_out, c) AS n_all, coalesce(sum(s) OVER
(PARTITION BY held_out, c ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
AS s_run, coalesce(sum(n) OVER (PARTITION BY held_out, c ORDER BY h, id ROWS BETWEEN UNBOUNDED
PRECEDING AND 1 PRECEDING), 0) AS n_run FROM x), e AS (SELECT id, y, fold, held_out, CASE WHEN
fold = held_out THEN (s_all + 0.5E0) / (n_all + 1) ELSE (s_run + 0.5E0) / (n_run + 1) END > 0.85
AS high FROM w), r AS (SELECT held_out, high, avg(CAST(y AS DOUBLE)) AS rate FROM e WHERE fold
<> held_out GROUP BY held_out, high) SELECT e.id AS id, e.fold AS fold, e.y AS label,
round(1.0E0 / (1.0E0 + exp(-2.0E0 * (2.0E0 * r.rate - 1.0E0))), 9) AS p FROM e JOIN r ON
e.held_out = r.held_out AND e.high = r.high WHERE e.fold = e.held_out
"""

ORACLE_SQL["arm_comparison"] = """
WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
md5(concat('96:', CAST(o_orderkey AS STRING))) AS h, (o_orderkey * 37 % 101) / 101.0E0 AS a,
(o_orderkey * 53 % 97) / 97.0E0 AS b FROM orders), f AS (SELECT id, y, a, b, round((a + b) / 2, 9)
AS c, CAST((row_number() OVER (ORDER BY y, h, id) - 1) % 5 AS INT) AS fold FROM t), r AS (SELECT
'a' AS run, fold, id, y, a AS s FROM f UNION ALL SELECT 'b', fold, id, y, b FROM f UNION ALL
SELECT 'blend', fold, id, y, c FROM f), w AS (SELECT run, fold, id, y, sum(1 - y) OVER (PARTITION
BY run, fold ORDER BY s RANGE UNBOUNDED PRECEDING) AS n_upto, sum(1 - y) OVER (PARTITION BY run,
fold, s) AS n_tied, sum(y) OVER (PARTITION BY run, fold ORDER BY s RANGE UNBOUNDED PRECEDING) AS
p_upto, sum(y) OVER (PARTITION BY run, fold, s) AS p_tied, sum(y) OVER (PARTITION BY run, fold) AS
p_all, sum(1 - y) OVER (PARTITION BY run, fold) AS n_all FROM r), v AS (SELECT run, fold, id, y,
CASE WHEN y = 1 THEN (n_upto - n_tied / 2.0E0) / n_all ELSE (p_all - p_upto + p_tied / 2.0E0) /
p_all END AS v FROM w), x AS (SELECT a.run AS run_a, b.run AS run_b, a.fold AS fold, a.y AS y,
avg(a.v) AS mean_a, avg(b.v) AS mean_b, var_samp(a.v - b.v) / count(*) AS var FROM v a JOIN v b ON
a.id = b.id AND a.run < b.run GROUP BY a.run, b.run, a.fold, a.y), g AS (SELECT run_a, run_b,
fold, max(CASE WHEN y = 1 THEN mean_a END) AS auc_a, max(CASE WHEN y = 1 THEN mean_b END) AS
auc_b, sum(var) AS var FROM x GROUP BY run_a, run_b, fold), m AS (SELECT run_a, run_b, avg(auc_a)
AS auc_a, avg(auc_b) AS auc_b, sqrt(sum(var)) / count(*) AS e FROM g GROUP BY run_a, run_b) SELECT
run_a, run_b, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_a - auc_b, 6) AS
difference, round(e, 6) AS std_error, round((auc_a - auc_b) / e, 6) AS z FROM m
"""

_CELLS = """
WITH t AS (SELECT l.doc_id AS id, 2.0E0 * l.quality - 1.0E0 AS y, {cell} AS cell FROM labels l JOIN
documents d ON l.doc_id = d.doc_id), a AS (SELECT cell, avg(y) AS f FROM t GROUP BY cell), r AS
(SELECT t.cell AS cell, avg(4.0E0 * t.y / (1.0E0 + exp(2.0E0 * t.y * a.f))) AS g FROM t JOIN a ON
t.cell = a.cell GROUP BY t.cell) SELECT t.id AS id, round(1.0E0 / (1.0E0 + exp(-2.0E0 * (a.f +
{step} * r.g))), 9) AS p FROM t JOIN a ON t.cell = a.cell JOIN r ON t.cell = r.cell
"""
_LONG, _ENGLISH = "CAST(d.n_chars > 1000 AS INT)", "CAST(d.lang = 'en' AS INT)"
_LINES = "CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 > 8 AS INT)"

ORACLE_SQL["crossed_tree_score"] = _CELLS.format(cell=f"2 * {_LONG} + {_ENGLISH}", step="0.3E0")

ORACLE_SQL["leafwise_cells"] = _CELLS.format(
    cell=f"4 * {_LONG} + 2 * {_ENGLISH} + {_LINES}", step="0.05E0"
)

# Rounds of a stump on one flag: each adds the mean of the loss's gradient on either side.
_ROUNDS = """
WITH RECURSIVE t AS (SELECT l.doc_id AS id, CAST(l.quality AS INT) AS y, CAST(d.n_chars > 1000 AS
INT) AS long, md5(concat('96:', CAST(l.doc_id AS STRING))) AS h FROM labels l JOIN documents d ON
l.doc_id = d.doc_id), f AS (SELECT id, y, 2.0E0 * y - 1.0E0 AS e, long, CAST((row_number() OVER
(ORDER BY y, h, id) - 1) % 5 AS INT) AS fold FROM t), k AS (SELECT DISTINCT fold FROM f), w AS
(SELECT k.fold AS fold, f.long AS long, sum(CASE WHEN e > 0 THEN 1.0E0 ELSE 0 END) AS p, sum(CASE
WHEN e < 0 THEN 1.0E0 ELSE 0 END) AS n FROM f CROSS JOIN k WHERE f.fold <> k.fold GROUP BY k.fold,
f.long), u AS (SELECT unnest([0.3E0, 0.9E0]) AS step), m AS (SELECT 1 AS rounds, step, fold, long,
p, n, (p - n) / (p + n) AS margin FROM w CROSS JOIN u UNION ALL SELECT rounds + 1, step, fold,
long, p, n, margin + step * (p * 4.0E0 / (1.0E0 + exp(2.0E0 * margin)) - n * 4.0E0 / (1.0E0 +
exp(-2.0E0 * margin))) / (p + n) FROM m WHERE rounds < 4), s AS (SELECT m.rounds AS rounds, m.step
AS step, f.id AS id, f.fold AS fold, f.y AS y, 1.0E0 / (1.0E0 + exp(-2.0E0 * m.margin)) AS s FROM
f JOIN m ON f.fold = m.fold AND f.long = m.long)
"""

ORACLE_SQL["staged_sweep"] = _ROUNDS + """
SELECT concat('step ', CAST(step AS STRING), ', ', CAST(rounds AS STRING), ' rounds') AS run, id,
fold, round(s, 9) AS p FROM s
"""

ORACLE_SQL["staged_leaderboard"] = _ROUNDS + """
, g AS (SELECT rounds, fold, s, sum(y) AS p, sum(1 - y) AS n FROM s WHERE step = 0.3E0 AND rounds <
4 GROUP BY rounds, fold, s), c AS (SELECT rounds, fold, p, n, coalesce(sum(n) OVER (PARTITION BY
rounds, fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g), a AS
(SELECT rounds, fold, sum(p * (b + 0.5E0 * n)) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE))
AS auc FROM c GROUP BY rounds, fold) SELECT concat('stump, ', CAST(rounds AS STRING), ' rounds') AS
run, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc FROM a GROUP BY rounds
"""

ORACLE_SQL["group_folds"] = """
WITH t AS (SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS c, CASE WHEN o_orderstatus = 'F'
THEN 1 ELSE 0 END AS y FROM orders), g AS (SELECT c, count(*) AS n, least(7, floor(sum(y) * 8 /
count(*))) AS b FROM t GROUP BY c), r AS (SELECT c, b, row_number() OVER (PARTITION BY b ORDER BY n
DESC, md5(concat('96:', c)), c) - 1 AS i FROM g) SELECT t.id AS id, CAST((CASE WHEN (i // 5) % 2 = 0
THEN i % 5 ELSE 4 - i % 5 END + b) % 5 AS INT) AS fold FROM t JOIN r ON t.c = r.c
"""
ORACLE_SQL["group_folds_split"] = ORACLE_SQL["group_folds"]

ORACLE_SQL["permutation_importance"] = """
WITH t AS (SELECT l.doc_id AS id, CAST(l.quality AS INT) AS y, CAST(d.n_chars > 1000 AS INT) AS x
FROM labels l JOIN documents d ON l.doc_id = d.doc_id), a AS (SELECT id, y, x, row_number() OVER
(ORDER BY md5(concat('96:', CAST(id AS STRING))), id) AS k FROM t), b AS (SELECT x AS px,
row_number() OVER (ORDER BY md5(concat('97:', CAST(id AS STRING))), id) AS k FROM t), m AS (SELECT
x, avg(CAST(y AS DOUBLE)) AS rate FROM t GROUP BY x), v AS (SELECT 'none' AS feature, y, m.rate AS
s FROM a JOIN m ON a.x = m.x UNION ALL SELECT 'constant', y, m.rate FROM a JOIN m ON a.x = m.x UNION
ALL SELECT 'is_long', y, m.rate FROM a JOIN b ON a.k = b.k JOIN m ON b.px = m.x), g AS (SELECT
feature, s, sum(y) AS p, sum(1 - y) AS n FROM v GROUP BY feature, s), c AS (SELECT feature, p, n,
coalesce(sum(n) OVER (PARTITION BY feature ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1
PRECEDING), 0) AS b FROM g), u AS (SELECT feature, sum(p * (b + 0.5E0 * n)) / (CAST(sum(p) AS
DOUBLE) * CAST(sum(n) AS DOUBLE)) AS auc FROM c GROUP BY feature), z AS (SELECT feature, auc,
(SELECT auc FROM u WHERE feature = 'none') - auc AS lost FROM u WHERE feature <> 'none') SELECT
'stump' AS run, feature, round(auc, 6) AS auc, round(lost, 6) AS auc_loss, CAST(row_number() OVER
(ORDER BY lost DESC, feature) AS INT) AS rank FROM z
"""

ORACLE_SQL["target_stats_over_orders"] = """
WITH t AS (SELECT o_orderkey AS id, concat(o_orderpriority, '/', strftime(o_orderdate, '%Y-%m')) AS
c, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders WHERE o_orderkey % 5 <> 0), o
AS (SELECT unnest([96, 97, 98, 99]) AS seed), x AS (SELECT id, c, y, seed, md5(concat(CAST(seed AS
STRING), ':', CAST(id AS STRING))) AS h FROM t CROSS JOIN o), r AS (SELECT id, (coalesce(sum(y) OVER
(PARTITION BY c, seed ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5E0)
/ (count(y) OVER (PARTITION BY c, seed ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1
PRECEDING) + 1) AS stat FROM x) SELECT id, round(avg(stat), 9) AS stat FROM r GROUP BY id
"""
ORACLE_SQL["target_stats_over_orders_split"] = ORACLE_SQL["target_stats_over_orders"]

ORACLE_SQL["fold_stats_over_orders"] = """
WITH t AS (SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS c, CASE WHEN o_orderstatus = 'F'
THEN 1 ELSE 0 END AS y, md5(concat('96:', CAST(o_orderkey AS STRING))) AS h FROM orders), f AS
(SELECT id, c, y, CAST((row_number() OVER (ORDER BY y, h, id) - 1) % 5 AS INT) AS fold FROM t), k AS
(SELECT DISTINCT fold AS held_out FROM f), o AS (SELECT unnest([96, 97]) AS seed), x AS (SELECT id,
c, fold, held_out, seed, md5(concat(CAST(seed AS STRING), ':', CAST(id AS STRING))) AS h, CASE WHEN
fold <> held_out THEN y ELSE 0 END AS s, CASE WHEN fold <> held_out THEN 1 ELSE 0 END AS n FROM f
CROSS JOIN k CROSS JOIN o), w AS (SELECT id, fold, held_out, sum(s) OVER (PARTITION BY seed,
held_out, c) AS s_all, sum(n) OVER (PARTITION BY seed, held_out, c) AS n_all, coalesce(sum(s) OVER
(PARTITION BY seed, held_out, c ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
AS s_run, coalesce(sum(n) OVER (PARTITION BY seed, held_out, c ORDER BY h, id ROWS BETWEEN
UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_run FROM x), e AS (SELECT id, held_out, CASE WHEN fold
= held_out THEN (s_all + 0.5E0) / (n_all + 1) ELSE (s_run + 0.5E0) / (n_run + 1) END AS stat FROM w)
SELECT id, held_out, round(avg(stat), 6) AS stat FROM e GROUP BY id, held_out
"""

_GROUPS = """
WITH t AS (SELECT CAST(o_custkey AS STRING) AS c, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END
AS y FROM orders WHERE o_orderkey % 5 <> 0), g AS (SELECT c, sum(y) AS s, count(*) AS n FROM t GROUP
BY c), r AS (SELECT c, coalesce(sum(n) OVER (ORDER BY (s + 0.5E0) / (n + 1.0E0), c ROWS BETWEEN
UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM g), m AS (SELECT c,
CAST(floor(before * 31 / total) AS INT) AS grp FROM r)
"""
ORACLE_SQL["category_groups"] = _GROUPS + """
SELECT c AS lookup_key, grp AS "group" FROM m
"""
ORACLE_SQL["category_groups_apply"] = _GROUPS + """
SELECT o.o_orderkey AS id, coalesce(m.grp, -1) AS "group" FROM orders o LEFT JOIN m ON
CAST(o.o_custkey AS STRING) = m.c WHERE o.o_orderkey % 5 = 0
"""

ORACLE_SQL["cv_grouped_category"] = """
WITH t AS (SELECT l.doc_id AS id, CAST(l.quality AS INT) AS y, d.source AS c, md5(concat('96:',
CAST(l.doc_id AS STRING))) AS h FROM labels l JOIN documents d ON l.doc_id = d.doc_id), f AS (SELECT
id, y, c, CAST((row_number() OVER (ORDER BY y, h, id) - 1) % 5 AS INT) AS fold FROM t), k AS (SELECT
DISTINCT fold FROM f), g AS (SELECT k.fold AS fold, f.c AS c, sum(f.y) AS s, count(*) AS n FROM f
CROSS JOIN k WHERE f.fold <> k.fold GROUP BY k.fold, f.c), r AS (SELECT fold, c, s, n,
coalesce(sum(n) OVER (PARTITION BY fold ORDER BY (s + 0.5E0) / (n + 1.0E0), c ROWS BETWEEN UNBOUNDED
PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY fold) AS total FROM g), m AS
(SELECT fold, c, s, n, floor(before * 4 / total) AS grp FROM r), q AS (SELECT fold, grp,
sum(2.0E0 * s - n) AS s, sum(n) AS n FROM m GROUP BY fold, grp), w AS (SELECT fold, grp, sum(n) OVER
(PARTITION BY fold ORDER BY grp) AS nl, sum(s) OVER (PARTITION BY fold ORDER BY grp) AS sl, sum(n)
OVER (PARTITION BY fold) AS nt, sum(s) OVER (PARTITION BY fold) AS st FROM q), b AS (SELECT fold,
grp AS cut FROM (SELECT fold, grp, row_number() OVER (PARTITION BY fold ORDER BY sl * sl / nl + (st -
sl) * (st - sl) / (nt - nl) DESC) AS i FROM w WHERE nl < nt) z WHERE i = 1), e AS (SELECT q.fold AS
fold, q.grp <= b.cut AS below, sum(q.s) / sum(q.n) AS mean FROM q JOIN b ON q.fold = b.fold GROUP BY
q.fold, q.grp <= b.cut) SELECT f.id AS id, f.fold AS fold, f.y AS label, round(1.0E0 / (1.0E0 +
exp(-2.0E0 * e.mean)), 9) AS p FROM f LEFT JOIN m ON f.fold = m.fold AND f.c = m.c JOIN b ON f.fold
= b.fold JOIN e ON f.fold = e.fold AND e.below = (coalesce(m.grp, -1) <= b.cut)
"""

_BLEND = """
WITH a AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 101) / 101.0E0 + 0.3E0 * (CASE WHEN
o_orderstatus = 'F' THEN 1 ELSE 0 END) AS a, CASE WHEN o_orderstatus = 'F' THEN 1.0E0 ELSE 0.0E0 END
AS y, (o_orderkey * 53 % 97) / 97.0E0 AS b FROM orders WHERE o_orderkey % 10 <> 3), w AS (SELECT
greatest(0.0E0, least(1.0E0, sum((a - b) * (y - b)) / sum((a - b) * (a - b)))) AS w FROM a {where})
"""
ORACLE_SQL["blend_weights"] = _BLEND.format(where="") + """
SELECT 'a' AS name, round(w, 6) AS weight FROM w UNION ALL SELECT 'b', round(1 - w, 6) FROM w
"""
ORACLE_SQL["blend_learnt"] = _BLEND.format(where="WHERE id % 2 = 0") + """
SELECT a.id AS id, round(w.w * a.a + (1 - w.w) * a.b, 6) AS p FROM a CROSS JOIN w
"""

ORACLE_SQL["column_profile"] = """
WITH v AS (SELECT 0 AS position, 'o_orderkey' AS "column", CAST(o_orderkey AS DOUBLE) AS x, CAST(NULL
AS STRING) AS s FROM orders UNION ALL SELECT 1, 'o_custkey', CAST(o_custkey AS DOUBLE), NULL FROM
orders UNION ALL SELECT 2, 'o_orderstatus', NULL, o_orderstatus FROM orders UNION ALL SELECT 3,
'o_totalprice', o_totalprice, NULL FROM orders UNION ALL SELECT 5, 'o_orderpriority', NULL,
o_orderpriority FROM orders), t AS (SELECT position, s, count(*) AS n, row_number() OVER (PARTITION BY
position ORDER BY count(*) DESC, s) AS i FROM v WHERE s IS NOT NULL GROUP BY position, s) SELECT
CAST(v.position AS INT) AS position, v."column", count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null,
min(v.x) AS least, max(v.x) AS greatest, round(avg(v.x), 3) AS mean, round(stddev_pop(v.x), 3) AS std,
max(t.s) AS top_value, max(t.n) AS top_count FROM v LEFT JOIN t ON v.position = t.position AND t.i = 1
GROUP BY v.position, v."column"
"""

ORACLE_SQL["column_drift"] = """
WITH v AS (SELECT o_orderdate >= TIMESTAMP '1996-01-01' AS late, 'o_orderstatus' AS "column",
o_orderstatus AS s FROM orders UNION ALL SELECT o_orderdate >= TIMESTAMP '1996-01-01',
'o_orderpriority', CASE WHEN o_orderpriority < '5' THEN o_orderpriority END FROM orders), n AS (SELECT
"column", late, count(s) AS known, 1 - count(s) / CAST(count(*) AS DOUBLE) AS nulls FROM v GROUP BY
"column", late), k AS (SELECT DISTINCT "column", s FROM v WHERE s IS NOT NULL), c AS (SELECT
k."column", k.s, greatest(1.0E-6, sum(CASE WHEN NOT v.late THEN 1.0E0 ELSE 0 END) / max(a.known)) AS p,
greatest(1.0E-6, sum(CASE WHEN v.late THEN 1.0E0 ELSE 0 END) / max(b.known)) AS q FROM k JOIN v ON
k."column" = v."column" AND k.s = v.s JOIN n a ON a."column" = k."column" AND NOT a.late JOIN n b ON
b."column" = k."column" AND b.late GROUP BY k."column", k.s) SELECT c."column", 'values' AS kind,
round(sum((q - p) * ln(q / p)), 6) AS psi, round(max(b.nulls) - max(a.nulls), 6) AS null_change FROM c
JOIN n a ON a."column" = c."column" AND NOT a.late JOIN n b ON b."column" = c."column" AND b.late GROUP
BY c."column"
"""
