"""Measurement reports over the driver's tables: joins, roll-ups, shares, top-k, sets, text forms."""

from __future__ import annotations

from .dialect import plan

PLANS: dict = {}


def _add(name, text):
    PLANS[name] = plan(text)


# --- aggregation
_add("group_summary", lambda s: f"""
SELECT *, round(total / sum(total) OVER (), 6) AS share FROM (
  SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, {s.percentile(0.95, 'l_quantity')} AS p95, max(l_quantity) AS most
  FROM lineitem GROUP BY l_returnflag, l_linestatus) g""")
_add("nearest_rank_percentile", lambda s: f"SELECT event_type, {s.percentile(0.95, 'value')} AS p95, {s.percentile(0.5, 'value')} AS p50, count(*) AS n FROM events GROUP BY event_type")
_add("mean_with_empty_guard", lambda s: "SELECT n_name, round(coalesce(avg(CASE WHEN s_acctbal > 9000 THEN s_acctbal END), 0.0), 6) AS mean FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
_add("category_totals_long", lambda s: """
WITH g AS (SELECT o_orderstatus, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS urgent, sum(CASE WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS high, count(o_orderpriority) AS n FROM orders GROUP BY o_orderstatus)
SELECT o_orderstatus, 'urgent' AS category, CAST(urgent AS BIGINT) AS total FROM g UNION ALL SELECT o_orderstatus, 'high', CAST(high AS BIGINT) FROM g UNION ALL SELECT o_orderstatus, 'other', CAST(n - urgent - high AS BIGINT) FROM g""")
_add("category_top3", lambda s: """
SELECT o_orderstatus, k, o_orderpriority, pct FROM (
  SELECT o_orderstatus, o_orderpriority, round(n * 100e0 / sum(n) OVER (PARTITION BY o_orderstatus), 4) AS pct, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) AS k
  FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority) a) b WHERE k <= 3""")
_add("merge_duplicates_last_wins", lambda s: "SELECT user_id, event_type, round(sum(value), 4) AS total, max_by(props, event_id) AS last_props FROM events GROUP BY user_id, event_type")
_add("distinct_per_group", lambda s: "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
_add("once_per_key_sum", lambda s: """
SELECT o_orderstatus, round(sum(o_totalprice), 2) AS price_once, CAST(sum(n) AS BIGINT) AS line_rows FROM orders
JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey GROUP BY o_orderstatus""")
_add("matrix_totals", lambda s: f"""
SELECT l_returnflag, l_linestatus, n, secs, CASE WHEN secs = 0 THEN {s.inf} ELSE round(n / secs, 6) END AS rate FROM (
  SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_linenumber END) AS secs FROM lineitem GROUP BY l_returnflag, l_linestatus) t""")
_add("inf_aware_mean", lambda s: f"""
SELECT g, coalesce(round(avg(CASE WHEN v < {s.inf} THEN v END), 6), CASE WHEN count(v) > 0 AND min(v) = {s.inf} THEN {s.inf} END) AS mean FROM (
  SELECT o_orderpriority AS g, CASE WHEN o_orderpriority LIKE '1%' OR o_orderkey % 7 = 0 THEN {s.inf} WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_totalprice END AS v FROM orders) t GROUP BY g""")
_add("mode_pivot", lambda s: """
SELECT o_orderpriority, f, o, round(f * 1e0 / o, 6) AS ratio FROM (
  SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY o_orderpriority) p WHERE o > 0""")
_add("run_totals", lambda s: "SELECT count(*) AS frames, round(sum(l_extendedprice), 2) AS size, round(sum(l_extendedprice) * 8 / (count(*) / 30.0) / 1000, 4) AS kbps FROM lineitem")
_add("skipped_combinations", lambda s: """
SELECT count(*) AS skipped FROM (SELECT DISTINCT o_orderstatus FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) b
WHERE NOT ((o_orderstatus = 'F' AND o_orderpriority < '3') OR o_orderstatus = 'O')""")
_add("total_row", lambda s: "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price, round(sum(o_totalprice) / count(*), 6) AS ratio_of_sums FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())")
_add("hierarchy_rollup", lambda s: f"""
SELECT path, round(sum(direct), 2) AS inclusive, round(sum(CASE WHEN path = p THEN direct ELSE 0 END), 2) AS exclusive, count(*) AS n FROM (
  SELECT {s.explode_prefixes('p')} AS path, p, direct FROM (
    SELECT concat(concat(concat(concat(r_name, '.'), n_name), '.'), c_mktsegment) AS p, sum(c_acctbal) AS direct FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name, c_mktsegment) d) e GROUP BY path""")
_add("tail_share", lambda s: "SELECT l_returnflag, sum(CASE WHEN l_linenumber > 4 THEN 1 ELSE 0 END) AS tail, round(CASE WHEN count(*) = 0 THEN 0 ELSE sum(CASE WHEN l_linenumber > 4 THEN 1 ELSE 0 END) * 100e0 / count(*) END, 6) AS pct FROM lineitem GROUP BY l_returnflag")
_add("named_counters", lambda s: f"SELECT concat(concat(event_type, '/'), {s.text('user_id % 5')}) AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
_add("attributed_deltas", lambda s: "SELECT user_id, sum(d) AS gained FROM (SELECT user_id, event_id - lag(event_id, 1, 0) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS d FROM events) t GROUP BY user_id")
_add("conditional_counts", lambda s: "SELECT count(*) AS total, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS selected, sum(CASE WHEN NOT value > 50 THEN 1 ELSE 0 END) AS rejected FROM events")
_add("byte_counter", lambda s: "SELECT source, CAST(sum(octet_length(encode(text" + (", 'utf-8'" if s.name == "spark" else "") + "))) AS BIGINT) AS bytes FROM documents GROUP BY source")
_add("sha_checksum", lambda s: f"SELECT doc_id, {s.sha256('text')} AS sha FROM documents")
_add("text_statistics", lambda s: "SELECT lang, count(*) AS modules, sum(length(text) - length(replace(text, chr(10), '')) + 1) AS line_count FROM documents GROUP BY lang")
# --- joins
_add("baseline_delta", lambda s: f"""
WITH y AS (SELECT o_orderstatus, o_orderpriority, {s.year('o_orderdate')} AS yr, count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT c.o_orderstatus, c.o_orderpriority, c.yr, c.n, p.n AS baseline_n, c.n - p.n AS delta_n, round(c.n * 1e0 / p.n, 6) AS ratio
FROM y c LEFT JOIN y p ON c.o_orderstatus = p.o_orderstatus AND c.o_orderpriority = p.o_orderpriority AND c.yr = p.yr + 1""")
_add("parity_join", lambda s: """
WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)
SELECT a.user_id, a.n AS own, b.n AS other, round(a.n * 1e0 / b.n, 6) AS ratio FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.event_type = 'view' WHERE a.event_type = 'click'""")
_add("pairwise_ratio", lambda s: f"""
WITH t AS (SELECT l_partkey, l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_partkey, l_returnflag),
j AS (SELECT b.l_returnflag AS compared, a.l_partkey, a.q AS base_q, CASE WHEN a.l_partkey % 3 = 0 THEN 0 ELSE b.q END AS compared_q FROM t a JOIN t b ON a.l_partkey = b.l_partkey WHERE a.l_returnflag = 'N' AND b.l_returnflag <> 'N'
  UNION ALL SELECT 'nothing', l_partkey, q, 0 FROM t WHERE l_returnflag = 'N' AND l_partkey < 20)
SELECT compared, count(*) AS matched, CAST(sum(base_q) AS BIGINT) AS base_q, CAST(sum(compared_q) AS BIGINT) AS compared_q, CASE WHEN sum(compared_q) = 0 THEN {s.inf} ELSE round(sum(base_q) * 1e0 / sum(compared_q), 6) END AS ratio,
  {s.argmin('l_partkey', 'compared_q - base_q, l_partkey')} AS largest_excess, max(base_q - compared_q) AS excess FROM j GROUP BY compared""")
_add("label_join_with_fallback", lambda s: "SELECT d.doc_id, coalesce(l.toxic, 0) AS toxic, CASE WHEN l.doc_id IS NULL THEN concat('unlabelled/', d.source) ELSE concat('labelled/', d.source) END AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
_add("dimension_join_with_default", lambda s: f"""
SELECT coalesce(m.module, concat('other::', e.event_type)) AS module, count(*) AS n FROM events e
LEFT JOIN {s.values("('click', 'ui::pointer'), ('view', 'ui::page')", 'event_type, module')} m ON e.event_type = m.event_type GROUP BY 1""")
_add("size_comparison", lambda s: """
SELECT p_brand, a.n AS own, b.n AS reference, round(a.n * 1e0 / b.n, 6) AS ratio FROM (SELECT p_brand, sum(p_size) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand) a JOIN (SELECT p_brand, sum(p_size) AS n FROM part WHERE p_partkey % 2 = 1 GROUP BY p_brand) b USING (p_brand)""")
_add("cache_lookup", lambda s: f"SELECT count(*) AS reused FROM (SELECT {s.sha256('text')} AS k FROM documents WHERE doc_id % 2 = 0) a JOIN (SELECT DISTINCT {s.sha256('text')} AS k FROM documents WHERE doc_id % 2 = 1) b ON a.k = b.k")
_add("longest_prefix_resolution", lambda s: f"""
SELECT p_type, max(CASE WHEN k = 1 THEN pre END) AS known FROM (
  SELECT p_type, pre, row_number() OVER (PARTITION BY p_type ORDER BY length(pre) DESC) AS k FROM (
    SELECT p_type, {s.explode_prefixes("replace(p_type, ' ', '.')")} AS pre FROM (SELECT DISTINCT p_type FROM part) d) e
  WHERE length(pre) % 2 = 0) f GROUP BY p_type""")
# --- windows
_add("share_of_group", lambda s: "SELECT o_orderstatus, o_orderpriority, n, round(n * 100e0 / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS pct FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) g")
_add("share_of_total_top_k", lambda s: "SELECT * FROM (SELECT l_suppkey, n, round(n * 100e0 / (SELECT count(*) FROM lineitem), 6) AS pct FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) g) t ORDER BY n DESC, l_suppkey LIMIT 18")
_add("per_distinct_average", lambda s: "SELECT event_type, round(sum(value) / count(DISTINCT user_id), 6) AS per_user FROM events GROUP BY event_type")
_add("running_offset", lambda s: "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bit_offset FROM lineitem")
_add("previous_row", lambda s: "SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events")
_add("order_hint", lambda s: "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 256 AS hint FROM events")
_add("prefix_sums", lambda s: "SELECT p_size, n, CAST(sum(n) OVER (ORDER BY p_size) AS BIGINT) AS cum_n, CAST(sum(n * p_size) OVER (ORDER BY p_size) AS BIGINT) AS cum_w FROM (SELECT p_size, count(*) AS n FROM part GROUP BY p_size) g")
_add("piecewise_linear_map", lambda s: f"""
SELECT i AS qp, CASE WHEN i <= 17 THEN i WHEN i <= 42 THEN 17 + {s.div('(i - 17) * 22 + 12', 25)} ELSE 39 + {s.div('(i - 42) * 5 + 10', 21)} END AS mapped FROM {s.range(64)} t""")
# --- top-k and sets
_add("hottest_rows", lambda s: "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 12")
_add("short_list_per_group", lambda s: "SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) t WHERE k <= 5")
_add("first_n_in_order", lambda s: "SELECT * FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer WHERE c_mktsegment = 'BUILDING') t WHERE pos <= 20")
_add("arg_min_payload", lambda s: f"SELECT l_suppkey, {s.argmin('l_orderkey', 'l_extendedprice, l_quantity, l_orderkey')} AS order_key FROM lineitem GROUP BY l_suppkey")
_add("key_intersection", lambda s: "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
_add("union_of_traces", lambda s: "SELECT user_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, value FROM events WHERE value > 50")
_add("ordered_distinct", lambda s: "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_id) AS pos FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) t")
_add("anti_seen_set", lambda s: "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
# --- text forms and predicates
_add("counter_prefix_filter", lambda s: "SELECT p_partkey, p_name FROM part WHERE (p_name LIKE 'a%' OR p_name LIKE 'b%' OR p_name LIKE 'part%') AND NOT p_name LIKE '%7'")
_add("null_list_gate", lambda s: "SELECT doc_id FROM documents WHERE lang IS NULL OR lang IN ('en', 'fr')")
_add("finite_positive", lambda s: f"SELECT count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN {s.inf} WHEN event_id % 7 = 0 THEN NULL ELSE value - 20 END AS v FROM events) t WHERE v IS NOT NULL AND v > 0 AND v < {s.inf}")
_FILES = "('clip_1920x1080_30_50f_yuv420p10le.yuv'), ('a_64x32.yuv'), ('b_1280x720_2997_12frames_gray8.yuv'), ('c.yuv'), ('scene_352x288_1080p30_9f.yuv')"
_add("filename_metadata", lambda s: f"""
SELECT f, {s.extract('f', '([0-9]+)x([0-9]+)', 1)} AS w, {s.extract('f', '([0-9]+)x([0-9]+)', 2)} AS h, {s.extract('f', '([0-9]+)(f|frames)[_.]', 1)} AS frames,
  CASE WHEN {s.extract('f', '(yuv4[0-9][0-9]p[0-9le]*|gray8|gbrp8)', 1)} = '' THEN CASE WHEN f LIKE '%.yuv' THEN 'yuv420p8' END ELSE {s.extract('f', '(yuv4[0-9][0-9]p[0-9le]*|gray8|gbrp8)', 1)} END AS format,
  CASE WHEN fps = '' THEN NULL WHEN CAST(fps AS INT) >= 1000 AND CAST(fps AS INT) % 100 = 97 THEN concat({s.text(s.div('CAST(fps AS INT)', 100))}, '.97') ELSE fps END AS fps
FROM (SELECT f, {s.extract('f', '[0-9]+x[0-9]+(?:p|[-_.]+)([0-9]+)(?:[-_.]|$)', 1)} AS fps FROM {s.values(_FILES, 'f')} v) t""")
_add("number_formats", lambda s: f"SELECT o_orderkey, concat({s.fixed('floor(o_totalprice) / 8', 3)}, 'x') AS ratio, concat({s.fixed('(o_orderkey % 100) * 0.25', 2)}, '%') AS pct FROM orders")
_add("mode_labels", lambda s: f"""
SELECT i AS qp, concat(CASE WHEN i = 0 THEN 'lossless' ELSE concat('qp=', {s.text('i')}) END, concat(CASE WHEN i % 2 = 1 THEN '+predictive' ELSE '' END, CASE WHEN i % 3 = 2 THEN concat('+fast=', {s.text('i % 4')}) ELSE '' END)) AS label FROM {s.range(64)} t""")
_add("qp_maps", lambda s: f"SELECT i AS qp, least(255, {s.div('i * 10 + 2', 3)}) AS qindex, {s.div('i + 5', 6)} AS slow, {s.div('2 * i + 2', 3)} AS fast FROM {s.range(64)} t")
_add("geometry_checks", lambda s: f"""
SELECT i AS w, {s.div('i * 7', 8)} AS h, i > 0 AND {s.div('i * 7', 8)} > 0 AS positive, i % 2 = 0 AND {s.div('i * 7', 8)} % 2 = 0 AS fits_420, i % 2 = 0 AS fits_422, i >= 8 AND {s.div('i * 7', 8)} >= 8 AND i % 8 = 0 AND {s.div('i * 7', 8)} % 8 = 0 AS fits_8 FROM {s.range(80)} t""")
_add("metric_lines", lambda s: f"SELECT event_id, concat(concat('frame: index=', {s.text('event_id')}), concat(' psnr_all=', CASE WHEN event_id % 9 = 0 THEN 'inf' ELSE {s.fixed('value', 3)} END)) AS line FROM events")
_add("last_duplicate_wins", lambda s: "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) t WHERE k = 1")
_add("round_trip_difference", lambda s: "SELECT count(*) AS differing FROM (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem EXCEPT SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity > 10) t")
_add("nested_stage_lists", lambda s: f"SELECT l_linenumber AS module, {s.listed('l_returnflag', 'n')} AS stages FROM (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_linenumber, l_returnflag) g GROUP BY l_linenumber")
_add("trace_specs", lambda s: f"""
SELECT spec, CASE WHEN trim(c) = '' THEN stem ELSE trim(c) END AS case_name, CASE WHEN trim(src) = '' THEN NULL ELSE trim(src) END AS source, path FROM (
  SELECT spec, path, {s.extract("path", "([^/]*?)([.][^./]*)?$", 1)} AS stem, CASE WHEN label LIKE '%/%' THEN {s.extract("label", "^([^/]*)/", 1)} ELSE '' END AS c, CASE WHEN label LIKE '%/%' THEN {s.extract("label", "^[^/]*/(.*)$", 1)} ELSE label END AS src FROM (
    SELECT spec, CASE WHEN spec LIKE '%=%' THEN {s.extract("spec", "^([^=]*)=", 1)} ELSE '' END AS label, CASE WHEN spec LIKE '%=%' THEN {s.extract("spec", "^[^=]*=(.*)$", 1)} ELSE spec END AS path FROM (
      SELECT concat(CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'src=' WHEN 2 THEN concat(o_orderstatus, '/src=') WHEN 3 THEN ' /src =' ELSE 'case/=' END, concat(concat('dir/t', {s.text('o_orderkey')}), '.jsonl')) AS spec FROM orders) a) b) c""")
_add("format_names", lambda s: f"""
SELECT sampling, i + 8 AS depth, CASE WHEN sampling = 'gray' THEN 'gray' ELSE concat(concat('yuv', sampling), 'p') END AS layout, concat(concat(CASE WHEN sampling = 'gray' THEN 'gray' ELSE concat(concat('yuv', sampling), 'p') END, {s.text('i + 8')}), CASE WHEN i > 0 THEN 'le' ELSE '' END) AS name
FROM {s.range(9)} r CROSS JOIN {s.values("('gray'), ('420'), ('422'), ('444')", 'sampling')} t""")
_add("status_histogram", lambda s: """
SELECT o_orderpriority, count(*) AS n, round(avg(score), 6) AS mean, sum(CASE WHEN score >= 2 THEN 1 ELSE 0 END) AS accepted, sum(CASE WHEN score >= 0 AND score < 2 THEN 1 ELSE 0 END) AS watched, sum(CASE WHEN score < 0 THEN 1 ELSE 0 END) AS regressed
FROM (SELECT o_orderpriority, CAST(o_orderkey % 9 - 4 AS DOUBLE) AS score FROM orders) t GROUP BY o_orderpriority""")
_add("source_preserving", lambda s: "SELECT event_type, count(*) AS n, sum(CASE WHEN value <= 10 THEN 1 ELSE 0 END) AS kept, max(value) <= 10 AS preserves FROM events GROUP BY event_type")
