"""DuckDB SQL for the queries."""

from __future__ import annotations

_R = "CAST(floor((CAST(1 AS FLOAT) - CAST(0.9 AS FLOAT)) * CAST(length({0}) AS FLOAT)) AS INT)"
_URLS = "urls AS (SELECT page_id AS seq_id, coalesce(url, '') AS s FROM pages)"
_PAIRS = f"""pairs AS (SELECT t.seq_id AS target, t.s AS t, q.seq_id AS centre, q.s AS q, least({_R.format("t.s")}, {_R.format("q.s")}) AS r
    FROM urls t, urls q WHERE q.seq_id % 20 = 0 AND length(t.s) > 0 AND length(q.s) >= length(t.s) - least({_R.format("t.s")}, {_R.format("q.s")})),
costs AS (SELECT target, centre, r, list_min(list_transform(range(greatest(0, length(t) - r), greatest(greatest(0, length(t) - r), least(length(q), length(t) + r)) + 1), lambda j: levenshtein(t, substr(q, 1, CAST(j AS INT))))) AS cost FROM pairs),
edges AS (SELECT target, centre, cost FROM costs WHERE cost <= r)"""
_BASE = f"WITH {_URLS}, {_PAIRS}"
_RECRUITED = "recruited AS (SELECT target AS seq_id, min(centre) AS centroid FROM edges GROUP BY target)"
_HOSTS = "hosts AS (SELECT seq_id, count(*) OVER (PARTITION BY regexp_extract(s, '^[a-z]+://[^/]*')) AS n FROM urls)"
_SUMMARY = f"""{_BASE}, {_RECRUITED}, {_HOSTS}, summary AS (
SELECT centroid, count(*) AS density, max(n) AS mode, first(seq_id ORDER BY n DESC, seq_id <> centroid, seq_id) AS mode_seq FROM recruited JOIN hosts USING (seq_id) GROUP BY centroid)"""
_PART = "sizes AS (SELECT l_partkey, count(*) AS size FROM lineitem GROUP BY 1)"
_CUST = "sizes AS (SELECT o_orderstatus, o_custkey, count(*) AS density FROM orders GROUP BY 1, 2)"
_USER = "sizes AS (SELECT user_id, count(*) AS size FROM events GROUP BY 1)"
_MONTHS = "months AS (SELECT strftime(o_orderdate, '%Y-%m') AS iteration, count(*) AS n_seqs, count(*) FILTER (WHERE o_totalprice >= 200000) AS n_big FROM orders GROUP BY 1)"


def _fragments(sizes: str, least: int) -> str:
    return f"""WITH {sizes}, ranked AS (SELECT size, sum(size) OVER (ORDER BY size DESC, row_number ROWS UNBOUNDED PRECEDING) AS cum, sum(size) OVER () AS total
FROM (SELECT size, row_number() OVER () AS row_number FROM sizes WHERE size > {least})), grid AS (SELECT k / 2.0 AS x FROM range(0, 200) g(k))
SELECT CAST(x AS DOUBLE) AS x, CAST(max(cum) AS BIGINT) AS cum, CAST(arg_max(size, cum) AS BIGINT) AS ng FROM grid JOIN ranked ON cum <= CAST(total AS DOUBLE) * CAST(x AS DOUBLE) / 100 GROUP BY x"""


def _metrics(column: str, least: int, key: str = "") -> str:
    group = f" GROUP BY {key}" if key else ""
    return f"""SELECT {key + ", " if key else ""}count(*) FILTER (WHERE {column} > 1) AS n_clusters, CAST(coalesce(sum({column}) FILTER (WHERE {column} > 1), 0) AS BIGINT) AS n_clustered, max({column}) AS densest,
avg({column}) FILTER (WHERE {column} > 1) AS mean_size, count(*) FILTER (WHERE {column} >= {least}) AS n_above_least, count(*) FILTER (WHERE {column} = 1) AS n_singletons,
CAST(median({column}) FILTER (WHERE {column} > 1) AS DOUBLE) AS median_size FROM sizes{group}"""


_EXPECTED = f"""WITH {_USER}, h AS (SELECT size, count(*) AS obs FROM sizes GROUP BY size), n AS (SELECT count(*) AS total FROM events),
e AS (SELECT size, obs, CAST(floor(greatest(CAST(obs AS DOUBLE), (obs / (sum(obs) OVER ())) * total / size)) AS BIGINT) AS n,
1 - exp(-(size * floor(0.05::DOUBLE * total) / total)) * (1 + (size * floor(0.05::DOUBLE * total) / total) * exp(size / total)) AS found FROM h, n)"""

_TURNS = "turns AS (SELECT CAST(conv_id AS VARCHAR) AS centroid, concat_ws('-', conv_id, turn, role) AS seq_id FROM conversations)"
_LINES = "lines AS (SELECT conv_id * 1000 + turn AS line_no, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS ids FROM conversations)"

ORACLE_SQL: dict[str, str] = {
    "dedup_counts": "SELECT min(doc_id) AS seq_id, md5(coalesce(text, '')) AS digest, count(*) AS count FROM documents GROUP BY coalesce(text, '')",
    "strand_counts": """WITH t AS (SELECT conv_id * 1000 + turn AS ord, conv_id || '-' || turn AS seq_id, role, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM conversations),
b AS (SELECT ord, seq_id, CASE WHEN role = 'assistant' THEN translate(reverse(s), 'ACGT', 'TGCA') ELSE s END AS s FROM t), a AS (SELECT * FROM b UNION ALL SELECT ord + 500, seq_id || '-again', translate(reverse(s), 'ACGT', 'TGCA') FROM b WHERE ord % 1000 = 0)
SELECT arg_min(seq_id, ord) AS seq_id, md5(arg_min(s, ord)) AS digest, count(*) AS count FROM a GROUP BY least(s, translate(reverse(s), 'ACGT', 'TGCA'))""",
    "sample_md5": "SELECT doc_id AS seq_id FROM documents WHERE ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.25",
    "include_ids": "SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)",
    "exclude_ids": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "ambiguous_edges": f"{_BASE} SELECT target, centre FROM edges",
    "recruit_cost": f"{_BASE} SELECT target, centre, cost FROM edges",
    "recruit_first_center": f"{_BASE}, {_RECRUITED} SELECT * FROM recruited",
    "nonambiguous_weights": f"{_BASE}, o AS (SELECT *, count(*) OVER (PARTITION BY target) AS c FROM edges) SELECT centre, 1 + count(*) FILTER (WHERE c = 1) AS weight FROM o GROUP BY centre",
    "ambiguous_assigned": f"""{_BASE}, o AS (SELECT *, count(*) OVER (PARTITION BY target) AS c FROM edges), w AS (SELECT centre, 1 + count(*) FILTER (WHERE c = 1) AS weight FROM o GROUP BY centre)
SELECT target AS seq_id, first(centre ORDER BY -ln(1 - ('0x' || substr(md5('11:' || target || ':' || centre), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / weight, centre) AS centroid FROM edges JOIN w USING (centre) GROUP BY target""",
    "cluster_summary": f"{_SUMMARY} SELECT * FROM summary",
    "bait_centers": f"{_SUMMARY} SELECT centroid AS seq_id FROM summary WHERE density > 1 OR mode > 1",
    "mode_centers": f"{_SUMMARY} SELECT DISTINCT mode_seq AS seq_id FROM summary WHERE density > 1",
    "greedy_clusters": f"""WITH RECURSIVE {_URLS}, ranked AS (SELECT seq_id, s, row_number() OVER (ORDER BY length(s) DESC, s DESC, seq_id DESC) AS k FROM urls),
pairs AS (SELECT t.k AS target, t.s AS t, q.k AS centre, q.s AS q, least({_R.format("t.s")}, {_R.format("q.s")}) AS r FROM ranked t, ranked q WHERE q.k < t.k AND length(t.s) > 0 AND length(q.s) > 0),
near AS (SELECT target, centre FROM pairs WHERE list_min(list_transform(range(greatest(0, length(t) - r), greatest(greatest(0, length(t) - r), least(length(q), length(t) + r)) + 1), lambda j: levenshtein(t, substr(q, 1, CAST(j AS INT))))) <= r),
before AS (SELECT k, coalesce(list(centre) FILTER (WHERE centre IS NOT NULL), []) AS qs FROM ranked LEFT JOIN near ON target = k GROUP BY k),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS centres UNION ALL
SELECT b.k, CASE WHEN list_has_any(w.centres, b.qs) THEN w.centres ELSE list_append(w.centres, b.k) END FROM walk w JOIN before b ON b.k = w.k + 1),
chosen AS (SELECT unnest(centres) AS k FROM (SELECT centres FROM walk ORDER BY k DESC LIMIT 1)),
place AS (SELECT r.k, coalesce(CASE WHEN c.k IS NOT NULL THEN r.k END, (SELECT min(near.centre) FROM near JOIN chosen ON near.centre = chosen.k WHERE near.target = r.k)) AS q FROM ranked r LEFT JOIN chosen c ON c.k = r.k)
SELECT a.seq_id, b.seq_id AS centroid FROM place JOIN ranked a ON a.k = place.k JOIN ranked b ON b.k = place.q""",
    "iteration_metrics": f"WITH {_PART} {_metrics('size', 35)}",
    "iteration_metrics_by_status": f"WITH {_CUST} {_metrics('density', 5, 'o_orderstatus')}",
    "size_histogram_norm": f"WITH {_PART} SELECT size, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM sizes GROUP BY size",
    "size_threshold_table": f"WITH {_CUST} SELECT o_orderstatus, CAST(sum(density) AS BIGINT) AS seq_counts, "
    + ", ".join([f"count(*) FILTER (WHERE density >= {k}) AS clusters_above_{k}" for k in (10, 20, 30, 35, 40)] + [f"CAST(coalesce(sum(density) FILTER (WHERE density >= {k}), 0) AS BIGINT) AS seqs_in_clusters_above_{k}" for k in (10, 20, 30, 40, 50)])
    + " FROM sizes GROUP BY o_orderstatus",
    "fragmentation_curve": _fragments(_USER, 0),
    "fragmentation_parts": _fragments(_PART, 25),
    "cumulative_by_iteration": f"WITH {_MONTHS} SELECT *, CAST(sum(n_seqs) OVER w AS BIGINT) AS cum_n_seqs, CAST(sum(n_big) OVER w AS BIGINT) AS cum_n_big FROM months WINDOW w AS (ORDER BY iteration ROWS UNBOUNDED PRECEDING)",
    "adapt_rate": """WITH days AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, lag(n) OVER (ORDER BY day) AS previous_n FROM days)
SELECT day, n, previous_n, round(CASE WHEN previous_n IS NULL THEN 0.1::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN n < previous_n THEN 0.1::DOUBLE + (1 - n / previous_n) * 0.008::DOUBLE ELSE 0.1::DOUBLE END) END, 9) AS rate FROM p""",
    "carried_frontier": f"WITH {_MONTHS} SELECT iteration, last_value(CASE WHEN n_seqs % 3 = 0 THEN n_seqs END IGNORE NULLS) OVER (ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS frontier FROM months",
    "miss_probability": f"WITH {_PART}, n AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM lineitem) SELECT DISTINCT size, round(exp(-(size * (0.02::DOUBLE * total) / total)) * (1 + (size * (0.02::DOUBLE * total) / total) * exp(size / total)), 9) AS miss FROM sizes, n",
    "expected_sizes": f"{_EXPECTED} SELECT size, obs, n, round(found, 9) AS found FROM e",
    "freeze_exact": f"""{_EXPECTED}, terms AS (SELECT size, obs, n, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(found) + (n - k) * ln(1 - found))) AS below
FROM (SELECT size, obs, n, found, unnest(range(0, obs)) AS k FROM e) GROUP BY size, obs, n)
SELECT size, obs, n, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - below)), 6) AS chance, 1 - below >= 0.9::DOUBLE AS frozen FROM terms""",
    "size_outer_compare": """WITH p AS (SELECT p_name AS name, CAST(sum(p_size) AS BIGINT) AS part_sum FROM part GROUP BY 1),
s AS (SELECT p_name AS name, count(*) AS n_sold FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50 GROUP BY 1)
SELECT name, coalesce(part_sum, -1) AS part_sum, coalesce(n_sold, -1) AS n_sold FROM p FULL JOIN s USING (name)""",
    "matched_abundance": """WITH m AS (SELECT DISTINCT o_custkey AS other, o_orderpriority AS centroid FROM orders), t AS (SELECT centroid, CAST(sum(c_nationkey) AS BIGINT) AS other_sum, CAST(max(c_nationkey) AS BIGINT) AS other_max FROM customer FULL JOIN m ON c_custkey = other WHERE centroid IS NOT NULL GROUP BY 1),
o AS (SELECT o_orderpriority AS centroid, count(*) AS n_members, CAST(sum(o_custkey % 7) AS BIGINT) AS members_sum FROM orders GROUP BY 1)
SELECT centroid, coalesce(other_sum, -1) AS other_sum, coalesce(other_max, -1) AS other_max, coalesce(n_members, -1) AS n_members, coalesce(members_sum, -1) AS members_sum FROM t FULL JOIN o USING (centroid)""",
    "pearson": "SELECT round(corr(c_acctbal, o_totalprice), 6) AS r, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey",
    "spearman": """WITH j AS (SELECT c_acctbal AS x, o_totalprice AS y FROM customer JOIN orders ON c_custkey = o_custkey),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM j)
SELECT round(corr(rx, ry), 6) AS r, count(*) AS n FROM r""",
    "entropy": "WITH n AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1) SELECT round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS entropy FROM n",
    "miss_curve": f"""WITH {_PART}, g AS (SELECT DISTINCT size AS k, unnest([1, 2, 5, 10]) AS percent FROM sizes), n AS (SELECT g.*, total, CAST(floor(total * percent / 100) AS BIGINT) AS drawn FROM g, (SELECT count(*) AS total FROM lineitem))
SELECT k, CAST(percent AS BIGINT) AS percent, round(exp(lgamma(total - drawn + 1) - lgamma(total - drawn - k + 1) - lgamma(total + 1) + lgamma(total - k + 1)) * (1 + k * drawn / (total - drawn - k + 1)), 7) AS miss FROM n""",
    "log_factorial": "SELECT l_suppkey, count(*) AS n, round(lgamma(count(*) + 1), 5) AS ln_factorial FROM lineitem GROUP BY l_suppkey",
    "kmer_spectrum": "SELECT seq_id, kmer, count(*) AS n FROM (SELECT item_id AS seq_id, substr(text, CAST(i AS INT), 4) AS kmer FROM (SELECT item_id, text, unnest(range(1, length(text) - 2)) AS i FROM benchmark)) GROUP BY 1, 2",
    "kmer_rollup": "SELECT seq_id, kmer, count(*) AS n FROM (SELECT item_id AS seq_id, substr(text, CAST(i AS INT), 2) AS kmer FROM (SELECT item_id, text, unnest(range(1, length(text) - 2)) AS i FROM benchmark)) GROUP BY 1, 2",
    "kmer_excess": f"""WITH {_URLS}, k AS (SELECT seq_id, substr(s, CAST(i AS INT), 4) AS kmer, count(*) AS n FROM (SELECT seq_id, s, unnest(range(1, length(s) - 2)) AS i FROM urls) GROUP BY 1, 2),
c AS (SELECT t.seq_id AS target, q.seq_id AS centre, sum(least(t.n, q.n)) AS common FROM k t JOIN k q USING (kmer) WHERE q.seq_id % 20 = 0 GROUP BY 1, 2)
SELECT target, centre, CAST(n - common AS BIGINT) AS excess FROM c JOIN (SELECT seq_id AS target, sum(n) AS n FROM k GROUP BY 1) USING (target)""",
    "filter_length": "WITH l AS (SELECT list_sort(list(length(text))) AS n FROM benchmark WHERE length(text) > 0) SELECT greatest(1, CAST(floor(ln(n[len(n) // 2 + 1]) / ln(4) + 1e-12) AS BIGINT)) AS k FROM l",
    "fasta_sort": "SELECT page_id AS seq_id, length(coalesce(url, '')) AS n, row_number() OVER (ORDER BY length(coalesce(url, '')) DESC, page_id DESC) AS place FROM pages",
    "fasta_shuffle": "SELECT page_id AS seq_id, row_number() OVER (ORDER BY ('0x' || substr(md5('3:' || page_id), 1, 8))::BIGINT, page_id) AS place FROM pages",
    "members_to_lines": f"WITH {_TURNS} SELECT centroid, concat_ws(chr(9), centroid, string_agg(seq_id, chr(9) ORDER BY seq_id)) AS value FROM turns GROUP BY centroid",
    "lines_to_members": f"WITH {_LINES}, m AS (SELECT line_no, unnest(ids) AS seq_id, unnest(range(0, len(ids))) AS pos FROM lines) SELECT seq_id, first(line_no ORDER BY line_no, pos) AS line_no, first(pos ORDER BY line_no, pos) AS pos FROM m GROUP BY seq_id",
    "line_sizes": f"WITH {_LINES} SELECT line_no, CAST(len(ids) AS BIGINT) AS size FROM lines WHERE len(ids) >= 2",
    "singleton_padding": f"WITH {_USER}, a AS (SELECT size, count(*) AS n FROM sizes GROUP BY 1 UNION ALL SELECT 1, count(*) FROM events) SELECT size, CAST(sum(n) AS BIGINT) AS n FROM a WHERE n > 0 GROUP BY size",
    "category_counts": "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1",
    "iteration_maximum": f"WITH {_CUST} SELECT o_orderstatus, max(density) AS max_density FROM sizes GROUP BY 1",
    "running_ids": "SELECT strftime(o_orderdate, '%Y-%m') AS iteration, o_orderkey AS line_no, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m'), o_orderkey) - 1 AS cluster_id FROM orders",
    "select_centres": f"{_BASE}, {_RECRUITED} SELECT seq_id, s AS sequence FROM urls WHERE seq_id IN (SELECT centroid FROM recruited)",
    "select_rest": f"{_BASE}, {_RECRUITED} SELECT seq_id, s AS sequence FROM urls WHERE seq_id NOT IN (SELECT centroid FROM recruited)",
    "select_members": f"{_BASE}, {_RECRUITED} SELECT seq_id, centroid, s AS sequence FROM recruited JOIN urls USING (seq_id)",
    "apart_clusters": f"""WITH RECURSIVE {_URLS}, ranked AS (SELECT seq_id, s, row_number() OVER (ORDER BY length(s) DESC, s DESC, seq_id DESC) AS k FROM urls),
pairs AS (SELECT t.k AS target, t.s AS t, q.k AS centre, q.s AS q, least({_R.format("t.s")}, {_R.format("q.s")}) AS r FROM ranked t, ranked q WHERE q.k < t.k AND length(t.s) > 0 AND length(q.s) > 0),
close AS MATERIALIZED (SELECT * FROM pairs WHERE length(q) >= length(t) - 2 * r AND levenshtein(t, substr(q, 1, length(t))) <= 4 * r),
ends AS (SELECT target, centre, r, t, q, unnest(range(greatest(0, length(t) - 2 * r), greatest(greatest(0, length(t) - 2 * r), least(length(q), length(t) + 2 * r)) + 1)) AS j FROM close),
costs AS MATERIALIZED (SELECT target, centre, r, min(levenshtein(t, substr(q, 1, CAST(j AS INT)))) AS cost FROM ends GROUP BY ALL),
near AS MATERIALIZED (SELECT target, centre, cost, r FROM costs WHERE cost <= 2 * r),
before AS MATERIALIZED (SELECT k, coalesce(list(centre) FILTER (WHERE centre IS NOT NULL), []) AS qs FROM ranked LEFT JOIN near ON target = k GROUP BY k),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS centres UNION ALL
SELECT b.k, CASE WHEN list_has_any(w.centres, b.qs) THEN w.centres ELSE list_append(w.centres, b.k) END FROM walk w JOIN before b ON b.k = w.k + 1),
chosen AS (SELECT unnest(centres) AS k FROM (SELECT centres FROM walk ORDER BY k DESC LIMIT 1)),
first AS (SELECT target, min(centre) AS centre FROM near WHERE centre IN (SELECT k FROM chosen) GROUP BY target),
taken AS (SELECT target, centre FROM first JOIN near USING (target, centre) WHERE cost < r)
SELECT a.seq_id, b.seq_id AS centroid FROM (SELECT k AS target, k AS centre FROM chosen UNION ALL SELECT target, centre FROM taken) x JOIN ranked a ON a.k = x.target JOIN ranked b ON b.k = x.centre""",
    "letters_recruit": f"""WITH m AS (SELECT conv_id * 1000 + turn AS doc_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM conversations),
p AS (SELECT t.doc_id AS target, t.s AS t, q.doc_id AS centre, q.s AS q, least({_R.format("t.s").replace("0.9 ", "0.95 ")}, {_R.format("q.s").replace("0.9 ", "0.95 ")}) AS r FROM m t, m q WHERE q.doc_id % 20 = 0 AND length(t.s) > 0 AND length(q.s) > 0),
k AS MATERIALIZED (SELECT * FROM p WHERE length(q) >= length(t) - r AND levenshtein(t, substr(q, 1, length(t))) <= 2 * r),
e AS (SELECT target, centre, r, t, q, unnest(range(greatest(0, length(t) - r), least(length(q), length(t) + r) + 1)) AS j FROM k)
SELECT target AS seq_id, min(centre) AS centroid FROM e WHERE levenshtein(t, substr(q, 1, CAST(j AS INT))) <= r GROUP BY target""",
    "recruit_substring": f"""WITH b AS (SELECT item_id, coalesce(text, '') AS s FROM benchmark), t AS (SELECT item_id AS target, substr(s, 11, greatest(0, length(s) - 20)) AS t FROM b), q AS (SELECT item_id AS centre, s AS q FROM b WHERE item_id % 20 = 0),
p AS (SELECT *, least({_R.format("t").replace("0.9 ", "0.97 ")}, {_R.format("q").replace("0.9 ", "0.97 ")}) AS r FROM t, q WHERE length(t) > 0 AND length(q) > 0),
a AS (SELECT *, unnest(range(1, length(q) + 2)) AS a FROM p), e AS (SELECT *, unnest(range(greatest(0, length(t) - r), length(t) + r + 1)) AS n FROM a)
SELECT target, centre, min(levenshtein(t, substr(q, CAST(a AS INT), CAST(n AS INT)))) AS cost FROM e WHERE a + n <= length(q) + 1 OR n = greatest(0, length(t) - r) GROUP BY target, centre, r HAVING min(levenshtein(t, substr(q, CAST(a AS INT), CAST(n AS INT)))) <= r""",
    "equal_length_clusters": f"""WITH RECURSIVE urls AS (SELECT page_id AS seq_id, translate(substr(md5(regexp_extract(url, '^[a-z]+://[^/]*')), 1, 28) || substr(md5(url), 1, 3), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)), ranked AS (SELECT seq_id, s, row_number() OVER (ORDER BY length(s) DESC, s DESC, seq_id DESC) AS k FROM urls),
pairs AS (SELECT t.k AS target, t.s AS t, q.k AS centre, q.s AS q, least({_R.format("t.s")}, {_R.format("q.s")}) AS r FROM ranked t, ranked q WHERE q.k < t.k AND length(t.s) > 0 AND length(q.s) > 0),
near AS (SELECT target, centre FROM pairs WHERE list_min(list_transform(range(greatest(0, length(t) - r), greatest(greatest(0, length(t) - r), least(length(q), length(t) + r)) + 1), lambda j: levenshtein(t, substr(q, 1, CAST(j AS INT))))) <= r),
before AS (SELECT k, coalesce(list(centre) FILTER (WHERE centre IS NOT NULL), []) AS qs FROM ranked LEFT JOIN near ON target = k GROUP BY k),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS centres UNION ALL
SELECT b.k, CASE WHEN list_has_any(w.centres, b.qs) THEN w.centres ELSE list_append(w.centres, b.k) END FROM walk w JOIN before b ON b.k = w.k + 1),
chosen AS (SELECT unnest(centres) AS k FROM (SELECT centres FROM walk ORDER BY k DESC LIMIT 1)),
place AS (SELECT r.k, coalesce(CASE WHEN c.k IS NOT NULL THEN r.k END, (SELECT min(near.centre) FROM near JOIN chosen ON near.centre = chosen.k WHERE near.target = r.k)) AS q FROM ranked r LEFT JOIN chosen c ON c.k = r.k)
SELECT a.seq_id, b.seq_id AS centroid FROM place JOIN ranked a ON a.k = place.k JOIN ranked b ON b.k = place.q""",
    "fasta_round_trip": "SELECT 'p' || page_id AS seq_id, 'p' || page_id || ' of > pages' AS header, coalesce(url, '') AS sequence, length(coalesce(url, '')) AS length FROM pages",
    "fastq_quality_cut": """WITH r AS (SELECT CAST(page_id AS VARCHAR) AS header, coalesce(url, '') AS s, substr(repeat(md5(coalesce(url, '')), 8), 1, length(coalesce(url, ''))) AS q FROM pages),
c AS (SELECT *, regexp_extract(q, '[!-5]{4,}') AS bad FROM r), k AS (SELECT *, CASE WHEN bad = '' THEN length(s) ELSE strpos(q, bad) - 1 END AS n FROM c)
SELECT header, substr(s, 1, n) AS sequence, substr(q, 1, n) AS quality FROM k WHERE n >= 0.25 * length(s) AND NOT contains(substr(s, 1, n), 'N')""",
    "fastq_sample_counts": "SELECT regexp_extract(coalesce(url, ''), '^[a-z]+://[^/]*') AS sample, count(*) AS n_reads FROM pages GROUP BY 1",
    "cluster_lines_round_trip": f"WITH {_TURNS} SELECT centroid, seq_id FROM turns UNION SELECT centroid, centroid FROM turns",
    "pair_file": f"{_BASE} SELECT target, centre FROM edges",
    "duplicate_report": "SELECT min(doc_id) AS seq_id, count(*) AS count FROM documents GROUP BY coalesce(source, '') HAVING count(*) > 1",
    "counts_literal": f"WITH {_PART} SELECT concat('part ', chr(39), l_partkey, chr(39)) AS seq_id, size AS count FROM sizes",
    "id_list": "SELECT CAST(doc_id AS VARCHAR) AS seq_id, source FROM documents SEMI JOIN labels USING (doc_id)",
    "summary_file": f"{_SUMMARY} SELECT 1 AS iteration, centroid AS cluster_id, CAST(centroid AS VARCHAR) AS centroid, density, mode, CAST(mode_seq AS VARCHAR) AS mode_seq FROM summary",
    "run_folder": f"WITH {_CUST} SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS iteration, o_custkey AS line_no, density, row_number() OVER (ORDER BY o_orderstatus, o_custkey) - 1 AS cluster_id FROM sizes",
    "result_bundle": f"WITH {_CUST} SELECT * FROM sizes",
    "other_tools": """SELECT 'cdhit' AS tool, count(DISTINCT l_suppkey) AS n_clusters, count(*) AS n_members FROM lineitem UNION ALL SELECT 'uclust', count(DISTINCT l_suppkey), count(*) FROM lineitem
UNION ALL SELECT 'meshclust', count(DISTINCT l_suppkey), count(*) FROM lineitem WHERE l_returnflag IN ('A', 'R')""",
    "abundance_files": "SELECT p_name AS sequence, count(*) AS count, min(p_partkey) FILTER (WHERE p_size > 25) AS centroid FROM part GROUP BY 1",
    "one_sided_sizes": "SELECT p_name AS name, CAST(sum(p_size) AS BIGINT) AS part_sum, 1 AS n_sold FROM part WHERE p_name NOT IN (SELECT p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50) GROUP BY 1",
    "centre_maps": f"WITH {_TURNS} SELECT seq_id AS centroid, centroid AS other FROM turns WHERE seq_id <> centroid",
    "summary_with_stats": f"""WITH {_MONTHS}, c AS (SELECT strftime(o_orderdate, '%Y-%m') AS iteration, o_custkey, count(*) AS density FROM orders GROUP BY 1, 2)
SELECT iteration, n_big + 0.5::DOUBLE AS minutes, count(*) AS clusters, CAST(sum(density) AS BIGINT) AS members, max(density) AS largest FROM months JOIN c USING (iteration) GROUP BY 1, 2""",
    "clusters_over_time": f"""WITH {_MONTHS}, t AS (SELECT iteration, sum(n_big + 0.5::DOUBLE) OVER (ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS cum_minutes FROM months)
SELECT iteration, o_custkey, density, cum_minutes FROM (SELECT strftime(o_orderdate, '%Y-%m') AS iteration, o_custkey, count(*) AS density FROM orders GROUP BY 1, 2) JOIN t USING (iteration)""",
    "total_time": f"WITH {_MONTHS} SELECT substr(iteration, 1, 4) AS year, sum(n_big + 0.5::DOUBLE) AS total_minutes FROM months GROUP BY 1",
    "log_choices": f"WITH {_MONTHS} SELECT iteration, n_seqs AS n, n_big AS k, round(lgamma(n_seqs + 1) - lgamma(n_big + 1) - lgamma(n_seqs - n_big + 1), 5) AS ln_choices FROM months",
    "singleton_split": f"WITH {_CUST} SELECT o_orderstatus, count(*) FILTER (WHERE density = 1) AS n_alone, count(*) FILTER (WHERE density > 1) AS n_shared FROM sizes GROUP BY 1",
    "counted_records": """WITH r AS (SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY coalesce(source, '') HAVING count(*) > 1)
SELECT doc_id AS seq_id, coalesce(n, 1) AS count, round(100.0::DOUBLE / coalesce(n, 1), 6) AS share FROM documents LEFT JOIN r USING (doc_id)""",
    "option_rows": "SELECT 'pages' AS option, true AS is_true, CAST(count(*) AS VARCHAR) AS n FROM pages UNION ALL SELECT 'adaptive', true, NULL UNION ALL SELECT 'mode_shift', false, NULL",
}


def _frontier() -> str:
    """Step by step, as many as there are quarters of a day."""
    steps = []
    for k in range(4):
        before, world = (f"f{k - 1}", f"(SELECT max(mass) AS mass, max(bound) AS bound FROM f{k - 1})") if k else (None, "(SELECT CAST(count(*) AS DOUBLE) AS mass, CAST(0 AS BIGINT) AS bound FROM events)")
        old = f"UNION ALL SELECT size, n FROM {before} WHERE NOT frozen" if before else ""
        steps.append(f"""p{k} AS MATERIALIZED (SELECT size, CAST(sum(n) AS BIGINT) AS obs FROM (SELECT size, n FROM h WHERE iteration = {k} {old}) GROUP BY size),
e{k} AS MATERIALIZED (SELECT size, obs, mass, bound, CAST(floor(greatest(CAST(obs AS DOUBLE), (obs / (sum(obs) OVER ())) * mass / size)) AS BIGINT) AS n,
1 - exp(-(size * floor(0.05::DOUBLE * mass) / mass)) * (1 + (size * floor(0.05::DOUBLE * mass) / mass) * exp(size / mass)) AS found FROM p{k}, {world}),
t{k} AS (SELECT size, obs, mass, bound, 1 - sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(found) + (n - j) * ln(1 - found))) >= 0.9::DOUBLE AS frozen
FROM (SELECT *, unnest(range(0, obs)) AS j FROM e{k}) GROUP BY size, obs, mass, bound),
u{k} AS (SELECT *, frozen AND size >= coalesce(max(size) FILTER (WHERE NOT frozen) OVER (), 0) AS upper FROM t{k}),
f{k} AS MATERIALIZED (SELECT size, obs AS n, frozen, upper, mass - coalesce(sum(size * obs) FILTER (WHERE upper) OVER (), 0) AS mass, coalesce(min(size) FILTER (WHERE upper) OVER (), bound) AS bound FROM u{k})""")
    rows = " UNION ALL ".join(f"SELECT {k} AS iteration, * FROM f{k}" for k in range(4))
    return f"""WITH s AS (SELECT CAST(floor(hour(ts) / 6) AS INT) AS iteration, user_id, count(*) AS size FROM events GROUP BY ALL), h AS (SELECT iteration, size, count(*) AS n FROM s GROUP BY ALL),
{", ".join(steps)} SELECT CAST(iteration AS INT) AS iteration, size, n, frozen, upper, CAST(mass AS DOUBLE) AS mass, CAST(bound AS BIGINT) AS bound FROM ({rows})"""


ORACLE_SQL |= {
    "frontier_by_quarter": _frontier(),
    "stream_summary": f"{_SUMMARY} SELECT * FROM summary",
    "cluster_summary_compat": f"{_SUMMARY} SELECT *, density + 1 AS density_compat FROM summary",
    "missed_clusters": f"""WITH {_PART}, c AS (SELECT count(*) AS total FROM lineitem), k AS (SELECT DISTINCT size AS k FROM sizes), g AS (SELECT k, total, unnest([1, 2, 5, 20]) AS m FROM k, c),
d AS (SELECT *, unnest([1, 2, 5, 10]) AS percent FROM g), w AS (SELECT *, CAST(floor(total * percent / 100) AS BIGINT) AS n FROM d), i AS (SELECT *, unnest(range(0, m + 1)) AS i FROM w),
l AS (SELECT *, lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(total - k * m + 1) - lgamma(n - i + 1) - lgamma(total - k * m - n + i + 1) - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1) AS ln FROM i WHERE i <= n AND n - i <= total - k * m)
SELECT k, CAST(m AS BIGINT) AS m, CAST(percent AS BIGINT) AS percent, round(sum(exp(ln + i * ln(k))), 6) AS missed, round(sum(exp(ln + least(i, 1) * ln(k))), 6) AS compat FROM l GROUP BY k, m, percent""",
    "recruit_sweep": "WITH " + _URLS + ", p AS (SELECT t.seq_id AS target, t.s AS t, q.seq_id AS centre, q.s AS q FROM urls t, urls q WHERE q.seq_id % 20 = 0 AND length(t.s) > 0 AND length(q.s) > 0), "
    + ", ".join(f"p{k} AS (SELECT *, least({_R.format('t').replace('0.9 ', f'{s} ')}, {_R.format('q').replace('0.9 ', f'{s} ')}) AS r, CAST({s} AS DOUBLE) AS similarity FROM p)" for k, s in enumerate((0.86, 0.88, 0.9, 0.92, 0.94)))
    + """, a AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4),
e AS (SELECT similarity, target, centre FROM a WHERE length(q) >= length(t) - r AND list_min(list_transform(range(greatest(0, length(t) - r), greatest(greatest(0, length(t) - r), least(length(q), length(t) + r)) + 1), lambda j: levenshtein(t, substr(q, 1, CAST(j AS INT))))) <= r),
b AS (SELECT similarity, target, min(centre) AS centroid FROM e GROUP BY similarity, target) SELECT similarity, count(*) AS n_recruited, count(DISTINCT centroid) AS n_centroids FROM b GROUP BY similarity""",
    "two_line_records": "SELECT page_id || ' > x' AS header, trim(url) AS sequence FROM pages WHERE coalesce(url, '') <> ''",
}
