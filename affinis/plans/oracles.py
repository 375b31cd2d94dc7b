"""DuckDB statements that state each catalogue query independently."""

from __future__ import annotations

from affinis.functions.hashing import coefficients
from affinis.operators.content import DELETED


def _ratings(e: str, d: str) -> str:
    return f"""raw AS (SELECT {e} AS e, {d} AS d, l_quantity AS v, l_orderkey AS ok, l_linenumber AS ln FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ratings AS (SELECT e, d, v FROM (SELECT *, row_number() OVER (PARTITION BY e, d ORDER BY ok DESC, ln DESC, v DESC) AS rn FROM raw) WHERE rn = 1)"""


SUP, PART, CUST = _ratings("l_suppkey", "o_custkey"), _ratings("l_partkey", "o_custkey"), _ratings("o_custkey", "l_partkey")
PAIRS = "pairs AS (SELECT a.e AS i, b.e AS j, a.d, a.v AS x, b.v AS y FROM ratings a JOIN ratings b ON a.d = b.d AND a.e < b.e)"
SIX = "six AS (SELECT i, j, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM pairs GROUP BY i, j)"
SIM = "CASE WHEN n * sxy - sx * sy = 0 OR n * sxx - sx * sx <= 0 OR n * syy - sy * sy <= 0 THEN 0.0::DOUBLE ELSE (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END"
SIMS = f"sims AS (SELECT i, j, n, {SIM} AS sim FROM six WHERE n >= 3)"
MODEL = "model AS (SELECT * FROM sims WHERE sim > 1e-14)"


def _chain(rel: str, *more: str) -> str:
    return "WITH " + ",\n".join([rel, PAIRS, SIX, SIMS, MODEL, *more]) + "\n"


def _hashes(count: int) -> str:
    rows = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(coefficients(count)))
    return f"""dims AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS idx FROM (SELECT DISTINCT d FROM ratings)),
m AS (SELECT count(*) AS m FROM dims), coef(k, a, b) AS (VALUES {rows}),
sig AS (SELECT e, k::BIGINT AS k, min((a::BIGINT * idx + b) % 24251 % m.m) AS h FROM ratings JOIN dims USING (d), coef, m GROUP BY e, k)"""


def _jaccard(threshold: float) -> str:
    return f"""cand AS (SELECT DISTINCT s.e AS i, t.e AS j FROM sig s JOIN sig t ON s.k = t.k AND s.h = t.h AND s.e < t.e),
sz AS (SELECT e, count(*) AS c FROM ratings GROUP BY e),
jac AS (SELECT six.i, six.j, n, n / (a.c + b.c - n) AS jaccard FROM six JOIN cand ON six.i = cand.i AND six.j = cand.j JOIN sz a ON a.e = six.i JOIN sz b ON b.e = six.j WHERE n / (a.c + b.c - n) >= {threshold})"""


SYM = "sym AS (SELECT i AS x, j AS y, sim FROM model UNION ALL SELECT j, i, sim FROM model)"
ITEM_PRED = """near AS (SELECT t.d AS u, t.e AS i, s.y, s.sim, r.v, row_number() OVER (PARTITION BY t.d, t.e ORDER BY s.sim DESC, s.y) AS rn FROM ratings t JOIN sym s ON s.x = t.e JOIN ratings r ON r.e = s.y AND r.d = t.d),
agg AS (SELECT u, i, sum(v * sim) AS num, sum(abs(sim)) AS den FROM near WHERE rn <= 3 GROUP BY u, i),
own AS (SELECT e, avg(v) AS a FROM ratings GROUP BY e),
pred AS (SELECT t.d AS u, t.e AS i, t.v, CASE WHEN num IS NULL OR num = 0 OR den = 0 THEN own.a ELSE num / den END AS pred FROM ratings t LEFT JOIN agg ON agg.u = t.d AND agg.i = t.e JOIN own ON own.e = t.e)"""


def _user_pred(den: str, extra: str = "") -> str:
    return _chain(CUST, SYM, f"""avgs AS (SELECT e, avg(v) AS a FROM ratings GROUP BY e),
raters AS (SELECT r.e, r.d, r.v, a.a FROM ratings r JOIN avgs a USING (e)),
dens AS (SELECT d, sum(abs(a)) AS s FROM raters GROUP BY d),
agg AS (SELECT t.e AS u, t.d AS i, sum((r.v - r.a) * s.sim) AS num, sum(abs(s.sim)) AS ds FROM ratings t JOIN sym s ON s.x = t.e JOIN raters r ON r.e = s.y AND r.d = t.d GROUP BY t.e, t.d)""") + f"""
SELECT t.e AS u, t.d AS i, round(CASE WHEN num IS NULL OR num = 0 OR {den} = 0 THEN a.a ELSE a.a + num / {den} END, 6) AS pred
FROM ratings t JOIN avgs a ON a.e = t.e LEFT JOIN agg ON agg.u = t.e AND agg.i = t.d LEFT JOIN dens ON dens.d = t.d"""


_DEL = DELETED.replace("'", "''")
TOKENS = f"""tok AS (SELECT source AS doc, unnest(regexp_split_to_array(translate(lower(text), '{_DEL}', ''), '\\s+')) AS word FROM documents),
cnt AS (SELECT doc, word, count(*) AS cnt FROM tok WHERE word NOT IN ('', '-', chr(160)) GROUP BY doc, word)"""
IDF = """tot AS (SELECT count(DISTINCT doc) AS nd, sum(cnt) AS t FROM cnt),
idf AS (SELECT word, count(*) AS df, sum(cnt)::BIGINT AS total, log2(any_value(nd) / count(*)) AS idf FROM cnt, tot GROUP BY word HAVING sum(cnt) > 1e-5 * any_value(t))"""
TF = "tf AS (SELECT doc, word, cnt, cnt / max(cnt) OVER (PARTITION BY doc) AS tf FROM cnt)"
TOP = """w AS (SELECT doc, word, round(tf * idf, 9) AS tfidf FROM tf JOIN idf USING (word)),
top AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY tfidf DESC, word) AS rank FROM w QUALIFY rank <= 200)"""
CONTENT = f"WITH {TOKENS},\n{IDF},\n{TF},\n{TOP}"
FIRST = ", fst AS (SELECT lang AS u, arg_min(source, doc_id) AS doc FROM documents GROUP BY lang)"

DIST = """dist AS (SELECT i, j, CASE WHEN (i + j) % 97 = 0 THEN 'nan'::DOUBLE WHEN (i + j) % 53 = 0 THEN sim + 1e-3 WHEN (i + j) % 7 = 0 THEN sim + 1e-13 ELSE sim END AS sim FROM {src} WHERE (i + j) % 31 <> 0)"""
VERDICT = """fin AS (SELECT o.i IS NOT NULL AS ho, g.i IS NOT NULL AS hg, o.sim AS o, g.sim AS g, coalesce(isfinite(o.sim), false) AS fo, coalesce(isfinite(g.sim), false) AS fg FROM {a} o FULL JOIN {b} g ON o.i = g.i AND o.j = g.j),
ver AS (SELECT count(*) FILTER (ho) AS n_output, count(*) FILTER (hg) AS n_golden, count(*) FILTER (NOT (ho AND hg)) AS unmatched, count(*) FILTER (ho AND NOT fo) AS nonfinite_output, count(*) FILTER (hg AND NOT fg) AS nonfinite_golden,
 count(*) FILTER (fo AND fg) AS finite_compared, count(*) FILTER (fo AND fg AND abs(o - g) > 1e-12) AS tol_failures, coalesce(max(CASE WHEN fo AND fg THEN abs(o - g) END), 0.0::DOUBLE) AS max_abs_diff,
 count(*) FILTER (fo AND o > 1e-14) AS emitted, count(*) FILTER (fg AND g > 1e-14) AS emitted_golden, count(*) FILTER ((fo AND o > 1e-14) <> (fg AND g > 1e-14)) AS emitted_mismatches FROM fin)
SELECT *, reason IS NULL AS passed FROM (SELECT *, CASE WHEN n_output <> n_golden OR unmatched > 0 THEN 'length' WHEN nonfinite_output + nonfinite_golden > 0 THEN 'finiteness' WHEN tol_failures > 0 THEN 'tolerance' WHEN emitted_mismatches > 0 THEN 'membership' END AS reason FROM ver)"""

LENS = "lens AS (SELECT e, count(*) AS len FROM ratings GROUP BY e), sl AS (SELECT sims.i, sims.j, n, least(a.len, b.len) AS short, greatest(a.len, b.len) AS long FROM sims JOIN lens a ON a.e = sims.i JOIN lens b ON b.e = sims.j)"
ORDER = "ord AS (SELECT row_number() OVER (ORDER BY short, i, j) - 1 AS slot, i, j, short FROM sl)"
EVENTS = "iv AS (SELECT user_id AS u, event_type AS kind, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + (props::JSON ->> 'k')::BIGINT * 60 + 60 AS e FROM events)"


def _islands(src: str, name: str, where: str = "true") -> str:
    return f"""{name}0 AS (SELECT u, s, e, max(e) OVER (PARTITION BY u ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src} WHERE {where}),
{name}1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM {name}0),
{name} AS (SELECT u, min(s) AS s, max(e) AS e FROM {name}1 GROUP BY u, island)"""


TRIALS = "trials AS (SELECT l_returnflag AS config, (day(l_shipdate) * 10 + l_linenumber)::BIGINT AS block, l_linestatus AS segment, sum(l_quantity) AS seconds FROM lineitem GROUP BY ALL)"
RATIOS = f"{TRIALS}, lr AS (SELECT ln(a.seconds / b.seconds) AS r FROM trials a JOIN trials b USING (block, segment) WHERE a.config = 'A' AND b.config = 'R')"


def _lane(g: int) -> str:
    return f"SELECT {g} AS \"group\", sum(e)::BIGINT AS effective, sum(rounds * 32)::BIGINT AS slots, round(sum(e) / sum(rounds * 32), 9) AS utilisation FROM (SELECT slot // {32 // g} AS w, sum(short) AS e, max((short + {g - 1}) // {g}) AS rounds FROM ord GROUP BY w)"


def _prefix() -> str:
    from affinis.plans.catalogue import PREFIX_SIZES

    sizes = ", ".join(f"({n})" for n in PREFIX_SIZES)
    return _chain(SUP, "p AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS k, sim FROM sims)", f"sizes(size) AS (VALUES {sizes})", """f AS (SELECT size, size <= (SELECT count(*) FROM p) AS available,
 coalesce(size >= 2 AND (SELECT sim FROM p WHERE k = size // 2 - 1) = (SELECT sim FROM p WHERE k = size // 2), false) AS a,
 coalesce(size >= 3 AND (SELECT sim FROM p WHERE k = size - 2) = (SELECT sim FROM p WHERE k = size - 1), false) AS b FROM sizes)""") + "SELECT size, available, available AND a AS split_equal, available AND b AS end_equal, available AND (a OR b) AS refused FROM f"


ORACLES: dict[str, str] = {
    "ratings_dedup_last_wins": f"WITH {SUP} SELECT e, d, v FROM ratings",
    "ratings_user_orientation": f"WITH {_ratings('o_custkey', 'l_suppkey')} SELECT e, d, v FROM ratings",
    "distinct_ids": f"WITH {SUP} SELECT DISTINCT 'e' AS side, e AS id FROM ratings UNION ALL SELECT DISTINCT 'd', d FROM ratings",
    "entity_support_filter": f"WITH {PART} SELECT e, count(*) AS n FROM ratings GROUP BY e HAVING count(*) >= 3",
    "supported_rows": f"WITH {PART} SELECT e, d, v FROM ratings WHERE e IN (SELECT e FROM ratings GROUP BY e HAVING count(*) >= 30)",
    "dense_entity_ids": f"WITH {PART} SELECT e, row_number() OVER (ORDER BY e) - 1 AS idx FROM (SELECT DISTINCT e FROM ratings)",
    "mod_subset": f"WITH {PART}, ids AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS idx FROM (SELECT DISTINCT e FROM ratings)) SELECT e, d, v FROM ratings WHERE e IN (SELECT e FROM ids WHERE idx % 11 = 0)",
    "topk_active_entities": f"WITH {PART} SELECT e, d, v FROM ratings WHERE e IN (SELECT e FROM ratings GROUP BY e ORDER BY count(*) DESC, e LIMIT 50)",
    "row_length_stats": f"WITH {SUP} SELECT max(c) AS max_row, min(c) AS min_row, sum(c)::BIGINT AS nnz FROM (SELECT count(*) AS c FROM ratings GROUP BY e)",
    "restricted_row_lengths": f"WITH {SUP} SELECT e, count(*) FILTER (d >= 100 AND d < 500) AS len FROM ratings GROUP BY e",
    "payload_domain_report": f"""WITH {SUP}, dom AS (SELECT max(c) AS max_row, max(v) AS vmax, bool_and(i) AS integral, bool_and(f) AS finite FROM (SELECT count(*) AS c, max(v) AS v, bool_and(v >= 0 AND v = floor(v)) AS i, bool_and(isfinite(v)) AS f FROM ratings GROUP BY e)),
lim(payload, top) AS (VALUES ('f64', NULL), ('i32', 2147483647), ('packed', 2097151)) SELECT payload, max_row, vmax, integral, finite, finite AND (top IS NULL OR (integral AND max_row <= top AND vmax * max_row <= top AND vmax * vmax * max_row <= top)) AS accepted FROM lim, dom""",
    "payload_bit_audit": f"""WITH {SUP}, {PAIRS}, {SIX}, dom AS (SELECT max(c) AS r, max(v) AS m FROM (SELECT count(*) AS c, max(v) AS v FROM ratings GROUP BY e)), o AS (SELECT max(n) AS n, max(sx) AS sx, max(sy) AS sy, max(sxx) AS sxx, max(syy) AS syy, max(sxy) AS sxy FROM six),
f AS (SELECT 'n' AS field, r::BIGINT AS bound, n::BIGINT AS observed FROM dom, o UNION ALL SELECT 'sx', (r * m)::BIGINT, sx::BIGINT FROM dom, o UNION ALL SELECT 'sy', (r * m)::BIGINT, sy::BIGINT FROM dom, o UNION ALL SELECT 'sxx', (r * m * m)::BIGINT, sxx::BIGINT FROM dom, o UNION ALL SELECT 'syy', (r * m * m)::BIGINT, syy::BIGINT FROM dom, o UNION ALL SELECT 'sxy', (r * m * m)::BIGINT, sxy::BIGINT FROM dom, o)
SELECT field, bound, CASE WHEN bound = 0 THEN 0 ELSE length(bin(bound))::INTEGER END AS bound_bits, observed, CASE WHEN observed = 0 THEN 0 ELSE length(bin(observed))::INTEGER END AS observed_bits FROM f""",
    "pair_overlap_counts": f"WITH {SUP}, {PAIRS} SELECT i, j, count(*) AS n FROM pairs GROUP BY i, j HAVING count(*) >= 3",
    "pair_six_stats": _chain(SUP) + "SELECT * FROM six WHERE n >= 3",
    "item_pearson_all": _chain(PART) + "SELECT * FROM sims",
    "item_pearson_emitted": _chain(SUP) + "SELECT * FROM model",
    "part_pearson_emitted": _chain(PART) + "SELECT * FROM model",
    "user_pearson_emitted": _chain(CUST) + "SELECT * FROM model",
    "pearson_two_pass": f"""WITH {SUP}, {PAIRS}, mean AS (SELECT i, j, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM pairs GROUP BY i, j HAVING count(*) >= 3),
c AS (SELECT i, j, n, sum((x - mx) * (y - my)) AS c, sum((x - mx) * (x - mx)) AS a, sum((y - my) * (y - my)) AS b FROM pairs JOIN mean USING (i, j) GROUP BY i, j, n)
SELECT i, j, n, round(CASE WHEN c = 0 OR a <= 0 OR b <= 0 THEN 0.0::DOUBLE ELSE c / (sqrt(a) * sqrt(b)) END, 9) + 0.0::DOUBLE AS sim FROM c""",
    "given_pairs_pearson": f"""WITH {PART}, asked AS (SELECT DISTINCT e AS i, e + k AS j FROM ratings, (VALUES (1), (97)) t(k)),
six AS (SELECT asked.i, asked.j, count(y.v) AS n, coalesce(sum(CASE WHEN y.v IS NOT NULL THEN x.v END), 0) AS sx, coalesce(sum(y.v), 0) AS sy, coalesce(sum(CASE WHEN y.v IS NOT NULL THEN x.v * x.v END), 0) AS sxx, coalesce(sum(y.v * y.v), 0) AS syy, coalesce(sum(x.v * y.v), 0) AS sxy
 FROM asked LEFT JOIN ratings x ON x.e = asked.i LEFT JOIN ratings y ON y.e = asked.j AND y.d = x.d GROUP BY asked.i, asked.j)
SELECT i, j, n, {SIM} AS sim FROM six""",
    "pearson_dim_sharded": _chain(SUP) + "SELECT * FROM model",
    "pearson_packed": _chain(SUP) + "SELECT * FROM model",
    "pearson_i32": _chain(SUP) + "SELECT * FROM sims",
    "pearson_packed_dim": _chain(SUP) + "SELECT * FROM model",
    "pearson_i32_dim": _chain(SUP) + "SELECT * FROM model",
    "packed_words": _chain(SUP) + "SELECT i, j, (n << 42) | (sx::BIGINT << 21) | sy::BIGINT AS w0, (sxx::BIGINT << 42) | (syy::BIGINT << 21) | sxy::BIGINT AS w1, n, sx::BIGINT AS sx, sy::BIGINT AS sy, sxx::BIGINT AS sxx, syy::BIGINT AS syy, sxy::BIGINT AS sxy FROM six WHERE n >= 3",
    "minhash_signatures": f"WITH {SUP}, {_hashes(50)} SELECT e, k, h FROM sig",
    "lsh_bands": f"WITH {SUP}, {_hashes(50)} SELECT e, k // 2 AS band, (sum(131 * h) & 2147483647)::BIGINT AS bucket FROM sig GROUP BY e, k // 2",
    "lsh_candidates": f"WITH {SUP}, {_hashes(50)} SELECT DISTINCT s.e AS i, t.e AS j FROM sig s JOIN sig t ON s.k = t.k AND s.h = t.h AND s.e < t.e",
    "lsh_jaccard_pairs": _chain(PART, _hashes(50), _jaccard(0.05)) + "SELECT * FROM jac",
    "lsh_jaccard_pairs_100": _chain(SUP, _hashes(100), _jaccard(0.05)) + "SELECT * FROM jac",
    "lsh_user_pearson": _chain(CUST, _hashes(50), _jaccard(0.01)) + "SELECT model.* FROM model JOIN jac USING (i, j)",
    "item_topn_prediction": _chain(SUP, SYM, ITEM_PRED) + "SELECT u, i, round(pred, 6) AS pred FROM pred",
    "user_prediction_corrected": _user_pred("ds"),
    "user_prediction_compat": _user_pred("dens.s"),
    "entity_averages_with_unk": f"WITH {SUP} SELECT e::VARCHAR AS id, round(avg(v), 9) AS avg FROM ratings GROUP BY e UNION ALL SELECT 'UNK', round(avg(v), 9) FROM ratings",
    "prediction_rmse": _chain(SUP, SYM, ITEM_PRED) + "SELECT count(*) AS n, round(sqrt(avg((pred - v) * (pred - v))), 6) AS rmse, round(avg(CASE WHEN pred IS NOT NULL THEN 1 ELSE 0 END), 6) AS coverage FROM pred",
    "doc_tokens": f"WITH {TOKENS} SELECT * FROM cnt",
    "doc_tf": f"WITH {TOKENS}, {TF} SELECT doc, word, cnt, round(tf, 9) AS tf FROM tf",
    "word_idf": f"WITH {TOKENS}, {IDF} SELECT word, df, total, round(idf, 9) AS idf FROM idf",
    "doc_tfidf_top200": f"{CONTENT} SELECT doc, word, tfidf, rank FROM top",
    "user_profile_union": f"{CONTENT} SELECT DISTINCT lang AS u, word FROM (SELECT DISTINCT lang, source FROM documents) r JOIN top ON top.doc = r.source",
    "user_profile_first": f"{CONTENT}{FIRST} SELECT u, word FROM fst JOIN top USING (doc)",
    "set_cosine_pairs": f"""{CONTENT}{FIRST}, uw AS (SELECT u, word FROM fst JOIN top USING (doc)), pr AS (SELECT DISTINCT lang AS u, source AS doc FROM documents),
sz AS (SELECT doc, count(*) AS c FROM top GROUP BY doc), us AS (SELECT u, count(*) AS c FROM uw GROUP BY u), inter AS (SELECT pr.u, pr.doc, count(*) AS n FROM pr JOIN uw ON uw.u = pr.u JOIN top ON top.doc = pr.doc AND top.word = uw.word GROUP BY pr.u, pr.doc)
SELECT u, doc, round(n / (sqrt(us.c) * sqrt(sz.c)), 9) AS sim FROM inter JOIN us USING (u) JOIN sz USING (doc) WHERE n / (sqrt(us.c) * sqrt(sz.c)) >= 0.01""",
    "result_check_pass": _chain(SUP, VERDICT.format(a="sims", b="sims").split("\nSELECT")[0]) + "SELECT" + VERDICT.split("\nSELECT")[1],
    "result_check_report": _chain(SUP, DIST.format(src="sims"), VERDICT.format(a="dist", b="sims").split("\nSELECT")[0]) + "SELECT" + VERDICT.split("\nSELECT")[1],
    "model_crosscheck": _chain(SUP, DIST.format(src="model"), "x AS (SELECT m.sim AS o, t.sim AS t FROM model m FULL JOIN (SELECT * FROM dist WHERE NOT isnan(sim)) t ON m.i = t.i AND m.j = t.j)") + "SELECT count(o) AS ours, count(t) AS theirs, count(abs(o - t)) AS common, count(*) FILTER (t IS NULL) AS only_ours, count(*) FILTER (o IS NULL) AS only_theirs, coalesce(max(abs(o - t)), 0.0::DOUBLE) AS max_abs_diff, count(*) FILTER (abs(o - t) > 1e-12) AS value_failures, count(*) FILTER ((t IS NULL AND o > 1e-14 + 1e-11) OR (o IS NULL AND t > 1e-14 + 1e-11)) AS member_failures FROM x",
    "model_membership_difference": _chain(SUP, DIST.format(src="model")) + "SELECT i, j FROM model EXCEPT ALL SELECT i, j FROM dist",
    "overlap_band_flat": _chain(PART) + "SELECT i, j, n FROM six WHERE n = 3",
    "overlap_band_skew": _chain(SUP) + "SELECT i, j, n FROM six WHERE n >= 11",
    "overlap_band_stats": _chain(SUP, "b AS (SELECT n, CASE WHEN n = 3 THEN 'flat' ELSE 'skew' END AS band FROM sims WHERE n = 3 OR n >= 11)") + "SELECT band, count(*) AS n_pairs, min(n) AS n_min, max(n) AS n_max, round(avg(n), 6) AS n_mean, round(stddev_pop(n), 6) AS n_stdev, round(sum(n) / (SELECT sum(n) FROM sims), 6) AS work_share FROM b GROUP BY band",
    "prefix_pairs_boundary": "",
    "stratified_match_sample": _chain(PART, LENS, """s AS (SELECT *, CASE WHEN short BETWEEN 29 AND 30 OR short BETWEEN 24 AND 25 THEN 1 WHEN short BETWEEN 37 AND 38 OR short BETWEEN 33 AND 34 THEN 2 END AS bucket,
 CASE WHEN short BETWEEN 29 AND 30 OR short BETWEEN 37 AND 38 THEN 'full' WHEN short BETWEEN 24 AND 25 OR short BETWEEN 33 AND 34 THEN 'tail' END AS side, length(bin(long))::INTEGER AS depth, least(n * 10 // short, 9)::INTEGER AS decile FROM sl),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket, depth, decile, side ORDER BY i, j) AS rn, count(*) FILTER (side = 'full') OVER (PARTITION BY bucket, depth, decile) AS nf, count(*) FILTER (side = 'tail') OVER (PARTITION BY bucket, depth, decile) AS nt FROM s WHERE side IS NOT NULL)""") + "SELECT i, j, side, bucket, depth, decile FROM r WHERE rn <= least(nf, nt)",
    "short_len_order": _chain(SUP, LENS, ORDER) + "SELECT * FROM ord",
    "lane_slot_cost": _chain(SUP, LENS, ORDER) + " UNION ALL ".join(_lane(g) for g in (1, 4, 32)),
    "shard_ranges_tile": "WITH t AS (SELECT count(*) AS n FROM lineitem), s(shards) AS (VALUES (1), (3), (7)), r AS (SELECT shards, g, n, n * g // shards AS b, n * (g + 1) // shards AS e FROM s, t, generate_series(0, 6) q(g) WHERE g < shards), x AS (SELECT *, lead(b, 1, n) OVER (PARTITION BY shards ORDER BY g) AS nx FROM r) SELECT shards, count(*) FILTER (e <> nx OR e < b OR (g = 0 AND b <> 0)) AS gaps, sum(e - b)::BIGINT AS covered FROM x GROUP BY shards",
    "interval_union": f"WITH {EVENTS}, {_islands('iv', 'un')} SELECT u, s, e FROM un",
    "interval_overlap": f"WITH {EVENTS}, {_islands('iv', 'ua', 'kind = (SELECT min(kind) FROM iv)')}, {_islands('iv', 'ub', 'kind = (SELECT max(kind) FROM iv)')}, ta AS (SELECT u, sum(e - s)::BIGINT AS t FROM ua GROUP BY u), tb AS (SELECT u, sum(e - s)::BIGINT AS t FROM ub GROUP BY u), ov AS (SELECT ua.u, sum(least(ua.e, ub.e) - greatest(ua.s, ub.s))::BIGINT AS t FROM ua JOIN ub ON ua.u = ub.u AND ua.s < ub.e AND ub.s < ua.e GROUP BY ua.u) SELECT ta.u, ta.t AS a_total, tb.t AS b_total, coalesce(ov.t, 0) AS overlapped FROM ta JOIN tb ON ta.u = tb.u LEFT JOIN ov ON ov.u = ta.u",
    "trial_summary": f"""WITH {TRIALS}, x AS (SELECT config, count(*) AS n, list_sort(list(seconds)) AS xs, median(seconds) AS m, min(seconds) AS lo, max(seconds) AS hi, coalesce(stddev_samp(seconds), 0) AS sd FROM trials GROUP BY config),
q AS (SELECT *, least(greatest(floor(0.25 * (n + 1))::BIGINT, 1), n - 1) AS a, least(greatest(floor(0.75 * (n + 1))::BIGINT, 1), n - 1) AS b FROM x), p AS (SELECT *, CASE WHEN n >= 4 THEN xs[a] + (xs[a + 1] - xs[a]) * (0.25::DOUBLE * (n + 1) - a) END AS p25, CASE WHEN n >= 4 THEN xs[b] + (xs[b + 1] - xs[b]) * (0.75::DOUBLE * (n + 1) - b) END AS p75 FROM q)
SELECT config, n AS n_trials, round(m, 9) AS median_s, round(lo, 9) AS min_s, round(hi, 9) AS max_s, round(sd, 9) AS stdev_s, round(p25, 9) AS p25_s, round(p75, 9) AS p75_s, round(p75 - p25, 9) AS iqr_s FROM p""",
    "paired_log_ratio": f"WITH {RATIOS}, s AS (SELECT count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM lr) SELECT n, round(exp(m), 9) AS ratio, round(exp(m - sd / sqrt(n) * 1.96), 9) AS low, round(exp(m + sd / sqrt(n) * 1.96), 9) AS high FROM s",
    "incremental_sums": _chain(SUP) + "SELECT i, j, n, sim FROM sims",
}
ORACLES["prefix_pairs_boundary"] = _prefix()

# --- files --------------------------------------------------------------------------------------

NAMED = "SELECT 'u' || d AS user_id, 'b' || e AS business_id, v AS stars FROM ratings"
NAMED_MODEL = "SELECT least('b' || i, 'b' || j) AS a, greatest('b' || i, 'b' || j) AS b, sim FROM model"


def _strings(relation: str, e: str, d: str) -> str:
    """The rating relation under the names that the files hold, so that they sort as strings."""
    return relation.replace("SELECT e, d, v FROM (SELECT", f"SELECT {e} AS e, {d} AS d, v FROM (SELECT")


_ITEMS, _USERS = _strings(SUP, "'b' || e", "'u' || d"), _strings(CUST, "'u' || e", "'b' || d")
_SCORE = "SELECT count(*) AS n, count(pred) AS answered, round(sqrt(avg((pred - v) * (pred - v))), 6) AS rmse FROM pred"
_LSH_MODEL = "lshmodel AS (SELECT model.* FROM model JOIN jac USING (i, j))"
_USER_PRED = """sym AS (SELECT i AS x, j AS y, sim FROM lshmodel UNION ALL SELECT j, i, sim FROM lshmodel), avgs AS (SELECT e, avg(v) AS a FROM ratings GROUP BY e),
agg AS (SELECT t.e AS u, t.d AS i, sum((r.v - b.a) * s.sim) AS num, sum(abs(s.sim)) AS den FROM ratings t JOIN sym s ON s.x = t.e JOIN ratings r ON r.e = s.y AND r.d = t.d JOIN avgs b ON b.e = r.e GROUP BY t.e, t.d),
pred AS (SELECT t.v, CASE WHEN num IS NULL OR num = 0 OR den = 0 THEN a.a ELSE a.a + num / den END AS pred FROM ratings t JOIN avgs a ON a.e = t.e LEFT JOIN agg ON agg.u = t.e AND agg.i = t.d)"""

ORACLES |= {
    "source_reviews": f"WITH {SUP} {NAMED}",
    "source_test_pairs": f"WITH {SUP} SELECT user_id, business_id FROM ({NAMED})",
    "source_numbered_lines": f"WITH {SUP} SELECT count(*) AS n, 0::BIGINT AS first, count(*) - 1 AS last, (count(*) * (count(*) - 1) // 2)::BIGINT AS total, count(*) AS numbers FROM ratings",
    "source_numbered_reviews": f"WITH {SUP} SELECT business_id, max(user_id) AS user_id, min(user_id) AS first_user FROM ({NAMED}) GROUP BY business_id",
    "source_model": _chain(SUP) + NAMED_MODEL,
    "sink_model_by_name": _chain(SUP) + NAMED_MODEL,
    "sink_results": _chain(SUP) + "SELECT row_number() OVER (ORDER BY i, j) - 1 AS k, sim FROM sims",
    "source_averages": ORACLES["entity_averages_with_unk"],
    "source_stop_words": f"WITH {TOKENS}, stop AS (SELECT DISTINCT unnest(regexp_split_to_array(translate(lower(text), '{_DEL}', ''), '\\s+')) AS word FROM benchmark) SELECT * FROM cnt WHERE word NOT IN (SELECT word FROM stop WHERE word IS NOT NULL)",
    "source_sections": f"{CONTENT}, t20 AS (SELECT * FROM top WHERE rank <= 20) SELECT 'b' AS section, doc AS id, (rank - 1)::INTEGER AS at, word FROM t20 UNION ALL SELECT 'u', doc, 0, word FROM t20 WHERE rank = 1",
    "source_trace": "SELECT (user_id % 4)::BIGINT AS device, CASE WHEN event_id % 2 = 0 THEN 'stats' ELSE 'reduce' END AS name, (10 * event_id)::BIGINT AS s, (10 * event_id + user_id % 7 + 1)::BIGINT AS e FROM events WHERE event_id < 1000",
    "source_records": f"WITH {TRIALS} SELECT config, count(*) AS n, round(sum(seconds), 6) AS seconds FROM trials GROUP BY config",
    "train_predict_item": _chain(_ITEMS, SYM, ITEM_PRED) + _SCORE,
    "train_predict_user": _chain(_USERS, _hashes(50), _jaccard(0.01), _LSH_MODEL, _USER_PRED) + _SCORE,
    "fixture_roundtrip": "SELECT unnest(['digests', 'emitted_count', 'golden_recomputed', 'dims_ascending', 'pair_canonical', 'pairs_sorted']) AS rule, 0::BIGINT AS violations",
    "bootstrap_ci": f"""WITH {TRIALS}, lr AS (SELECT segment, block, ln(a.seconds / b.seconds) AS r FROM trials a JOIN trials b USING (block, segment) WHERE a.config = 'A' AND b.config = 'R'),
bl AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY block) - 1 AS pos, count(*) OVER (PARTITION BY segment) AS size FROM lr),
pk AS (SELECT segment, draw, ('0x' || substr(md5('20260917|' || draw || '|' || segment || '|' || pos), 1, 12))::BIGINT % size AS pos FROM bl, generate_series(0, 4999) g(draw)),
mn AS (SELECT draw, avg(r) AS m FROM pk JOIN bl USING (segment, pos) GROUP BY draw)
SELECT count(*) AS draws, round(exp(quantile_cont(m, 0.025)), 9) AS low, round(exp(quantile_cont(m, 0.975)), 9) AS high FROM mn""",
}
