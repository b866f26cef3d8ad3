"""DuckDB SQL of the catalogue's queries, written from the operators' meaning and not from their code."""

from __future__ import annotations

#: Score samples as common table expressions.
S = "s AS (SELECT event_id, user_id AS video, event_type AS camera, epoch_us(ts) AS us, value AS score FROM events)"
HOUR, DAY = 3_600_000_000, 86_400_000_000


def _islands(source: str, key: str, least: int, test: str = "score >= 60") -> str:
    return f"""
        f AS (SELECT {key}, us, event_id, {test} AS up, lead(us) OVER (PARTITION BY {key} ORDER BY us, event_id) AS nx FROM {source}),
        i AS (SELECT *, count(*) FILTER (WHERE NOT up) OVER (PARTITION BY {key} ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f),
        seg AS (SELECT {key}, min(us) AS start_us, CASE WHEN bool_or(nx IS NULL) THEN max(us) + 1000000 ELSE max(nx) END AS end_us, count(*) AS n
                FROM i WHERE up GROUP BY {key}, island HAVING end_us - start_us >= {least})"""


def _chains(name: str, source: str, key: str, t: str, tie: str, gap: int) -> str:
    return f"""
        {name}0 AS (SELECT *, coalesce({t} - lag({t}) OVER (PARTITION BY {key} ORDER BY {t}, {tie}), {gap + 1}) > {gap} AS fresh FROM {source}),
        {name} AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY {key} ORDER BY {t}, {tie} ROWS UNBOUNDED PRECEDING) AS chain FROM {name}0)"""


def _peaks(source: str, key: str) -> str:
    return _chains("c", source, key, "us", "event_id", 12 * HOUR) + f""",
        r AS (SELECT *, row_number() OVER (PARTITION BY {key}, chain ORDER BY score DESC, us) AS k, count(*) OVER (PARTITION BY {key}, chain) AS n FROM c),
        pk AS (SELECT {key}, us AS peak_us, score AS peak_score, n FROM r WHERE k = 1)"""


def _slots(source: str, tie: str) -> str:
    return _chains("m", source, "video", "peak_us", tie, 12 * HOUR) + f""",
        slot AS (SELECT video, CAST(sum(peak_us) // count(*) AS BIGINT) AS mid, count(*) AS n FROM m GROUP BY video, chain)
        SELECT video, greatest(0, mid - {HOUR}) AS start_us, mid + {HOUR} AS end_us, n FROM slot"""


LERP = """
        q AS (SELECT * FROM s WHERE camera = 'click'), k AS (SELECT video, us, score FROM s WHERE camera = 'view'),
        lo AS (SELECT q.event_id, max(k.us) AS t FROM q JOIN k ON q.video = k.video AND k.us <= q.us GROUP BY 1),
        hi AS (SELECT q.event_id, min(k.us) AS t FROM q JOIN k ON q.video = k.video AND k.us >= q.us GROUP BY 1),
        j AS (SELECT q.event_id, q.video, q.us, q.score, lo.t AS t0, hi.t AS t1, a.score AS v0, b.score AS v1
              FROM q LEFT JOIN lo USING (event_id) LEFT JOIN hi USING (event_id)
              LEFT JOIN k a ON a.video = q.video AND a.us = lo.t LEFT JOIN k b ON b.video = q.video AND b.us = hi.t),
        lerp AS (SELECT event_id, video, us, score,
                 CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = us THEN v0 ELSE v0 + (v1 - v0) * (us - t0) / (t1 - t0) END AS x FROM j)"""

RANGE_JOIN = f"""
        e AS (SELECT event_id, video, us FROM s WHERE camera = 'signup'),
        m AS (SELECT e.event_id, r.us AS start_us, e.us - r.us AS off, {{rank}} AS rk, r.event_id AS pos
              FROM e JOIN s r ON e.video = r.video AND {{which}} AND e.us BETWEEN r.us AND r.us + {DAY}),
        b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY rk, abs(off - {DAY // 2}), pos) = 1)"""

COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))) + {g})"


def _cos(a: str, b: str, guard: str = "0.0") -> str:
    return COS.format(a=a, b=b, g=guard)


def _pairs(direction: str, queries: str = "") -> str:
    return f"""
        WITH p AS (SELECT a.vec_id AS query, b.vec_id AS match, round({_cos('a.embedding', 'b.embedding')}, 4) AS similarity
                   FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id{queries})
        SELECT query, match, similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity {direction}, match) AS INT) AS place FROM p QUALIFY place <= 3"""


TWO = "WITH v AS (SELECT e.vec_id, e.embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q0, (SELECT embedding FROM embeddings WHERE vec_id = 1) AS q1 FROM embeddings e)"
PLACES = "v AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"
GREY = "g AS (SELECT label AS video, vec_id, CAST(floor(abs(CAST(unnest(embedding) AS DOUBLE)) * 255) AS INT) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)"

SQL: dict[str, str] = {
    "segments": f"WITH {S}, {_islands('s', 'video', HOUR)} SELECT * FROM seg",
    "segments_by_camera": f"WITH {S}, {_islands('s', 'video, camera', DAY)} SELECT * FROM seg",
    "majority_vote": f"WITH {S}, {_islands('s', 'video, camera', 2 * DAY)} SELECT video, count(DISTINCT camera) AS n_cameras FROM seg GROUP BY video HAVING count(DISTINCT camera) >= 3",
    "peaks": f"WITH {S}, u AS (SELECT * FROM s WHERE score >= 60), {_peaks('u', 'video')} SELECT * FROM pk",
    "merged_slots": f"WITH {S}, u AS (SELECT * FROM s WHERE score >= 60), {_peaks('u', 'video, camera')}, {_slots('pk', 'camera')}",
    "interp_join": f"WITH {S}, {LERP} SELECT event_id, video, us, score, round(x, 6) AS interpolated FROM lerp",
    "detect_slots": f"""WITH {S}, {LERP}, w AS (SELECT event_id, video, us, coalesce(round(0.7 * score + 0.3 * x, 6), score) AS score FROM lerp),
        u AS (SELECT * FROM w WHERE score >= 42), {_peaks('u', 'video')}, {_slots('pk', 'peak_us')}""",
    "motion_diff": f"""WITH {S}, d AS (SELECT event_id, video, us, abs(score - lag(score) OVER (PARTITION BY video ORDER BY us, event_id)) AS d FROM s QUALIFY d IS NOT NULL),
        n AS (SELECT event_id, video, us, CASE WHEN max(d) OVER (PARTITION BY video) > 0 THEN d / max(d) OVER (PARTITION BY video) ELSE d END AS d FROM d)
        SELECT event_id, video, round(CASE WHEN count(*) OVER (PARTITION BY video) >= 5 THEN sum(d) OVER (PARTITION BY video ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 ELSE d END, 6) AS motion FROM n""",
    "moving_avg_even": f"""WITH {S} SELECT event_id, video, round(CASE WHEN count(*) OVER (PARTITION BY video) >= 6
        THEN sum(score) OVER (PARTITION BY video ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6 ELSE score END, 6) AS smooth FROM s""",
    "best_window": f"""WITH {S}, w AS (SELECT video, us, sum(CAST(score AS DECIMAL(20, 4))) OVER (PARTITION BY video ORDER BY us RANGE BETWEEN CURRENT ROW AND {DAY - 1} FOLLOWING) AS total FROM s)
        SELECT video, us AS start_us, CAST(total AS DOUBLE) AS total FROM w QUALIFY row_number() OVER (PARTITION BY video ORDER BY total DESC, us) = 1 AND total > 0""",
    "sample_frames": f"""WITH {S}, e AS (SELECT video, min(us) AS lo, max(us) AS hi FROM s GROUP BY video),
        g AS (SELECT video, lo + i * (hi - lo) // 16 AS at FROM e, range(16) r(i)),
        n AS (SELECT g.video, g.at, s.us FROM g JOIN s USING (video) QUALIFY row_number() OVER (PARTITION BY g.video, g.at ORDER BY abs(s.us - g.at), s.us) = 1)
        SELECT g.video, g.at, n.us AS sample_us FROM g JOIN n ON g.video = n.video AND g.at = n.at""",
    "threshold_sweep": f"""WITH {S}, t AS (SELECT s.*, thr AS threshold FROM s, (SELECT unnest(range(40, 85, 5)) AS thr)), {_islands('t', 'video, threshold', HOUR, 'score >= threshold')}
        SELECT CAST(threshold AS INT) AS threshold, count(*) AS n_segments, CAST(sum(end_us - start_us) AS BIGINT) AS kept_us FROM seg GROUP BY threshold""",
    "footage": f"""WITH {S}, {_islands('s', 'video', HOUR)}, k AS (SELECT video, CAST(sum(end_us - start_us) AS BIGINT) AS kept FROM seg GROUP BY video), a AS (SELECT video, max(us) - min(us) AS whole FROM s GROUP BY video)
        SELECT video, coalesce(kept, 0) AS kept_us, round(coalesce(100.0 * kept / nullif(whole, 0), 0.0), 6) AS percent FROM a LEFT JOIN k USING (video)""",
    "early_stop": """WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, CAST(max(CAST(o_totalprice > 450000 AS INT)) AS INT) AS confirmed FROM orders GROUP BY 1)
        SELECT * FROM d QUALIFY coalesce(sum(confirmed) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 15""",
    "status_summary": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1",
    "series_summary": f"WITH {S} SELECT video, round(max(score), 4) AS top, round(min(score), 4) AS low, round(avg(score), 6) AS mean, (array_agg(us ORDER BY score DESC, us))[1] AS top_us, count(*) FILTER (WHERE score >= 60) AS n_above FROM s GROUP BY video",
    "occupancy": f"""WITH {S}, z AS (SELECT *, min(us) OVER (PARTITION BY video) + {5 * DAY} AS e FROM s)
        SELECT video, round(avg(CASE WHEN score >= 50 THEN 1.0 ELSE 0.0 END), 6) AS occupancy, coalesce(max(score) FILTER (WHERE us BETWEEN e - {2 * DAY} AND e + {2 * DAY}), 0.0) AS event_max FROM z GROUP BY video""",
    "verdict": f"""WITH {S}, g AS (SELECT video, camera, max(CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE score END) AS top, count(*) FILTER (WHERE event_id % 3 <> 0) AS n_bright FROM s GROUP BY ALL)
        SELECT *, CASE WHEN n_bright = 0 THEN 'ALL DARK' WHEN top >= 60 THEN 'DETECTED' ELSE 'NOT FOUND' END AS verdict FROM g""",
    "colour_gate": f"""WITH e AS (SELECT user_id AS video, epoch_us(ts) AS us, value, CAST(json_extract(props, '$.k') AS INT) AS k, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t0 FROM events),
        g AS (SELECT video, round(avg(CASE WHEN k > 50 THEN 1.0 ELSE 0.0 END), 6) AS colour_share, max(CASE WHEN us < t0 + {DAY} THEN 0.0 ELSE value END) AS top FROM e GROUP BY video)
        SELECT *, CASE WHEN colour_share >= 0.5 THEN 'scored' ELSE 'skipped' END AS status FROM g""",
    "histogram40": f"WITH {S}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM s) SELECT least(39, CAST(floor((score - lo) * 40 / (hi - lo)) AS BIGINT)) AS bin, count(*) AS n FROM s, e GROUP BY 1",
    "totals_rollup": "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity, CAST(grouping(l_returnflag) AS INT) AS is_total FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    "skip_reasons": """SELECT CASE WHEN o_totalprice IS NULL THEN 'unparseable' WHEN o_totalprice < 1000 THEN 'too_short' WHEN o_totalprice > 400000 THEN 'too_long'
        WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'extracted' END AS reason, count(*) AS n FROM orders GROUP BY 1""",
    "top_global": f"WITH {S} SELECT event_id, video, us, score FROM s ORDER BY score DESC, video, us LIMIT 20",
    "top_per_group": f"WITH {S} SELECT event_id, video, score, CAST(row_number() OVER (PARTITION BY video ORDER BY score DESC, event_id) AS INT) AS place FROM s WHERE score >= 60 QUALIFY place <= 3",
    "head_tail": f"""WITH {S}, h AS (SELECT event_id, camera, score, CAST(row_number() OVER (PARTITION BY camera ORDER BY score DESC, event_id) AS INT) AS place, 'head' AS part FROM s),
        t AS (SELECT event_id, camera, score, CAST(row_number() OVER (PARTITION BY camera ORDER BY score, event_id) AS INT) AS place, 'tail' AS part FROM s)
        SELECT * FROM h WHERE place <= 8 UNION ALL SELECT * FROM t WHERE place <= 8""",
    "best_detection": f"WITH {S} SELECT video, camera, event_id, score FROM s QUALIFY row_number() OVER (PARTITION BY video, camera ORDER BY score DESC, event_id) = 1",
    "middle_item": f"WITH {S} SELECT video, list_sort(list(event_id))[count(*) // 2 + 1] AS middle FROM s GROUP BY video",
    "clip_slices": """WITH o AS (SELECT o_orderkey AS video_id, floor(o_totalprice / 1000) AS d FROM orders)
        SELECT video_id, format('{}_clip{:04d}', video_id, i) AS clip_id, CAST(i * 50 AS DOUBLE) AS start_sec, CAST((i + 1) * 50 AS DOUBLE) AS end_sec
        FROM (SELECT video_id, unnest(range(CAST(floor(d / 50) AS BIGINT))) AS i FROM o WHERE d >= 100)""",
    "event_segment_lookup": f"WITH {S}, {RANGE_JOIN.format(rank='0', which="r.camera = 'view'")} SELECT e.event_id, e.video, b.start_us, b.off AS offset_us FROM e LEFT JOIN b USING (event_id)",
    "session_fallback": f"WITH {S}, {RANGE_JOIN.format(rank="CASE r.camera WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END", which="r.camera <> 'signup'")} SELECT e.event_id, b.rk AS rank, b.pos FROM e LEFT JOIN b USING (event_id)",
    "resume_anti": """SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders o WHERE o_orderstatus <> 'F'
        AND NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderstatus = 'F' AND d.o_custkey = o.o_custkey AND d.o_orderpriority = o.o_orderpriority)
        QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1""",
    "existing_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "missing_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "camera_match": f"""WITH {S}, d AS (SELECT video, us // {DAY} AS slot, camera, event_id FROM s QUALIFY row_number() OVER (PARTITION BY video, us // {DAY}, camera ORDER BY us, event_id) = 1)
        SELECT v.video, v.slot, v.event_id AS view_id, c.event_id AS click_id FROM d v LEFT JOIN d c ON v.video = c.video AND v.slot = c.slot AND c.camera = 'click' WHERE v.camera = 'view'""",
    "cam_cross": "SELECT n_nationkey, r_regionkey FROM nation, region",
    "manifest_upsert": """SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS source FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""",
    "manifest_update": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS path FROM orders",
    "listing_hrefs": """WITH p AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS a FROM pages) SELECT page_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS pos, unnest(a) AS href FROM p""",
    "parse_times": """SELECT o_orderkey, raw, sec, note, strict_sec FROM orders JOIN (VALUES
        (0::BIGINT, '09:45', 35100::INT, NULL::VARCHAR, 35100::INT), (1, '~9:45', 35100, NULL, NULL), (2, '9', 32400, NULL, NULL), (3, '20:15 (?)', 72900, NULL, NULL),
        (4, '~ 8:05!', 29100, NULL, NULL), (5, '12:30:15', 45015, NULL, 45015), (6, '25:99', 95940, NULL, 95940), (7, '17??++', NULL, 'unparseable:''17??++''', NULL),
        (8, '17??', NULL, 'unparseable:''17??''', NULL), (9, 'noon', NULL, 'unparseable:''noon''', NULL), (10, '1:2:3:4', NULL, 'unparseable:''1:2:3:4''', NULL),
        (11, '', NULL, 'empty_time', NULL), (12, 'All day', NULL, 'skipped_no_anchor:''All day''', NULL)) AS t(id, raw, sec, note, strict_sec) ON o_orderkey % 13 = id""",
    "safe_label": """SELECT c_custkey, substring(regexp_replace(c_name || ' / ' || c_mktsegment, '[^A-Za-z0-9_]', '_', 'g'), 1, 30) AS label, replace(c_name || ' ' || c_mktsegment, ' ', '%20') AS url_part FROM customer""",
    "caption_merge": "SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS captions, count(*) AS n FROM conversations GROUP BY conv_id",
    "roi_filter": f"""WITH {S}, b AS (SELECT *, event_id % 100 AS cx, event_id * 7 % 100 AS cy, (2 * (event_id % 600) + 41) // 2 AS px, (2 * (event_id * 3 % 300) + 60) // 2 AS py FROM s)
        SELECT video, count(*) FILTER (WHERE cx BETWEEN 25 AND 75 AND cy BETWEEN 10 AND 90) AS n_inside,
               count(*) FILTER (WHERE px BETWEEN 100 AND 500 AND py BETWEEN 40 AND 250) AS n_inside_pixels,
               coalesce(max(score) FILTER (WHERE cx BETWEEN 25 AND 75 AND cy BETWEEN 10 AND 90), 0.0) AS top FROM b GROUP BY video""",
    "top_frame_names": f"""WITH {S}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, video, us) AS place FROM s QUALIFY place <= 20)
        SELECT event_id, printf('rank%02d_%s_t%04ds_score%.3f.jpg', place, CAST(video AS VARCHAR), us // 1000000, score / 100) AS name FROM t""",
    "blob_shares": f"""WITH RECURSIVE {GREY}, m AS (SELECT vec_id, CAST((pos - 1) // 8 AS INT) AS i, CAST((pos - 1) % 8 AS INT) AS j FROM g WHERE x > 20),
        r AS (SELECT vec_id, i AS i0, j AS j0, i, j FROM m UNION SELECT r.vec_id, r.i0, r.j0, m.i, m.j FROM r JOIN m ON r.vec_id = m.vec_id AND abs(r.i - m.i) <= 1 AND abs(r.j - m.j) <= 1),
        c AS (SELECT vec_id, i0, j0, min(i * 8 + j) AS root FROM r GROUP BY vec_id, i0, j0), b AS (SELECT vec_id, root, count(*) / 64.0 AS share FROM c GROUP BY vec_id, root)
        SELECT e.vec_id AS event_id, count(root) AS n_blobs, count(root) FILTER (WHERE share BETWEEN 0.05 AND 0.3) AS n_inside, round(coalesce(max(share) FILTER (WHERE share BETWEEN 0.05 AND 0.3) / 0.3, 0), 6) AS score
        FROM embeddings e LEFT JOIN b ON e.vec_id = b.vec_id GROUP BY e.vec_id""",
    "cosine_query": f"{TWO} SELECT vec_id, round({_cos('embedding', 'q0', '1e-8')}, 4) AS similarity FROM v",
    "softmax_score": f"{TWO} SELECT vec_id, round(1 / (1 + exp(10 * ({_cos('embedding', 'q1')} - {_cos('embedding', 'q0')}))), 4) AS score FROM v",
    "baseline_threshold": f"{TWO}, c AS (SELECT vec_id, round({_cos('embedding', 'q0', '1e-8')}, 4) AS similarity, round({_cos('q0', 'q1', '1e-8')}, 4) AS base FROM v) SELECT vec_id, similarity FROM c WHERE similarity >= base + 0.05",
    "pair_similarity": _pairs("DESC"),
    "pair_dissimilarity": _pairs("ASC", " WHERE a.vec_id % 100 = 0"),
    "mean_pool": f"WITH {PLACES} SELECT label, CAST(pos AS INT) AS pos, round(avg(CAST(x AS DOUBLE)), 5) AS x FROM v GROUP BY label, pos",
    "median_background": f"WITH {PLACES} SELECT label, CAST(pos AS INT) AS pos, median(CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS x FROM v GROUP BY label, pos",
    "centroid_reps": f"""WITH {PLACES}, c AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM v GROUP BY label, pos),
        d AS (SELECT v.label, v.vec_id, round(sqrt(sum((CAST(x AS DOUBLE) - m) ** 2)), 6) AS distance FROM v JOIN c ON v.label = c.label AND v.pos = c.pos GROUP BY v.label, v.vec_id)
        SELECT label, vec_id, round(distance, 4) AS distance, CAST(row_number() OVER (PARTITION BY label ORDER BY d.distance, vec_id) AS INT) AS place FROM d QUALIFY place <= 5""",
    "auto_label": """SELECT event_id, CAST(CASE WHEN user_id % 10 = 0 THEN 0 WHEN value / 100 >= 0.55 THEN 1 WHEN value / 100 <= 0.49 THEN 0 END AS INT) AS label FROM events WHERE user_id % 10 = 0 OR value / 100 >= 0.55 OR value / 100 <= 0.49""",
    "auc_by_group": """WITH r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS k FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
        g AS (SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS p, sum(k) FILTER (WHERE quality = 1) AS s FROM r GROUP BY lang)
        SELECT lang, n, p AS n_positive, round((s - p * (p + 1) / 2.0) / nullif(p * (n - p), 0), 6) AS auc FROM g""",
    "class_report": """WITH r AS (SELECT CAST(quality AS INT) AS y, CAST(n_chars > 1000 AS INT) AS p FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), c AS (SELECT unnest([0, 1]) AS k),
        m AS (SELECT k, count(*) FILTER (WHERE y = k) AS s, count(*) FILTER (WHERE p = k) AS q, count(*) FILTER (WHERE y = k AND p = k) AS t FROM c, r GROUP BY k)
        SELECT CAST(k AS INT) AS class, s AS support, round(coalesce(t / nullif(q, 0), 0), 6) AS precision, round(coalesce(t / nullif(s, 0), 0), 6) AS recall, round(coalesce(2 * t / nullif(s + q, 0), 0), 6) AS f1 FROM m""",
    "stream_sessions": f"WITH {S}, u AS (SELECT * FROM s WHERE score >= 60), {_chains('c', 'u', 'video', 'us', 'event_id', 12 * HOUR)} SELECT video, count(*) AS n, max(score) AS top FROM c GROUP BY video, chain",
    "stream_differences": f"WITH {S} SELECT video, round(abs(score - lag(score) OVER (PARTITION BY video ORDER BY us)), 6) AS diff FROM s QUALIFY diff IS NOT NULL",
    "motion_score": f"""WITH {GREY}, d AS (SELECT video, pos, vec_id, abs(x - lag(x) OVER (PARTITION BY video, pos ORDER BY vec_id)) AS d FROM g),
        f AS (SELECT video, vec_id, avg(d) / 255 AS d FROM d GROUP BY ALL) SELECT video, round(coalesce(avg(d), 0.0), 6) AS motion FROM f GROUP BY video""",
    "frame_stats": f"WITH {GREY} SELECT vec_id AS us, round(avg(x), 6) AS bright, round(avg(CASE WHEN x > 20 THEN 1.0 ELSE 0.0 END), 6) AS above FROM g GROUP BY vec_id",
    "pixel_deviation": f"WITH {GREY} SELECT g.vec_id AS us, round(avg(abs(g.x - q.x)), 6) AS deviation FROM g JOIN g q ON g.pos = q.pos AND q.vec_id = 0 GROUP BY g.vec_id",
}

_ROUNDS = "".join(
    f""",
        n{k} AS (SELECT s.video, s.us, s.score FROM s WHERE NOT EXISTS (SELECT 1 FROM t{k - 1} t WHERE t.video = s.video AND abs(t.us - s.us) < {DAY})
              QUALIFY row_number() OVER (PARTITION BY s.video ORDER BY s.score DESC, s.us) = 1), t{k} AS (SELECT * FROM t{k - 1} UNION ALL SELECT * FROM n{k})"""
    for k in range(1, 6)
)
SQL["nms_top"] = f"WITH {S}, t0 AS (SELECT video, us, score FROM s QUALIFY row_number() OVER (PARTITION BY video ORDER BY score DESC, us) = 1){_ROUNDS} SELECT video, us, score FROM t5"
