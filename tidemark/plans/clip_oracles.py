"""DuckDB SQL of the clip workflow's queries, written from the operators' meaning and not from their code."""

from __future__ import annotations

from .oracles import DAY, GREY, HOUR, LERP, S, TWO, _cos, _islands

PIXELS = "f AS (SELECT label AS video, vec_id, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 255) AS INT)) AS p FROM embeddings)"
CLOCK = "m AS (SELECT event_id, (epoch_us(ts) // 60000000) % 1440 AS m FROM events)"
FOUND = f"""
        e AS (SELECT event_id, video, us, CASE WHEN event_id % 11 = 0 THEN 'skipped_no_anchor' WHEN event_id % 13 = 0 THEN 'unparseable' END AS note FROM s WHERE camera = 'signup'),
        r AS (SELECT e.event_id, r.us AS start, e.us - r.us AS off FROM e JOIN s r ON e.video = r.video AND r.camera = 'view' AND e.us BETWEEN r.us AND r.us + {DAY}
              QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.us - r.us - {DAY // 2}), r.event_id) = 1),
        a AS (SELECT e.*, start, start + greatest(0, off - {6 * HOUR}) AS lo, start + least({DAY}, off + {6 * HOUR}) AS hi FROM e LEFT JOIN r USING (event_id)),
        x AS (SELECT a.event_id, a.lo, c.us, c.event_id % 4 = 0 AS dark, CASE WHEN c.event_id % 4 = 0 OR c.us < a.lo + {HOUR} THEN 0 ELSE c.score END AS score
              FROM a JOIN s c ON c.video = a.video AND c.camera = 'click' AND c.us BETWEEN a.lo AND a.hi WHERE note IS NULL AND start IS NOT NULL),
        w AS (SELECT event_id, lo, us, dark, sum(CAST(score AS DECIMAL(20, 4))) OVER (PARTITION BY event_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {HOUR - 1} FOLLOWING) AS total FROM x),
        b AS (SELECT event_id, min(lo) AS lo, bool_and(dark) AS all_dark FROM w GROUP BY event_id),
        t AS (SELECT event_id, us AS top FROM w QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY total DESC, us) = 1),
        o AS (SELECT a.event_id, coalesce(note, CASE WHEN start IS NULL THEN 'no_segment_on_server' WHEN top IS NULL THEN 'no_scores' WHEN all_dark THEN 'no_bright_frames' END) AS skip_reason, greatest(a.lo, top - 120000000) AS cut_at
              FROM a LEFT JOIN b USING (event_id) LEFT JOIN t USING (event_id))"""

SQL: dict[str, str] = {
    "listing_manifest": """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'http://v/' || c_custkey ELSE 'https://videos/' || c_custkey END AS url,
        CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE '' END AS title, CASE WHEN c_nationkey > 5 THEN c_nationkey * 1.5 ELSE 0 END AS duration FROM customer WHERE c_custkey % 7 <> 0""",
    "listing_videos": r"""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*/([a-z]{2})/', 1) AS camera, regexp_extract_all(replace(html, '">', '.mp4">'), 'href="([^"]+\.mp4)"', 1) AS h FROM pages WHERE page_id % 5 <> 0)
        SELECT page_id, camera, unnest(range(len(h))) AS pos, unnest(h) AS href FROM p""",
    "pending_items": "SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'P'",
    "manifest_join": "SELECT l_linestatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY l_linestatus",
    "series_round_trip": f"WITH {S} SELECT event_id, video, us, score FROM s WHERE camera = 'view'",
    "features_union": "SELECT vec_id, CAST(label AS BIGINT) AS video_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS place FROM embeddings",
    "cluster_sizes": "SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label",
    "cluster_members": "SELECT vec_id, 'kind ' || label AS name FROM embeddings",
    "mask_round_trip": f"WITH {PIXELS} SELECT vec_id AS event_id, array_to_string(list_transform(p, lambda x: printf('%02X', greatest(0, least(255, x)))), '') AS mask, len(p) AS n FROM f",
    "clip_durations": "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 0.0 WHEN s_suppkey % 3 = 1 THEN round(floor(abs(s_acctbal) * 100) * 0.04, 3) ELSE round(floor(abs(s_acctbal) * 100) / 1000, 3) END AS duration FROM supplier",
    "cut_manifest": f"""WITH {S}, {_islands('s', 'video, camera', DAY)}, c AS (SELECT video, camera, greatest(0, start_us - 2000000) AS start_us, end_us, video || '_' || camera || '_' || (start_us // 1000000) || '.mp4' AS out FROM seg)
        SELECT *, CASE WHEN camera = 'view' THEN 'aac' ELSE 'copy' END AS codec FROM c WHERE video % 3 <> 0""",
    "slot_folders": """SELECT n_nationkey, r_regionkey, printf('slot%02d/cam%d.mp4', n_nationkey, r_regionkey) AS out FROM nation, region
        WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 0 AND s_nationkey = n_nationkey AND s_suppkey % 5 = r_regionkey)""",
    "negative_markers": f"""WITH {S}, {_islands('s', 'video, camera', 2 * DAY)}, v AS (SELECT video, count(DISTINCT camera) AS n FROM seg GROUP BY video)
        SELECT d.video, coalesce(n, 0) AS n_cameras, CASE WHEN n >= 3 THEN 'confirmed' ELSE 'negative' END AS status FROM (SELECT DISTINCT video FROM s) d LEFT JOIN v USING (video)""",
    "event_clip_index": f"WITH {S}, {FOUND} SELECT event_id, CASE WHEN skip_reason IS NULL THEN 'extracted' ELSE 'skipped' END AS status, skip_reason, CASE WHEN skip_reason IS NULL THEN cut_at END AS clip_start FROM o",
    "event_outcomes": f"WITH {S}, {FOUND} SELECT coalesce(skip_reason, 'extracted') AS reason, count(*) AS n FROM o GROUP BY ALL",
    "combined_scores": f"""WITH {S}, {_islands('s', 'video', HOUR)}, p AS (SELECT video, round(max(score) * min(score), 4) AS combined FROM s GROUP BY video)
        SELECT seg.video, (start_us + end_us) // 2 AS middle_us, combined FROM seg JOIN p ON seg.video = p.video""",
    "first_last_detection": f"""WITH {S}, u AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY us, event_id) AS k FROM s WHERE score >= 60)
        SELECT video, min(us) AS first_us, max(us) AS last_us, count(*) AS n, string_agg(CAST(us AS VARCHAR), ',' ORDER BY us) FILTER (WHERE k <= 5) AS first_five FROM u GROUP BY video""",
    "recording_hours": """SELECT event_id, strftime(ts, '%H%M%S') || '--vv-1' AS stem, date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + date_part('second', ts) AS start_sec,
        printf('%02d:%02d', date_part('hour', ts) * 60 + date_part('minute', ts), date_part('second', ts)) AS clock FROM events WHERE date_part('hour', ts) >= 9""",
    "first_names": f"""WITH {S}, r AS (SELECT *, CASE camera WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS rank FROM s)
        SELECT video, rank, count(*) AS n, min(event_id) AS first_id FROM r WHERE rank = (SELECT min(rank) FROM r q WHERE q.video = r.video) GROUP BY video, rank""",
    "camera_names": "SELECT c_custkey, 'building1' AS camera FROM customer WHERE c_mktsegment = 'BUILDING' AND ends_with(c_name, '1')",
    "iso_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "number_pairs": """WITH v AS (SELECT o_orderkey, o_orderkey % 4 <> 0 AND o_custkey < o_orderkey AS ok, o_custkey FROM orders)
        SELECT o_orderkey, CASE WHEN ok THEN CAST(o_custkey AS DOUBLE) END AS start, CASE WHEN ok THEN CAST(o_orderkey AS DOUBLE) END AS "end" FROM v""",
    "half_even": "SELECT o_orderkey, CASE o_custkey % 4 WHEN 1 THEN o_custkey // 4 + 0.2 WHEN 3 THEN o_custkey // 4 + 0.8 ELSE o_custkey / 4 END AS tenths FROM orders",
    "json_round_trip": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, upper(n_name) AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation",
    "camera_lists": f"WITH {S} SELECT video, string_agg(DISTINCT camera, ',' ORDER BY camera) AS cameras FROM s GROUP BY video",
    "daily_limit": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders QUALIFY row_number() OVER (PARTITION BY day ORDER BY o_orderkey) <= 2",
    "above_baseline": f"""{TWO}, c AS (SELECT vec_id, round({_cos('embedding', 'q0', '1e-8')}, 4) AS similarity, round({_cos('q0', 'q1', '1e-8')}, 4) + 0.05 AS least FROM v WHERE vec_id > 1)
        SELECT vec_id, similarity FROM (SELECT * FROM c ORDER BY similarity DESC, vec_id LIMIT 3) WHERE similarity >= least""",
    "largest_masks": f"WITH {PIXELS} SELECT video, vec_id AS event_id, len(list_filter(p, lambda x: x > 20)) AS area FROM f QUALIFY row_number() OVER (PARTITION BY video ORDER BY area DESC, vec_id) <= 5",
    "blob_band": f"WITH {PIXELS}, b AS (SELECT vec_id, list_filter(p, lambda x: x BETWEEN 8 AND 40) AS q FROM f) SELECT vec_id AS event_id, coalesce(list_max(q), 0) AS largest, CAST(len(q) AS INT) AS n FROM b",
    "motion_filter": f"""WITH {GREY}, d AS (SELECT video, vec_id, abs(x - lag(x) OVER (PARTITION BY video, pos ORDER BY vec_id)) AS d FROM g),
        m AS (SELECT video, vec_id, avg(d) / 255 AS m FROM d GROUP BY video, vec_id), v AS (SELECT video, coalesce(avg(m), 0) AS motion FROM m GROUP BY video)
        SELECT video, round(motion, 6) AS motion, motion >= 0.05 AS kept FROM v""",
    "less_background": f"""WITH {PIXELS}, z AS (SELECT vec_id, p, (SELECT p FROM f WHERE vec_id = 0) AS b FROM f)
        SELECT vec_id AS event_id, array_to_string(list_transform(p, lambda x, i: greatest(0, least(255, x - b[i] + 128))), ',') AS pixels FROM z""",
    "unit_vectors": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM v)
        SELECT vec_id, round(e[1] / greatest(l, 1e-8), 5) AS first, round(2 * e[len(e)] / greatest(l * sqrt(5), 1e-8), 5) AS last FROM n""",
    "boxes": """WITH v AS (SELECT vec_id, CAST(vec_id % 101 AS DOUBLE) / 100 AS cx, CAST(vec_id % 37 AS DOUBLE) / 36 AS cy FROM embeddings), c AS (SELECT *, CAST(trunc(cx * 640) AS INT) AS px, CAST(trunc(cy * 360) AS INT) AS py FROM v)
        SELECT vec_id, CAST(trunc((cx - 0.125) * 640) AS INT) AS x1, CAST(trunc((cy - 0.25) * 360) AS INT) AS y1, CAST(trunc((cx + 0.125) * 640) AS INT) AS x2, CAST(trunc((cy + 0.25) * 360) AS INT) AS y2,
               greatest(0, least(512, px - 64)) AS crop_x, greatest(0, least(232, py - 64)) AS crop_y FROM c""",
    "filled_frames": f"""WITH {S}, d AS (SELECT video, us // {DAY} AS day, max(score) AS top FROM s GROUP BY ALL), g AS (SELECT video, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY video)
        SELECT g.video, g.day, coalesce(top, 0) AS top FROM g LEFT JOIN d USING (video, day)""",
    "label_times": f"""WITH {CLOCK} SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN m * 60 WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN m // 60 * 3600 WHEN event_id % 11 = 0 THEN NULL ELSE m * 60 END AS INT) AS sec,
        CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'skipped_no_anchor:''All Day''' WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'unparseable:''17??''' END AS note FROM m""",
    "frame_runs": f"""WITH {GREY}, u AS (SELECT vec_id, pos - 1 AS pos, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS island FROM g WHERE x > 20)
        SELECT vec_id AS event_id, CAST(min(pos) AS INT) AS first, CAST(max(pos) AS INT) AS last FROM u GROUP BY vec_id, island""",
    "nearest_vectors": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT a.vec_id, b.vec_id AS match, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id)
        SELECT vec_id, match, round(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, match) AS INT) AS place FROM d QUALIFY place <= 3""",
    "stream_index": "SELECT event_id, event_type AS event, CASE WHEN value < 10 THEN 'skipped' ELSE 'extracted' END AS status FROM events",
    "stream_interpolation": f"WITH {S}, {LERP} SELECT event_id, video, us, round(x, 6) AS interpolated FROM lerp",
    "stream_batches": "SELECT event_id, event_type AS camera, CASE WHEN value <= 99 THEN value / 2 END AS scored, CASE WHEN value > 99 THEN 'ValueError: saturated' END AS error FROM events",
    "stream_cameras": "SELECT event_id, event_type AS camera, CASE WHEN value <= 99 THEN value / 2 END AS scored, CASE WHEN value > 99 THEN 'ValueError: saturated' END AS error FROM events WHERE event_type IN ('view', 'click')",
    "stream_segments": f"WITH {S}, {_islands('s', 'video', HOUR)} SELECT * FROM seg",
}
