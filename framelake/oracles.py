"""DuckDB SQL for the photo queries, each written from the rules and not from the Spark plans."""

from __future__ import annotations

from .config import PHOTO_SUFFIXES
from .queries import CLOSED, EV, FACES, HV, LOOSE, PAIRS, PATHS

EV_PAIRS, HV_PAIRS = PAIRS.format("ev"), PAIRS.format("hv")
BITS = "(bit_count(xor(x.high, y.high)) + bit_count(xor(x.low, y.low)))"
IOU = """CASE WHEN least({0}.x + {0}.w, {1}.x + {1}.w) - greatest({0}.x, {1}.x) <= 0 OR least({0}.y + {0}.h, {1}.y + {1}.h) - greatest({0}.y, {1}.y) <= 0 THEN 0.0::double
  ELSE (least({0}.x + {0}.w, {1}.x + {1}.w) - greatest({0}.x, {1}.x)) * (least({0}.y + {0}.h, {1}.y + {1}.h) - greatest({0}.y, {1}.y))
     / ({0}.w * {0}.h + {1}.w * {1}.h - (least({0}.x + {0}.w, {1}.x + {1}.w) - greatest({0}.x, {1}.x)) * (least({0}.y + {0}.h, {1}.y + {1}.h) - greatest({0}.y, {1}.y))) END"""
BHATTACHARYYA = "sqrt(greatest(0.0::double, 1 - list_reduce(list_prepend(0.0::double, list_transform(list_zip({0}, {1}), lambda p: sqrt(p[1] * p[2]))), lambda s, v: s + v)))"
ISLANDS = f"""{EV}, gap AS (SELECT *, coalesce(t - lag(t) OVER (ORDER BY t, key) > 15, true) AS begins FROM ev),
isl AS (SELECT *, sum(begins::int) OVER (ORDER BY t, key ROWS UNBOUNDED PRECEDING) AS component FROM gap),
grp AS (SELECT component, count(*) AS size, min(t) AS earliest, max(t) AS latest, min(key) AS first_key, count(*) >= 2 AND max(t) - min(t) <= 15 AS is_burst FROM isl GROUP BY component)"""
GROUPED = f"""{EV}, mem AS (SELECT *, regexp_extract(path, 'u([0-9]+)', 1) || '|' || day::varchar AS component FROM ev)"""


def scored(source: str, mode: str) -> str:
    """adj, nor and ran over the members of `source`."""
    face = "face" if mode in ("face", "flag") else "0.0::double"
    burst = {"burst": "true", "noface": "false", "face": "false", "flag": "is_burst"}[mode]
    return f"""adj AS (SELECT *, CASE WHEN iso > 800 THEN sharpness / (1 + (iso - 800) * 0.00015::double) ELSE sharpness END AS adjusted FROM {source}),
nor AS (SELECT *, greatest(0.0::double, least(1.0::double, adjusted / greatest(0.01::double, max(adjusted) OVER (PARTITION BY component)))) AS s_norm FROM adj),
sco AS (SELECT *, CASE WHEN {burst} THEN s_norm WHEN {face} > 0 THEN 0.6::double * {face} + 0.35::double * s_norm + 0.05::double * exposure ELSE 0.8::double * s_norm + 0.2::double * exposure END AS score FROM nor),
ran AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, input_ord) AS rank FROM sco)"""


SCORES = "SELECT key, round(adjusted, 6) AS adjusted, round(s_norm, 6) AS s_norm, round(score, 6) AS score, rank FROM ran"
NOFACE = f"{GROUPED}, {scored('mem', 'noface')}"
FACED = f"""WITH {FACES}, big AS (SELECT *, max(w * h) OVER (PARTITION BY key) AS top FROM faces)"""
EYES = f"""per AS (
  SELECT key, list_reduce(list_prepend(0.0::double, list(sharpness ORDER BY ord, w, h)), lambda s, v: s + v) / count(*) AS fs, list_reduce(list_prepend(0.0::double, list(eye ORDER BY ord, w, h) FILTER (eye > 0)), lambda s, v: s + v) / nullif(count(*) FILTER (eye > 0), 0) AS es, bool_or({CLOSED}) AS closed, bool_and(lo IS NOT NULL AND ro IS NOT NULL) AS both_eyes,
         min(coalesce(least(lo, ro), lo, ro)) AS eye_open FROM faces GROUP BY key)"""
BASE = r"regexp_extract({0}, '[^/\\]*$')"

ORACLES = {
    "day_facets": f"WITH {EV} SELECT day::varchar AS day, count(*) AS n_files FROM ev GROUP BY ALL",
    "date_range": f"WITH {EV} SELECT key, day::varchar AS day FROM ev WHERE ev.day BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'",
    "import_cap": f"WITH {EV} SELECT key, day::varchar AS day, path || '#' || lpad(key::varchar, 12, '0') AS path FROM ev ORDER BY ev.day DESC, path LIMIT 200",
    "ext_filter": f"""WITH {PATHS}, e AS (SELECT doc_id, path, lower(regexp_extract({BASE.format("path")}, '\\.([^.]*)$', 1)) AS ext FROM paths)
        SELECT doc_id, path, ext FROM e WHERE ext IN ({", ".join(f"'{x}'" for x in PHOTO_SUFFIXES)})""",
    "path_parts": f"""WITH {PATHS}, b AS (SELECT *, {BASE.format("path")} AS base FROM paths)
        SELECT doc_id, base, regexp_replace(base, '\\.[^.]*$', '') AS stem, '/in/' || source AS dir, lower(regexp_extract(base, '\\.([^.]*)$', 1)) AS ext,
               CASE WHEN n_chars % 2 = 0 THEN base ELSE source END AS shown FROM b""",
    "parse_fnumber": f"""WITH {PATHS}, v AS (
          SELECT doc_id, CASE n_chars % 5 WHEN 0 THEN CASE WHEN n_chars % 7 <> 0 THEN (n_chars % 90)::double / (n_chars % 7) END WHEN 1 THEN (n_chars % 32) / 4::double WHEN 4 THEN (n_chars % 22)::double END AS v,
                 CASE n_chars % 5 WHEN 0 THEN (n_chars % 90) || '/' || (n_chars % 7) WHEN 2 THEN 'f/x' END AS raw FROM paths)
        SELECT doc_id, CASE WHEN v IS NOT NULL THEN regexp_replace(printf('%.1f', round(v, 1)), '\\.0$', '') ELSE raw END AS f_number FROM v""",
    "parse_iso": f"WITH {PATHS} SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN -1 ELSE n_chars END AS iso FROM paths",
    "exif_time": "SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS captured_at FROM events",
    "exif_caption": """SELECT event_id, concat_ws('  ', CASE WHEN event_type <> 'view' THEN strftime(ts, '%H:%M:%S') END, CASE WHEN user_id % 2 = 0 THEN 'F2.8' END,
               CASE WHEN user_id % 3 = 0 THEN '1/250' END, CASE WHEN user_id % 5 = 0 THEN 'ISO' || user_id END) AS caption FROM events""",
    "format_window": """WITH w AS (SELECT event_id, greatest(1, least(3600, (user_id % 70) * 60 + event_id % 60)) AS total FROM events)
        SELECT event_id, total::bigint AS total, concat_ws(' ', CASE WHEN total // 3600 > 0 THEN total // 3600 || 'h' END, CASE WHEN total % 3600 // 60 > 0 THEN total % 3600 // 60 || 'm' END,
               CASE WHEN total % 60 > 0 THEN total % 60 || 's' END) AS shown FROM w""",
    "folder_names": r"SELECT p_partkey, length(trim(p_name || CASE WHEN p_size % 3 = 0 THEN '?' ELSE '' END)) BETWEEN 1 AND 30 AND p_size % 3 <> 0 AND NOT regexp_matches(p_name, '[<>:\"/\\|?*]') AS ok FROM part",
    "candidate_pairs": f"WITH {EV}, {EV_PAIRS} SELECT a, b FROM pairs",
    "burst_pairs": f"WITH {EV}, {EV_PAIRS} SELECT a, b FROM pairs WHERE tb - ta <= 15",
    "hamming_pairs": f"""WITH {EV}, {HV}, {HV_PAIRS}
        SELECT p.a, p.b, {BITS}::bigint AS bits, {BITS} <= {LOOSE.max_phash} AS close FROM pairs p JOIN hv x ON x.key = p.a JOIN hv y ON y.key = p.b""",
    "bhattacharyya_pairs": f"""WITH {EV}, {HV}, {HV_PAIRS}, d AS (SELECT p.a, p.b, {BHATTACHARYYA.format("x.hist", "y.hist")} AS distance FROM pairs p JOIN hv x ON x.key = p.a JOIN hv y ON y.key = p.b)
        SELECT a, b, round(distance, 6) AS distance, distance > {LOOSE.max_color_distance} AS veto FROM d""",
    "adaptive_hsv": f"""WITH {EV}, {HV}, {HV_PAIRS},
        m AS (SELECT key, hist, 4.0::double * list_reduce(list_prepend(0.0::double, list_transform(list_zip(hist[17:40], range(24)), lambda p: p[1] * p[2])), lambda s, v: s + v) AS mean FROM hv),
        j AS (SELECT p.a, p.b, x.hist AS p, y.hist AS q, least(x.mean, y.mean) AS m FROM pairs p JOIN m x ON x.key = p.a JOIN m y ON y.key = p.b),
        w AS (SELECT *, CASE WHEN m >= 50 THEN 0.95::double WHEN m <= 15 THEN 0.0::double ELSE 0.95::double * (m - 15) / 35 END AS wh,
                     CASE WHEN m >= 50 THEN 0.03::double WHEN m <= 15 THEN 0.5::double ELSE 0.5::double - 0.47::double * (m - 15) / 35 END AS ws,
                     CASE WHEN m >= 50 THEN 0.02::double WHEN m <= 15 THEN 0.5::double ELSE 0.5::double - 0.48::double * (m - 15) / 35 END AS wv FROM j)
        SELECT a, b, round(wh * {BHATTACHARYYA.format("p[1:16]", "q[1:16]")} + ws * {BHATTACHARYYA.format("p[17:40]", "q[17:40]")} + wv * {BHATTACHARYYA.format("p[41:64]", "q[41:64]")}, 6) AS distance FROM w""",
    "iou_pairs": f"""WITH o AS (SELECT l_orderkey AS key, l_linenumber AS ord, l_discount AS x, l_tax AS y, l_quantity / 50 AS w, l_discount + 0.1::double AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT p.key, p.ord AS i, q.ord AS j, round({IOU.format("p", "q")}, 6) AS iou FROM o p JOIN o q ON p.key = q.key AND p.ord < q.ord""",
    "semantic_window_pairs": f"""WITH o AS (
          SELECT o_orderkey AS key, epoch_us(o_orderdate) // 1000000 AS t, l_returnflag AS label, l_discount AS x, l_tax AS y, l_quantity / 50 AS w, l_discount + 0.1::double AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        f AS (SELECT DISTINCT key, t FROM o), {PAIRS.format("f")},
        n AS (SELECT p.a, p.b, count(*) AS n FROM pairs p JOIN o x ON x.key = p.a JOIN o y ON y.key = p.b WHERE x.label = y.label AND {IOU.format("x", "y")} >= 0.4 GROUP BY ALL)
        SELECT a, b, coalesce(n, 0)::bigint AS matches, coalesce(n, 0) >= 2 AND tb - ta <= 180 AS similar FROM pairs LEFT JOIN n USING (a, b)""",
    "orb_match": f"""WITH {EV}, {HV}, s AS (SELECT key, key // 8 AS shot, high, low FROM hv),
        p AS (SELECT DISTINCT a.shot AS a, b.shot AS b FROM s a JOIN s b ON a.shot + 1 = b.shot),
        n AS (SELECT x.shot AS a, count(*) AS n FROM s x WHERE EXISTS (SELECT 1 FROM s y WHERE y.shot = x.shot + 1 AND {BITS} <= {LOOSE.orb_max_hamming}) GROUP BY x.shot)
        SELECT a, b, coalesce(n, 0)::bigint AS matches, coalesce(n, 0) >= {LOOSE.orb_min_matches} AS similar FROM p LEFT JOIN n USING (a)""",
    "composite_all_edges": f"""WITH {EV}, {HV}, {HV_PAIRS}, s AS (SELECT key // 8 AS shot, high, low FROM hv),
        o AS (SELECT l_orderkey AS key, l_returnflag AS label, l_discount AS x, l_tax AS y, l_quantity / 50 AS w, l_discount + 0.1::double AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        n AS (SELECT p.a, p.b, count(*) AS n FROM pairs p JOIN o x ON x.key = p.a JOIN o y ON y.key = p.b WHERE x.label = y.label AND {IOU.format("x", "y")} >= 0.4 GROUP BY ALL),
        d AS (SELECT DISTINCT a // 8 AS sa, b // 8 AS sb FROM pairs),
        m AS (SELECT d.sa, d.sb, count(*) AS m FROM d JOIN s x ON x.shot = d.sa WHERE EXISTS (SELECT 1 FROM s y WHERE y.shot = d.sb AND {BITS} <= {LOOSE.orb_max_hamming}) GROUP BY ALL)
        SELECT p.a, p.b FROM pairs p JOIN hv x ON x.key = p.a JOIN hv y ON y.key = p.b LEFT JOIN n ON n.a = p.a AND n.b = p.b LEFT JOIN m ON m.sa = p.a // 8 AND m.sb = p.b // 8
        WHERE NOT ({BHATTACHARYYA.format("x.hist", "y.hist")} > {LOOSE.max_color_distance})
          AND (tb - ta <= 15 OR coalesce(n.n, 0) >= 2 AND tb - ta <= 180 OR coalesce(m.m, 0) >= {LOOSE.orb_min_matches} OR {BITS} <= {LOOSE.max_phash})""",
    "burst_groups": f"WITH {ISLANDS} SELECT first_key, size, earliest, latest, is_burst FROM grp",
    "burst_components": f"WITH {ISLANDS} SELECT key, min(key) OVER (PARTITION BY component) AS component FROM isl",
    "best_score_burst": f"WITH {GROUPED}, {scored('mem', 'burst')} {SCORES}",
    "best_score_noface": f"WITH {GROUPED}, {scored('mem', 'noface')} {SCORES}",
    "best_score_face": f"WITH {GROUPED}, {scored('mem', 'face')} {SCORES}",
    "burst_best": f"""WITH {ISLANDS}, num AS (SELECT *, 'G' || row_number() OVER (ORDER BY first_key) AS group_id, row_number() OVER (ORDER BY first_key) AS id FROM grp),
        pos AS (SELECT *, row_number() OVER (ORDER BY earliest, id) AS position FROM num),
        mem AS (SELECT isl.*, is_burst FROM isl JOIN grp USING (component)), {scored("mem", "flag")}
        SELECT group_id, position, size, pos.is_burst, ran.key AS best_key, round(score, 6) AS best_score FROM pos JOIN ran USING (component) WHERE rank = 1""",
    "group_order": f"""WITH {EV}, g AS (SELECT regexp_extract(path, 'u([0-9]+)', 1)::bigint AS component, min(CASE WHEN regexp_extract(path, 'u([0-9]+)', 1)::bigint % 2 = 1 THEN t END) AS earliest, min(key) AS first_key,
          count(*) FILTER (regexp_extract(path, 'u([0-9]+)', 1)::bigint % 2 = 1) AS n_timed FROM ev GROUP BY 1),
        n AS (SELECT *, row_number() OVER (ORDER BY first_key) AS id FROM g)
        SELECT component, 'G' || id AS group_id, row_number() OVER (ORDER BY earliest NULLS LAST, id) AS position, n_timed FROM n""",
    "portrait_order": f"WITH {EV} SELECT key, row_number() OVER (ORDER BY (face > 0) DESC, t, key) AS position FROM ev",
    "summary_counts": f"WITH {ISLANDS} SELECT count(*) AS photos, count(*) FILTER (face > 0) AS with_face, count(DISTINCT component) AS groups FROM isl",
    "main_faces": f"{FACED} SELECT key, count(*) FILTER (w * h >= 0.25::double * top) AS n_main, min(ord) FILTER (w * h = top) AS primary FROM big GROUP BY key",
    "face_quality": f"""WITH {FACES}, q AS (SELECT key, list_filter([smile, lo, ro], lambda v: v IS NOT NULL) AS parts FROM faces)
        SELECT key, round(greatest(0.0::double, least(1.0::double, coalesce(max(list_sum(parts) / len(parts)) FILTER (len(parts) > 0), 0))), 6) AS quality FROM q GROUP BY key""",
    "eyes_closed": f"""WITH {FACES}, {EYES}
        SELECT key, closed AS eyes_closed, both_eyes AS both_eyes_detected, round(eye_open, 6) AS eye_open, CASE WHEN both_eyes THEN 'both eyes' WHEN closed THEN 'closed' ELSE '' END AS shown FROM per""",
    "portrait_blend": f"""WITH {FACES}, {EYES},
        b AS (SELECT o_orderkey AS key, o_totalprice AS s, o_orderstatus <> 'P' AS f, fs, es, closed FROM orders JOIN per ON o_orderkey = key),
        c AS (SELECT *, CASE WHEN f AND fs > 0 THEN fs ELSE s END AS one FROM b),
        d AS (SELECT *, CASE WHEN f AND es > 0 THEN 0.4::double * one + 0.6::double * es ELSE one END AS two FROM c)
        SELECT key, floor(CASE WHEN f AND closed THEN two * 0.2::double ELSE two END * 10000 + 0.5) / 10000 AS sharpness FROM d""",
    "mean_top4": """WITH c AS (SELECT vec_id, unnest(embedding[1:16])::double AS v, generate_subscripts(embedding[1:16], 1) - 1 AS i FROM embeddings),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS n FROM c)
        SELECT vec_id, round(sum(v ORDER BY n) / 4, 6) AS top4, string_agg(i::varchar, ',' ORDER BY n) AS cells FROM r WHERE n <= 4 GROUP BY vec_id""",
    "exposure_score": """WITH b AS (SELECT source, n_chars % 256 AS bin FROM documents),
        s AS (SELECT source, count(*) FILTER (bin <= 5 OR bin >= 250) / count(*)::double AS clip, sum(bin) / count(*)::double AS mean FROM b GROUP BY source)
        SELECT source, round(greatest(0.0::double, least(1.0::double, (1 - clip) * (1 - 0.15::double * abs(mean - 127) / 127))), 6) AS score FROM s""",
    "semantic_enrich": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity * (l_discount + 1) DESC, l_linenumber, l_partkey) AS n FROM lineitem)
        SELECT o_orderkey AS key, l_returnflag AS label, round(CASE WHEN l_extendedprice - 30000 > 0 THEN l_extendedprice - 30000 ELSE o_totalprice END, 4) AS sharpness
        FROM orders LEFT JOIN o ON o_orderkey = l_orderkey AND n = 1""",
    "feature_join": """WITH f AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders)
        SELECT c_custkey AS key, c_name, o_totalprice AS price FROM customer JOIN f ON c_custkey = o_custkey AND n = 1""",
    "immutable_update": f"WITH {EV} SELECT key, round(CASE WHEN iso > 8000 THEN sharpness * 2 ELSE sharpness END, 4) AS sharpness, path FROM ev",
    "toggle_selection": f"WITH {EV} SELECT key FROM ev WHERE (iso > 3000) <> (iso < 6000)",
    "compare_set": f"""WITH {EV}, u AS (SELECT key, t, regexp_extract(path, 'u([0-9]+)', 1) AS user FROM ev)
        SELECT key, user, row_number() OVER (PARTITION BY user ORDER BY t DESC, key DESC) AS slot FROM u QUALIFY slot <= 4""",
    "united_selection": f"WITH {EV} SELECT key FROM ev WHERE iso > 7000 OR exposure < 0.2 OR sharpness > 80",
    "exclude_in_flight": f"WITH {EV} SELECT key, path FROM ev WHERE iso > 2000 AND NOT exposure < 0.5 AND NOT sharpness > 80",
    "owning_group": f"WITH {ISLANDS} SELECT isl.key, first_key FROM isl JOIN grp USING (component) WHERE iso > 5000",
    "all_but_best": f"WITH {NOFACE} SELECT a.key, b.key AS best_key FROM ran a JOIN ran b USING (component) WHERE a.rank > 1 AND b.rank = 1",
    "best_or_first": f"""WITH {NOFACE}, l AS (SELECT * FROM ran WHERE iso <= 6000)
        SELECT component, coalesce(min(key) FILTER (rank = 1), min(key)) AS key FROM l GROUP BY component""",
    "export_plan": f"""WITH {NOFACE}, b AS (SELECT key, path AS src, regexp_extract(path, '[^/]*$') AS name FROM ran WHERE rank = 1),
        n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY key) - 1 AS n FROM b)
        SELECT key, src, '/out/' || CASE WHEN n = 0 THEN name ELSE replace(name, '.jpg', '_' || n || '.jpg') END AS dst FROM n""",
    "filing_plan": f"""WITH {EV}, b AS (SELECT key, path AS src, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || CASE WHEN exposure > 0.8 THEN 'keep' ELSE 'later' END AS dir FROM ev WHERE exposure >= 0.5 AND iso % 1000 <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY key) - 1 AS n FROM b)
        SELECT key, 'move' AS action, src, dir || '/' || CASE WHEN n = 0 THEN name ELSE replace(name, '.jpg', '_' || n || '.jpg') END AS dst FROM n""",
    "filing_report": f"""WITH {EV}, e AS (SELECT key, CASE WHEN iso % 1000 <> 0 THEN path END AS path, exposure FROM ev)
        SELECT key, CASE WHEN path IS NULL THEN 'skipped' WHEN path IN (SELECT path FROM e WHERE exposure > 0.95 AND path IS NOT NULL) THEN 'failed' ELSE 'done' END AS outcome FROM e WHERE exposure >= 0.5""",
    "delete_plan": f"WITH {NOFACE} SELECT key, path FROM ran WHERE rank > 1 AND NOT exposure > 0.9 AND NOT iso < 500",
    "prune_groups": f"""WITH {GROUPED}, {scored("mem", "noface")}, lef AS (SELECT * EXCLUDE (adjusted, s_norm, score, rank) FROM ran WHERE rank > 1),
        {scored("lef", "noface").replace("adj AS", "adj2 AS").replace("FROM adj)", "FROM adj2)").replace("nor AS", "nor2 AS").replace("FROM nor)", "FROM nor2)").replace("sco AS", "sco2 AS").replace("FROM sco)", "FROM sco2)").replace("ran AS", "ran2 AS")}
        SELECT component, key AS best_key FROM ran2 WHERE rank = 1""",
}
