"""Queries over what users do: toggles and caps of an import, presses, folders, filing; and faces with eyes; with DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import IMPORT_CAPS
from .functions import scalar
from .operators import cascade, entries, facets, rank, replay
from .oracles import ISLANDS, NOFACE
from .plans import actions
from .queries import EV, _best, _bursts, _table, photos_of_events


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = photos_of_events(spark, sf_dir)
    return photos.select("key", "day", F.concat("path", F.lit("#"), F.lpad(F.col("key").cast("string"), 12, "0")).alias("path"))


def _toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some users' events as a log of toggles: days flipped, now and then a range of days or all of them switched on."""
    e = _table(spark, sf_dir, "events").where("user_id % 13 = 5").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("k") % 30)
    action = F.when(F.col("k") % 20 == 0, "range").when(F.col("k") % 20 == 1, "all").when(F.col("k") % 20 == 2, "clear").otherwise("toggle")
    return e.select(F.col("event_id").alias("seq"), action.alias("action"), day.alias("day"), F.date_add(day, 12).alias("day_to"))


FILES = f"""{EV}, fi AS (SELECT key, day, path || '#' || lpad(key::varchar, 12, '0') AS path FROM ev),
tg0 AS (SELECT event_id AS seq, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE user_id % 13 = 5),
tg AS (SELECT seq, CASE k % 20 WHEN 0 THEN 'range' WHEN 1 THEN 'all' WHEN 2 THEN 'clear' ELSE 'toggle' END AS action, DATE '2024-01-01' + k % 30 AS day FROM tg0),
lr AS (SELECT * FROM tg WHERE action <> 'toggle' ORDER BY seq DESC LIMIT 1),
fl AS (SELECT day, count(*) % 2 = 1 AS odd FROM tg WHERE action = 'toggle' AND seq > coalesce((SELECT seq FROM lr), -1) GROUP BY day),
dy AS (SELECT day, count(*) AS n_files FROM fi GROUP BY day),
ch AS (SELECT dy.day, n_files, (CASE (SELECT action FROM lr) WHEN 'range' THEN dy.day BETWEEN (SELECT day FROM lr) AND (SELECT day FROM lr) + 12 WHEN 'clear' THEN false ELSE true END) <> coalesce(odd, false) AS chosen
  FROM dy LEFT JOIN fl ON fl.day = dy.day)"""


def import_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.import_facets(_files(spark, sf_dir), _toggles(spark, sf_dir), 1000, descending=False).withColumn("day", F.col("day").cast("string"))


def import_cap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import takes under each of the caps."""
    files, toggles = _files(spark, sf_dir), _toggles(spark, sf_dir)
    taken = [facets.imported(files, toggles, cap).select(F.lit(cap).alias("cap"), "key", F.col("day").cast("string").alias("day"), "path") for cap in IMPORT_CAPS]
    return reduce(DataFrame.union, taken)


def cascade_eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as photos; their lines in turn are faces and eyes."""
    q = F.col("l_quantity")
    face = F.col("l_linenumber") % 2 == 1
    pick = lambda a, b: F.when(face, a).otherwise(b).cast("double")
    seen = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), (F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("id"), F.when(face, "face").otherwise("eye").alias("kind"),
        pick(F.col("l_partkey") % 200, F.col("l_partkey") % 300).alias("x"), pick(F.col("l_suppkey") % 100, F.col("l_suppkey") % 150).alias("y"), pick(30 + q * 5, 10 + q).alias("w"), pick(40 + q * 4, 14 + q / 2).alias("h"),
        (F.col("l_extendedprice") / 50 - 100).alias("sharpness"),
    )
    photos = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    found = cascade.cascade_photos(photos, seen)
    return found.withColumn("face_sharpness", F.round("face_sharpness", 9)).withColumn("eye_sharpness", F.round("eye_sharpness", 9))


def compare_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's presses, by mouse or keyboard, and the compare set after each."""
    k = F.get_json_object("props", "$.k").cast("int") % 9
    log = _table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "event_id", k.alias("key"), F.col("event_type").isin("click", "purchase").alias("mouse"))
    done = replay.replayed(log, "user", [F.col("event_id")])
    return done.select("event_id", "action", "evicted", F.array_join(F.col("held").cast("array<string>"), ",").alias("held"))


def filing_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's photos as a job; some folders cannot be written, some files are gone, some fail."""
    e = photos_of_events(spark, sf_dir).withColumn("user", F.regexp_extract("path", "u([0-9]+)", 1).cast("long"))
    path = F.concat(F.regexp_replace("path", "[.]jpg$", ""), F.lit("_"), F.col("key").cast("string"), F.lit(".jpg"))
    e = e.withColumn("path", F.when(F.col("iso") % 1000 != 0, path))
    wanted = e.where("exposure >= 0.3").select(F.col("user").alias("job"), "key", (-F.col("t")).alias("ord"))
    closed = e.where("user % 10 = 4").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"))
    done = actions.filing_outcome(wanted, e.select("key", "path"), unwritable=closed, missing=e.where("key % 17 = 3").select("path"), faulty=e.where("key % 31 = 9").select("path"))
    return done


def folder_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation ask for folders in turn: names that repeat, that are too long or that hold what no name may."""
    n = F.col("c_custkey")
    name = F.concat(F.lit(" "), F.when(n % 7 == 0, F.lit("a?b")).when(n % 11 == 0, F.lit("x" * 31)).when(n % 5 == 0, F.col("c_name")).otherwise(F.concat(F.lit("day "), (n % 17).cast("string"))), F.lit("  "))
    return actions.accepted_folders(_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", name.alias("name")), "c_nationkey", "c_custkey").withColumn("place", F.col("place").cast("long"))


def object_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as objects found on images of at most 640 pixels: boxes relative to those, and as regions of the original images."""
    n = F.col("l_orderkey")
    width, height = (800 + n % 3000).cast("int"), (300 + n % 2100).cast("int")
    seen = entries.resized(width, height)
    at = lambda c, m: (F.col(c) % m).cast("double")
    box = [at("l_partkey", 640), at("l_suppkey", 480), F.col("l_quantity") * 13.0, F.col("l_quantity") * 7.0]
    found = _table(spark, sf_dir, "lineitem").select(n.alias("key"), "l_linenumber", "l_partkey", "l_suppkey", seen.alias("seen"), *[b.alias(c) for b, c in zip(box, "xywh", strict=True)], width.alias("width"), height.alias("height"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("label"))
    unit = entries.normalised_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("seen.w"), F.col("seen.h"), F.col("label"))
    region = entries.pixel_region(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("seen"), F.col("width"), F.col("height"))
    told = found.select("key", "l_linenumber", "l_partkey", "l_suppkey", unit.alias("u"), region.alias("r"))
    return told.select("key", "l_linenumber", "l_partkey", "l_suppkey", "u.label", *[F.round(f"u.{c}", 9).alias(c) for c in "xywh"], *[F.col(f"r.{c}").alias(f"region_{c}") for c in "xywh"])


def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = photos_of_events(spark, sf_dir)
    return entries.selection_summary(_bursts(spark, sf_dir), e.where("iso > 6000").select("key"))


def export_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best photo of each group that is left, or its first, into a folder that has some of the names already."""
    members, best = _best(spark, sf_dir)
    left = members.where("iso <= 6000")
    shown = rank.best_or_first(best.withColumnRenamed("key", "best_key"), left)
    held = spark.createDataFrame([("/out", x) for x in HELD], "dir string, name string")
    return actions.export_plan(shown, left.select("key", "path"), "/out", held)


#: Names that the folder of an export has already.
HELD = ("view.jpg", "click_1.jpg", "click_3.jpg", "view_2.jpg", "other.jpg")


def display_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _table(spark, sf_dir, "events").select("event_id", scalar.fixed(v, 0).alias("whole"), scalar.fixed(F.sqrt(v), 1).alias("tenths"), scalar.fixed(v / 10, 3).alias("thousandths"))


QUERIES = {f.__name__: f for f in (import_facets, import_cap_days, cascade_eyes, compare_replay, filing_outcome, folder_list, object_regions, selection_summary, export_best, display_numbers)}

CAPS = ", ".join(f"({n})" for n in IMPORT_CAPS)
ORACLES = {
    "import_facets": f"""WITH {FILES}, w AS (SELECT *, sum(CASE WHEN chosen THEN n_files ELSE 0 END) OVER () AS total, coalesce(sum(CASE WHEN chosen THEN n_files ELSE 0 END) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ch)
        SELECT day::varchar AS day, n_files, chosen, row_number() OVER (ORDER BY w.day) AS place, total::bigint AS selected_total, total > 1000 AS over_limit,
               CASE WHEN chosen THEN least(n_files, greatest(0, 1000 - before)) ELSE 0 END::bigint AS n_imported FROM w""",
    "import_cap_days": f"""WITH {FILES}, o AS (SELECT key, fi.day, path, row_number() OVER (ORDER BY fi.day DESC, path) AS nth FROM fi JOIN ch ON ch.day = fi.day WHERE chosen)
        SELECT cap, key, day::varchar AS day, path FROM (VALUES {CAPS}) c(cap) JOIN o ON nth <= cap""",
    "cascade_eyes": """WITH d AS (SELECT l_orderkey AS key, l_linenumber * 1000000000000::bigint + l_partkey * 100000::bigint + l_suppkey AS id, l_linenumber % 2 = 1 AS face, l_quantity AS q, l_partkey AS p, l_suppkey AS s, l_extendedprice / 50 - 100 AS sharpness FROM lineitem),
        f AS (SELECT key, id, (p % 200)::double AS x, (s % 100)::double AS y, (30 + q * 5)::double AS w, (40 + q * 4)::double AS h, sharpness FROM d WHERE face AND 30 + q * 5 >= 48 AND 40 + q * 4 >= 48),
        e AS (SELECT key, (p % 300)::double AS x, (s % 150)::double AS y, (10 + q)::double AS w, (14 + q / 2)::double AS h, sharpness FROM d WHERE NOT face AND 10 + q >= 16 AND 14 + q / 2 >= 16),
        m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY w * h DESC, id) = 1 AS first FROM f QUALIFY w * h >= 0.25 * max(w * h) OVER (PARTITION BY key)),
        t AS (SELECT m.key, m.id, any_value(m.x) AS x, any_value(m.y) AS y, any_value(m.w) AS w, any_value(m.h) AS h, any_value(m.sharpness) AS sharpness, bool_or(first) AS first, count(e.key) AS n_eyes,
                     coalesce(sum(e.sharpness) FILTER (e.sharpness > 0), 0) AS total, count(*) FILTER (e.sharpness > 0) AS n_sharp
              FROM m LEFT JOIN e ON e.key = m.key AND e.x >= m.x AND e.y >= m.y AND e.x + e.w <= m.x + m.w AND e.y + e.h <= m.y + m.h GROUP BY m.key, m.id),
        r AS (SELECT key, count(*) AS n, max(x) FILTER (first) AS x, max(y) FILTER (first) AS y, max(w) FILTER (first) AS w, max(h) FILTER (first) AS h, avg(sharpness) AS fs, bool_or(n_eyes = 0 AND w >= 120) AS closed, bool_and(n_eyes >= 2) AS both_eyes,
                     CASE WHEN sum(n_sharp) > 0 THEN least(1.0::double, sum(total) / sum(n_sharp) / 1000) END AS es FROM t GROUP BY key)
        SELECT o_orderkey AS key, n IS NOT NULL AS has_face, x AS face_x, y AS face_y, w AS face_w, h AS face_h, coalesce(n, 0) AS n_faces, round(fs, 9) AS face_sharpness, coalesce(closed, false) AS eyes_closed,
               coalesce(both_eyes, false) AS both_eyes, round(es, 9) AS eye_sharpness FROM orders LEFT JOIN r ON r.key = o_orderkey""",
    "compare_replay": """WITH RECURSIVE l AS (SELECT user_id AS u, event_id, CAST(json_extract(props, '$.k') AS INT) % 9 AS key, event_type IN ('click', 'purchase') AS mouse, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
        r AS (
          SELECT DISTINCT u, 0::bigint AS nth, NULL::bigint AS event_id, '' AS action, NULL::int AS evicted, []::int[] AS held FROM l UNION ALL
          SELECT l.u, l.nth, l.event_id, CASE WHEN list_contains(held, key) THEN 'removed' WHEN len(held) >= 4 AND NOT mouse THEN 'ignored' ELSE 'added' END,
                 CASE WHEN NOT list_contains(held, key) AND len(held) >= 4 AND mouse THEN held[1] END,
                 CASE WHEN list_contains(held, key) THEN list_filter(held, lambda x: x <> key) WHEN len(held) >= 4 AND NOT mouse THEN held WHEN len(held) >= 4 THEN list_append(held[2:], key) ELSE list_append(held, key) END
          FROM r JOIN l ON l.u = r.u AND l.nth = r.nth + 1)
        SELECT event_id, action, evicted, array_to_string(held, ',') AS held FROM r WHERE nth > 0""",
    "filing_outcome": f"""WITH {EV}, e AS (SELECT key, t, exposure, regexp_extract(path, 'u([0-9]+)', 1)::bigint AS job, CASE WHEN iso % 1000 <> 0 THEN replace(path, '.jpg', '') || '_' || key || '.jpg' END AS src FROM ev),
        o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY -t, key) AS nth, key % 17 = 3 AS gone, key % 31 = 9 AS bad FROM e WHERE exposure >= 0.3 AND src IS NOT NULL),
        s AS (SELECT *, min(nth) FILTER (bad AND NOT gone) OVER (PARTITION BY job) AS stop FROM o)
        SELECT job, key, src, CASE WHEN job % 10 = 4 THEN 'refused' WHEN nth > stop THEN 'not_reached' WHEN nth = stop THEN 'failed' WHEN gone THEN 'missing' ELSE 'done' END AS outcome FROM s""",
    "folder_list": """WITH n AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'a?b' WHEN c_custkey % 11 = 0 THEN repeat('x', 31) WHEN c_custkey % 5 = 0 THEN trim(c_name) ELSE 'day ' || c_custkey % 17 END AS folder FROM customer),
        f AS (SELECT c_nationkey, folder, min(c_custkey) AS first FROM n WHERE folder <> 'a?b' AND length(folder) BETWEEN 1 AND 30 GROUP BY ALL)
        SELECT c_nationkey, folder, row_number() OVER (PARTITION BY c_nationkey ORDER BY first) AS place FROM f QUALIFY place <= 10""",
    "object_regions": """WITH o AS (SELECT *, (800 + l_orderkey % 3000)::int AS width, (300 + l_orderkey % 2100)::int AS height, l_partkey % 640 AS x, l_suppkey % 480 AS y, l_quantity * 13 AS w, l_quantity * 7 AS h FROM lineitem),
        s AS (SELECT *, CASE WHEN greatest(width, height) <= 640 THEN width WHEN width >= height THEN 640 ELSE round(width * 640 / height::double)::int END AS sw,
                     CASE WHEN greatest(width, height) <= 640 THEN height WHEN height >= width THEN 640 ELSE round(height * 640 / width::double)::int END AS sh FROM o),
        r AS (SELECT *, greatest(0, least(width - 1, round(x / sw::double * width)::int)) AS rx, greatest(0, least(height - 1, round(y / sh::double * height)::int)) AS ry FROM s)
        SELECT l_orderkey AS key, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'A' THEN l_returnflag ELSE 'Object' END AS label, round(greatest(0.0::double, least(1.0::double, x / sw::double)), 9) AS x,
               round(greatest(0.0::double, least(1.0::double, y / sh::double)), 9) AS y, round(greatest(0.0::double, least(1.0::double, w / sw::double)), 9) AS w, round(greatest(0.0::double, least(1.0::double, h / sh::double)), 9) AS h,
               rx AS region_x, ry AS region_y, greatest(1, least(width - rx, round(w / sw::double * width)::int)) AS region_w, greatest(1, least(height - ry, round(h / sh::double * height)::int)) AS region_h FROM r""",
    "selection_summary": f"WITH {ISLANDS} SELECT count(*) AS photos, count(*) FILTER (face > 0) AS with_face, count(*) FILTER (iso > 6000) AS selected, count(DISTINCT component) AS groups FROM isl",
    "export_best": f"""WITH {NOFACE}, l AS (SELECT * FROM ran WHERE iso <= 6000),
        k AS (SELECT component, coalesce(min(key) FILTER (rank = 1), min(key)) AS key FROM l GROUP BY component),
        b AS (SELECT l.key, path AS src, regexp_extract(path, '[^/]*$') AS name FROM l JOIN k ON k.key = l.key),
        h(name) AS (VALUES {", ".join(f"('{x}')" for x in HELD)}),
        n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY key) - CASE WHEN name IN (SELECT name FROM h) THEN 0 ELSE 1 END AS nth, count(*) OVER (PARTITION BY name) AS many FROM b),
        f AS (SELECT DISTINCT n.name, g FROM n, unnest(range(1, many + {len(HELD)} + 2)) r(g)),
        free AS (SELECT name, g, row_number() OVER (PARTITION BY name ORDER BY g) AS nth FROM f WHERE replace(name, '.jpg', '_' || g || '.jpg') NOT IN (SELECT name FROM h UNION SELECT name FROM b))
        SELECT key, src, '/out/' || CASE WHEN n.nth = 0 THEN n.name ELSE replace(n.name, '.jpg', '_' || g || '.jpg') END AS dst FROM n LEFT JOIN free ON free.name = n.name AND free.nth = n.nth""",
    "display_numbers": "SELECT event_id, printf('%.0f', floor(value + 0.5)) AS whole, printf('%.1f', round(sqrt(value), 1)) AS tenths, printf('%.3f', round(value / 10, 3)) AS thousandths FROM events",
}
