"""The queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, hard_negatives, html_text, jaccard_join, language, license_scan, mixing, piece_codec, quality, ranked_search, secret_scan, trie_dedup, url_filter
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.held_out()))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: number of ids and chunks, a hash of the ids, and whether the text came back."""
    done = piece_codec.encode(table(spark, sf_dir, "documents"), verify=True)
    return done.select("doc_id", "n_chunks", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.assess(table(spark, sf_dir, "documents")).select(*columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and its ids decoded: number of ids, digest of the ids in decimals, digest of the decoded text."""
    done = bpe_codec.encode(table(spark, sf_dir, "documents"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as an anchor; some labels are moved on, so that vectors far apart share one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_html_text": op7_html_text,
    "op8_quality_rules": op8_quality_rules,
    "op9_secret_scan": op9_secret_scan,
    "op10_url_filter": op10_url_filter,
    "op11_bpe": op11_bpe,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op1_license_scan": r"""
        WITH templates(template, x) AS (VALUES TEMPLATES),
        tw AS (SELECT template, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') AS w FROM templates),
        ts AS (SELECT DISTINCT template, array_to_string(w[i:i + 4], ' ') AS s FROM tw, unnest(range(1, len(w) - 3)) r(i)),
        n AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
        dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
        ds AS (SELECT rid, doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS s FROM dw, unnest(range(1, len(w) - 3)) r(i)),
        hit AS (SELECT rid, doc_id, template, n, p, s FROM ds JOIN ts USING (s) JOIN n USING (template)),
        win AS (SELECT DISTINCT rid, doc_id, template, n, 2 * (p // 2) AS g FROM hit),
        found AS (
          SELECT win.rid, win.doc_id, win.template, g, count(DISTINCT s) / any_value(win.n)::double AS c
          FROM win JOIN hit ON win.rid = hit.rid AND win.template = hit.template AND p >= g - win.n AND p < g + win.n + 2
          GROUP BY ALL)
        SELECT doc_id, template, max(c) AS containment, min(g)::bigint AS first_word
        FROM found WHERE c >= 0.8 GROUP BY doc_id, template""".replace("TEMPLATES", ", ".join(f"('{k}', '{v}')" for k, v in sorted(license_scan.TEMPLATES.items()))),
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY n)
                 AND row_number() OVER (PARTITION BY n, doc_id) = 1 AS kept,
               sha256(n) AS text_sha256
        FROM t""",
    "op8_quality_rules": r"""
        WITH d AS (
          SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        word AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        gram AS (
          SELECT rid, i, word || ' ' || lead(word, 1) OVER win || ' ' || lead(word, 2) OVER win AS g
          FROM word WINDOW win AS (PARTITION BY rid ORDER BY i)),
        again AS (SELECT rid, i FROM gram WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
        covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
        per_word AS (
          SELECT rid, count(*) FILTER (lower(word) IN (STOPS)) AS stops,
                 count(*) FILTER (length(word) > 1 AND regexp_matches(word, '^[^\p{Ll}]*[A-Z][^\p{Ll}]*$')) AS shouted
          FROM word GROUP BY rid),
        line AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
        lines AS (
          SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM line
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
        m AS (
          SELECT doc_id, len(w)::bigint AS n_words,
                 length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint AS word_chars,
                 (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
                 coalesce(lines.dup, 0)::bigint AS n_dup_lines, coalesce(lines.n, 0)::bigint AS n_lines,
                 coalesce(covered.n, 0)::bigint AS n_repeat_words, coalesce(stops, 0) AS stops, coalesce(shouted, 0) AS shouted
          FROM d LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN per_word USING (rid)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 20.0 * n_words AND n_symbols <= 0.5 * n_words
                 AND stops >= 0.02 * n_words AND n_dup_lines <= 0.5 * n_lines AND shouted <= 0.5 * n_words AS kept
        FROM b""".replace("STOPS", ", ".join(f"'{x}'" for x in quality.STOP_WORDS)),
    "op10_url_filter": r"""
        WITH rules(verdict, host, path) AS (
          VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        u AS (
          SELECT row_number() OVER () AS rid, page_id,
                 translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        fit AS (
          SELECT u.*, r.host || r.path AS rule, r.verdict AS v FROM u LEFT JOIN rules r
          ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
          QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC) = 1)
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit""",
    "op12_ranked_search": r"""
        WITH d AS (
          SELECT row_number() OVER () AS rid, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'TERM') AS w FROM documents),
        whole AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::bigint AS terms FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'TERM')) AS term FROM benchmark),
        word AS (SELECT rid, unnest(w) AS term FROM d),
        tf AS (SELECT rid, term, count(*) AS tf FROM word WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint AS weight FROM tf, whole GROUP BY term, docs),
        part AS (
          SELECT rid, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * docs) // terms))) AS part
          FROM tf JOIN d USING (rid) JOIN weight USING (term), whole),
        total AS (SELECT item_id, rid, doc_id, sum(part)::bigint AS score FROM part JOIN q USING (term) GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::int AS rank, doc_id, score
        FROM total WHERE score > 0 QUALIFY rank <= 50""".replace("TERM", ranked_search.TERM),
    "op13_hard_negatives": r"""
        WITH e AS (
          SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.rid AS arow, a.vec_id AS anchor_id, a.label AS own, e.rid, e.vec_id, e.label,
                 list_sum(list_transform(list_zip(a.v, e.v), lambda p: p[1] * p[2]))::bigint AS score
          FROM e AS a JOIN e ON a.vec_id % 50 = 0 AND a.rid <> e.rid),
        p AS (SELECT * FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY arow ORDER BY score DESC, vec_id NULLS LAST) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.arow, p.rid ORDER BY s.score DESC, s.vec_id NULLS LAST)::int AS rank,
               s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON p.arow = s.arow AND s.label <> s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        QUALIFY rank <= 3""",
}
