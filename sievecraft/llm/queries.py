"""One query per text operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_id, licences, lm_score, mixing, near_dedup, quality_rules, toxicity, url_filter
from .common import id_remainder, table

#: Near-duplicates: three-word shingles, a similarity of 0.85.
DEDUP = {"percent": 85, "width": 3}
URL_RULES = (
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = F.col("hits")
    rows = decontaminate.add_hits(docs, table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(hits["items"]), ","), 256).alias("items_sha256"),
        decontaminate.contaminated(hits).alias("contaminated"),
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 4) != 2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.add_score(docs, toxicity_model(spark, sf_dir, docs))
    return rows.select(
        "doc_id",
        F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken. Each document has one source."""
    rows = mixing.mix(docs.select("doc_id", "text", "source")).rows
    return rows.select("doc_id", "size", F.get("source_sizes", F.lit(0)).alias("source_size"), F.get("targets", F.lit(0)).alias("target"), "taken")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_score.score_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_seen", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), **DEDUP)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, id_remainder(F.col("doc_id"), 3) != 1)
    rows = language_id.add_language(docs.select("doc_id", "text"), model)
    held = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held, F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_html_text, op3_toxicity, op4_mix_sources, op5_quality_rules, op6_lm_score, op7_near_dedup, op8_url_filter, op9_licences, op10_language)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _licence_sql() -> str:
    def norm(of: str, first: int = 0) -> str:
        for pattern, to in licences.STEPS[first:]:
            of = f"regexp_replace({of}, '{pattern}', '{to}', 'g')"
        return f"trim({of}, ' ')"

    known = ", ".join(f"('{d}', '{n}')" for d, n in licences.digests(licences.LICENCES).items())
    opens = licences.OPENS
    return f"""
WITH low AS (SELECT doc_id, {_LOWER.format("text")} AS t FROM documents),
both_ AS (SELECT doc_id, t, CASE WHEN regexp_matches(t, '(?m){opens}') THEN array_to_string(list_filter(regexp_split_to_array(t, '{licences.GAP}'), lambda p: NOT regexp_matches(p, '{opens}')), chr(10)) END AS b FROM low),
norm AS (SELECT doc_id, {norm("t")} AS t, {norm("b", 2)} AS b FROM both_),
hashed AS (SELECT doc_id, CASE WHEN t <> '' THEN sha256(t) END AS t, CASE WHEN b <> '' THEN sha256(b) END AS b FROM norm),
known(digest, licence) AS (VALUES {known})
SELECT doc_id, CASE WHEN k.licence IS NULL AND l.licence IS NOT NULL THEN h.b ELSE h.t END AS digest, coalesce(k.licence, l.licence) AS licence
FROM hashed h LEFT JOIN known k ON h.t = k.digest LEFT JOIN known l ON h.b = l.digest"""


ORACLES = {
    "op1_decontaminate": f"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS s
        FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT doc_id, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
         FROM (SELECT doc_id, w, k, unnest(range(1, greatest(0, len(w) - k + 1) + 1)) AS p FROM dw, ks)),
hits AS (SELECT doc_id, p, dwin.k AS k, item FROM dwin JOIN win ON dwin.k = win.k AND dwin.s = win.s),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered ON dw.doc_id = covered.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id""",
    "op5_quality_rules": """
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, p, list_slice(w, p, p + 2) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(0, len(w) - 2) + 1)) AS p FROM w)),
twice AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT win.doc_id, unnest(range(p, p + 3)) AS q FROM win JOIN twice ON win.doc_id = twice.doc_id AND win.s = twice.s) GROUP BY doc_id),
c AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS any_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(CAST(any_failed AS INT)) AS x FROM f GROUP BY source),
m AS (SELECT sum(x) / sum(n) AS m, var_pop(x / n) AS v, avg(1.0 / n) AS noise FROM h),
s AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * noise, 1e-12) - 1, 1.0), 10000.0) AS s FROM m),
bad AS (SELECT source FROM h, s WHERE (x + m * s) / (n + s) > 0.5)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept FROM f""",
    "op6_lm_score": f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
tok AS (SELECT doc_id, CASE WHEN p = 1 THEN '' ELSE w[p - 1] END AS v, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
ou AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, x FROM tok UNION ALL SELECT doc_id, '' FROM w WHERE len(w) > 0) GROUP BY doc_id, x),
au AS (SELECT x, sum(n) AS n FROM ou GROUP BY x),
ob AS (SELECT doc_id, v, x, count(*) AS n FROM tok GROUP BY doc_id, v, x),
ab AS (SELECT v, x, sum(n) AS n FROM ob GROUP BY v, x),
tot AS (SELECT count(*) AS n FROM tok),
doc AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
s AS (SELECT ob.doc_id, ob.n, ab.n > ob.n AS seen,
        CASE WHEN ab.n > ob.n THEN ln((ab.n - ob.n) / (av.n - ov.n)) WHEN ax.n > ox.n THEN ln(0.4 * (ax.n - ox.n) / greatest(tot.n - doc.n, 1)) ELSE ln(0.4 * 0.4 / greatest(tot.n - doc.n, 1)) END AS l
      FROM ob JOIN ab ON ob.v = ab.v AND ob.x = ab.x JOIN ou ov ON ob.doc_id = ov.doc_id AND ob.v = ov.x JOIN ou ox ON ob.doc_id = ox.doc_id AND ob.x = ox.x
      JOIN au av ON ob.v = av.x JOIN au ax ON ob.x = ax.x JOIN doc ON ob.doc_id = doc.doc_id, tot),
g AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(n * CAST(seen AS INT)) AS BIGINT) AS n_seen, sum(n * l) AS l FROM s GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_seen, 0) AS n_seen, round(coalesce(l, 0.0), 4) AS log_score, round(l / n_words, 6) AS mean_log_score
FROM w LEFT JOIN g ON w.doc_id = g.doc_id""",
    "op7_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 2), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS p FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM both_ JOIN size sa ON a = sa.doc_id JOIN size sb ON b = sb.doc_id WHERE 100 * k >= 85 * (sa.n + sb.n - k)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.r FROM reach JOIN link ON reach.doc_id = link.a WHERE reach.r < link.b)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON d.doc_id = c.doc_id LEFT JOIN size ON d.doc_id = size.doc_id""",
    "op8_url_filter": f"""
WITH p AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, q, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, max_by(h || q, length(h || q)) AS rule, max_by(verdict, length(h || q)) AS verdict
         FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best ON p.page_id = best.page_id""",
    "op9_licences": _licence_sql(),
}
