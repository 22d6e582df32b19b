"""The operators' queries over whole tables, and the SQL that must agree where SQL can express them."""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwork.llm import byte_bpe, exact, filter_audit, language, licenses, line_quality, mixing, pii, revisits, rule_ensemble, simhash, spelling, toxicity
from meterwork.llm.common import is_held_out

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


@lru_cache(maxsize=1)
def tokenizer() -> byte_bpe.Tokenizer:
    return byte_bpe.Tokenizer.of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def quality_model(spark: SparkSession, sf: str) -> rule_ensemble.Ensemble:
    return rule_ensemble.learn(documents(spark, sf), labels(spark, sf), "quality", ~is_held_out("doc_id", 4, 2))


def op1_line_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_quality.judged(documents(spark, sf), with_text=False)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.duplicates(documents(spark, sf)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf).select("doc_id", "text"), tokenizer())


def op4_byte_gru(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    network = language.learn(docs, ~is_held_out("doc_id", 3, 1))
    rows = language.predicted(docs, network)
    return rows.select("doc_id", is_held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op5_rule_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    rows = rule_ensemble.scored(documents(spark, sf).select("doc_id", "text"), quality_model(spark, sf))
    return rows.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_attention_gru(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    network = toxicity.learn(docs, labels(spark, sf), "toxic", ~is_held_out("doc_id", 5, 0))
    rows = toxicity.scored(docs, network)
    return rows.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_pareto_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sizes(documents(spark, sf)).drop("copies")


def op8_simhash_tiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = simhash.near_groups(documents(spark, sf))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def page_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Five captures of every page: two full responses (the second changed for odd pages) and three revisits.

    Of the revisits, one comes before any response of every third page's, one has the tag of the first response, one
    the page's last tag or, for every fourth page, only a payload digest. URLs are written in several ways.
    """
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("tag"))
    n, k = F.col("page_id"), F.col("k")
    second = F.when(n % 2 == 1, F.md5(F.concat("tag", F.lit("x")))).otherwise(F.col("tag"))
    tag = F.when(k.isin(0, 1, 2), F.col("tag")).otherwise(second)
    at = 1_700_000_000 + (n % 1000) * 60 + F.when((k == 0) & (n % 3 != 0), 1).otherwise(k) * 86_400
    url = F.when(k == 1, F.concat("url", F.lit("#top"))).when(k == 2, F.regexp_replace("url", "^https?://", "HTTPS://")).otherwise(F.col("url"))
    bare = (k == 4) & (n % 4 == 0)
    revisit = F.concat(
        F.lit("HTTP/1.1 304 Not Modified\r\nDate: day "), k.cast("string"), F.lit("\r\nContent-Length: 0\r\n"),
        F.when(bare, F.lit("")).otherwise(F.concat(F.lit('ETag: W/"'), tag, F.lit('"\r\n'))), F.lit("Cache-Control: max-age="), k.cast("string"), F.lit("\r\n\r\n"))
    response = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nDate: day "), k.cast("string"), F.lit('\r\nContent-Type: text/html\r\nETag: "'), tag, F.lit('"\r\nContent-Length: 9\r\n\r\n'))
    rows = pages.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return rows.select((n * 10 + k).alias("record_id"), url.alias("url"), at.alias("ts"), F.when(k.isin(1, 3), response).otherwise(revisit).alias("block"), tag.alias("digest"))


def op9_revisits(spark: SparkSession, sf: str) -> DataFrame:
    rows = revisits.resolved(page_captures(spark, sf))
    field = lambda name: F.try_element_at(F.col("headers"), F.lit(name))
    return rows.select("record_id", "canonical", "target_id", "outcome", field("etag").alias("etag"), field("date").alias("date"),
                       field("content-length").alias("content_length"), field("cache-control").alias("cache_control"), F.size(F.map_keys("headers")).alias("n_headers"))


def op10_pii_lstm(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return pii.found(docs, pii.learn(docs))


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    rows = spelling.spelling_variants(documents(spark, sf))
    return rows.select("word", "n", "n_near", "form", "form_n", "root")


def op12_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = licenses.scanned(documents(spark, sf))
    base = F.array_distinct(F.col("places.label"))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min("places.first").alias("first_word"), F.array_max("places.first").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.col("spans.label"))), ",").alias("labels"), "score")


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audited(documents(spark, sf), labels(spark, sf))


QUERIES = {f.__name__: f for f in (op1_line_quality, op2_exact_dedup, op3_byte_bpe, op4_byte_gru, op5_rule_ensemble, op6_attention_gru,
                                    op7_pareto_mix, op8_simhash_tiles, op9_revisits, op10_pii_lstm, op11_spelling_variants, op12_license_scan,
                                    op13_filter_audit)}

_STOCK = " OR ".join(f"contains(translate(line, '{UPPER}', '{LOWER}'), '{x}')" for x in line_quality.BOILERPLATE)
_CLOSING = line_quality.CLOSING.replace("'", "''")

SQL = {
    "op1_line_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (SELECT doc_id, i, w AS a, lead(w) OVER p AS b, lead(w, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
l AS (SELECT doc_id, line, n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth
      FROM (SELECT doc_id, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
            FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))) WHERE n > 0),
j AS (SELECT doc_id, n, nth,
        NOT (NOT regexp_matches(line, '{_CLOSING}') OR 3 * len(regexp_extract_all(line, '{line_quality.SYMBOL_RUN}')) > n
             OR 4 * len(regexp_extract_all(line, '{line_quality.SEPARATOR}')) > n OR {_STOCK}) AS good FROM l),
s AS (SELECT doc_id, sum(n) AS n_words, count(*) FILTER (WHERE nth > 1) AS n_dup_lines, sum(CASE WHEN good THEN n ELSE 0 END) AS kept_words FROM j GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(kept_words, 0)::BIGINT AS kept_words
      FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_words >= 0.5 * n_words AS kept, kept_words FROM f""",
    "op2_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op7_pareto_mix": r"""
WITH n AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, ''))) AS nth FROM documents),
d AS (SELECT doc_id, source, size, size >= 100 AS heavy,
             (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || t || CASE WHEN nth > 1 THEN ':' || nth ELSE '' END), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM n),
s AS (SELECT source, sum(size)::BIGINT AS source_size, coalesce(sum(size) FILTER (NOT heavy), 0)::BIGINT AS l, coalesce(sum(size) FILTER (heavy), 0)::BIGINT AS h,
        (ARRAY[5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(w) OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s),
c AS (SELECT level FROM l WHERE level <= 3 * source_size / w::DOUBLE ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST LIMIT 1),
t AS (SELECT l.source, source_size, l.l, l.h, CASE WHEN c.level IS NULL THEN 3.0::DOUBLE * source_size ELSE least(3.0::DOUBLE * source_size, c.level * w) END AS target FROM l LEFT JOIN c ON true),
v AS (SELECT *, CASE WHEN l + h > 0 THEN target / (l + h * 2.0::DOUBLE) END AS per FROM t),
e AS (SELECT *, CASE WHEN h = 0 THEN 0 WHEN per * 2.0::DOUBLE > 3 THEN 3.0::DOUBLE ELSE per * 2.0::DOUBLE END AS eh,
        CASE WHEN l = 0 THEN 0 WHEN per * 2.0::DOUBLE > 3 THEN (target - h * 3.0::DOUBLE) / l ELSE per END AS el FROM v),
b AS (SELECT *, least(greatest(coalesce(eh, 0), 0), 3)::DOUBLE AS bh, least(greatest(coalesce(el, 0), 0), 3)::DOUBLE AS bl FROM e),
p AS (SELECT *, target - (l * floor(bl)::BIGINT + h * floor(bh)::BIGINT) AS rest_words FROM b),
x AS (SELECT d.doc_id, d.size, d.u, p.source, p.source_size, p.target, p.rest_words, CASE WHEN heavy THEN floor(bh) ELSE floor(bl) END::BIGINT AS whole,
        CASE WHEN heavy THEN bh - floor(bh) ELSE bl - floor(bl) END AS rest FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
q AS (SELECT *, CASE WHEN rest > 0 AND size > 0 AND rest_words > 0 THEN (u / (1.0::DOUBLE - u)) / (rest / (1.0::DOUBLE - rest) * 1.0::DOUBLE) END AS q FROM x),
r AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(size) OVER (PARTITION BY source, q) AS own FROM q)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
  (size * (whole + CASE WHEN q IS NOT NULL AND (upto < rest_words OR upto - own < rest_words AND upto - rest_words <= rest_words - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
    "op9_revisits": r"""
WITH k AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
c AS (SELECT page_id * 10 + k AS record_id, k,
        1700000000 + (page_id % 1000) * 60 + CASE WHEN k = 0 AND page_id % 3 <> 0 THEN 1 ELSE k END * 86400 AS ts,
        regexp_replace(trim(CASE WHEN k = 1 THEN url || '#top' WHEN k = 2 THEN regexp_replace(url, '^https?://', 'HTTPS://') ELSE url END), '#.*$', '') AS url,
        CASE WHEN k IN (3, 4) AND page_id % 2 = 1 THEN md5(md5(coalesce(html, '')) || 'x') ELSE md5(coalesce(html, '')) END AS tag,
        k IN (1, 3) AS response, k = 4 AND page_id % 4 = 0 AS bare FROM pages, k),
u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
        || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/$', '') AS stem,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query FROM c),
n AS (SELECT *, CASE WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)') THEN url WHEN query <> '' THEN stem || '?' || query ELSE stem END AS canonical FROM u),
l AS (SELECT *, max(CASE WHEN response THEN lpad(ts::VARCHAR, 12, '0') || lpad(record_id::VARCHAR, 20, '0') END)
        OVER (PARTITION BY canonical ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM n),
j AS (SELECT l.*, f.record_id AS f_id, f.tag AS f_tag, f.k AS f_k, l.canonical IS NOT NULL AND f.record_id IS NOT NULL AS met
      FROM l LEFT JOIN n AS f ON f.record_id = substr(l.last, 13)::BIGINT WHERE NOT l.response)
SELECT record_id, canonical, CASE WHEN met AND tag = f_tag THEN f_id END AS target_id,
  CASE WHEN NOT met THEN 'orphan' WHEN tag = f_tag THEN 'matched' ELSE 'conflict' END AS outcome,
  CASE WHEN met AND tag = f_tag THEN CASE WHEN bare THEN '"' || f_tag || '"' ELSE 'W/"' || tag || '"' END END AS etag,
  CASE WHEN met AND tag = f_tag THEN 'day ' || k::VARCHAR END AS date, CASE WHEN met AND tag = f_tag THEN '9' END AS content_length,
  CASE WHEN met AND tag = f_tag THEN 'max-age=' || k::VARCHAR END AS cache_control, CASE WHEN met AND tag = f_tag THEN 5 END AS n_headers FROM j""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE r AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195, unicode(ch)::BIGINT - 64] END))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END))) AS h FROM r WHERE length(run) >= 6),
g AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM g WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM x AS a JOIN x AS b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
      UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.less = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.less = v.word),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN (SELECT min(near) FROM p WHERE p.word = v.word AND p.near_n = b.top) END AS form,
        CASE WHEN top >= 5 * v.n THEN top END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, n, n_near, form, form_n, c.root FROM f JOIN c ON c.word = f.word WHERE c.next IS NULL""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic,
        (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS bits FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY part, bits),
e AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS e(f, b)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM e AS a, e AS b, e AS c, e AS d, e
      WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, step::INT AS step, bs[step] AS own, list_sum(list_prepend(0, bs[1:step - 1]))::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
q AS (SELECT part, filter_order, step, own, sum(CASE WHEN bits & (own | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN bits & own > 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN bits & own > 0 AND bits & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN bits & own > 0 AND bits & before = 0 THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN bits & own > 0 AND bits & before = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM q""",
}
