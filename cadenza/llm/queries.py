"""The queries opN_<name> over the test tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, lang_id, mixing, near_dup, page_diff, quality_rules, secret_scan, toxicity, warc_zip
from .common import table


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hostile).alias("text"))
    return chat_format.digest(chat_format.prefix_target_examples(turns.unionByName(own)))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(16 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
             + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g'))) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR pos = n)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR pos = n) AS n_examples,
       count(*) FILTER (role = 'assistant') AS n_targets
FROM r GROUP BY conv_id
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
s AS (
  SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT k, i, s.n, item_id FROM s JOIN g ON s.g = g.g AND s.n = g.n),
p AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS q FROM (SELECT DISTINCT k, i, n FROM h)) GROUP BY k),
i AS (SELECT k, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS v FROM (SELECT DISTINCT k, item_id::VARCHAR AS v FROM h WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(v, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (k) LEFT JOIN i USING (k)
"""


def op10_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(table(spark, sf_dir, "documents"))


#: Targets by water-filling; probabilities from the sums over sizes; then each source's order is gone down, one unit a step: a unit that would have fitted at the last stop ends a pass.
OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, '')))) AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM d GROUP BY source),
c AS (
  SELECT *, source_size * 3 AS cap, row_number() OVER r AS k,
         (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER b, 0))::BIGINT AS rem,
         (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS rem_weight FROM s
  WINDOW r AS (ORDER BY source_size * 3 / weight, source NULLS LAST),
         b AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT min(k) AS k, arg_min(rem, k) AS rem, arg_min(rem_weight, k) AS rem_weight FROM c WHERE weight::DOUBLE * rem < cap::DOUBLE * rem_weight),
t AS (
  SELECT source, source_size,
         CASE WHEN o.k IS NULL OR c.k < o.k THEN cap::DOUBLE ELSE (weight * o.rem)::DOUBLE / o.rem_weight::DOUBLE END AS target FROM c, o),
g AS (
  SELECT *, target - copies * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t)),
n AS (
  SELECT d.source, rest, size, count(*) AS n FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source WHERE size > 0 AND size <= rest GROUP BY ALL),
h AS (
  SELECT *, (sum(size * n) OVER (PARTITION BY source) - sum(size * n) OVER (PARTITION BY source ORDER BY size))::DOUBLE AS longer,
         (sum(size * size * n) OVER (PARTITION BY source ORDER BY size))::DOUBLE AS upto FROM n),
p AS (SELECT source, (rest - arg_max(longer, size)) / arg_max(upto, size) AS per_word FROM h WHERE longer + upto / size > rest GROUP BY source, rest),
q AS (
  SELECT d.*, g.source_size, target, copies, rest,
         CASE WHEN size > 0 AND size <= rest THEN CASE WHEN per_word * size < 1 THEN
           ((('0x' || substr(key, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / (1.0 - (('0x' || substr(key, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / (per_word * size / (1.0 - per_word * size)) ELSE 0.0 END END AS rank
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source),
un AS (SELECT source, key, rank, rest, sum(size)::BIGINT AS words FROM q WHERE rank IS NOT NULL GROUP BY source, key, rank, rest),
li AS (SELECT source, rest, list(key ORDER BY rank, key) AS keys, list(words ORDER BY rank, key) AS words FROM un GROUP BY source, rest),
w AS (
  SELECT source, keys, words, rest, 0::BIGINT AS i, rest AS gap, 'inf'::DOUBLE AS room, false AS stopped, NULL::VARCHAR AS took FROM li
  UNION ALL
  SELECT source, keys, words, rest, i + 1, CASE WHEN fits THEN gap - words[i + 1] ELSE gap END, CASE WHEN ends THEN gap ELSE room END,
         stopped OR (ends AND gap <= 0.005::DOUBLE * rest), CASE WHEN fits THEN keys[i + 1] END
  FROM (SELECT *, NOT stopped AND words[i + 1] <= gap AS fits, words[i + 1] > gap AND words[i + 1] <= room AS ends FROM w WHERE i < len(keys))),
z AS (
  SELECT doc_id, q.source, size, source_size, target, copies + (took IS NOT NULL)::BIGINT AS copies
  FROM q LEFT JOIN (SELECT source, took FROM w WHERE took IS NOT NULL) w ON q.source IS NOT DISTINCT FROM w.source AND q.key = w.took AND q.rank IS NOT NULL)
SELECT *, size * copies AS taken FROM z
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return judged.select("row.doc_id", "stats.n_words", *[f"stats.{c}" for c in quality_rules.STATS[1:]], "base_failed", "kept")


#: Statistics in words and lines; quantiles of the merged histograms; fences, averaged with the wider group's.
OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT k, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM h) GROUP BY k),
s AS (
  SELECT k, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(text, '!'))::BIGINT AS n_bangs
  FROM d LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
x AS (
  SELECT lang, source, unnest(['symbols', 'bangs', 'capitals', 'dup_lines', 'word_length']) AS rate,
         unnest([n_symbols * 1000 // n_words, n_bangs * 1000 // n_words, n_capitals * 1000 // word_chars, n_dup_lines * 1000 // n_lines, word_chars * 100 // n_words]) AS v FROM b WHERE NOT base_failed),
y AS (SELECT lang, source, rate, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)::INTEGER) END AS b FROM x),
z AS (
  SELECT 0 AS level, lang, source, rate, b, count(*) AS n FROM y GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, rate, b, count(*) FROM y GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, rate, b, count(*) FROM y GROUP BY ALL),
u AS (
  SELECT *, CASE WHEN b < 64 THEN b ELSE ((b - (b // 32 - 1) * 32 + 1) << (b // 32 - 1)::INTEGER) - 1 END AS top,
         100 * sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM z),
q AS (
  SELECT level, lang, source, rate, max(total)::BIGINT AS total, min(top) FILTER (upto >= total * 20) AS low, min(top) FILTER (upto >= total * 50) AS mid, min(top) FILTER (upto >= total * 80) AS high
  FROM u GROUP BY level, lang, source, rate),
f AS (SELECT level, lang, source, rate, total, high + 8 * (high - mid) AS hi, greatest(low - 8 * (mid - low), 0) AS lo FROM q),
m AS (
  SELECT f.lang, f.source, f.rate,
         (f.total * f.hi + 100 * ((f1.total * f1.hi + 100 * f2.hi) // (f1.total + 100))) // (f.total + 100) AS hi,
         (f.total * f.lo + 100 * ((f1.total * f1.lo + 100 * f2.lo) // (f1.total + 100))) // (f.total + 100) AS lo
  FROM f JOIN f f1 ON f1.level = 1 AND f1.rate = f.rate AND f1.lang IS NOT DISTINCT FROM f.lang JOIN f f2 ON f2.level = 2 AND f2.rate = f.rate WHERE f.level = 0),
p AS (
  SELECT lang, source, max(hi) FILTER (rate = 'symbols') AS symbols, max(hi) FILTER (rate = 'bangs') AS bangs, max(hi) FILTER (rate = 'capitals') AS capitals,
         max(hi) FILTER (rate = 'dup_lines') AS dup_lines, max(hi) FILTER (rate = 'word_length') AS long, max(lo) FILTER (rate = 'word_length') AS short FROM m GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_bangs, base_failed,
       NOT base_failed AND NOT coalesce(
         (n_symbols - 2) * 1000 > symbols * n_words OR (n_bangs - 2) * 1000 > bangs * n_words OR (n_capitals - 2) * 1000 > capitals * word_chars
         OR (n_dup_lines - 2) * 1000 > dup_lines * n_lines OR word_chars * 100 // n_words > long OR word_chars * 100 // n_words < short, false) AS kept
FROM b LEFT JOIN p ON p.lang IS NOT DISTINCT FROM b.lang AND p.source IS NOT DISTINCT FROM b.source
"""


def op3_warc_zip_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc_zip.write_packages(table(spark, sf_dir, "pages"), warc_zip.new_folder(spark))
    return warc_zip.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: Base32 of the digest from its hex digits: 5 of these are 4 of those.
OP3_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, 1 + (q // 4) * 5, 5))::BIGINT >> (15 - 5 * (q % 4))::INTEGER) & 31))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to, url FROM p
"""


def op4_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_deleted")


def op5_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = lang_id.train(documents)
    return lang_id.predict(documents.select("doc_id", "text"), net).select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, and what each document reaches.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.doc_id WHERE r.c < b.y)
SELECT doc_id, len(g)::BIGINT AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept FROM s JOIN r USING (doc_id) GROUP BY doc_id, g
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(documents, secret_scan.train(documents))
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, secret_scan.KINDS), F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )


def op9_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_prefix_targets, op2_quality_rules, op3_warc_zip_packages, op4_page_differencing, op5_byte_gru_language,
        op6_decontaminate, op7_minhash_near_duplicates, op8_secret_scan, op9_ftrl_toxicity, op10_mix_to_weights,
    )
}
ORACLE = {"op1_chat_prefix_targets": OP1_SQL, "op2_quality_rules": OP2_SQL, "op3_warc_zip_packages": OP3_SQL, "op6_decontaminate": OP6_SQL, "op7_minhash_near_duplicates": OP7_SQL, "op10_mix_to_weights": OP10_SQL}
