r"""Benchmark decontamination with DataFrame functions only.

The normalised n-grams of the benchmark become a hash set that is broadcast (after a check of its size; beyond
`BROADCAST_WINDOWS` the same join is shuffled). All token windows of all documents are hashed and looked up; each hit is
verified on the words themselves. Hit words, spans or whole documents can then be removed.

Words: A-Z lower-cased, then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. A window is `n` consecutive words of an item; an item
of fewer words, but not none, is one window.

Defined cases: null or empty text has no words; an item without words has no window; a null item_id counts as an item
without a name (its hits count, its id is not listed); equal items each count; repeated document rows each get a result;
an empty benchmark hits nothing; other columns are kept by `remove` and ignored by `scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

NGRAM = 10
#: The set is broadcast up to this many windows (about 200 bytes each: 40 MB).
BROADCAST_WINDOWS = 200_000
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD, RAW_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands in the set for no window, so that each document passes the join once.
NONE = 0
#: Windows that share a chunk of words.
CHUNK = 32


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def benchmark_windows(benchmark: DataFrame, n: int = NGRAM, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: hash, len, window (words joined by a space), items (array of ids)."""
    items = benchmark.select(F.col(item).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    each = items.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.slice("w", i + 1, F.least(F.size("w"), F.lit(n))))).alias("g"))
    return each.groupBy(F.array_join("g", " ").alias("window")).agg(
        F.first(F.size("g")).alias("len"), F.first(F.xxhash64(F.transform("g", lambda w: F.xxhash64(w)))).alias("hash"), F.collect_set("item_id").alias("items"))


def _document_windows(documents: DataFrame, sizes: list[int], doc: str, text: str) -> DataFrame:
    """Windows of all sizes of all documents: doc_id, fingerprint, n_words, size, hash, and where: `pos` in the words `cw` of
    a chunk that begins at word `base`. Besides, one row of size 0 and hash NONE for each document.

    A row of a window carries the words of its chunk of CHUNK windows, never those of the document, so that work and memory
    grow in proportion to the length of a text."""
    docs = documents.select(F.col(doc).alias("doc_id"), F.xxhash64(F.col(text)).alias("fingerprint"), words(F.col(text)).alias("w"))
    docs = docs.select("doc_id", "fingerprint", F.size("w").alias("n_words"), "w", F.transform("w", lambda x: F.xxhash64(x)).alias("hw"))
    wide = CHUNK + max(sizes) - 1
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    chunk = lambda b: F.struct(b.alias("base"), F.slice("w", b + 1, F.lit(wide)).alias("cw"), F.slice("hw", b + 1, F.lit(wide)).alias("ch"))
    itself = F.struct(F.lit(-1).alias("base"), F.array().cast("array<string>").alias("cw"), F.array().cast("array<bigint>").alias("ch"))
    rows = docs.select("doc_id", "fingerprint", "n_words", F.explode(F.concat(F.array(itself), F.transform(starts, chunk))).alias("c"))
    rows = rows.select("doc_id", "fingerprint", "n_words", "c.base", "c.cw", "c.ch")

    def of(size: int) -> Column:
        last = F.least(F.size("ch") - size, F.lit(CHUNK - 1))  # what starts later is in the next chunk
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(size).alias("size"), i.alias("pos"), F.xxhash64(F.slice("ch", i + 1, size)).alias("hash")))

    none = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("pos"), F.lit(NONE).cast("long").alias("hash")))
    each = F.when(F.col("base") < 0, none).otherwise(F.concat(*[of(k) for k in sizes]))
    rows = rows.select("doc_id", "fingerprint", "n_words", "base", "cw", F.explode(each).alias("x"))
    return rows.select("doc_id", "fingerprint", "n_words", "base", "cw", "x.size", "x.pos", "x.hash")


def scan(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, fingerprint (of the text), n_words, hits (array of struct<start,end>, word
    positions from 0, end exclusive, ascending), items (array of ids, sorted as strings), n_hit."""
    grams = written(benchmark_windows(benchmark, n), "decontam-windows")
    found = grams.groupBy("len").count().collect()  # at most n rows
    lengths, total = sorted({r["len"] for r in found}), sum(r["count"] for r in found)
    none = documents.sparkSession.range(1).select(F.lit("").alias("window"), F.lit(0).alias("len"), F.lit(NONE).cast("long").alias("hash"), F.array().cast(grams.schema["items"].dataType).alias("items"))
    grams = grams.unionByName(none)
    grams = F.broadcast(grams) if total <= BROADCAST_WINDOWS else grams

    rows = _document_windows(documents, lengths or [n], doc, text)
    same = (F.col("len") == F.col("size")) & (F.array_join(F.slice("cw", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("size")), " ") == F.col("window"))
    hit = rows.join(grams, "hash").where(((F.col("len") == 0) & (F.col("size") == 0)) | ((F.col("size") > 0) & same))
    hit = hit.withColumn("start", F.when(F.col("size") > 0, F.col("base") + F.col("pos")).otherwise(-1))
    hit = hit.select("doc_id", "fingerprint", "n_words", "start", "len", "items")
    by = hit.groupBy("doc_id", "fingerprint", "n_words").agg(
        F.count_if(F.col("start") < 0).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("start") >= 0, F.struct("start", (F.col("start") + F.col("len")).alias("end"))))).alias("hits"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("start") >= 0, F.col("items"))))), lambda i: i.cast("string"))).alias("items"),
    )
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(
            F.greatest(a["upto"], h["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(a["upto"], h["start"]))).alias("n")),
        lambda a: a["n"],
    )
    out = by.select("doc_id", "fingerprint", F.col("n_words").cast("long").alias("n_words"), "hits", "items", covered.alias("n_hit"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.drop("copy")


def remove(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM, mode: str = "documents", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """documents without contaminated rows (mode "documents"), or with hit words and the gaps between them cut out of the
    text (mode "spans"; an n_chars column then follows the text). All columns are kept."""
    found = scan(documents, benchmark, n, doc, text).where("n_hit > 0")
    found = found.groupBy(F.col("doc_id").alias("__doc"), F.col("fingerprint").alias("__print")).agg(F.first("hits").alias("__hits"))
    found = written(found, "decontam-hits")
    same = documents[doc].eqNullSafe(F.col("__doc")) & (F.xxhash64(documents[text]) == F.col("__print"))
    few = found.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    if mode == "documents":
        found = found.drop("__hits")
        return documents.join(F.broadcast(found) if few else found, same, "left_anti")
    cut = documents.join(found, same, "left").withColumn(text, F.when(F.col("__hits").isNull(), F.col(text)).otherwise(cut_spans(F.col(text), F.col("__hits"))))
    if "n_chars" in documents.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__hits").isNull(), F.col("n_chars")).otherwise(F.length(text).cast(documents.schema["n_chars"].dataType)))
    return cut.select(*documents.columns)


def merged(hits: Column) -> Column:
    """Spans in order of start, with those that overlap or touch made one."""
    kind = "array<struct<start:int,end:int>>"
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    none = F.struct(F.array().cast(kind).alias("done"), span(F.lit(-1), F.lit(-1)).alias("open"))
    whole = lambda a: F.when(a["open"]["end"] >= 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])

    def step(a: Column, h: Column) -> Column:
        longer = F.struct(a["done"].alias("done"), span(a["open"]["start"], F.greatest(a["open"]["end"], h["end"])).alias("open"))
        return F.when(h["start"] <= a["open"]["end"], longer).otherwise(F.struct(whole(a).alias("done"), span(h["start"], h["end"]).alias("open")))

    return F.aggregate(hits, none, step, whole)


def cut_spans(text: Column, hits: Column) -> Column:
    """text without the words in hits and without the gaps between two such neighbours."""
    own = F.array_remove(F.split(text, RAW_GAP), "")
    gaps = F.split(text, RAW_WORD, -1)
    spans = merged(hits)
    inside = lambda i: F.exists(spans, lambda h: (h["start"] <= i) & (i < h["end"]))
    parts = F.transform(own, lambda w, i: F.concat(F.when(inside(i) & inside(i - 1), "").otherwise(F.get(gaps, i)), F.when(inside(i), "").otherwise(w)))
    return F.concat(F.array_join(parts, ""), F.coalesce(F.get(gaps, F.size(own)), F.lit("")))
