"""Word and character error rates over corpora and groups, per row, and their comparison.

Rates are sums of edits over sums of reference units, so they merge across partitions by partial sums. Rows with an empty
normalised reference are left out; empty hypotheses count in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import distance, text


def edit_counts(rows: DataFrame, ref: str = "ref", hyp: str = "hyp", legacy: bool = True, normalizer=text.normalize) -> DataFrame:
    """rows with word_edits, words, char_edits, chars (null where the reference is empty), and the same with _legacy."""
    forms = {"": True} | ({"_legacy": False} if legacy else {})
    for tail, expand in forms.items():
        rows = rows.withColumns({f"__r{tail}": normalizer(F.col(ref), expand), f"__h{tail}": normalizer(F.col(hyp), expand)})
        rows = rows.withColumns({f"__rw{tail}": distance.word_list(F.col(f"__r{tail}")), f"__hw{tail}": distance.word_list(F.col(f"__h{tail}"))})
        said = F.col(f"__r{tail}") != ""
        rows = rows.withColumns({
            f"word_edits{tail}": F.when(said, distance.word_edits(f"__rw{tail}", f"__hw{tail}")), f"words{tail}": F.when(said, F.size(f"__rw{tail}").cast("long")),
            f"char_edits{tail}": F.when(said, distance.char_edits(F.col(f"__r{tail}"), F.col(f"__h{tail}"))), f"chars{tail}": F.when(said, F.length(f"__r{tail}").cast("long")),
        }).drop(*[f"__{x}{tail}" for x in ("r", "h", "rw", "hw")])
    return rows


def _rate(edits: str, units: str) -> Column:
    return F.try_divide(F.sum(edits), F.sum(units))


def error_rates(counts: DataFrame, *by: str, legacy: bool = True) -> DataFrame:
    """wer, cer, wer_legacy, cer_legacy and n of edit_counts, overall or by columns; null groups are left out. n is the number
    of rows in the last form computed."""
    for c in by:
        counts = counts.where(F.col(c).isNotNull())
    tails = ["", "_legacy"] if legacy else [""]
    out = [_rate(f"{kind}_edits{t}", f"{kind}s{t}").alias(f"{name}{t}") for t in tails for name, kind in (("wer", "word"), ("cer", "char"))]
    return counts.groupBy(*by).agg(*out, F.count(f"words{tails[-1]}").alias("n"))


def row_rate(tail: str = "") -> Column:
    """A row's own word error rate; null for an empty reference."""
    return F.try_divide(F.col(f"word_edits{tail}"), F.col(f"words{tail}"))


def digit_report(counts: DataFrame, ref: str = "ref") -> DataFrame:
    """Mean row rates with and without spoken numbers, over all rows and over those with digits in the reference."""
    digits = text.has_digits(F.col(ref))
    return counts.agg(
        F.count("*").alias("n_rows"), F.count_if(digits).alias("n_digit_rows"), F.avg(row_rate("_legacy")).alias("mean_legacy"), F.avg(row_rate()).alias("mean_spoken"),
        F.avg(F.when(digits, row_rate("_legacy"))).alias("digit_mean_legacy"), F.avg(F.when(digits, row_rate())).alias("digit_mean_spoken"),
    )


def verdict(rate: Column, other: Column, margin: float = 1e-9) -> Column:
    """worse, better or same of a rate against another system's."""
    return F.when(rate - other > margin, "worse").when(rate - other < -margin, "better").otherwise("same")


def extremes(rows: DataFrame, rate: str, order: str, n: int = 5, worst: bool = True) -> DataFrame:
    """The n rows of highest (or lowest) rate; ties by `order`, null rates last."""
    key = F.col(rate).desc_nulls_last() if worst else F.col(rate).asc_nulls_last()
    return rows.orderBy(key, order).limit(n)


def before_after(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """One-row metrics of two systems, a row per metric: baseline, tuned, abs_delta, rel_percent, same_n."""
    pick = lambda df, side: df.select(F.expr("stack(2, 'WER', wer, 'CER', cer)").alias("metric", side), F.col("n").alias(f"n_{side}"))
    both = pick(base, "baseline").join(pick(tuned, "tuned"), "metric")
    delta = F.col("tuned") - F.col("baseline")
    return both.select("metric", "baseline", "tuned", delta.alias("abs_delta"), F.try_divide(100 * delta, F.col("baseline")).alias("rel_percent"), (F.col("n_baseline") == F.col("n_tuned")).alias("same_n"))


def compare_named(base: DataFrame, tuned: DataFrame, key: str = "dataset") -> DataFrame:
    """Metrics of two systems by name; every tuned row stays, with null deltas where the baseline lacks it."""
    b = base.select(key, F.col("wer").alias("base_wer"), F.col("n").alias("base_n"))
    rows = tuned.select(key, F.col("wer").alias("tuned_wer"), F.col("n").alias("tuned_n")).join(b, key, "left")
    delta = F.col("tuned_wer") - F.col("base_wer")
    return rows.select(key, "base_wer", "tuned_wer", delta.alias("delta"), F.try_divide(100 * delta, F.col("base_wer")).alias("rel_percent"), (F.col("base_n") == F.col("tuned_n")).alias("same_n"))


def summary_table(results: DataFrame, registry: DataFrame, key: str = "dataset") -> DataFrame:
    """results in registry order (column position), with the registry's published figures; unknown names are an error."""
    unknown = [r[0] for r in results.join(registry, key, "left_anti").select(key).distinct().limit(20).collect()]
    if unknown:
        raise KeyError(f"unknown benchmark(s): {sorted(unknown)}")
    rows = results.join(registry, key).orderBy("position")
    percent = lambda c: F.round(100 * F.col(c), 2)
    return rows.select(key, "n", percent("wer").alias("wer_percent"), percent("cer").alias("cer_percent"), percent("wer_legacy").alias("wer_legacy_percent"), "published_wer_percent")


def bootstrap(counts: DataFrame, replicates: int = 2000, seed: str = "42") -> DataFrame:
    """Paired bootstrap of the difference of two systems' word error rates.

    counts: rows (idx from 0 without gaps, base_edits, base_words, tuned_edits, tuned_words). Each replicate draws as many
    rows as there are, by hash: reruns agree. Instead of a row for each draw and replicate that meets a join on one key, draws
    are counted by (replicate, idx), and that is joined to counts on idx. One row: n, point, low, high, verdict, in points.
    """
    n = counts.count()
    draws = counts.sparkSession.range(replicates).withColumnRenamed("id", "rep").crossJoin(counts.select(F.col("idx").alias("draw")))
    k = F.concat_ws("|", F.lit(seed), F.col("rep"), F.col("draw"))
    draws = draws.select("rep", (F.conv(F.substring(F.md5(k), 1, 15), 16, 10).cast("long") % F.lit(max(n, 1))).alias("idx"))
    drawn = draws.groupBy("rep", "idx").agg(F.count("*").alias("times")).join(counts, "idx")
    total = lambda c: F.sum(F.col("times") * F.col(c))
    rate = lambda of, side: F.try_divide(of(f"{side}_edits"), of(f"{side}_words"))
    deltas = drawn.groupBy("rep").agg((rate(total, "tuned") - rate(total, "base")).alias("delta"))
    span = deltas.agg(F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    point = counts.agg(F.count("*").alias("n"), (100 * (rate(F.sum, "tuned") - rate(F.sum, "base"))).alias("point"))
    both = point.crossJoin(F.broadcast(span)).select("n", "point", (100 * F.col("p")[0]).alias("low"), (100 * F.col("p")[1]).alias("high"))
    return both.withColumn("verdict", F.when((F.col("low") < 0) & (F.col("high") > 0), "not distinguishable from noise").otherwise("significant"))


def style_rates(rows: DataFrame, col: str = "hyp") -> DataFrame:
    """Percent of texts with punctuation, and of those that begin with a capital."""
    share = lambda c: F.avg(c.cast("double")) * 100
    return rows.agg(F.count("*").alias("n"), share(text.has_punctuation(F.col(col))).alias("punctuated"), share(text.starts_with_capital(F.col(col))).alias("capitalised"))


def align_by_key(rows: DataFrame, other: DataFrame, key: str = "audio_file") -> DataFrame | None:
    """rows with the other system's hyp_other, or None if a row has no or several partners there."""
    theirs = other.select(key, F.col("hyp").alias("hyp_other"))
    doubtful = rows.join(theirs.groupBy(key).agg(F.count("hyp_other").alias("__n"), F.count("*").alias("__all")), key, "left").where("coalesce(__n, 0) <> 1 or __all <> 1")
    return None if not doubtful.isEmpty() else rows.join(theirs, key, "left")


def align_by_position(rows: DataFrame, other: DataFrame, position: str = "idx") -> DataFrame | None:
    """rows with hyp_other by position, or None unless both have the same rows and the same references."""
    theirs = other.select(position, F.col("ref").alias("__ref"), F.col("hyp").alias("hyp_other"), F.lit(1).alias("__there"))
    both = rows.withColumn("__here", F.lit(1)).join(theirs, position, "full")
    odd = both.where(F.col("__here").isNull() | F.col("__there").isNull() | ~F.col("ref").eqNullSafe(F.col("__ref")))
    return None if not odd.isEmpty() else both.select(*rows.columns, "hyp_other")


def zip_counts(base: DataFrame, tuned: DataFrame, position: str = "idx") -> DataFrame:
    """edit_counts of two systems, empty references dropped on each side, paired by what is left in order, up to the shorter."""
    def side(df: DataFrame, name: str) -> DataFrame:
        df = df.where("words is not null")
        # One numbering for the whole table: a scored test set, a few thousand rows.
        return df.select((F.row_number().over(W.orderBy(position)) - 1).cast("long").alias("idx"), F.col("word_edits").alias(f"{name}_edits"), F.col("words").alias(f"{name}_words"))

    return side(base, "base").join(side(tuned, "tuned"), "idx")
