"""Quality rules with a hashed n-gram log-likelihood ratio (operator 1), in built-in functions only.

Words and word pairs are hashed into a fixed number of buckets. Two
multinomials over the buckets are counted: one of a trusted target (documents
labelled good), one of the whole raw corpus. A document's score is the mean,
over its n-grams, of log p_target - log p_raw; it is kept if it passes the base
rules and its score reaches a fixed threshold. Equal texts of one corpus get
equal verdicts; with ratios counted before, verdicts depend on the text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import SPACE_RUN, bitmap, cut, marked, table, words

BUCKETS = 1 << 16
SMOOTHING = 1.0
THRESHOLD = -0.1
#: Log ratios are added up as integers, so a score does not depend on the order of addition.
UNIT = 1_000_000
SYMBOLS = r"[#*$%&|<>]"


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def grams(hashes: Column) -> Column:
    """Buckets of all words and word pairs; the last word is paired with the end of the text."""
    return F.concat(F.transform(hashes, lambda x: _bucket(x)), F.transform(hashes, lambda x, i: _bucket(F.xxhash64(x, F.get(hashes, i + 1)))))


def _counts(docs: DataFrame, name: str) -> DataFrame:
    """(bucket, name): n-grams of all texts by bucket; each task sends ``BUCKETS`` rows at most."""
    hashes = docs.select(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    return hashes.select(F.explode(grams(F.col("h"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[int]:
    """The log ratio of each of the ``BUCKETS`` buckets, in millionths.

    Raw counts cover every document, target counts every document that is
    labelled good, whatever their number: a bounded bitmap of their ids drops
    most other texts where they are, and a semi join by sorting, which needs no
    side to be small, decides. Without any trusted word all ratios are 0.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("trusted_id"))
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("trusted_id"), "text").withColumn("key", F.xxhash64("trusted_id"))
    maybe = marked(named, bitmap(good.select(F.xxhash64("trusted_id").alias("key")))).where("marked").select("trusted_id", "text")
    trusted = maybe.join(good.hint("merge"), "trusted_id", "left_semi")
    both = _counts(docs, "raw").join(_counts(trusted, "target"), "bucket", "left").fillna(0, ["target"])
    counts = cut(both, "rule-counts")
    totals = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    if not totals["target"]:
        return [0] * BUCKETS

    def log_share(count: str, total: int) -> Column:
        return F.log((F.coalesce(F.col(count), F.lit(0)) + SMOOTHING) / (total + SMOOTHING * BUCKETS))

    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    ratio = log_share("target", totals["target"]) - log_share("raw", totals["raw"])
    found = every.select("bucket", F.round(ratio * UNIT).cast("int").alias("ratio")).orderBy("bucket").collect()
    return [r["ratio"] for r in found]


def judge(docs: DataFrame, labels: DataFrame | None, threshold: float = THRESHOLD, ratios: list[int] | None = None) -> DataFrame:
    """Counts, base verdict, score and verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and score. Null and empty texts have no
    words: all counts 0, score 0, base_failed. Repeated rows are judged alike.
    Labels of unknown documents, null labels and other columns are ignored; an
    empty table gives an empty result. ``ratios`` (see :func:`log_ratios`) may
    come from another corpus; the labels are then not needed. They are one
    constant array of the plan, over which each text's n-grams are summed where
    the text is, so nothing is shuffled. Each column that a lambda reads more than once is projected first, so that
    it is not computed again for every element.
    """
    text, space = F.coalesce(F.col("text"), F.lit("")), SPACE_RUN[:-1]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(space.replace("[", "[^")))
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        words(text).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    counted = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    h = F.col("h")
    windows = F.when(F.size(h) >= 5, F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, 5)))))
    d = d.select(*counted, grams(h).alias("grams"), windows.alias("windows"))
    repeated = F.size("windows") > F.size(F.array_distinct("windows"))
    d = d.select(*counted, "grams", F.when(repeated, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    same = F.filter("s", lambda e, j: F.coalesce(e["x"] == F.get(F.col("s"), j - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get(F.col("s"), j + 1)["x"], F.lit(False)))
    d = d.select(*counted, "grams", F.sort_array(F.transform(same, lambda e: e["i"])).alias("at"))
    new = F.transform("at", lambda p, j: F.least(F.lit(5), p - F.coalesce(F.get(F.col("at"), j - 1), p - 5)))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    known = F.split(F.lit(",".join(map(str, log_ratios(docs, labels) if ratios is None else ratios))), ",").cast("array<int>")
    d = d.withColumn("sum", F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + F.get(known, g)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    score = F.coalesce(F.try_divide(F.col("sum"), 2 * UNIT * F.col("n_words")), F.lit(0.0))
    return d.select(*counted, "n_repeat_words", failed.alias("base_failed"), (~failed & (score >= threshold)).alias("kept"), score.alias("score"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
