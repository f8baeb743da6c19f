"""Quality classifier: regularised quadratic discriminant analysis (operator 3).

Each document is a vector of transformed statistics of its text. Class means
and covariances come from one aggregation over all labelled training rows; the
covariances are shrunk towards their pooled mean and the identity. Scores are
differences of Gaussian log densities, whose Mahalanobis terms use Cholesky
factors that are computed once and kept as constants of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import SPACE_RUN, cut, table, words

FOLDS = 5
CUTOFF = 0.3


def text_statistics(docs: DataFrame, carried: Column | None = None) -> DataFrame:
    """``x1..xd`` of every document, from its whole text alone, and ``carried`` (doc_id if not given) as the column ``carried``; zeros where a text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select((F.col("doc_id") if carried is None else carried).alias("carried"), text.alias("t"), words(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE_RUN[:-1].replace("[", "[^"))).alias("lines"))
    n, chars = F.size("w"), F.length("t")

    def without(pattern: str) -> Column:
        return chars - F.length(F.regexp_replace("t", pattern, ""))

    d = d.select(
        "carried", n.alias("n_words"), chars.alias("length"), F.length(F.array_join("w", "")).alias("inside"), F.size(F.array_distinct("w")).alias("distinct"),
        without(r"[#*$%&<>]").alias("symbols"), without(r"\|").alias("bars"), without("!").alias("shouts"), without(r"\p{Lu}").alias("upper"), without(r"[0-9]").alias("digits"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dup_lines"), without(r"[.,;:?]").alias("stops"),
    )

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))

    def rate(part: str, whole: str) -> Column:
        return F.log1p(50 * share(part, whole))

    xs = [
        F.log1p("n_words"), share("inside", "n_words"), rate("symbols", "n_words"), rate("bars", "n_words"), rate("shouts", "n_words"), rate("upper", "length"),
        rate("digits", "length"), share("distinct", "n_words") * F.log1p("n_words"), rate("dup_lines", "n_lines"), rate("stops", "n_words"), F.log1p(share("n_words", "n_lines")),
    ]
    xs[1] = F.least(xs[1], F.lit(40.0))
    return d.select("carried", *(x.alias(f"x{k}") for k, x in enumerate(xs, 1)))


@dataclass(frozen=True)
class Discriminant:
    """Class log priors, means and inverted Cholesky factors; or a constant share where a class has too few rows."""

    constant: float | None
    means: tuple = ()
    inverses: tuple = ()
    offsets: tuple = ()

    def score(self, xs: list[Column]) -> Column:
        if self.constant is not None:
            return F.lit(float(self.constant))
        logs = []
        for mean, inverse, offset in zip(self.means, self.inverses, self.offsets, strict=True):
            centred = [x - float(m) for x, m in zip(xs, mean, strict=True)]
            z = [sum((c * float(a) for c, a in zip(centred[: i + 1], row[: i + 1], strict=True)), F.lit(0.0)) for i, row in enumerate(inverse)]
            logs.append(F.lit(float(offset)) - sum((v * v for v in z), F.lit(0.0)) / 2)
        return 1 / (1 + F.exp(F.least(logs[0] - logs[1], F.lit(700.0))))


def fit(rows: DataFrame, shrink: float = 0.3, ridge: float = 0.02) -> Discriminant:
    """Fit on rows of (label, x1..xd), all of them, in one aggregation of sums and products per class."""
    names = [c for c in rows.columns if c.startswith("x")]
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = {r["label"]: r for r in rows.groupBy("label").agg(
        F.count("*").alias("n"), F.array(*(F.sum(c) for c in names)).alias("s"), F.array(*(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs)).alias("p")
    ).collect()}
    n = [sums[k]["n"] if k in sums else 0 for k in (0, 1)]
    if min(n) < 2:
        return Discriminant((n[1] + 0.5) / (sum(n) + 1))
    means, covariances = [], []
    for k in (0, 1):
        mean, second = np.array(sums[k]["s"]) / n[k], np.zeros((d, d))
        for (i, j), p in zip(pairs, sums[k]["p"], strict=True):
            second[i, j] = second[j, i] = p / n[k]
        means.append(mean)
        covariances.append(second - np.outer(mean, mean))
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / sum(n)
    floor = np.diag(ridge * np.diag(pooled) + 1e-3)
    inverses, offsets = [], []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - shrink) * covariances[k] + shrink * pooled + floor)
        inverses.append(np.linalg.inv(factor))
        offsets.append(np.log(n[k] / sum(n)) - np.log(np.diag(factor)).sum())
    return Discriminant(None, tuple(means), tuple(inverses), tuple(offsets))


def learn(docs: DataFrame, labels: DataFrame, carried: Column | None = None) -> tuple[DataFrame, Discriminant]:
    """Statistics of all documents (doc_id, held_out, carried if given, x1..xd), written once, and the model fitted to those not held out."""
    more = [] if carried is None else [carried.alias("carried")]
    x = cut(text_statistics(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id"), *more)), "classifier-statistics")
    x = x.select("carried.*", *(c for c in x.columns if c != "carried"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))
    known = labels.where("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    return x.withColumn("held_out", held_out), fit(x.where(~held_out).drop("carried").join(known, "doc_id").drop("doc_id"))


def accepted(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, as they are, with all their columns of whatever name.

    The rows are written once with their statistics, so that texts are looked
    at once. Null and empty texts are scored as texts without words, repeated
    rows alike; without labels of both kinds all rows share one score; an
    empty table gives an empty one.
    """
    x, model = learn(docs, labels, F.struct("*"))
    return x.where(model.score([F.col(c) for c in x.columns if c.startswith("x")]) >= cutoff).select("carried.*")


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document.

    Rows of which crc32 of doc_id is 0 modulo 5 are held out and never learnt
    from. Null labels, labels other than 0 and 1 and labels of unknown
    documents are ignored; of several labels of a document the largest holds;
    a repeated document counts once for each row. A null doc_id is held out
    (it has no label). Null and empty texts are scored as texts without words.
    If a class has fewer than two training rows, every score is the smoothed
    share of label 1. An empty table gives an empty result.
    """
    x, model = learn(docs, labels)
    score = model.score([F.col(c) for c in x.columns if c.startswith("x")])
    return x.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
