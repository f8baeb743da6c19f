"""The pipeline's stages against brute-force versions of their decisions."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import word_distance, words
from tidewake.llm import decontamination, mixing, quality_classifier, simhash
from tidewake.llm.common import cut, row_name, table


def similarities(texts):
    """Jaccard similarity of the 5-word shingles of every pair of texts, if it is over 0.5."""
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}

    s = {i: shingles(t) for i, t in texts.items()}
    out = {}
    for a in s:
        for b in s:
            if a < b and (j := len(s[a] & s[b]) / len(s[a] | s[b])) > 0.5:
                out[a, b] = j
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, small):
    d = table(spark, small, "documents")
    quality, near, leaks, mix, shards = (f for _, f in corpus_pipeline.STAGES)

    kept = cut(quality(spark, d, small), "test-quality")
    good = quality_classifier.classify(d, table(spark, small, "labels")).where("predicted = 1")
    assert kept.columns == d.columns and ids(kept) == ids(good) and 0 < kept.count() < d.count()

    one = cut(near(spark, kept, small), "test-near")
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    left = ids(one)
    assert one.columns == d.columns and set(left.values()) == {1}
    similar = similarities(rows)
    for (a, b), j in similar.items():
        if j >= 0.85:
            assert not (a in left and b in left)
    gone = set(rows) - set(left)
    assert gone and all(any(j >= 0.65 and i in pair for pair, j in similar.items()) for i in gone)

    clean = cut(leaks(spark, one, small), "test-leaks")
    items = [decontamination.words_of(r["text"]) for r in table(spark, small, "benchmark").collect()]
    held = {r["doc_id"] for r in one.collect() for p in items if word_distance(p, decontamination.words_of(r["text"])) <= int(decontamination.ERRORS * len(p))}
    assert clean.columns == d.columns and ids(clean) == Counter({r["doc_id"] for r in one.collect()} - held) and held

    mixture = cut(mix(spark, clean, small), "test-mix")
    taken = {r["doc_id"]: r for r in mixing.mix(clean, name=row_name("doc_id", "text", "source")).collect()}
    copies = ids(mixture)
    assert mixture.columns == d.columns and {r["doc_id"]: copies[r["doc_id"]] for r in clean.collect()} == {r["doc_id"]: math.floor(t["taken"] / t["size"] + 0.5) if t["size"] else 0 for r in clean.withColumn("name", row_name("doc_id", "text", "source")).collect() for t in [taken[r["name"]]]}
    words_of, target = Counter(), {r["source"]: r["target"] for r in taken.values()}
    for r in mixture.collect():
        words_of[r["source"]] += len(words(r["text"]))
    longest = max(r["size"] for r in taken.values())
    for source, want in target.items():
        # a document is taken whole or not at all, so a source is met to some of its documents
        assert abs(words_of[source] - want) <= 0.35 * want + 2 * longest

    placed = shards(spark, mixture, small)
    assert ids(placed) == ids(mixture) and {r["shard"] for r in placed.collect()} <= set(range(16))


def test_run_is_the_stages_in_turn(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 50


def test_stages_of_repeated_and_empty_rows(spark, small):
    d = table(spark, small, "documents").limit(20)
    twice = d.unionByName(d)
    one = corpus_pipeline.STAGES[1][1](spark, twice, small)
    assert max(ids(one).values()) == 1
    nothing = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, small).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(6)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(n))

    passage, texts = prose(60), {}
    for k in range(30):
        texts[100 * k] = prose(rng.randint(40, 400)) + (f" {passage}" if k % 3 == 0 else "")
        for c in range(1, 1 + k % 4):
            w = texts[100 * k].split()
            for at in rng.sample(range(len(w)), max(1, len(w) // 60)):
                w[at] = "changed"
            texts[100 * k + c] = " ".join(w)
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    left = ids(corpus_pipeline.STAGES[1][1](spark, d, ""))
    assert set(left) >= {100 * k for k in range(30)}
    similar = similarities(texts)
    assert not [(p, j) for p, j in similar.items() if j >= 0.85 and p[0] in left and p[1] in left]
    assert all(any(j >= 0.65 and i in p for p, j in similar.items()) for i in set(texts) - set(left))


@pytest.mark.parametrize("part", [simhash.PART, 3])
def test_near_copies_are_settled_by_exact_similarity(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng, texts = random.Random(9), {}

    def prose(n):
        return ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n)]

    for k in range(40):
        # one word changed takes 5 of n - 4 shingles away: 40 / 50 of 49 words, 39 / 49 of 48 words
        for first, n in ((100, 49), (1000, 48)):
            w = prose(n)
            texts[first + 2 * k], texts[first + 2 * k + 1] = " ".join(w), " ".join([*w[:20], "changed", *w[21:]])
    w = prose(49)
    texts |= {2000 + k: " ".join([*w[: 6 * k], *(["changed"] * (k > 0)), *w[6 * k + (k > 0) :]]) for k in range(8)}
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    left = set(ids(corpus_pipeline.STAGES[1][1](spark, d, "")))
    assert left == {100 + 2 * k for k in range(40)} | {1000 + k for k in range(80)} | {2000}


def test_large_families_are_settled_in_linear_work(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 8)
    met_rows = []

    def compared(reach):
        def run(met):
            met_rows.append(met.count())
            x, y = met.alias("x"), met.alias("y")
            pairs = x.join(y, F.expr("x.bucket = y.bucket and x.item < y.item")).where(reach)
            return pairs.select(F.col("x.item").alias("a"), F.col("y.item").alias("b"))

        return run

    def settled(items, reach):
        met_rows.clear()
        rows = spark.createDataFrame(items, "bucket long, item long")
        return {r["node"]: r["component"] for r in simhash._settled(rows, "item", compared(reach), "test").collect()}

    # one family of 400, all alike: parts and leaders meet, and nothing again
    assert settled([(1, k) for k in range(400)], "true") == dict.fromkeys(range(400), 0)
    assert len(met_rows) == 1 and met_rows[0] <= 400 + 50 * 25
    # a family of 400 and ten others that nobody but one member of it, or one of them, is alike with
    odd = {10_000 + k: 7 * k for k in range(5)} | {20_000 + k: 20_000 + (k + 1) % 5 for k in range(5)}
    reach = "(x.item < 1000 and y.item < 1000) or " + " or ".join(f"(x.item = {min(p)} and y.item = {max(p)})" for p in odd.items())
    found = settled([(1, k) for k in [*range(400), *odd]], reach)
    assert found == dict.fromkeys([*range(400), *range(10_000, 10_005)], 0) | dict.fromkeys(range(20_000, 20_005), 20_000)
    assert sum(met_rows) <= 10 * 400
    # chains have no leaders: whatever is not joined at first meets afterwards
    rng = random.Random(12)
    items = [(rng.randrange(3), k) for k in range(150)]
    nodes, label = dict((k, b) for b, k in items), {k: k for _, k in items}
    linked = [(a, b) for a in nodes for b in range(a + 1, min(a + 4, 150)) if nodes[a] == nodes[b]]
    for _ in range(150):
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    assert settled(items, "y.item - x.item < 4") == {k: label[k] for k in {k for p in linked for k in p}}


def test_repeated_passages_do_not_hide_near_copies(spark):
    rng, texts = random.Random(10), {}
    for k in range(12):
        w = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(204)]
        passage = w[:24] * (5, 10, 20)[k % 3]
        # shingles of 200 words and a passage of 24 of them, whose seams add a few
        texts[10 * k], texts[10 * k + 1] = " ".join(w), " ".join([*passage, *w])
    assert all(similarities(texts)[10 * k, 10 * k + 1] >= 0.95 for k in range(12))
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert set(ids(corpus_pipeline.STAGES[1][1](spark, d, ""))) == {10 * k for k in range(12)}


def test_fingerprints_of_sets_at_the_similarity_are_within_the_radius():
    rng = np.random.default_rng(11)
    for n, a, b in ((4, 1, 0), (12, 3, 0), (40, 5, 5), (160, 20, 20)):
        for _ in range(1500):
            h = rng.integers(0, 1 << 64, n + a + b, dtype=np.uint64)
            assert (simhash.sketch(h[: n + a])[0] ^ simhash.sketch(np.r_[h[:n], h[n + a :]])[0]).bit_count() <= simhash.WIDE_RADIUS
