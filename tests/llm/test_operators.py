"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.oracle import same
from tidewake.llm import decontamination, license_scan, mixing, quality_classifier, quality_rules, registry, sharding, simhash, suffix_dedup, token_counts, url_filter
from tidewake.llm.components import connected_components
from tidewake.llm.suffix_array import permuted_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, w string, row string, key string, x1 string, h string, size string"


def words(t):
    return WORD.findall(t or "")


def make_rows():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    shared = prose(120)
    texts = [prose(rng.randint(1, 200)) for _ in range(40)] + [prose(30) + "\n" + shared + "\n" + prose(30) for _ in range(8)]
    texts += [None, "", " \t\n", "ÉÈ ßtraße 日本語 \u0001 x", "the " * 500, "a b c d e f\na b c d e f\n\n" * 3, "Wörter!! *** ### $$$ | | <p> &", prose(4000), shared, shared, shared.upper()]
    texts += [texts[0]] * 5 + [texts[1] + " extra"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, 0) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], None, "s1", None), (None, None, None, None, None), (5, texts[6], "x", "", 1)]
    return [(*r, "w", "r", "k", "x", "h", "s") for r in rows]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 5 != 0), 0) for i in range(0, 48, 2)] + [(2, 0, 0), (4, None, 0), (None, 1, 0), (9999, 1, 0), (6, 7, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, small, name):
    same(registry.QUERIES[name](spark, small), registry.ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, small, name):
    rows = registry.QUERIES[name](spark, small).collect()
    conversations = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct().count()
    n = {"op12_conversation_repair": conversations, "op13_packing": len(rows) if len(rows) >= 200 else 200}.get(name, 200)
    assert len(rows) == n or name == "op2_decontamination"


# ---------------------------------------------------------------- 1


def rule_counts(t):
    w = words(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams(t):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(t)]
    out = [x % quality_rules.BUCKETS for x in h]
    for k, x in enumerate(h):
        s = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42)
        out.append((xxhash.xxh64_intdigest(h[k + 1].to_bytes(8, "little"), s) if k + 1 < len(h) else s) % quality_rules.BUCKETS)
    return out


def test_quality_rules(docs, labels):
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["doc_id"] is not None}
    raw, target = Counter(), Counter()
    for r in ROWS:
        raw.update(grams(r[1]))
        if r[0] in good:
            target.update(grams(r[1]))
    b = quality_rules.BUCKETS

    def score(t):
        g = grams(t)
        each = [math.log((target[x] + 1) / (target.total() + b)) - math.log((raw[x] + 1) / (raw.total() + b)) for x in g]
        return sum(math.floor(x * 1e6 + 0.5) if x >= 0 else -math.floor(-x * 1e6 + 0.5) for x in each) / 1e6 / len(g) if g else 0.0

    found = quality_rules.judge(docs, labels).collect()
    assert len(found) == len(ROWS)
    expected = Counter((r[0], *rule_counts(r[1])) for r in ROWS)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found) == expected
    by_key = defaultdict(set)
    for r in ROWS:
        by_key[(r[0], *rule_counts(r[1]))].add(round(score(r[1]), 5))
    for r in found:
        assert round(r["score"], 5) in by_key[(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])]
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["score"] >= quality_rules.THRESHOLD)


def test_quality_rules_without_labels_or_rows(docs, labels, nothing):
    assert {r["score"] for r in quality_rules.judge(docs, labels.limit(0)).collect()} == {0.0}
    assert quality_rules.judge(nothing, labels).count() == 0


# ---------------------------------------------------------------- 2


def word_distance(a, b):
    """Smallest edit distance of a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(3)
    for _ in range(200):
        a, b = [rng.choice("abc") for _ in range(rng.randint(1, 70))], [rng.choice("abc") for _ in range(rng.randint(0, 90))]
        d, limit = word_distance(a, b), rng.randint(0, 30)
        found = decontamination.myers(a, b, limit)
        assert (found[0] if found else None) == (d if d <= limit and b else None)


def test_decontamination(spark, docs, nothing):
    rng = random.Random(5)
    clean = [r for r in ROWS if r[1] and len(words(r[1])) > 60]
    items = []
    for k, r in enumerate(clean[:12]):
        w = words(r[1])[10:50]
        for _ in range(k % 8):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["zzz"], [w[at], "zzz"]])
        items.append((k, " ".join(w).upper() if k % 2 else ", ".join(w)))
    items += [(100, None), (101, ""), (102, "the the"), (103, "?! --"), (104, " ".join(words(clean[0][1])[3:7])), (105, "日本語"), (None, items[0][1]), (0, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter()
    for r in ROWS:
        for i, t in items:
            p, w = decontamination.words_of(t), decontamination.words_of(r[1])
            if p and w:
                d = word_distance(p, w)
                if d <= int(decontamination.ERRORS * len(p)):
                    expected[(r[0], i, d)] += 1
    assert got(decontamination.leaks(docs, benchmark), "doc_id", "item_id", "distance") == expected
    assert expected[(clean[0][0], 104, 0)] and any(k[1] == 105 for k in expected) and any(k[1] == 102 for k in expected)
    assert sorted(r["item_id"] for r in decontamination.unsought(benchmark).collect()) == [100, 101, 103]
    leaky = {(d, t) for d, t, *_ in ROWS if any(k[0] == d for k in expected)}
    kept = decontamination.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and 0 < kept.count() < len(ROWS) and len(leaky) > 5
    assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0 and decontamination.leaks(nothing, benchmark).count() == 0


def test_decontamination_in_blocks(docs, spark, monkeypatch):
    benchmark = spark.createDataFrame([(k, r[1]) for k, r in enumerate(ROWS[:8])], "item_id long, text string")
    whole = got(decontamination.leaks(docs, benchmark), "doc_id", "item_id", "distance")
    kept = got(decontamination.without_leaks(docs, benchmark), "doc_id", "text")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    assert got(decontamination.leaks(docs, benchmark), "doc_id", "item_id", "distance") == whole
    assert got(decontamination.without_leaks(docs, benchmark), "doc_id", "text") == kept and docs.count() == len(ROWS)


# ---------------------------------------------------------------- 3


def test_classifier_finds_the_labels(spark, small):
    d, l = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality_classifier.classify(d, l).join(l, "doc_id").where("held_out").collect()
    assert np.mean([x["predicted"] == x["quality"] for x in r]) > 0.97
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in r)


def test_classifier_against_numpy(docs, labels):
    kept = {}
    for r in labels.collect():
        if r["quality"] in (0, 1) and r["doc_id"] is not None:
            kept[r["doc_id"]] = max(kept.get(r["doc_id"], 0), r["quality"])
    x = [(r["carried"], np.array([r[f"x{k}"] for k in range(1, 12)])) for r in quality_classifier.text_statistics(docs).collect()]
    train = [(v, kept[i]) for i, v in x if i in kept and zlib.crc32(str(i).encode()) % 5]
    per = [np.array([v for v, y in train if y == k]) for k in (0, 1)]
    cov = [np.cov(p.T, bias=True) for p in per]
    pooled = sum(len(p) * c for p, c in zip(per, cov, strict=True)) / len(train)
    s = [0.7 * c + 0.3 * pooled + np.diag(0.02 * np.diag(pooled) + 1e-3) for c in cov]
    logs = [[math.log(len(p) / len(train)) - 0.5 * np.linalg.slogdet(m)[1] - 0.5 * (v - p.mean(0)) @ np.linalg.solve(m, v - p.mean(0)) for _, v in x] for p, m in zip(per, s, strict=True)]
    expected = sorted(1 / (1 + math.exp(min(700, a - b))) for a, b in zip(*logs, strict=True))
    assert np.allclose(sorted(r["score"] for r in quality_classifier.classify(docs, labels).collect()), expected, atol=1e-6)


def plain_statistics(t):
    t = t or ""
    w, lines = words(t), [x for x in t.split("\n") if WORD.search(x)]
    n, m = max(1, len(w)), max(1, len(lines))

    def rate(count, whole):
        return math.log1p(50 * count / whole) if whole else 0.0

    def having(pattern):
        return len(re.findall(pattern, t))

    upper = sum(unicodedata.category(c) == "Lu" for c in t)
    return [
        math.log1p(len(w)), min(40.0, sum(map(len, w)) / n), rate(having(r"[#*$%&<>]"), len(w)), rate(t.count("|"), len(w)), rate(t.count("!"), len(w)), rate(upper, len(t)), rate(having("[0-9]"), len(t)),
        len(set(w)) / n * math.log1p(len(w)), rate(len(lines) - len(set(lines)), m if lines else 0), rate(having(r"[.,;:?]"), len(w)), math.log1p(len(w) / m) if lines else 0.0,
    ]


def test_text_statistics(docs):
    found = sorted((r["carried"] or -1, [round(r[f"x{k}"], 9) for k in range(1, 12)]) for r in quality_classifier.text_statistics(docs).collect())
    assert found == sorted((r[0] or -1, [round(x, 9) for x in plain_statistics(r[1])]) for r in ROWS)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, t string, w string, lines string, carried string, x1 string, name string, row string, place string, copies string, label string, mix_key string, chosen_key string"


def test_stages_keep_columns_of_any_name(spark, labels):
    d = spark.createDataFrame([(*r[:5], *(f"{c}{i}" for c in "abcdefghijkl")) for i, r in enumerate(ROWS)], CLASHING)
    given = {r["chosen_key"]: r for r in d.collect()}
    for stage in (lambda: quality_classifier.accepted(d, labels, 0.01), lambda: simhash.one_of_each(d), lambda: mixing.mixed(d), lambda: decontamination.without_leaks(d, d.select(F.lit(1).alias("item_id"), F.lit("not there at all").alias("text")))):
        out = stage()
        assert out.columns == d.columns
        rows = out.collect()
        assert rows and all(given[r["chosen_key"]] == r for r in rows)


def test_long_texts(spark, labels):
    """Texts of some megabytes, as one line and as many."""
    rng = random.Random(12)
    parts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)) for _ in range(150)]
    notice = license_scan.TEMPLATES[0][1]
    texts = [" ".join([*parts, notice]), "\n".join([*parts[::-1], notice]), None, ""]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    n = 150 * 2000 + 7
    assert {r["doc_id"]: (r["n_words"], r["n_repeat_words"]) for r in quality_rules.judge(d, labels).collect()} == {0: (n, 0), 1: (n, 0), 2: (0, 0), 3: (0, 0)}
    assert {r["doc_id"] for r in quality_classifier.classify(d, labels).collect()} == {0, 1, 2, 3}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(d).collect()} == {0: n, 1: n, 2: 0, 3: 0}
    assert {(r["doc_id"], r["license"], r["dice"]) for r in license_scan.scan(d).collect()} == {(0, "Apache-2.0", 1.0), (1, "Apache-2.0", 1.0)}
    assert {r["doc_id"]: r["size"] for r in sharding.shard_documents(d).collect()} == {0: len(texts[0]) + 1, 1: len(texts[1]) + 1, 2: 1, 3: 1}
    assert {r["doc_id"]: r["n_removed"] > 2_000_000 for r in suffix_dedup.remove_repeats(d).collect()} == {0: True, 1: True, 2: False, 3: False}
    assert {r["doc_id"] for r in decontamination.leaks(d, spark.createDataFrame([(1, parts[7][100:400])], "item_id long, text string")).collect()} == {0, 1}


def test_classifier_without_enough_labels(docs, labels, nothing):
    r = quality_classifier.classify(docs, labels.where("quality = 1")).collect()
    assert len(r) == len(ROWS) and len({x["score"] for x in r}) == 1
    assert quality_classifier.classify(nothing, labels).count() == 0


# ---------------------------------------------------------------- 4


def test_mix(docs, nothing):
    found = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], len(words(r[1]))) for r in ROWS)
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(sizes.values())
    target, full = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[o] for o in open_) for s in order}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            break
        full.update(over)
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in order)
    assert got(mixing.mix(docs.repartition(7)), "doc_id", "size", "taken") == Counter((r["doc_id"], r["size"], r["taken"]) for r in found)
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("max_slots", [16, 1024, 1 << 20])
def test_mix_meets_every_target_with_long_blocks(spark, max_slots):
    """Sources of a tenth of a block to many blocks take their targets to a word, and every word of a source as often as any other or once more."""
    rng = random.Random(6)
    counts = {"a": (1, 100_000), "b": (50, 40), "c": (20, 110), "d": (3, 1), "e": (400, 37), None: (7, 500)}
    rows = [(f"{s}{k}", s, n) for s, (docs, n) in counts.items() for k in range(docs)]
    rows = [(i, " ".join(["w"] * n), s) for i, (_, s, n) in enumerate(rng.sample(rows, len(rows)))]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), max_slots=max_slots).collect()
    by = defaultdict(list)
    for r in found:
        by[r["source"]].append(r)
    assert set(by) == set(counts)
    for rs in by.values():
        target, size = rs[0]["target"], rs[0]["source_size"]
        assert abs(sum(r["taken"] for r in rs) - target) <= 1
        rounds = math.floor(math.floor(target) / size)
        assert all(rounds * r["size"] <= r["taken"] <= min(3, rounds + 1) * r["size"] for r in rs)


def test_mixed_rows(docs):
    rows = Counter(r["doc_id"] for r in mixing.mixed(docs.where("doc_id >= 20")).collect())
    from tidewake.llm.common import row_name

    taken = {r["doc_id"]: r for r in mixing.mix(docs.where("doc_id >= 20"), name=row_name("doc_id", "text", "source")).collect()}
    assert sum(rows.values()) == sum(math.floor(r["taken"] / r["size"] + 0.5) for r in taken.values() if r["size"])


# ---------------------------------------------------------------- 5


def test_token_counts(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = [(900, "a<|endoftext|>b"), (901, " \x1c a\x85b　 c"), (902, "don't I'LL  we've\r\n\r\n x"), (903, "\u0000🙂Ⅷ½")]
    d = docs.select("doc_id", "text", "w").unionByName(docs.sparkSession.createDataFrame([(*e, "") for e in extra], "doc_id long, text string, w string"))
    expected = Counter((i, len((x or "").encode()), n, n > 512) for i, x in [(r[0], r[1]) for r in ROWS] + extra for n in [len(t.encode(x or "", add_special_tokens=False).ids)])
    assert got(token_counts.token_counts(d, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts.token_counts(nothing, path).count() == 0


def test_token_counts_of_another_kind_of_tokenizer(tmp_path):
    """A file that does not cut texts as byte-level BPE does goes through the library whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    assert token_counts.count_tokens([r[1] for r in ROWS], path, {}) == [len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS]


def test_token_cache_limit(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [r[1] for r in ROWS]
    whole = token_counts.count_tokens(texts, path, {})
    monkeypatch.setattr(token_counts, "CACHED", 50)
    assert token_counts.count_tokens(texts, path, {" the": 1}) == whole


# ---------------------------------------------------------------- 6


def brute_components(ids, prints, radius=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def plain_fingerprint(t):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x.encode()) for x in words(t)]
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(docs, nothing):
    prints = [plain_fingerprint(r[1]) for r in ROWS]
    ids = [r[0] for r in ROWS]
    expected = Counter(zip(ids, [signed(p) for p in prints], brute_components(ids, prints), strict=True))
    assert got(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == expected
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("part", [simhash.PART, 3])
def test_bit_sliced_links_join_all_near_prints(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for p in prints[:6]:
        for _ in range(12):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.append(q)
    prints = sorted(set(prints) | {0, (1 << 64) - 1, 1 << 63})
    links = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
    names = {r["node"]: r["component"] for r in connected_components(links).collect()}
    groups = brute_components(range(len(prints)), prints)
    mine, theirs = defaultdict(set), defaultdict(set)
    for k, p in enumerate(prints):
        mine[names.get(signed(p), signed(p))].add(k)
        theirs[groups[k]].add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_crowded_buckets_meet_by_finer_blocks(spark):
    # every 26-bit difference is in the blocks that one table leaves free: all prints share its bucket, and only prints of 15 or 16 more equal bits meet
    rng = random.Random(4)
    free = [b for b in range(64) if not simhash.MASKS[0] >> b & 1]
    prints = {sum(1 << b for b in rng.sample(free, rng.randint(0, len(free)))) for _ in range(3000)}
    prints |= {p ^ 1 << rng.choice(free) ^ 1 << rng.choice(free) for p in list(prints)[:500]}
    links = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    label, todo = {}, sorted(prints)
    steps = [1 << a | 1 << b for a in free for b in free]  # a = b: one bit
    for p in todo:
        if p not in label:
            label[p], seen = p, [p]
            while seen:
                q = seen.pop()
                for x in steps:
                    if q ^ x in prints and q ^ x not in label:
                        label[q ^ x] = p
                        seen.append(q ^ x)
    mine, theirs = defaultdict(set), defaultdict(set)
    for p in prints:
        mine[found.get(signed(p), signed(p))].add(p)
        theirs[label[p]].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    assert all(bin(m).count("1") >= 53 and m & kept == kept for kept, finer in zip(simhash.MASKS, simhash.FINER_MASKS, strict=True) for m in finer)


def test_simhash_of_a_very_long_text(spark):
    rng = random.Random(5)
    w = [rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(300_000)]
    texts = [" ".join(w), "\t".join(w).upper(), "x" * 2_000_000, ""]
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, fp long").withColumn("bucket", F.lit(1)).withColumn("n", F.lit(1))
    found = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(d).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert found == {i: (signed(p), c) for (i, p), c in zip(enumerate(prints), brute_components(range(4), prints), strict=True)}


def test_near_over_several_words():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    v[100:200] = v[0] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    g = np.r_[np.zeros(250, int), np.ones(50, int)]
    i, j = simhash.near(v, g, slab=500)
    expected = {(a, b) for a in range(300) for b in range(a) if g[a] == g[b] and int(v[a] ^ v[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == expected


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(200, k) for k in range(201, 240)] + [(k, k + 1) for k in range(300, 330)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    r = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert r == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


# ---------------------------------------------------------------- 7


def best_windows(t):
    """The best window of each template in a text, over all windows that begin and end anywhere."""
    w = re.findall("[a-z0-9]+", t.lower())
    grams = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    for k, (name, text) in enumerate(license_scan.TEMPLATES):
        own, best = set(license_scan.bigrams(text)), None
        for i, first in enumerate(grams):
            held = set()
            for j in range(i, min(len(grams), i + 2 * len(own)) if first in own else i):
                held |= {grams[j]} & own
                dice = 2 * len(held) / (j - i + 1 + len(own))
                if dice >= 0.8 and (best is None or dice > best[0]):
                    best = (dice, i, j + 2)
        if best:
            yield (name, k, *best)


def test_license_scan(spark, nothing):
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 200)
    gpl = next(t for n, t in license_scan.TEMPLATES if n == "GPL-3.0" and len(t) > 100)
    lines = [
        "LICENSED under the Apache license - version 2.0", "Licensed under a bakery license", "Released under the MIT License", "mit", "Some words. " * 9, "",
        "Licensed under CC BY-SA 4.0.", mit,
    ]
    comment = "/*\n" + "\n".join(f" * {mit[i : i + 60]}" for i in range(0, len(mit), 60)) + "\n *\n * More of the file is told here.\n */"
    texts = [
        "\n".join(lines), None, "", "Licensed under the\nApache License,\nVersion 2.0.\n\nanother paragraph", mit.replace(" to ", "\n to ", 3), comment, "# " + gpl.replace(", ", ",\n# ") + " # end",
        "The figures in this chapter were drawn by the authors. Licensed under CC BY 4.0.", "See the file. This project is licensed under the MIT License. Contributions are welcome.", "licensed license software " * 50, f"{mit} {gpl} {mit}",
    ]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, lines[2], 1), (0, texts[0], 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n long")
    expected = Counter((i, *found) for i, t, _ in rows if t is not None for found in best_windows(t))
    assert len(expected) > 12 and {k[0] for k in expected} >= {0, 3, 4, 5, 6, 7, 8, 10}
    assert got(license_scan.scan(d), "doc_id", "license", "template", "dice", "first_word", "end_word") == expected
    assert license_scan.scan(nothing).count() == 0 and license_scan.scan(d, ()).count() == 0


def test_marks_cover_every_match():
    rng = random.Random(4)
    known = license_scan.marks(license_scan.TEMPLATES)
    for _, text in license_scan.TEMPLATES:
        own = license_scan.bigrams(text)
        for _ in range(50):
            kept = rng.sample(own, -(-len(own) * 8 // 12))
            if 2 * len(kept) / (len(kept) + len(own)) >= 0.8:
                assert any(m in g for g in kept for m in known)


# ---------------------------------------------------------------- 8


def test_url_filter(spark, nothing):
    pages = [
        (1, "http://A.Example.COM/en/5?q=1", None), (2, "https://x.com/en/", ""), (3, "http://example.com/en/77#t", ""), (4, "http://notexample.com/en/7", ""), (5, "http://a.net/de/8", ""), (6, "http://b.example.net/de/80", ""),
        (7, None, None), (8, "no scheme/en/", ""), (9, "http://org/es/", ""), (10, "http://com/es/", ""), (11, "http://alias.info/p", '<link rel="canonical" href="https://x.com/en/">'),
        (12, "http://alias2.info/p", "<META http-equiv=refresh content=\"0; URL='http://alias.info/p/'\">"), (13, "http://both.info/", '<link href="http://example.com/en/77" rel=canonical>'),
        (14, "https://both.info", '<link rel=canonical href="//x.com/en/#z">'), (15, "http://x.com/en/?utm_source=a", ""), (1, "http://A.Example.COM/en/5?q=1", None), (None, "http://q.info/", '<link rel="canonical" href="/r">'), (17, "http://q.info/r?utm_a=1", ""),
    ]
    d = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, rule string")
    r = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.filter_urls(d, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert r == {
        1: ("a.example.com", "/en/5", "com/en/", "block"), 2: ("x.com", "/en/", "com/en/", "block"), 3: ("example.com", "/en/77", "example.com/en/7", "allow"), 4: ("notexample.com", "/en/7", "com/en/", "block"),
        5: ("a.net", "/de/8", "net/de/", "allow"), 6: ("b.example.net", "/de/80", "example.net/de/8", "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("org", "/es/", "org/es/", "block"), 10: ("com", "/es/", None, "allow"),
        11: ("alias.info", "/p", None, "allow"), 12: ("alias2.info", "/p", None, "allow"), 13: ("both.info", "/", None, "allow"), 14: ("both.info", "", None, "allow"), 15: ("x.com", "/en/", "com/en/", "block"),
        None: ("q.info", "/", None, "allow"), 17: ("q.info", "/r", None, "allow"),
    } | {11: ("alias.info", "/p", None, "allow"), 12: ("alias2.info", "/p", None, "allow")}
    alone = {x["page_id"]: x["verdict"] for x in url_filter.filter_urls(d.where("page_id NOT IN (13, 14)"), url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert alone[11] == alone[12] == "block"
    assert url_filter.filter_urls(d.limit(0), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_links_are_read_tag_by_tag(spark):
    here, there = "http://host.com/a/b", "http://x.com/en/?a=1&b=2"
    pages = {
        "entities": ('<link rel="canonical" href="http://x.com/en/?a=1&amp;b=2">', [there]),
        "list": ("<link href='http://x.com/en/?a=1&#38;b=2' rel=' Alternate  CANONICAL'>", [there]),
        "greater": ('<link title="a > b" rel="canonical" href="http://x.com/en/?a=1&b=2">', [there]),
        "base": ('<base href="http://x.com/en/page"><link rel=canonical href="?a=1&b=2"><link rel=canonical href="other">', ["http://x.com/en/page?a=1&b=2", "http://x.com/en/other"]),
        "relative base": ('<base href="/c/"><base href="/d/"><link rel=canonical href="x">', ["http://host.com/c/x"]),
        "comment": ('<!-- <link rel="canonical" href="http://x.com/en/"> --><p>', []),
        "open comment": ('<!-- <link rel="canonical" href="http://x.com/en/">', []),
        "other name": ('<link data-rel="canonical" rel="next" href="http://x.com/en/">', []),
        "other tag": ('<linked rel="canonical" href="http://x.com/en/">', []),
        "no href": ("<link rel=canonical>", []),
        "first wins": ('<link rel=canonical href="http://x.com/1" href="http://x.com/2">', ["http://x.com/1"]),
        "long": ("<p>" * 200_000 + '<link rel=canonical href="/z">', ["http://host.com/z"]),
        "many quotes": ("<link " + 'a="b" ' * 5000 + 'rel=canonical href="/z">', []),
        "slash": ('<link rel="canonical" href="/z"/>', ["http://host.com/z"]),
        "refresh": ('<meta http-equiv="Refresh" content="5;URL=&quot;/q&quot;">', ["http://host.com/q"]),
        "no refresh": ('<meta http-equiv="refresh" content="5"><meta name=refresh content="0;url=/q">', []),
    }
    d = spark.createDataFrame([(k, here, html) for k, (html, _) in pages.items()], "k string, url string, html string")
    found = {r["k"]: r["t"] for r in d.select("k", url_filter.targets(F.col("url"), F.col("html")).alias("t")).collect()}
    assert found == {k: t for k, (_, t) in pages.items()}
    a = spark.createDataFrame([("http://h:80/x/",), ("https://h:443/x",), ("http://h:443/x",), ("h/x",)], "u string").select(url_filter.address(F.col("u")).alias("a"))
    assert [r["a"] for r in a.collect()] == ["h/x", "h/x", "h:443/x", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_aliases_of_random_graphs(spark, seed):
    """Verdicts of pages in components of random links, relative and absolute, by canonical link or refresh."""
    rng = random.Random(seed)
    hosts = ["x.com/en/", "example.com/en/7", "a.net/de/", "plain.info/p", "other.info/q", "o.org/es/"]
    urls = [f"http://{rng.choice(hosts)}{k}" if rng.random() < 0.3 else f"http://plain.info/p{k}" for k in range(120)]
    index = {u.removeprefix("http://"): k for k, u in enumerate(urls)}
    parent = list(range(len(urls)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    pages = []
    for k, u in enumerate(urls):
        html = "<p>no link</p>"
        if rng.random() < 0.5:
            to = rng.randrange(len(urls))
            target = urls[to].removeprefix("http://plain.info") if u.startswith("http://plain.info/") and urls[to].startswith("http://plain.info/") else urls[to]
            html = f'<link rel="canonical" href="{target}">' if rng.random() < 0.5 else f'<meta http-equiv="refresh" content="0; url={target}">'
            parent[root(k)] = root(to)
        pages.append((k, u, html))
    rules = [(v, *r.split("/", 1)) for v, r in url_filter.RULES]

    def ruled(u):
        host, path = u.removeprefix("http://").split("/", 1)
        fits = [(len(h) + len(p), v == "allow") for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    allowed = defaultdict(list)
    for k, u in enumerate(urls):
        if ruled(u) is not None:
            allowed[root(k)].append(ruled(u))
    expected = {k: "allow" if (ruled(u) if ruled(u) is not None else any(allowed[root(k)]) or not allowed[root(k)]) else "block" for k, u in enumerate(urls)}
    assert len(index) == len(urls) and len(set(expected.values())) == 2
    d = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(d, url_filter.rule_table(spark, url_filter.RULES)).collect()} == expected


def test_link_targets(spark):
    base = "https://Host.com/a/b/c?d=1"
    links = {
        "page2.html": "https://host.com/a/b/page2.html", "../x": "https://host.com/a/x", "../../../x?q#f": "https://host.com/x?q#f", "?id=3": "https://host.com/a/b/c?id=3", "./": "https://host.com/a/b/", "/r/./s/../t": "https://host.com/r/t",
        "//other.org/p": "https://other.org/p", "http://x.y/z": "http://x.y/z", "mailto:a@b.c": None, "#top": None, "..": "https://host.com/a/",
    }
    rows = [(k, base, f"<link rel='canonical' href='{k}'>") for k in links] + [("both", base, '<link rel=canonical href="u"><LINK href="v" REL="canonical"><meta http-equiv="refresh" content="3; url=w"><meta content="url=/n" http-equiv=Refresh>'), ("none", base, None), ("null", None, "<link rel=canonical href=u>")]
    d = spark.createDataFrame(rows, "k string, url string, html string").select("k", url_filter.targets(F.col("url"), F.col("html")).alias("t"))
    found = {r["k"]: r["t"] for r in d.collect()}
    assert {k: found[k] for k in links} == {k: [v] if v else [] for k, v in links.items()}
    assert sorted(found["both"]) == ["https://host.com/a/b/u", "https://host.com/a/b/v", "https://host.com/a/b/w", "https://host.com/n"] and found["none"] is None and not found["null"]


# ---------------------------------------------------------------- 9


def brute_removal(texts):
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        yield len(t), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()


def window_hashes(data, width=400):
    """Two polynomial hashes of every string of ``width`` bytes, packed in one number; widths are put together from powers of two."""
    packed = np.zeros(len(data) - width + 1, np.uint64)
    for base, prime in ((257, 2147483647), (263, 2147483629)):
        p, h, size, done, offset = np.uint64(prime), data.astype(np.uint64), 1, np.zeros(len(packed), np.uint64), 0
        while size <= width:
            if width & size:
                done = (done * np.uint64(pow(base, size, prime)) + h[offset : offset + len(packed)]) % p
                offset += size
            h = (h[: len(h) - size] * np.uint64(pow(base, size, prime)) + h[size:]) % p
            size *= 2
        packed = packed << np.uint64(32) | done
    return packed


def test_window_hashes():
    data = np.random.default_rng(1).integers(0, 3, 900).astype(np.uint8)
    data[450:] = data[:450]
    h = window_hashes(data)
    assert (h[:51] == h[450:]).all() and len(np.unique(h)) == len({data[i : i + 400].tobytes() for i in range(501)})


def test_suffix_dedup_of_a_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in d.collect()}
    ends = np.cumsum([len(t) for t in texts.values()])
    data = np.frombuffer(b"".join(texts.values()), np.uint8)
    h = window_hashes(data)
    of_one = np.zeros(len(h), bool)
    for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True):
        of_one[a : max(a, b - 399)] = True
    _, name, count = np.unique(h[of_one], return_inverse=True, return_counts=True)
    gone = np.zeros(len(data) + 1, int)
    at = np.flatnonzero(of_one)[count[name] > 1]
    gone[at] += 1
    gone[at + 400] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    expected = {}
    for i, t, a, b in zip(texts, texts.values(), np.r_[0, ends[:-1]], ends, strict=True):
        g = gone[a:b]
        expected[i] = len(t), int(g.sum()), int((g & ~np.r_[False, g[:-1]]).sum()), hashlib.sha256(data[a:b][~g].tobytes()).hexdigest()
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(d).collect()}
    assert found == expected and sum(x[1] for x in found.values()) > 1_000_000


@pytest.mark.parametrize("cap", [suffix_dedup.CAP, 2])
def test_suffix_dedup(docs, spark, monkeypatch, cap):
    monkeypatch.setattr(suffix_dedup, "CAP", cap)
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    more = []
    for i in range(40):
        a, n = rng.randint(0, 1700), rng.choice([399, 400, 401, 450, 700])
        more.append((1000 + i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 300))) + base[a : a + n] + rng.choice(["", "é", "z" * rng.randint(1, 900)])))
    more += [(2000, "ab" * 500), (2001, "a" * 400), (2002, "a" * 401), (2002, "a" * 401)]
    d = docs.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(*m, "") for m in more], "doc_id long, text string, key string"))
    rows = [(r[0], r[1]) for r in ROWS] + more
    expected = Counter((i, *e) for (i, _), e in zip(rows, brute_removal([(t or "").encode() for _, t in rows]), strict=True))
    assert got(suffix_dedup.remove_repeats(d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


def test_equal_rows_send_their_contexts_once(spark):
    rng = random.Random(8)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(3))
    rows = [(7, a + b), (None, a + b)] * 60 + [(8, c + a[100:800])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    expected = Counter((i, *e) for (i, _), e in zip(rows, brute_removal([t.encode() for _, t in rows]), strict=True))
    assert got(suffix_dedup.remove_repeats(d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


def test_suffix_dedup_of_nothing(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_long_texts_in_stretches(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    whole = {(int(a), int(x)) for _, s, m, a, h in suffix_dedup.contexts(data, [(0, 0, 9000)]) for a, x in zip(a, h, strict=True)}
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1500)
    cut = list(suffix_dedup.contexts(data, [(0, 0, 9000)]))
    assert {(int(a), int(x)) for _, s, m, a, h in cut for a, x in zip(a, h, strict=True)} == whole
    assert sum(int(m.sum()) for _, s, m, a, h in cut) == 9000 - 399


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for trial in range(150):
        t = rng.integers(1, rng.integers(1, 5) + 1, rng.integers(1, 150))
        text = np.r_[np.tile(t, 1 + trial % 3), 0].astype(np.uint16)
        plain = text.tolist()
        order = sorted(range(len(plain)), key=lambda i: plain[i:])
        sa = suffix_array(text)
        assert sa.tolist() == order
        if trial % 3 == 0:
            wide = np.r_[rng.integers(1, 40, 3 * len(t)), 0].astype(np.int32)
            assert suffix_array(wide).tolist() == sorted(range(len(wide)), key=lambda i, w=wide.tolist(): w[i:])
        phi, common = permuted_prefixes(text, sa)
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while a + k < len(plain) and plain[a + k] == plain[b + k]:
                k += 1
            assert (phi[b], common[b]) == (a, k)


# ---------------------------------------------------------------- 10


def plain_best_fit(items, capacity, max_bins=None):
    """Bin of each (key, size) of items in order, one at a time; None if more than max_bins are needed."""
    left, where = [], {}
    for key, size in items:
        room = [(r, b) for b, r in enumerate(left) if r >= size]
        b = min(room)[1] if room else len(left)
        if not room:
            left.append(capacity)
        left[b] -= size
        where[key] = b
        if size > capacity or (max_bins is not None and len(left) > max_bins):
            return None
    return where


def test_best_fit_decreasing():
    rng = random.Random(9)
    for trial in range(60):
        sizes = [rng.randint(1, 100 if trial % 2 else 6) for _ in range(rng.randint(1, 120))]
        where = plain_best_fit([(k, s) for k, s in enumerate(sorted(sizes, reverse=True))], 100)
        runs = sharding.best_fit_decreasing(Counter(sizes).items(), 100)
        assert [b for s in sorted(runs, reverse=True) for b, n in runs[s] for _ in range(n)] == list(where.values())
        few = max(where.values())
        assert sharding.best_fit_decreasing(Counter(sizes).items(), 100, few) is None or not few
    assert sharding.best_fit_decreasing([(101, 1)], 100) is None and sharding.best_fit_decreasing([], 0) == {}


def test_shards_of_a_whole_table(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    # one text is a third of all rows; texts of equal sizes differ
    d = d.unionByName(spark.range(10_000, 10_500).select(F.col("id").alias("doc_id"), F.lit("a copy of many").alias("text")))
    d = d.unionByName(spark.range(20_000, 20_300).select(F.col("id").alias("doc_id"), F.concat(F.lit("of one size "), "id").alias("text")))
    monkeypatch.setattr(sharding, "DIGITS", 64)
    rows = d.collect()
    groups = Counter()
    for r in rows:
        groups[r["text"]] += len((r["text"] or "").encode()) + 1
    digest = {t: "-" if t is None else hashlib.md5(t.encode()).hexdigest() for t in groups}
    items = sorted(groups.items(), key=lambda x: (-x[1], digest[x[0]]))
    total = sum(groups.values())
    found = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(d).collect()}
    load = Counter()
    for r in rows:
        load[found[r["doc_id"]]] += len((r["text"] or "").encode()) + 1
    capacity = max(load.values())
    where = plain_best_fit(items, max(capacity, -(-total // 16)), 16)
    assert {i: where[t] for i, t in ((r["doc_id"], r["text"]) for r in rows)} == found
    assert max(load.values()) <= -(-total // 16) * 1.0002
    # by leading digits alone the shards are as even as the digits say, and equal texts stay together
    monkeypatch.setattr(sharding, "DIGITS", 6)
    coarse = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(d).collect()}
    loads, homes = Counter(), defaultdict(set)
    for r in rows:
        loads[coarse[r["doc_id"]]] += len((r["text"] or "").encode()) + 1
        homes[r["text"]].add(coarse[r["doc_id"]])
    assert len(coarse) == len(found) and all(len(h) == 1 for h in homes.values())
    assert max(loads.values()) <= total / 16 * (1 + 1 / 32)


def test_size_classes(spark):
    sizes = [1, 2, 16_383, 16_384, 16_385, (1 << 40) - 1, 1 << 40, (1 << 50) + 12_345]
    found = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(sharding.size_class(F.col("s"))).collect()]
    assert found == [s >> max(0, s.bit_length() - 14) << max(0, s.bit_length() - 14) for s in sizes]


def test_shards(docs, nothing):
    r = sharding.shard_documents(docs, n_shards=4).collect()
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in r) == Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in ROWS)
    load, slots, home = Counter(), defaultdict(list), defaultdict(set)
    for x in r:
        load[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        home[(x["text_crc32"], x["size"])].add(x["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for k, h in home.items() if k[1] > 1)
    assert max(load.values()) <= max(sum(load.values()) / 4 * 1.1, max(Counter({(d[1] or ""): 0 for d in ROWS} | {t: sum(len((t or "").encode()) + 1 for d in ROWS if d[1] == t) for t in {d[1] for d in ROWS}}).values()))
    assert {(x["law"], x["grown_shard"]) for x in r} == {("bytes", None)}
    assert sharding.shard_documents(nothing).count() == 0
