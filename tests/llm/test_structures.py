"""Merkle manifest, conversation repair and packing against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from tidewake.llm import conversations, merkle, packing
from tidewake.llm.common import in_order, places

CLASHING = ("tree", "place", "digest", "item", "count", "block", "proof", "members", "at", "task", "n", "conv", "segment", "code", "initial", "kind", "copy", "length", "piece", "ids", "low", "level_0")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- order


def test_places_number_every_group_over_many_tasks(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), (F.col("id") * 7919 % 1009).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = places(in_order(rows, ["g", "v"], "test-order"), ["g"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["g"], r["place"])):
        groups[r["g"]].append((r["v"], r["place"]))
    assert len(found) == 3000
    for g in groups.values():
        assert [p for _, p in g] == list(range(len(g))) and [v for v, _ in g] == sorted(v for v, _ in g)


# ---------------------------------------------------------------- Merkle manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def plain_tree(leaves):
    """The root, and for each leaf the siblings (before, after) of every level."""
    proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(at):
            run = p - p % 3
            proofs[k].append((level[run:p], level[p + 1 : run + 3]))
        level, at = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)], [p // 3 for p in at]
    return level[0], proofs


def plain_manifest(rows):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((-1 if r[0] is None else r[0], leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by[s], key=lambda x: x[:2]), *plain_tree([x[1] for x in sorted(by[s], key=lambda x: x[:2])])) for s in order}
    root, tops = plain_tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        members, subroot, proofs = trees[s]
        for (_, digest, r), proof in zip(members, proofs, strict=True):
            steps = proof + top
            cut = r[:4] + (r[4].replace("\n", ""),) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r
            x = leaf(cut)
            for before, after in steps:
                x = sha("".join([*before, x, *after]))
            out.append((r[0], digest, subroot, root, sha("".join(y for b, a in steps for y in [*b, *a])), x, x == root))
    return sorted(out, key=str)


def merkle_rows():
    rng = random.Random(3)
    rows = [(k, "hot", "en", k, f"text {rng.random()}\nline" if k % 3 else None) for k in range(800)]
    rows += [(k, f"s{k % 7}", None, None, "a\nb") for k in range(60)] + [(1, None, "x", 1, ""), (2, None, "x", 1, "é\n" * 20000), (None, "hot", None, None, None), (None, None, None, None, "z\n")]
    return [*rows, rows[5], rows[5], (5, "hot", "other", 5, "tie"), (9, "", "en", 0, "empty source"), (3, "alone", "en", 1, "one\n")]


def digests(spark, docs, path):
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return merkle.op11_merkle_manifest(spark, path)


def test_manifest_is_that_of_plain_trees(spark, tmp_path):
    rows = merkle_rows()
    found = digests(spark, clashing(spark.createDataFrame(rows, DOCS)).repartition(5), str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 243, 244])
def test_manifest_of_few_leaves(spark, tmp_path, n):
    rows = [(k, "s", "en", k, f"t{k}\n") for k in range(n)]
    assert sorted(map(tuple, digests(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()), key=str) == (plain_manifest(rows) if n else [])


def test_manifest_equals_its_sql(spark, small):
    same(merkle.op11_merkle_manifest(spark, small), merkle.OP11_SQL, small)


# ---------------------------------------------------------------- conversations

SPACE = "\x20\t\n\x0b\x0c\r"


def plain_repair(messages):
    """Faults, cost, audit and text of one conversation's (role, text), by trying every edit at every place."""
    faults, seen = [], set()
    for role, text in messages:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "a": "u", "u": "a"}
    sys.setrecursionlimit(100_000)

    @lru_cache(maxsize=None)
    def best(k, state, inserted):
        options = []
        if k == len(messages):
            if state in ("", "a"):
                options.append((0, "", ""))
        else:
            cost, audit, text = best(k + 1, state, 0)
            options.append((cost + 4, "D" + audit, text))
            if faults[k] not in ("blank", "duplicate"):
                more, role = 3 * (faults[k] == "truncated"), messages[k][0]
                first = role[:1]
                if (state, first) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    cost, audit, text = best(k + 1, first, 0)
                    options.append((cost + more, "K" + audit, f"\n{role}:{messages[k][1]}" + text))
                cost, audit, text = best(k + 1, after[state], 0)
                options.append((cost + 3 + more, "R" + audit, f"\n{ {'u': 'user', 'a': 'assistant'}[after[state]] }:{messages[k][1]}" + text))
        if inserted < 3:
            cost, audit, text = best(k, after[state], inserted + 1)
            options.append((cost + 3, "I" + audit, f"\n{ {'u': 'user', 'a': 'assistant'}[after[state]] }:" + text))
        return min(options, default=(10**9, "", ""))

    for k in range(len(messages), -1, -1):  # keeps the recursion shallow
        for state in after:
            best(k, state, 0)
    cost, audit, text = best(0, "", 0)
    initials = [r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _ in messages]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(text[1:])


def plain_conversations(rows):
    conversations_of = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        conversations_of[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, messages in conversations_of.items():
        messages.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), m[2].encode()))
        turns = {m[0] for m in messages} - {None}
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *plain_repair([m[1:] for m in messages])))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def conversation_rows(n=150, seed=5):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "umpire"])
            rows.append((c, rng.choice([t, t, t, None, t * 3]), role, rng.choice(["Yes.", "no", "", " \n", "Why?\n", None, f"text {rng.random()}.", "same.", "Über!"])))
    rows += [(None, 1, "user", "hi."), (None, None, "assistant", "there."), (-1, 0, "user", "long. " * 50000), (-1, 1, "assistant", "word " * 50000)]
    return rows + rows[:7]


def test_repair_is_the_cheapest_of_all_edits(spark, tmp_path):
    rows = conversation_rows()
    clashing(spark.createDataFrame(rows, CONVERSATIONS)).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = conversations.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == plain_conversations(rows)


def test_repair_crosses_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 3)
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b!", f"{t}.", f"{t}", f"{t}?"])) for c in (1, 2, 3) for t in range(400 if c == 2 else 30)]
    found = conversations.repair(conversations.damaged(spark.createDataFrame(rows, CONVERSATIONS).repartition(4)), spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert sorted(map(tuple, found), key=str) == plain_conversations(rows)


def test_halves_meet_at_the_least_audit():
    rng = random.Random(2)
    for _ in range(300):
        codes = "".join(rng.choice("suaxSUAX--") for _ in range(rng.randint(1, 14)))
        messages = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x"), "" if c == "-" else f"{k}." if c.islower() else f"{k}") for k, c in enumerate(codes)]
        letters, tail, cost = conversations.repaired_segment(codes, conversations.START, None)
        assert (cost, "".join(letters) + tail) == plain_repair(messages)[4:6]
        pieces = [codes[k : k + 3] for k in range(0, len(codes), 3)]
        states = conversations.segment_states([conversations.table_of(p) for p in pieces])
        parts = [conversations.repaired_segment(p, a, b) for p, a, b in zip(pieces, states, [*states[1:], None], strict=True)]
        assert (sum(p[2] for p in parts), "".join("".join(p[0]) + p[1] for p in parts)) == plain_repair(messages)[4:6]


def test_repaired_messages_and_empty_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "First."), (1, 1, "user", "Second?"), (1, 2, "assistant", "Third."), (2, 0, "user", "")], CONVERSATIONS)
    assert [tuple(r) for r in conversations.repaired(rows).where("conv = '=1'").collect()] == [("=1", "user", ""), ("=1", "assistant", "First."), ("=1", "user", "Second?"), ("=1", "assistant", "Third.")]
    two = conversations.repair(rows).where("conv_id = 2").first()
    assert (two["audit"], two["cost"], two["blank"], two["repaired_sha256"]) == ("D", 4, 1, sha(""))
    assert conversations.repair(rows.limit(0)).count() == 0
    gone = conversations.repair(rows.limit(0), rows).collect()
    assert sorted(map(tuple, gone)) == [(c, 0, 0, 0, 0, 0, 0, "", sha("")) for c in (1, 2)]


# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def spec():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


def test_encoder_gives_the_library_s_ids_of_every_character(spec):
    encode = packing._encoder(spec)
    assert encode.merge is not None
    characters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}1 {c} .{c}{c} {c}" for c in characters] + ["", " ", "\n\n x", "a  b", "it's I'll", "x\x01 y", "the end<|endoftext|> more", "  \n", "  z"]
    for k in range(0, len(texts), 100_000):
        part = texts[k : k + 100_000]
        ids, ends = encode(pa.array(part, pa.large_string()))
        expected = encode.library.encode_batch_fast(part, add_special_tokens=False)
        for t, got, e in zip(part, np.split(ids, ends[:-1]), expected, strict=True):
            assert got.tolist() == [*e.ids, packing.END], repr(t)


def check_packing(rows, texts, spec, size=packing.SIZE):
    """Every id lies in one piece with its checksum, offsets have no gaps, sequences fit; returns the share of padding."""
    from tokenizers import Tokenizer

    library, sequences, pieces = Tokenizer.from_buffer(spec), defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for doc, copies in texts.items():
        expected = []
        for text in copies:
            expected.append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
        assert sum(p[1] for p in pieces[doc]) == sum(map(len, expected))
        if len(expected) == 1:
            at = 0
            for start, length, crc, n in sorted(pieces[doc]):
                assert start == at and n == len(expected[0]) and crc == zlib.crc32(expected[0][start : start + length].tobytes())
                at += length
    assert set(pieces) == set(texts)
    spent = used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
        used, spent = used + at, spent + packing.padded(at, size)
    return spent / max(1, used) - 1


def test_packing_keeps_every_token_once(spark, small, spec):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = packing.pack(docs, spec).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"])
    assert check_packing(found, texts, spec) < 0.01
    assert sorted(map(tuple, packing.pack(docs.repartition(3), spec).collect())) == sorted(map(tuple, found))


def test_packing_of_odd_documents(spark, spec):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["word", "été", "日本", "<|endoftext|>", "\x01", "  ", "\n"]) for _ in range(rng.randint(0, 300)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "long text " * 30000), (103, "same words " * 700), (103, "same words " * 700), (None, "no name"), (104, "1500 " * 750), (105, "1500 " * 750)]
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append(text)
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    assert check_packing(packing.pack(docs.repartition(4), spec).collect(), texts, spec) < 0.01
    assert packing.pack(docs.limit(0), spec).count() == 0
    assert [tuple(r)[1:] for r in packing.pack(docs.where("doc_id = 101"), spec).collect()] == [(0, 1, zlib.crc32(b"\x01\0\0\0"), 1, 0, 0)]


@pytest.mark.parametrize("seed", range(6))
def test_program_uses_every_piece_once_and_pads_little(seed):
    rng = random.Random(seed)
    demand = defaultdict(int)
    for _ in range([3, 50, 400, 4000, 30000, 5000][seed]):
        demand[min(2048, max(1, int(rng.lognormvariate(5.5, 1.2))))] += 1 if seed < 5 else 7
    chosen, left = packing.plan(dict(demand))
    taken = defaultdict(int, left)
    for pattern, times in chosen:
        total = packing._total(pattern)
        assert times > 0 and total <= 2048 and packing.padded(total) - total <= packing.SLACK
        for n, k in pattern:
            taken[n] += n and k * times
    assert dict(taken) == dict(demand)
    padding = sum((packing.padded(packing._total(p)) - packing._total(p)) * t for p, t in chosen)
    assert padding <= 0.004 * sum(n * k for n, k in demand.items())


def test_columns_lower_what_the_first_patterns_cost():
    rng = random.Random(1)
    demand = {n: rng.randint(1, 50) for n in (1500, 1400, 1111, 1000, 937, 700, 648, 548, 400, 300, 111, 48)}
    program = packing.Program(dict(demand))
    before = program.padding()
    solved = program.solve()
    assert program.padding() < before / 2
    for n in demand:
        assert abs(sum(dict(p).get(n, 0) * t for p, t in solved) - demand[n]) < 1e-6
