"""Token counts of a byte-level BPE tokenizer by a two-tier lookup in the map task (operator 5).

Tier one is a broadcast table of the lengths of the corpus's most frequent
pre-tokens; tier two is a bounded cache in each Python worker, filled by
encoding what it misses. Documents never move. The frequent pre-tokens are
found from all documents: each task sends its own few most frequent ones, and
those summaries alone are added up. The table affects the speed only.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import ship, table

#: Fixed: how byte-level BPE cuts a text into pre-tokens; white space is Unicode's property.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
FREQUENT = 8192
PER_TASK = 1024
#: A task's counter, and a worker's cache, hold at most so many different pre-tokens.
COUNTED = 1 << 18
CACHED = 1 << 20
LIMIT = 512
#: Byte-level BPE's alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


@lru_cache(maxsize=2)
def _tools(path: str):
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, regex.compile(PRE_TOKEN).findall if _is_byte_level(tokenizer) else None, special, {}


def _is_byte_level(tokenizer) -> bool:
    """Whether the file cuts texts as ``PRE_TOKEN`` does and encodes the pieces apart; others are encoded whole by the library."""
    spec = json.loads(tokenizer.to_str())
    cut, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and spec["normalizer"] is None
    return plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))


def _encode(tokenizer, pieces: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def _length(tokenizer, piece: str) -> int:
    """Tokens of one pre-token, which goes to the library's BPE model without its text pipeline."""
    return len(tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(_ALPHABET)))


def count_tokens(texts: list[str | None], path: str, frequent: dict[str, int]) -> list[int]:
    """Tokens of each text. Texts that hold a special token's string go to the tokenizer whole."""
    tokenizer, split, special, cache = _tools(path)
    out = []
    for text in texts:
        if not text:
            out.append(0)
        elif split is None or any(s in text for s in special):
            out.append(_encode(tokenizer, [text])[0])
        else:
            pieces = split(text)
            lengths = list(map(frequent.get, pieces))
            missed = [p for p, n in zip(pieces, lengths, strict=True) if n is None]
            new = list({p for p in missed if p not in cache})
            if new:
                if len(cache) + len(new) > CACHED:
                    cache.clear()
                    new = list(set(missed))
                cache.update((p, _length(tokenizer, p)) for p in new)
            out.append(sum(filter(None, lengths)) + sum(map(cache.__getitem__, missed)))
    return out


def _summaries(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, split, _, _ = _tools(path)
        if split is None:
            return
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(split(text))
                if len(counts) > COUNTED:
                    counts = Counter(dict(counts.most_common(COUNTED // 2)))
        top = counts.most_common(PER_TASK)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    return run


def frequent_lengths(docs: DataFrame, path: str, size: int = FREQUENT) -> dict[str, int]:
    """Token counts of the ``size`` most frequent pre-tokens (ties: code point order), by adding up the tasks' summaries."""
    found = docs.where("text IS NOT NULL").select("text").mapInArrow(_summaries(path), "piece string, n long")
    top = found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size).collect()
    pieces = [r["piece"] for r in top]
    tokenizer = _tools(path)[0]
    return {p: _length(tokenizer, p) for p in pieces}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    Null texts count as empty: 0 bytes, 0 tokens. No special tokens are added;
    special strings inside a text count as the tokenizer counts them by
    default. Repeated rows give repeated results, other columns are ignored,
    and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    table_of = spark.sparkContext.broadcast(frequent_lengths(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            n = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(count_tokens(text.to_pylist(), path, table_of.value), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
