"""Merkle manifest of a corpus: every document's leaf, its proof, and the roots of its source and of all (operator 11).

Leaves of a source are numbered in order and fall into aligned blocks of
``WIDTH ** DEPTH``. A block keeps each of its levels as one string of hex
digests: parents hash substrings of fixed width, and the siblings of a node are
the substrings on both sides of it. Roots of blocks are the nodes of the next
stage, which has a 243rd of the rows, until a source has one block; roots of
sources make the same kind of tree. Proofs then come down stage by stage, by
joins on (tree, block), whose keys are unique on one side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import cut, in_order, named, places, table

#: Nodes of a run, levels of a block, nodes of a block, and characters of a digest.
WIDTH, DEPTH = 3, 5
BLOCK = WIDTH**DEPTH
HEX = 64
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Hash of a record: each value as UTF-8 length, colon and value, or ``-`` if it is null."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def _levels(nodes: DataFrame) -> DataFrame:
    """Blocks with the strings ``level_0`` to ``level_5``; levels beyond the block's depth repeat the last one."""
    depth = F.when(F.col("count") <= 1, 0)
    for k in range(1, DEPTH):
        depth = depth.when(F.col("count") <= WIDTH**k, k)
    b = nodes.withColumn("depth", depth.otherwise(DEPTH)).withColumn("level_0", F.array_join(F.transform("members", lambda m: m["digest"]), ""))
    for k in range(DEPTH):
        b = b.withColumn(f"level_{k + 1}", F.when(F.col("depth") > k, _parents(F.col(f"level_{k}"))).otherwise(F.col(f"level_{k}")))
    return b


def _parents(level: Column) -> Column:
    """The next level's string: a hash of every run of fixed width, the last of which may be shorter."""
    width = WIDTH * HEX
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda i: digest(F.substring(level, i * width + 1, F.lit(width)))), "")


def _siblings(i: Column, k: int) -> Column:
    """The segments of level ``k`` before and after the ancestor of member ``i`` within its run."""
    level, node = F.col(f"level_{k}"), F.floor(i / WIDTH**k).cast("int")
    place = node % WIDTH
    before = F.substring(level, (node - place) * HEX + 1, place * HEX)
    after = F.substring(level, (node + 1) * HEX + 1, (WIDTH - 1 - place) * HEX)
    return F.struct(before.alias("before"), after.alias("after"))


def _climb(nodes: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """Stages of blocks (tree, block, count, members, top) over nodes (tree, place, count, digest, item); the last has one block a tree.

    ``count`` is the number of a tree's nodes in a stage, ``largest`` the greatest of the first stage.
    """
    stages = []
    while True:
        member = F.struct("place", "digest", "item")
        blocks = nodes.groupBy("tree", "count", F.floor(F.col("place") / BLOCK).cast("long").alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
        stages.append(cut(_levels(blocks).select("tree", "block", "count", "members", F.col(f"level_{DEPTH}").alias("top")), name))
        if largest <= BLOCK:
            return stages
        nodes = stages[-1].select("tree", F.col("block").alias("place"), F.ceil(F.col("count") / BLOCK).alias("count"), F.col("top").alias("digest"), F.lit(None).cast("int").alias("item"))
        largest = -(-largest // BLOCK)


def _descend(stages: list[DataFrame], above: DataFrame) -> DataFrame:
    """Rows (tree, place, digest, item, proof and what else ``above`` has) of the first stage's nodes, from those above the last one (tree, block, proof, ...)."""
    kept = [c for c in above.columns if c not in ("tree", "block", "proof")]
    for stage in reversed(stages):
        b = _levels(stage.drop("top")).join(above, ["tree", "block"])

        def proof(m: Column, i: Column) -> Column:
            own = F.slice(F.array(*(_siblings(i, k) for k in range(DEPTH))), F.lit(1), F.col("depth"))
            return F.struct(m["place"].alias("place"), m["digest"].alias("digest"), m["item"].alias("item"), F.concat(own, F.col("proof")).alias("proof"))

        rows = b.select("tree", *kept, F.explode(F.transform("members", proof)).alias("m")).select("tree", *kept, "m.*")
        above = rows.select("tree", F.col("place").alias("block"), "proof", *kept)
    return rows


def manifest(records: DataFrame, tree: str, order: list[str], item: Column) -> DataFrame:
    """A row a record: item, digest (its leaf), proof, subroot and root; ``records`` have their leaf as ``digest``.

    Records of equal ``tree`` (a text, never null) make a tree, in ``order``
    (nulls first), and the trees' roots one more, in the byte order of
    ``tree``. Steps of a proof hold the siblings before and after, which may
    both be empty. Equal records are leaves of their own. An empty table gives
    an empty result.
    """
    leaves = records.select(F.col(tree).alias("tree"), *(F.col(c).alias(f"order_{k}") for k, c in enumerate(order)), "digest", item.alias("item"))
    ordered = in_order(cut(leaves, "merkle-leaves"), ["tree", *(f"order_{k}" for k in range(len(order))), "digest"], "merkle-order")
    counts = ordered.groupBy("tree").agg(F.count("*").alias("count"))
    numbered = places(ordered, ["tree"]).join(counts, "tree").select("tree", "place", "count", "digest", "item")
    largest, trees = counts.agg(F.coalesce(F.max("count"), F.lit(0)).alias("n"), F.count("*").alias("trees")).first()
    stages = _climb(numbered, largest, "merkle-blocks")

    tops = in_order(stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("item"), F.col("top").alias("digest")), ["tree", "item"], "merkle-trees")
    upper = _climb(places(tops, ["tree"]).select("tree", "place", F.lit(trees).cast("long").alias("count"), "digest", "item"), trees, "merkle-top")
    empty = F.array().cast("array<struct<before:string,after:string>>")
    root = upper[-1].select("tree", "block", empty.alias("proof"), F.col("top").alias("root"))
    sources = _descend(upper, root).select(F.col("item").alias("tree"), F.lit(0).cast("long").alias("block"), "proof", F.col("digest").alias("subroot"), "root")
    return _descend(stages, sources).select("tree", "item", "digest", "proof", "subroot", "root")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""
    return F.aggregate(proof, leaf, lambda x, s: digest(F.concat(s["before"], x, s["after"])))


def proof_digest(proof: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


def document_manifest(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of documents: doc_id, source (as a tree's name), leaf, proof, subroot, root, and ``claimed``, the leaf of the record as it is found later.

    ``tampered`` gives the values of fields that are found changed; without it
    ``claimed`` is the leaf. Nulls in any field are told from all texts. Equal
    doc_ids are ordered by their leaves, so repeated rows are leaves of their
    own, each with its place; a null doc_id comes first. Empty and very long
    texts are hashed whole, in the scan; texts are never shuffled. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    found = tampered or {}
    fields = [F.col(c) for c in FIELDS]
    leaf = leaf_digest(*fields)
    claimed = leaf_digest(*(found.get(c, F.col(c)) for c in FIELDS)) if found else leaf
    rows = docs.select(named(F.col("source")).alias("tree"), F.col("doc_id"), leaf.alias("digest"), claimed.alias("claimed"))
    out = manifest(rows, "tree", ["doc_id"], F.struct("doc_id", "claimed"))
    return out.select("item.doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), "item.claimed", "proof", "subroot", "root")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, verified against a corpus in which half of them have lost their line feeds."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    m = document_manifest(docs, {"text": text})
    return m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.col("claimed"), F.col("proof")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: Trees by recursion over levels of all leaves at once; 0x edb88320 is CRC-32's polynomial.
OP11_SQL = r"""
WITH RECURSIVE plain AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN (list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)) & 1) = 1 THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents),
fields AS (SELECT *, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head FROM plain),
leaves AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS claimed FROM fields),
ordered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid FROM leaves),
tree AS (
  SELECT 0 AS level, sid, place, leaf AS digest, n FROM ordered
  UNION ALL SELECT level + 1, sid, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY level, sid, place // 3, n),
tops AS (SELECT sid, digest, count(*) OVER () AS n FROM tree WHERE n = 1),
above AS (
  SELECT 0 AS level, sid AS place, digest, n FROM tops
  UNION ALL SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM above WHERE n > 1 GROUP BY level, place // 3, n),
runs AS (
  SELECT level, sid, place // 3 AS run, list(digest ORDER BY place) AS nodes FROM tree WHERE n > 1 GROUP BY level, sid, place // 3
  UNION ALL SELECT 1000 + level, -1, place // 3, list(digest ORDER BY place) FROM above WHERE n > 1 GROUP BY level, place // 3),
named AS (SELECT *, row_number() OVER () AS rid FROM ordered),
marks AS (
  SELECT rid, level, runs.nodes, CAST(place // CAST(pow(3, level) AS BIGINT) % 3 AS BIGINT) AS k FROM named JOIN runs USING (sid) WHERE level < 1000 AND run = place // CAST(pow(3, level + 1) AS BIGINT)
  UNION ALL SELECT rid, level, runs.nodes, named.sid // CAST(pow(3, level - 1000) AS BIGINT) % 3 FROM named, runs WHERE level >= 1000 AND run = named.sid // CAST(pow(3, level - 999) AS BIGINT)),
steps AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY level) AS step, array_to_string(nodes[1:k], '') AS before, array_to_string(nodes[k + 2:], '') AS after FROM marks),
proofs AS (SELECT rid, sha256(coalesce(string_agg(before || after, '' ORDER BY step), '')) AS proof_sha256, count(*) AS n_steps FROM steps GROUP BY rid),
folded AS (
  SELECT rid, CAST(0 AS BIGINT) AS step, claimed AS x FROM named
  UNION ALL SELECT s.rid, s.step, sha256(s.before || f.x || s.after) FROM folded f JOIN steps s ON s.rid = f.rid AND s.step = f.step + 1)
SELECT doc_id, leaf, t.digest AS subroot, (SELECT digest FROM above WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, x AS folded_root, x = (SELECT digest FROM above WHERE n = 1) AS verified
FROM named JOIN tops t USING (sid) LEFT JOIN proofs USING (rid) JOIN folded ON folded.rid = named.rid AND folded.step = coalesce(n_steps, 0)
"""
