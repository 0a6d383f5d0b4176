"""Merkle manifest of a dataset by windows of fixed offsets. DataFrame functions only.

Every row is a leaf, every source a tree, and the roots of all sources are the leaves of one more tree. Level by level,
columns of lag and lead at the offsets 1 to FAN - 1, masked by a node's slot and the length of its run, hold its
siblings; the row of a first child hashes its run into the parent. Windows are keyed by run, never by source: places in
a source come from a range partition and from the counts of its parts, so a source of any size stays dealt out.

The way back goes from the root to the leaves: nodes of a level get the steps above them from their parents, one row for
FAN of them, so long paths are never shuffled with the leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrainflow.llm.common import shared_checkpoint

#: Nodes of a run.
FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def leaf_hash(*values: Column) -> Column:
    """Digest of the values: each `-` if null, else its UTF-8 bytes with their count before it."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """nodes (tree, ...) -> with idx, the place in its tree by `order` from 0, and n, the nodes of the tree; and the largest n.

    Nodes are dealt by ranges of (tree, *order); a node's place is its place in its part, less where its tree begins
    there, and the counts of earlier parts. Rows of equal order are put in any order; the checkpoint keeps it.
    """
    row = F.monotonically_increasing_id()
    by = ["tree", *order, "_row"]  # equal rows can be dealt apart, too
    dealt = nodes.withColumn("_row", row).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = shared_checkpoint(dealt.withColumn("_row", row))
    dealt = dealt.withColumns({"_part": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND((1 << 33) - 1)}).drop("_row")
    parts = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")  # one row for each part that holds any of it
    earlier = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shared_checkpoint(parts.select("tree", "_part", "_first", earlier.alias("_before"), F.sum("_n").over(tree).alias("n")))
    placed = dealt.join(parts, ["tree", "_part"]).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.drop("_part", "_at", "_first", "_before"), parts.agg(F.max("n")).first()[0] or 0


def with_siblings(level: DataFrame) -> DataFrame:
    """A level (tree, idx, n, hash, ...) -> with run, and left and right: the digests of the siblings before and after, joined."""
    run, slot = F.floor(F.col("idx") / FAN), F.col("idx") % FAN
    level = level.withColumns({"run": run, "slot": slot})
    length = F.least(F.lit(FAN), F.col("n") - F.col("run") * FAN)
    own = Window.partitionBy("tree", "run").orderBy("idx")
    left = [F.when(F.col("slot") >= k, F.lag("hash", k).over(own)) for k in range(FAN - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < length, F.lead("hash", k).over(own)) for k in range(1, FAN)]
    return level.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)})


def climb(nodes: DataFrame, most: int) -> list[tuple[DataFrame, DataFrame]]:
    """Levels of all trees of nodes (tree, idx, n, hash, ...) from the leaves up, each plain and with siblings. most: the largest n."""
    levels = [(nodes, with_siblings(nodes))]
    while most > 1:
        first = levels[-1][1].where((F.col("slot") == 0) & (F.col("n") > 1))
        parent = F.sha2(F.concat("hash", "right"), 256).alias("hash")
        level = shared_checkpoint(first.select("tree", F.col("run").alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), parent))
        levels.append((level, with_siblings(level)))
        most = -(-most // FAN)
    return levels


def roots_of(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """tree, hash of the last node of each tree."""
    return reduce(DataFrame.unionByName, [plain.where("n = 1").select("tree", "hash") for plain, _ in levels])


def descend(levels: list[tuple[DataFrame, DataFrame]], ends: DataFrame) -> DataFrame:
    """Leaves of the levels with steps (left, right; from the leaf up) and what `ends` (tree, above, ...) says of their tree.

    above: the steps from the root of the tree on. Each tree's root alone meets its row of ends; nodes meet their parents.
    """
    told = [c for c in ends.columns if c not in ("tree", "above")]
    paths = None
    for plain, sided in reversed(levels):
        kept = [c for c in plain.columns if c != "n"]
        found = plain.where("n = 1").join(ends, "tree").select(*kept, F.col("above").alias("steps"), *told)
        if paths is not None:
            above = paths.select("tree", F.col("idx").alias("run"), F.col("steps").alias("above"), *told)
            steps = F.concat(F.array(F.struct("left", "right")), F.col("above")).alias("steps")
            found = found.unionByName(sided.where("n > 1").join(above, ["tree", "run"]).select(*kept, steps, *told))
        paths = found
    return paths


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, lang, n_chars, text) -> one row per input row with its proof, checked after tampering.

    Columns: doc_id, leaf, subroot (of the source), root, proof_sha256 (digest of all siblings, from the leaf to the root, left
    to right), folded_root (what the leaf, tampered where 5 divides the crc32 of the doc_id, and its siblings give),
    verified (folded_root = root). Leaves of a source ascend by doc_id (null first), rows of one doc_id by leaf; equal
    rows are leaves of their own. Null source: a source of that name, the first. Nulls elsewhere: `-`, told from a text `-`.
    Texts count whole, whatever their length. A source of one row is its leaf. Empty table: empty result. Other columns are ignored.
    """
    types = {"doc_id": "bigint", "n_chars": "bigint"}
    docs = docs.select(*[F.col(f).cast(types.get(f, "string")).alias(f) for f in FIELDS])
    id_, source, lang, chars, text = (F.col(f) for f in FIELDS)
    tamper = F.crc32(id_.cast("string")) % 5 == 0
    nodes = docs.select(
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("tree"),
        id_,
        leaf_hash(id_, source, lang, chars, text).alias("hash"),
        F.when(tamper, leaf_hash(id_, source, lang, chars, F.translate(text, UPPER, LOWER))).alias("tampered"),
    )
    levels = climb(*numbered(nodes, ["doc_id", "hash"]))
    names = roots_of(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    upper = climb(*numbered(names, ["name"]))
    ends = roots_of(upper).select("tree", F.from_json(F.lit("[]"), _STEPS).alias("above"), F.col("hash").alias("root"))
    ends = descend(upper, ends).select(F.col("name").alias("tree"), F.col("steps").alias("above"), F.col("hash").alias("subroot"), "root")
    paths = descend(levels, shared_checkpoint(ends))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s.left, s.right)), ""), 256)
    folded = F.aggregate("steps", F.coalesce("tampered", "hash"), lambda h, s: F.sha2(F.concat(s.left, h, s.right), 256))
    out = paths.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
