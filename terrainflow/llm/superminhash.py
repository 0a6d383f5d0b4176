"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets and union-find grouping.

Every shingle of a set puts a permutation of the ranks 0, 1, 2, ... on the components of the signature, each rank with a
fraction of its own, and a component keeps the least value. The ranks of one shingle are correlated, as no two components
get the same one, which lowers the variance; and once all components of a set hold values below the next rank, no later one
can count, so a set of many shingles is through after a few ranks.

BANDS bands of ROWS components are the keys: two sets with 85 % in common miss each other in all of them in 7 of 10^9
cases, others less often. Of a key all members are compared with one leader first, the one that shares most keys; then, of
keys whose members are not yet in one component, small ones pair by pair and large ones with 64 leaders, 4096, and so on,
between components only. Marks of the sets rule out what can't be similar (a proven bound), full sets decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainflow.llm.common import join_ids, mix, shared_checkpoint, text_batches
from terrainflow.llm.graph import components
from terrainflow.llm.similar import SKETCH, _Once, marked, marks, set_marks, shingle_sets

SHINGLE = 3
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
#: Members of a key up to which its pairs are verified one by one, and by how much the leaders of others grow each round.
BUCKET, GROWTH = 32, 64
#: Bytes of text that are taken apart at once.
SLICE = 1 << 19
_STEP = 0x9E3779B97F4A7C15
_HALF = np.uint64(32)


def signatures(doc: np.ndarray, hashes: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """SuperMinHash signatures of n sets given as (doc, hash) without repeats. Values: rank and fraction, 32 bits each.

    All shingles take their ranks in step; those of a set stop when its largest value is below the next rank.
    """
    out = np.full((n, size), np.uint64(2**64 - 1))
    place = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(hashes), 1))
    act = np.arange(len(hashes))
    for rank in range(size):
        if not len(act):
            break
        x = mix(hashes[act] + np.uint64((rank + 1) * _STEP % 2**64))
        pick = rank + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(size - rank) >> _HALF).astype(np.int64)
        slot = place[act, pick]
        place[act, pick] = place[act, rank]
        np.minimum.at(out, (doc[act], slot.astype(np.int64)), np.uint64(rank << 32) | (x >> _HALF))
        more = out.max(axis=1) >= np.uint64((rank + 1) << 32)
        act = act[more[doc[act]]]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each set and band."""
    keys = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), np.uint64(b + 1))
        for r in range(rows):
            key = join_ids(key, mix(signature[:, b * rows + r].copy()))
        keys[:, b] = mix(key)
    return keys


def _sets(batches):
    """doc_id, number of shingles, node and, where the task meets the text for the first time, the keys of its bands."""
    once = _Once()
    for batch, lo, hi, data, offsets in text_batches(batches, SLICE):
        doc, hashes, node = shingle_sets(data, offsets, SHINGLE)
        size = np.bincount(doc, minlength=len(node))
        new = once(node) & (size > 0)
        at = np.cumsum(new) - 1
        use = new[doc]
        keys = band_keys(signatures(at[doc[use]], hashes[use], int(new.sum()))).view(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.where(new, BANDS, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(node), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], names=["doc_id", "n_shingles", "node", "keys"])


def _bodies(wanted):
    """Compressed text, size and marks of the set of each node that may be wanted."""

    def run(batches):
        once, squeeze = _Once(), zstandard.ZstdCompressor(level=3).compress
        for _, _, _, data, offsets in text_batches(batches, SLICE):
            doc, hashes, node = shingle_sets(data, offsets, SHINGLE)
            rows = np.flatnonzero(marked(wanted.value, node))
            rows = rows[once(node[rows])]
            if not len(rows):
                continue
            sketch = set_marks(doc, hashes, len(node))[rows]
            size = np.bincount(doc, minlength=len(node))[rows].astype(np.int32)
            body = pa.array([squeeze(data[offsets[r] : offsets[r + 1]].tobytes()) for r in rows.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(node[rows]), body, pa.array(size), *(pa.array(sketch[:, k].copy()) for k in range(len(SKETCH)))], names=["node", "body", "held", *SKETCH])

    return run


def _verify(batches):
    """Of (a, b, body, body) the pairs whose full sets are similar enough."""
    widen = zstandard.ZstdDecompressor().decompress

    def checked(pairs, texts):
        data = np.frombuffer(b"".join(texts), np.uint8)
        doc, hashes, _ = shingle_sets(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), SHINGLE)
        both = np.bincount(doc, minlength=len(texts)).reshape(-1, 2).sum(axis=1)
        pair = doc // 2
        order = np.lexsort((hashes, pair))
        pair, hashes = pair[order], hashes[order]
        again = (pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1])
        common = np.bincount(pair[1:][again], minlength=len(pairs))
        good = [p for p, ok in zip(pairs, (100 * common >= PERCENT * (both - common)).tolist(), strict=True) if ok]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in good], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        pairs, texts, held = [], [], 0
        for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            pairs.append((a, b))
            texts += [widen(x), widen(y)]
            held += len(texts[-1]) + len(texts[-2])
            if held > SLICE:
                yield checked(pairs, texts)
                pairs, texts, held = [], [], 0
        if pairs:
            yield checked(pairs, texts)


def _may_match(one: str, other: str):
    """Whether sizes and marks allow a link: sets with J >= P / 100 differ in at most (100 - P) / (100 + P) of both sizes."""
    x, y = F.col(f"{one}held"), F.col(f"{other}held")
    differ = sum((F.bit_count(F.col(f"{one}{s}").bitwiseXOR(F.col(f"{other}{s}"))) for s in SKETCH), F.lit(0))
    return (100 * F.least(x, y) >= PERCENT * F.greatest(x, y)) & (differ * (100 + PERCENT) <= (100 - PERCENT) * (x + y))


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that are linked."""
    text = lambda name: bodies.select(F.col("node").alias(name), F.col("body").alias(f"{name}_body"))
    return pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "a_body", "b_body").mapInArrow(_verify, "a bigint, b bigint")


def _links(nodes: DataFrame, texts: DataFrame, bucket: int) -> DataFrame:
    """nodes (node, keys), texts (text) -> (node, root) of all nodes with a link to another one."""
    spark = nodes.sparkSession
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = shared_checkpoint(keyed.join(sizes, "key"))
    wide = members.groupBy("node").agg(F.sum("n").alias("met"))
    members = shared_checkpoint(members.join(wide, "node"))
    sent = spark.sparkContext.broadcast(marks(wide.select("node")))
    schema = "node bigint, body binary, held int, " + ", ".join(f"{s} bigint" for s in SKETCH)
    bodies = texts.mapInArrow(_bodies(sent), schema)
    bodies = shared_checkpoint(bodies.join(wide.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    sent.destroy()

    sketches = bodies.select("node", "held", *SKETCH)
    of = lambda name: [F.col(c).alias(f"{name}_{c}") for c in ("held", *SKETCH)]
    first = members.groupBy("key").agg(F.max(F.struct("met", "node")).alias("l")).select("key", F.col("l.node").alias("leader"))
    met = members.join(first, "key").where("node <> leader").select("leader", "node").distinct()
    # Few nodes lead many keys, so this order joins a leader's marks to its pairs and the pairs to the others' marks.
    met = met.join(sketches.select(F.col("node").alias("leader"), *of("b")), "leader").join(sketches.select("node", *of("a")), "node").where(_may_match("a_", "b_"))
    edges = shared_checkpoint(_verified(met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), bodies))
    roots = components(edges)
    leaders, placed = 1, members.select("key", "n", "node")
    while True:
        # Only members of keys with several components stay, and only they carry their marks.
        placed = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        per = placed.groupBy("key", "root").agg(F.count("*").alias("of_root"))
        several = per.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        placed = placed.join(several, "key", "left_semi").join(per, ["key", "root"])
        placed = shared_checkpoint(placed if leaders > 1 else placed.join(sketches, "node"))
        if placed.isEmpty():
            return roots
        if leaders == 1:  # small keys are done with this
            chosen = placed.where(F.col("n") <= bucket).select("key", F.col("node").alias("b"), F.col("root").alias("b_root"), *of("b"))
            other = placed.where(F.col("n") <= bucket)
            once = F.col("node") < F.col("b")
            placed = placed.where(F.col("n") > bucket)
        else:
            # Leaders come from the smallest components: when those are through, one component is left.
            order = F.struct("of_root", F.xxhash64("node", F.lit(leaders)).alias("h"), "node", "root", "held", *SKETCH)
            chosen = placed.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(leaders)).alias("part")).agg(F.min(order).alias("l"))
            chosen = shared_checkpoint(chosen.select("key", F.col("l.node").alias("b"), F.col("l.root").alias("b_root"), *(F.col(f"l.{c}").alias(f"b_{c}") for c in ("held", *SKETCH))))
            other, once = placed, F.lit(True)
            placed = placed.join(chosen.select("key", F.col("b").alias("node")), ["key", "node"], "left_anti")
        other = other.select("key", "node", "root", *of("a"))
        found = other.join(chosen, "key").where(once & (F.col("root") != F.col("b_root")) & _may_match("a_", "b_"))
        found = shared_checkpoint(_verified(found.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), bodies))
        placed = placed.drop("of_root", "root")
        leaders *= GROWTH
        if not found.isEmpty():  # a component's edges to its root say as much as those that made it
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept, one row per input row.

    A-Z is lower-cased. n_shingles: distinct shingles of three words; a text of fewer words is one shingle. Rows of sets with
    PERCENT or more in common are linked; component_id is the smallest doc_id that can be reached; kept: doc_id is that one.
    Null texts and texts without words: no shingle, no link, a component of their own. Repeated rows: linked, all kept where
    one is, as they share their id. Null doc_id: takes part, names no component (null if it has no other row), never kept.
    Texts of any length count whole. Empty table: empty result. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = shared_checkpoint(docs.mapInArrow(_sets, "doc_id bigint, n_shingles bigint, node bigint, keys array<bigint>"))
    some = told.where("n_shingles > 0")
    least = some.groupBy("node").agg(F.min("doc_id").alias("least_doc"))
    keyed = told.where(F.size("keys") > 0).select("node", "keys").dropDuplicates(["node"])
    roots = _links(keyed, docs.select("text"), bucket)
    rooted = shared_checkpoint(least.join(roots, "node", "left").select("node", "least_doc", F.coalesce("root", "node").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_doc").alias("component_id")), "root").select("node", "component_id")
    out = some.join(shared_checkpoint(named), "node").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(told.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
