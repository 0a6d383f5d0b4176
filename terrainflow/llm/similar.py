"""Near-duplicates by SimHash fingerprints, verified on word shingles, and an exact search for those that fingerprints miss.

Every text has a fingerprint of its shingles. Texts of one fingerprint, and fingerprints that differ in at most two bits
(Golay keys, `simhash.py`), are verified on their whole sets; what holds is linked, and linked texts are not compared again.
At a similarity of 4/5 fingerprints may differ in more bits, so the rest of the links is found by shared shingles:

Two sets x and y with a Jaccard similarity of 4/5 or more have at least 4/5 of x and of y in common. In whatever order
all shingles are put, the first |x| // 5 + k of x and the first |y| // 5 + k of y have k in common at least. Those first
shingles are the keys, with k = 1 + size // 20; rarer ones stand first, as a table of counts by hash tells them, so
common lines are seldom keys. A wrong count changes the order for all documents alike, so it costs time, but loses
nothing. Keys cross one shuffle; what leaves it are the distinct lists of texts that share a key. Every candidate is
verified on the whole sets: each text with its first candidate, then the pairs that are not linked through others.

Where a key has more than BUCKET distinct texts, pairs would grow with the square of their number. A pair has half of
the k keys in other ones, or half of them in such crowded ones, so only texts with that many crowded keys stay in
those. They are compared with one leader a key first, the one with most crowded keys, as copies with fewer edits have
more of them; then with 64, with 4096, and so on. Leaders leave their key, texts of one component are not compared, and
rounds end when every key holds one component only.

Two bounds rule pairs out before any text is fetched. Similar sets have at least 4/9 of |x| + |y| in common, and of a
set at most those shingles that occur in several rows. And each shingle of a set flips one of 1024 bits: what both
sets hold cancels out, so where d bits differ, at least d shingles are in one set only, of which similar sets have at most
a ninth of |x| + |y|. How large the common part is does not matter, so long texts are told apart like short ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainflow.llm.common import join_ids, mix, shared_checkpoint, text_batches, word_ids, word_spans
from terrainflow.llm.graph import components
from terrainflow.llm.repeats import string_ids
from terrainflow.llm.simhash import fingerprint_hashes
from terrainflow.llm.simhash import links as fingerprint_links

SHINGLE = 5
#: Distinct texts of a key up to which its pairs are verified one by one, and up to which they are told as one list.
BUCKET, LISTED = 32, 512
#: By how much the leaders of a key grow from round to round.
GROWTH = 64
#: Bytes of text that are taken apart at once.
SLICE = 1 << 18
#: Cells of the table of counts, and bytes of a block of any table that tasks send.
CELLS, BLOCK = 1 << 22, 1 << 18
#: Count from which the texts of a key are dealt to SALTS tasks and never gathered.
HOT, SALTS = 4096, 64
#: Tasks that the texts of one component are dealt to.
SPREAD = 16
#: Bytes of a table of bits that marks numbers; others that meet a mark cost time only.
MARKS = 1 << 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _word_sets(data: np.ndarray, offsets: np.ndarray):
    """Identifiers of the words, index of the first one of each document, and an identifier of the words of each document."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    ids, n = word_ids(data, starts, ends), np.diff(first)
    place = np.arange(len(ids)) - np.repeat(first[:-1], n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(join_ids(ids, mix(place.astype(np.uint64)))), dtype=np.uint64)])
    return ids, first, mix(join_ids(sums[first[1:]] - sums[first[:-1]], n.astype(np.uint64)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE):
    """(document, shingle) without repeats, ordered, and an identifier of the words of each document. Fewer words: one shingle; no words: none."""
    ids, first, node = _word_sets(data, offsets)
    n = np.diff(first)
    counts = np.maximum(n - shingle + 1, 0)
    doc = np.repeat(np.arange(len(n)), counts)
    at = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    short = np.flatnonzero((n > 0) & (n < shingle))
    hashes = np.concatenate([string_ids(ids, shingle)[0][at] if len(at) else np.empty(0, np.uint64), node[short]])
    doc = np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new], node.view(np.int64)


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes.copy()) >> np.uint64(42)).astype(np.int64)


def _table_blocks(table: np.ndarray):
    """Blocks of a table that hold anything."""
    raw = table.view(np.uint8).reshape(-1, BLOCK)
    for k in np.flatnonzero(raw.any(axis=1)).tolist():
        body = zstandard.ZstdCompressor(level=1).compress(raw[k].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([body], pa.binary())], names=["block", "numbers"])


def _summed_table(parts: DataFrame, size: int, dtype, merge) -> np.ndarray:
    """The tables of all tasks merged by block; `size` numbers reach the driver, whatever the input."""

    def run(table: pa.Table) -> pa.Table:
        total = None
        for payload in table.column("numbers").to_pylist():
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), dtype)
            total = part.copy() if total is None else merge(total, part)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "numbers": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})

    schema = "block int, numbers binary"
    out = np.zeros(size, dtype)
    for r in parts.groupBy("block").applyInArrow(run, schema).collect():  # at most out.nbytes, compressed
        n = BLOCK // out.itemsize
        out[r.block * n : (r.block + 1) * n] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.numbers), dtype)
    return out


def _counts(batches):
    cells = np.zeros(CELLS, np.int32)
    for _, _, _, data, offsets in text_batches(batches, SLICE):
        some, n = np.unique(cell_of(shingle_sets(data, offsets)[1]), return_counts=True)
        cells[some] += n.astype(np.int32)
    yield from _table_blocks(cells)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """In how many rows the shingles of each cell occur, up to a thousand million."""
    add = lambda a, b: np.minimum(a.astype(np.int64) + b, 10**9).astype(np.int32)
    return _summed_table(docs.mapInArrow(_counts, "block int, numbers binary"), CELLS, np.int32, add)


def _place(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(numbers.astype(np.int64).view(np.uint64).copy()) >> np.uint64(37)  # 27 bits
    return (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8)


def _set_marks(batches):
    bits = np.zeros(MARKS, np.uint8)
    for batch in batches:
        byte, bit = _place(np.asarray(batch.column(0)))
        np.bitwise_or.at(bits, byte, bit)
    yield from _table_blocks(bits)


def marks(numbers: DataFrame) -> np.ndarray:
    """A table of bits of the one bigint column of `numbers`, for marked()."""
    return _summed_table(numbers.mapInArrow(_set_marks, "block int, numbers binary"), MARKS, np.uint8, np.bitwise_or)


def marked(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers may have been marked: all that were, and a few others."""
    byte, bit = _place(numbers)
    return (bits[byte] & bit) != 0


def _lists(values: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


class _Once:
    """Which numbers a task meets for the first time, as far as it remembers."""

    def __init__(self, most: int = 100_000):
        self.seen, self.most = set(), most

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        if len(self.seen) > self.most:
            self.seen.clear()
        out = np.zeros(len(numbers), bool)
        for i, x in enumerate(numbers.tolist()):
            if x not in self.seen:
                self.seen.add(x)
                out[i] = True
        return out


def _keys(shared):
    """node, number of shingles, how many of them occur in several rows, keys, hot keys of every text."""

    def run(batches):
        once = _Once()
        for _, _, _, data, offsets in text_batches(batches, SLICE):
            doc, hashes, node = shingle_sets(data, offsets)
            new = once(node)
            count = shared.value[cell_of(hashes)]
            size = np.bincount(doc, minlength=len(node))
            order = np.lexsort((hashes, count, doc))
            doc, hashes, count = doc[order], hashes[order], count[order]
            most = np.bincount(doc[count > 1], minlength=len(node))
            rank = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
            use = (rank < size[doc] // 5 + 1 + size[doc] // 20) & (count > 1) & new[doc]  # what one row has alone meets nothing
            hot = use & (count > HOT)
            use &= ~hot
            rows = np.flatnonzero(new & (size > 0))
            lists = [_lists(hashes[k], doc[k], len(node)).take(pa.array(rows)) for k in (use, hot)]
            yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(size[rows].astype(np.int32)), pa.array(most[rows].astype(np.int32)), *lists], names=["node", "size", "most", "keys", "hot"])

    return run


def _nodes(batches):
    for batch, lo, hi, data, offsets in text_batches(batches, SLICE):
        doc, hashes, node = shingle_sets(data, offsets)
        fp = fingerprint_hashes(mix(hashes.copy()), np.searchsorted(doc, np.arange(len(node) + 1)))
        yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:2], pa.array(node), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "node", "fp"])


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp), each node once -> (a, b): every text with the least one of its fingerprint, and those of linked fingerprints."""
    least = shared_checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    same = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    of = lambda fp, name: least.select(F.col("fp").alias(fp), F.col("least").alias(name))
    near = fingerprint_links(least).select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(of("fa", "x"), "fa").join(of("fb", "y"), "fb")
    return same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


#: The marks of a set, as columns of a node.
SKETCH = [f"s{k}" for k in range(16)]


def set_marks(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each of n sets its marks as numbers of 64 bits: every shingle flips one bit, so shingles of both sets leave no difference."""
    spot = (mix(hashes.copy()) >> np.uint64(8)) & np.uint64(64 * len(SKETCH) - 1)
    out = np.zeros((n, len(SKETCH)), np.uint64)
    np.bitwise_xor.at(out, (doc, (spot >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (spot & np.uint64(63)))
    return out.view(np.int64)


def _may_match(one, other, size, other_size):
    """Whether the marks of two sets allow a Jaccard similarity of 4/5."""
    differ = sum((F.bit_count(F.col(f"{one}{s}").bitwiseXOR(F.col(f"{other}{s}"))) for s in SKETCH), F.lit(0))
    return differ * 9 <= size + other_size


def _bodies(wanted):
    """Compressed texts of the nodes that may be wanted, and the size and marks of their sets."""

    def run(batches):
        once, squeeze = _Once(), zstandard.ZstdCompressor(level=3).compress
        for _, _, _, data, offsets in text_batches(batches, SLICE):
            node = _word_sets(data, offsets)[2].view(np.int64)
            rows = np.flatnonzero(marked(wanted.value, node))
            rows = rows[once(node[rows])]
            texts = [data[offsets[r] : offsets[r + 1]] for r in rows.tolist()]
            if not texts:
                continue
            doc, hashes, _ = shingle_sets(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
            sketch, size = set_marks(doc, hashes, len(texts)), np.bincount(doc, minlength=len(texts)).astype(np.int32)
            body = pa.array([squeeze(t.tobytes()) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(node[rows]), body, pa.array(size), *(pa.array(sketch[:, k].copy()) for k in range(len(SKETCH)))], names=["node", "body", "held", *SKETCH])

    return run


def _verify(batches):
    """Pairs (a, b) whose bodies have a Jaccard similarity of 4/5 or more."""
    widen = zstandard.ZstdDecompressor().decompress

    def checked(pairs, texts):
        data = np.frombuffer(b"".join(texts), np.uint8)
        doc, hashes, _ = shingle_sets(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        size = np.bincount(doc, minlength=len(texts)).reshape(-1, 2).sum(axis=1)
        pair = doc // 2
        order = np.lexsort((hashes, pair))
        pair, hashes = pair[order], hashes[order]
        again = (pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1])
        common = np.bincount(pair[1:][again], minlength=len(pairs))
        good = [p for p, ok in zip(pairs, (9 * common >= 4 * size).tolist(), strict=True) if ok]
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


def _similar(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets have a Jaccard similarity of 4/5 or more.

    They are stored: what works on them in Python too would have a second worker in each task.
    """
    one = lambda name: bodies.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("body", "held", *SKETCH)))
    both = pairs.join(one("a"), "a").join(one("b"), "b").where(_may_match("a_", "b_", F.col("a_held"), F.col("b_held")))
    both = both.select("a", "b", "a_body", "b_body")
    return shared_checkpoint(both.mapInArrow(_verify, "a bigint, b bigint"))


def _fits(size, most, other_size, other_most):
    """Whether two sets, of which `most` can be in another one, may have enough in common."""
    return 9 * F.least(most, other_most) >= 4 * (size + other_size)


def _candidates(docs: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, live): candidates (a, b) from keys of a few texts, and (key, node, size, most, held_keys) of crowded keys."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs.select("text")))
    each = docs.select("text").mapInArrow(_keys(counts), "node bigint, size int, most int, keys array<bigint>, hot array<bigint>")
    plain = F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(0).alias("salt")))
    dealt = F.transform("hot", lambda k: F.struct(k.alias("key"), (F.pmod("node", F.lit(SALTS)) + 1).cast("int").alias("salt")))
    rows = each.select("node", "size", "most", F.explode(F.concat(plain, dealt)).alias("k")).select("k.key", "k.salt", "node", "size", "most").repartition("key", "salt")
    sizes = rows.groupBy("key", "salt").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("size").alias("largest"))
    sizes = sizes.where(((F.col("lo") < F.col("hi")) & (F.col("largest") > 0)) | (F.col("salt") > 0)).select("key", "salt", "n")
    # Members of a key with more than a list holds stay rows of their own.
    alone = F.when((F.col("salt") > 0) | (F.col("n") > LISTED), F.col("node"))
    groups = rows.join(sizes, ["key", "salt"]).groupBy("key", "salt", alone.alias("alone")).agg(F.sort_array(F.collect_set(F.struct("node", "size", "most"))).alias("members"))
    groups = groups.groupBy(F.when(F.col("alone").isNotNull(), F.col("key")).alias("key"), "members").agg(F.count("*").alias("keys"))
    groups = shared_checkpoint(groups)
    few = (F.size("members") <= bucket) & F.col("key").isNull()
    live = groups.where(~few).select(F.coalesce("key", F.xxhash64("members")).alias("key"), "keys", F.explode("members").alias("m")).select("key", "keys", "m.node", "m.size", "m.most")
    two = groups.where(few).select("members", "keys", F.explode("members").alias("a"))
    two = two.select("a", "keys", F.explode(F.filter("members", lambda m: (m.node > F.col("a.node")) & _fits(m["size"], m["most"], F.col("a.size"), F.col("a.most")))).alias("b"))
    shared = two.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.sum("keys").alias("shared"), F.min(F.least("a.size", "b.size")).alias("least"))
    # A pair with fewer keys in common than half of k has the other half in crowded keys, or is not similar.
    pairs = shared_checkpoint(shared.where("2 * shared > least div 20").select("a", "b"))
    # Its smaller text has at least 4/5 of the shingles of the other, which bounds k from below for either.
    enough = live.groupBy("node").agg(F.sum("keys").alias("n"), F.min("size").alias("size")).where("2 * n > size div 25").select("node", F.col("n").alias("held_keys"))
    live = live.select("key", "node", "size", "most").join(enough, "node")
    live = shared_checkpoint(live.join(live.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi"))
    counts.destroy()
    return pairs, live


def similar_components(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_hash (xxhash64 of the text), node, root, one row per input row.

    Texts with the same words have one node. Rows of one root can be reached from one another over texts whose sets of
    five-word shingles (A-Z lower-cased) have a Jaccard similarity of 0.8 or more. Null or empty texts: one root of their own.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    named = shared_checkpoint(docs.mapInArrow(_nodes, "doc_id bigint, text_hash bigint, node bigint, fp bigint"))
    # Texts without words have one node, so nothing is lost where its fingerprint, zero, meets no other one.
    near = shared_checkpoint(fingerprint_pairs(named.select("node", "fp").distinct()))
    pairs, live = _candidates(docs, bucket)
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = shared_checkpoint(ends(near).unionByName(ends(pairs)).unionByName(live.select("node")).distinct())
    sent = spark.sparkContext.broadcast(marks(wanted))
    bodies = docs.select("text").mapInArrow(_bodies(sent), "node bigint, body binary, held int, " + ", ".join(f"{s} bigint" for s in SKETCH))
    bodies = shared_checkpoint(bodies.join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    sent.destroy()
    roots = components(_similar(near, bodies))

    def apart(some: DataFrame) -> DataFrame:
        of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        joined = some.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return joined.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")

    # Of the other candidates each text's first one, then those whose texts are still in two components.
    pairs = shared_checkpoint(apart(pairs))
    for some in (pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), pairs):
        rest = shared_checkpoint(apart(some))
        if not rest.isEmpty():  # a component's edges to its root say as much as those that made it
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_similar(rest, bodies)))
    leaders, placed = 1, live.join(bodies.select("node", *SKETCH), "node")
    while True:
        placed = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        per = placed.groupBy("key", "root").agg(F.count("*").alias("of_root"))
        open_keys = per.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        placed = shared_checkpoint(placed.join(open_keys, "key", "left_semi").join(per, ["key", "root"]))
        if placed.isEmpty():
            break
        # After the first ones, leaders come from the smallest components: when those are through, one component is left.
        rank = (F.lit(0) if leaders == 1 else F.col("of_root")).alias("rank")
        order = F.struct(rank, (-F.col("held_keys")).alias("fewer"), F.xxhash64("node", F.lit(leaders)).alias("h"), "node", "size", "most", "root", *SKETCH)
        chosen = placed.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(leaders)).alias("part")).agg(F.min(order).alias("l"))
        chosen = shared_checkpoint(chosen.select("key", *(F.col(f"l.{c}").alias(f"other_{c}") for c in ("node", "size", "most", "root", *SKETCH))))
        like = _fits(*(F.col(c) for c in ("size", "most", "other_size", "other_most"))) & _may_match("", "other_", F.col("size"), F.col("other_size"))
        met = placed.join(chosen, "key").where((F.col("root") != F.col("other_root")) & like)
        met = met.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()
        found = _similar(met, bodies)
        placed = placed.select("key", "node", "size", "most", "held_keys", *SKETCH).join(chosen.select("key", F.col("other_node").alias("node")), ["key", "node"], "left_anti")
        leaders *= GROWTH
        if not found.isEmpty():  # a component's edges to its root say as much as those that made it
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
    return named.join(roots, "node", "left").select("doc_id", "text_hash", "node", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs (all columns kept, no null doc_id) without near-duplicates: of each component the row with the smallest doc_id.

    Rows with the same doc_id and text count once; rows that share a doc_id only are documents of their own. Only texts
    that may belong to a component of several rows are shuffled.
    """
    text_hash = F.xxhash64(F.col("text").cast("string"))
    groups = shared_checkpoint(similar_components(docs, bucket))
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("f"), F.count("*").alias("n")).where("n > 1")
    # Copies count once, and a component of many texts is dealt to SPREAD tasks.
    texts = groups.select("root", "text_hash").distinct().withColumn("part", F.pmod("text_hash", F.lit(SPREAD)).cast("int"))
    dealt = first.select("root", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    several = texts.join(dealt, ["root", "part"], "left_semi").select("text_hash")
    sent = docs.sparkSession.sparkContext.broadcast(marks(several))
    may_go = F.arrow_udf(lambda h: pa.array(marked(sent.value, np.asarray(h))), "boolean")
    told = docs.withColumn("text_hash", text_hash).withColumn("may_go", may_go("text_hash"))
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("f")).select("f.doc_id", "f.text_hash")
    chosen = told.where("may_go").join(first, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return told.where("not may_go").unionByName(chosen).select(*docs.columns)
