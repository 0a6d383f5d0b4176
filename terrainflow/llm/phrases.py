"""Phrase collocations by mergeable Misra-Gries summaries.

First pass: tasks count the n-grams of their texts by a 64-bit hash and send the counts, by ranges of the hash, as packed
blocks. The blocks of a range are merged into one Misra-Gries summary. With more counters than the range's mass divided
by the threshold, what merging takes from any counter stays below the threshold, so every frequent n-gram survives. The
survivors are counted again over the same blocks. A range is as large as TEXT bytes of text make it, at any size of the
corpus, and a common n-gram is one entry of a block however often it occurs.

Second pass: the texts are read again, and the n-grams whose hash was frequent are counted exactly by their words. A table
of bits, sized by the number of frequent hashes, tells which; other n-grams that meet a bit cost rows, and the counts by
words decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrainflow.llm.common import join_ids, mix, shared_checkpoint, utf8, word_ids

LEAST = 30
LONGEST = 4
TOP = 2000
#: Bytes of text for each range of hashes.
TEXT = 4 << 20
#: Hashes that a task gathers before it sends them.
FLUSH = 1_000_000
#: Bytes of text that are taken apart at once.
SLICE = 1 << 19
#: Bits for each frequent hash, and the most bits of the table (256 MB), from which on more rows are counted.
BITS, MOST_BITS = 16, 1 << 31
#: Parts of a language that are ranked on their own before the language is.
SALTS = 64

_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _parts(batches):
    """(languages, language of each part, lower-case bytes, offsets) of about SLICE bytes; longer texts are cut where a piece ends."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, code = langs.dictionary.to_pylist(), np.asarray(langs.indices)
        data, offsets = utf8(batch.column(1))
        cuts = [offsets]
        for r in np.flatnonzero(np.diff(offsets) > SLICE).tolist():
            ends = offsets[r] + 1 + np.flatnonzero(_CLASS[data[offsets[r] : offsets[r + 1]]] == 2)
            ends = ends[ends < offsets[r + 1]]
            if len(ends):
                cuts.append(ends[np.flatnonzero(np.diff(ends // SLICE, prepend=0))])
        edges = np.sort(np.concatenate(cuts)) if len(cuts) > 1 else offsets
        code = code[np.searchsorted(offsets, edges[:-1], "right") - 1] if len(cuts) > 1 else code
        lo, n = 0, len(edges) - 1
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(edges, edges[lo] + SLICE, "right")) - 1))
            yield names, code[lo:hi], _LOWER[data[edges[lo] : edges[hi]]], edges[lo : hi + 1] - edges[lo]
            lo = hi


def _words(data: np.ndarray, offsets: np.ndarray):
    """Byte starts and ends of all words, and for each the number of its piece and of its text."""
    kind = _CLASS[data]
    inside = kind == 0
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, np.cumsum(kind == 2)[starts] + text, text


def _hashes(words: np.ndarray, piece: np.ndarray, seed: np.ndarray):
    """For n from 1 on: hashes of the n-grams (and of their language) and the index of their first words."""
    chain, at = join_ids(seed, words), np.arange(len(words))
    for n in range(1, LONGEST + 1):
        yield mix(chain.copy()), at
        at = at[at < len(words) - n]
        at = at[piece[at + n] == piece[at]]
        chain = join_ids(chain[: len(words)][at] if n == 1 else chain[np.searchsorted(last, at)], words[at + n])
        last = at


def _seeds(names) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(name or "") for name in names] or [0], np.uint64)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys and their counts."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(steps + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    n = len(raw) // 12
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    return keys, np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)


def _blocks(ranges: int):
    def send(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        rows = [(int(part[a]), int(counts[a:b].sum()), _pack(keys[a:b], counts[a:b])) for a, b in zip(edges, [*edges[1:], len(keys)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "mass", "payload"])

    def run(batches):
        held, n = [], 0
        for names, code, data, offsets in _parts(batches):
            starts, ends, piece, text = _words(data, offsets)
            if not len(starts):
                continue
            for keys, _ in _hashes(word_ids(data, starts, ends), piece, _seeds(names)[code[text]]):
                held.append(keys)
                n += len(keys)
            if n > FLUSH:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    return run


class Summary:
    """A Misra-Gries summary of `capacity` counters. What was taken from any counter is `removed` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.removed = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            take = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            keys, counts = keys[counts > take], counts[counts > take] - take
            self.removed += take
        self.keys, self.counts = keys, counts


def frequent_keys(payloads: list[bytes], mass: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur `least` times or more in the blocks, and how often. mass: the sum of all counts."""
    summary, held, n = Summary(mass // least + 1), [], 0
    for payload in payloads:
        held.append(_unpack(payload))
        n += len(held[-1][0])
        if n > 4 * summary.capacity:
            summary.merge(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, n = [], 0
    if held:
        summary.merge(*(np.concatenate(c) for c in zip(*held, strict=True)))
    found = summary.keys[summary.counts + summary.removed >= least]
    total = np.zeros(len(found), np.int64)
    for payload in payloads if len(found) else ():
        keys, counts = _unpack(payload)
        at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
        hit = found[at] == keys
        total[at[hit]] += counts[hit]  # keys of a block are distinct
    return found[total >= least], total[total >= least]


def _frequent(least: int):
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        keys, n = frequent_keys(table.column("payload").to_pylist(), int(np.asarray(table.column("mass")).sum()), least)
        return pa.table([pa.array(keys.view(np.int64)), pa.array(n)], schema=schema)

    return run


def _set_bits(log: int):
    """The bytes of the table that the task's keys set, as (byte, value)."""

    def run(batches):
        bits = np.zeros(1 << (log - 3), np.uint8)
        for batch in batches:
            spot = np.asarray(batch.column(0)).view(np.uint64) >> np.uint64(64 - log)
            np.bitwise_or.at(bits, (spot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8))
        for k, block in enumerate(np.array_split(bits, max(1, len(bits) >> 18))):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(block.tobytes())], pa.binary())], names=["block", "bits"])

    return run


def _bit_table(keys: DataFrame) -> np.ndarray:
    """A table of bits of fixed size for the keys; 256 MB reach the driver at most."""
    n = keys.count()
    log = int(np.clip(np.ceil(np.log2(max(1, n * BITS))), 20, np.log2(MOST_BITS)))
    bits = np.zeros(1 << (log - 3), np.uint8)
    blocks = np.array_split(bits, max(1, len(bits) >> 18))  # views
    for r in keys.mapInArrow(_set_bits(log), "block int, bits binary").toLocalIterator():
        blocks[r.block] |= np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.bits)), np.uint8)
    return bits


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The n words from each index on, joined by one space."""
    lo, hi = starts[at], ends[at + n - 1]
    words = sum((ends[at + k] - starts[at + k] for k in range(n)), np.zeros(len(at), np.int64))
    sizes = hi - lo
    plain = sizes == words + n - 1
    for k in range(n - 1):
        plain &= data[ends[at + k]] == 0x20
    ends_at = np.cumsum(np.where(plain, sizes, 0))
    total = int(ends_at[-1]) if len(at) else 0
    use = np.flatnonzero(plain)
    begin = np.where(plain, ends_at - sizes, ends_at)
    body = data[np.repeat(lo[use] - begin[use], sizes[use]) + np.arange(total)]
    out = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends_at]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
    if not plain.all():
        odd = np.flatnonzero(~plain)
        raw = data.tobytes()
        joined = [b" ".join(raw[starts[i + k] : ends[i + k]] for k in range(n)) for i in at[odd].tolist()]
        out = pa.concat_arrays([out, pa.array(joined, pa.large_binary())]).take(pa.array(np.where(plain, np.arange(len(at)), len(at) + np.cumsum(~plain) - 1)))
    return out.cast(pa.binary()).cast(pa.string())


def _count(shared):
    """(lang, phrase, words, n) of the n-grams that meet a bit, for each slice of text; and (lang, null, 0, words)."""
    names_of = ["lang", "phrase", "words", "n"]

    def run(batches):
        bits = shared.value
        log = int(np.log2(len(bits))) + 3
        for names, code, data, offsets in _parts(batches):
            starts, ends, piece, text = _words(data, offsets)
            if not len(starts):
                continue
            lang = code[text].astype(np.int64)
            some, each = np.unique(lang, return_counts=True)
            none = pa.nulls(len(some), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in some], pa.string()), none, pa.array(np.zeros(len(some), np.int32)), pa.array(each)], names=names_of)
            # Words are told by their bytes, n-grams by the numbers of their words: no hash decides what is counted.
            buffer = pa.py_buffer(np.ascontiguousarray(data))
            both = np.stack([starts, ends], axis=1).ravel()
            gaps = pa.Array.from_buffers(pa.large_binary(), len(both) - 1, [None, pa.py_buffer(both.astype(np.int64)), buffer])
            word = np.asarray(gaps.take(pa.array(np.arange(0, len(both) - 1, 2))).dictionary_encode().indices).astype(np.int64)
            size = int(word.max()) + 1
            for n, (keys, at) in enumerate(_hashes(word_ids(data, starts, ends), piece, _seeds(names)[lang]), 1):
                spot = keys >> np.uint64(64 - log)
                at = at[(bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                if not len(at):
                    continue
                number = lang[at] * size + word[at]
                for k in range(1, n):
                    number = np.unique(number, return_inverse=True)[1] * size + word[at + k]
                _, first, counts = np.unique(number, return_index=True, return_counts=True)
                first = at[first]
                told = pa.array(names, pa.string()).take(pa.array(lang[first]))
                yield pa.RecordBatch.from_arrays([told, _strings(data, starts, ends, first, n), pa.array(np.full(len(first), n, np.int32)), pa.array(counts)], names=names_of)

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(phrases (lang, phrase, words, f) of 1 to LONGEST words with f >= least, totals (lang, n)) of docs (lang, text), counted exactly."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = docs.mapInArrow(_blocks(1 + size // TEXT), "part int, mass bigint, payload binary")
    keys = shared_checkpoint(blocks.groupBy("part").applyInArrow(_frequent(least), "gram bigint, n bigint")).select("gram")
    sent = docs.sparkSession.sparkContext.broadcast(_bit_table(keys))
    counted = docs.mapInArrow(_count(sent), "lang string, phrase string, words int, n bigint")
    counted = shared_checkpoint(counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull()))
    sent.destroy()
    return counted.where("phrase is not null"), counted.where("phrase is null").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """docs (lang, text) -> the first `top` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z is lower-cased; texts are cut into pieces at .,;:!? and line ends, pieces into words at spaces and tabs. Candidates
    are phrases of 2 to LONGEST words that occur `least` times (a). Each is scored by its weakest cut into two parts, which
    occur l and r times: floor(2000000 a / (l + r)); ties to the first cut. Phrases of which a longer candidate holds 80 % or
    more are dropped. n: words of the language. Ranked by score and a falling, then by the phrase's bytes. Null lang: `und`.
    Null or empty texts: none. Repeated rows count each. Texts of any length count whole. Empty table: empty result. Other
    columns are ignored.
    """
    grams, totals = frequent_phrases(docs, least)
    part = lambda name, f: grams.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    span = lambda start, n: F.array_join(F.slice("ws", start, n), " ")
    candidates = grams.where("words >= 2").withColumn("ws", F.split("phrase", " ")).withColumnRenamed("f", "a")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", span(F.lit(1), F.col("cut")).alias("head"), span(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("tail"))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))").cast("bigint")
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w"))
    # Every run of 2 or more words of a longer candidate.
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: span(i, F.lit(k)))
    spans = F.concat(*[F.when(F.col("words") > k, runs(k)).otherwise(F.array().cast("array<string>")) for k in range(2, LONGEST)])
    inside = candidates.where("words > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    held = F.coalesce(wide("longer") * 100 >= wide("a") * 80, F.lit(False))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(~held).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_k") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
