"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. A segment of 23 bits is decoded with the perfect
binary Golay code: every vector within one flipped bit of it names a codeword, one to six in all, and two segments
that differ in at most two bits share a codeword. Two fingerprints that differ in at most two bits therefore share

- the first segment and a codeword of the second (no error in the first), or
- the second segment and a codeword of the first (no error in the second), or
- the third segment and a codeword of the first (one error in each of the first two).

Those keys are joined and the pairs verified. Where a key holds more than BUCKET distinct fingerprints, pairs would
grow with the square of their number; such fingerprints are linked exactly through their neighbours instead: two
fingerprints differ in at most two bits if and only if some value is within one bit of both, at most 65
fingerprints share such a value, and each is linked to the smallest of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainflow.llm.common import shared_checkpoint, text_batches
from terrainflow.llm.graph import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: Distinct fingerprints of a key up to which its pairs are verified one by one.
BUCKET = 32

_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Majority of each bit over the hashes of every document. first: index of its first hash, one more entry than documents."""
    out = np.zeros(len(first) - 1, np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, first[:-1][some], axis=0, dtype=np.int64)
        major = 2 * counts > np.diff(first)[some][:, None]
        out[some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # bytes: A-Z only, and the six separators only
    if len(words) <= shingle:
        return [digest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1])
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def _fingerprints(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch, lo, hi, data, offsets in text_batches(batches):
            body, hashes, first = data.tobytes(), [], [0]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                hashes += shingle_hashes(body[a:b], shingle)
                first.append(len(hashes))
            fp = fingerprint_hashes(np.array(hashes, np.uint64), np.array(first))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], schema=schema)

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed 64-bit number, zero without words."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_fingerprints(shingle), "doc_id bigint, fp bigint")


def _remainders() -> np.ndarray:
    """x^i modulo the generator, for i from 0 to 22."""
    out, x = [], 1
    for _ in range(23):
        out.append(x)
        x <<= 1
        if x >> 11:
            x ^= _GENERATOR
    return np.array(out)


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all vectors by 12 low and 11 high bits, and the error of at most three bits for each syndrome."""
    power = _remainders()
    xor = lambda width, base: np.bitwise_xor.reduce(np.where((np.arange(1 << width)[:, None] >> np.arange(width)) & 1, power[base : base + width], 0), axis=1)
    errors = np.zeros(2048, np.int64)
    for n in range(1, 4):
        for places in combinations(range(23), n):
            errors[int(np.bitwise_xor.reduce(power[list(places)]))] = sum(1 << p for p in places)
    return np.concatenate([xor(12, 0), xor(11, 12)]), errors


def decode(vectors: np.ndarray, tables) -> np.ndarray:
    """Index (12 bits) of the one codeword within three bits of each vector of 23 bits."""
    syndromes, errors = tables
    syndrome = syndromes[vectors & 4095] ^ syndromes[4096 + (vectors >> 12)]
    return (vectors ^ errors[syndrome]) >> 11


def near_codewords(vectors: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index): the distinct codewords that the vectors within one bit of each are decoded to."""
    flips = np.concatenate([[0], 1 << np.arange(23)])
    found = np.sort(decode(vectors[:, None] ^ flips, tables), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


def fuzzy_keys(fp: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints."""
    value = fp.view(np.uint64)
    a, b, c = ((value >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((0, 0x7FFFFF), (23, 0x7FFFFF), (46, 0x3FFFF)))
    row_a, word_a = near_codewords(a, tables)
    row_b, word_b = near_codewords(b, tables)
    keys = [(1 << 60) | (a[row_b] << 12) | word_b, (2 << 60) | (b[row_a] << 12) | word_a, (3 << 60) | (c[row_a] << 12) | word_a]
    return np.concatenate([row_b, row_a, row_a]), np.concatenate(keys)


def _keys(batches):
    tables = golay_tables()
    for batch in batches:
        fp = np.asarray(batch.column(0))
        for lo in range(0, len(fp), 20_000):
            row, key = fuzzy_keys(fp[lo : lo + 20_000], tables)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[lo : lo + 20_000][row])], names=["key", "fp"])


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): enough pairs of distinct fingerprints within DISTANCE bits to keep every chain of them together."""
    keys = shared_checkpoint(nodes.select("fp").mapInArrow(_keys, "key bigint, fp bigint"))
    sizes = shared_checkpoint(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    small = keys.join(sizes.where(F.col("n") <= bucket).select("key"), "key")
    pairs = (
        small.join(small.withColumnRenamed("fp", "other"), "key")
        .where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE))
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    crowded = keys.join(sizes.where(F.col("n") > bucket).select("key"), "key", "left_semi").select("fp").distinct()
    masks = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    near = crowded.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("near"))
    lowest = near.groupBy("near").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(lowest, "near").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp, component_id, one row per input row.

    A-Z is lower-cased; shingles are `shingle` words with repeats; a text with fewer words is one shingle; null or
    empty texts have fingerprint zero and are linked like any other. component_id: the smallest doc_id that can be
    reached over links of at most two bits. Null doc_id: the row takes part, but its id is never a component's unless
    the component has no other (then null). Repeated rows: the same component. Empty table: empty result.
    """
    marked = shared_checkpoint(fingerprints(docs, shingle))
    nodes = shared_checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("least_doc")))
    roots = components(links(nodes, bucket)).select(F.col("node").alias("fp"), "root")
    rooted = shared_checkpoint(nodes.join(roots, "fp", "left").select("fp", "least_doc", F.coalesce("root", "fp").alias("root")))
    named = shared_checkpoint(rooted.join(rooted.groupBy("root").agg(F.min("least_doc").alias("component_id")), "root").select("fp", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
