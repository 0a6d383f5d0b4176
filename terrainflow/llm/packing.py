"""Packing of token sequences by cutting-stock column generation.

Documents are tokenized and cut where a full sequence ends; the remainders (shorter than a sequence) are the items
of a cutting-stock problem. Its input is the histogram of their lengths, at most CAPACITY - 1 numbers however many
documents there are, so the linear program is solved on the driver: patterns (how many pieces of each length fill
one sequence) enter as columns while a knapsack over the dual prices finds one that pays. Patterns are rounded
down to whole numbers, what is left (less than one sequence a pattern) is filled by decreasing length. The plan
goes to the tasks, and documents, ranked within their length, take its places.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrainflow.llm.common import shared_checkpoint, shuffle_partitions

CAPACITY = 1024
END = 0
#: Column generation stops when the bound shows that less than this share of the sequences can be saved, or after ROUNDS columns.
GAP = 0.0005
ROUNDS = 1500


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def ranks_encoder(path: str):
    """A function from ordinary text to ids by a file of ranks: the same vocabulary in a form that is encoded faster."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def tokenizer_ids(path: str, ranks: str | None = None):
    """A function from a text to its ids as little-endian 32-bit numbers.

    ranks: a file with the same vocabulary; it serves all texts but those that may hold the name of a special token.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    ordinary = ranks_encoder(ranks) if ranks else whole
    return lambda text: np.array(whole(text) if "<|" in text else ordinary(text), "<u4").tobytes()


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _pieces(path: str, ranks: str | None, capacity: int, end: int):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    def run(batches):
        encode = tokenizer_ids(path, ranks)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + last
                n = len(ids) // 4
                for a in range(0, n, capacity):
                    part = ids[4 * a : 4 * (a + capacity)]
                    rows.append((doc, a, len(part) // 4, zlib.crc32(part), n))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


@dataclass
class Plan:
    """Patterns as lists of lengths, how often each is used, and for each length its places in pattern order."""

    patterns: list[list[int]] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)

    def places(self):
        """{length: (first rank, pattern, pieces a sequence, first offset)} as arrays, and the first sequence of each pattern."""
        first = np.concatenate([[0], np.cumsum(self.copies)]).astype(np.int64)
        at: dict[int, list] = {}
        used: dict[int, int] = {}
        for p, (pattern, copies) in enumerate(zip(self.patterns, self.copies, strict=True)):
            offset = 0
            for length in sorted(set(pattern), reverse=True):
                n = pattern.count(length)
                at.setdefault(length, []).append((used.get(length, 0), p, n, offset))
                used[length] = used.get(length, 0) + n * copies
                offset += n * length
        return {k: np.array(v, np.int64).T for k, v in at.items()}, first


def _knapsack(lengths: np.ndarray, prices: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable pattern by dynamic programming: at most capacity tokens, and no more of a length than there are.

    A length may be taken 1, 2, 4, ... at a time, so a few vector operations stand for all its counts.
    """
    best = np.zeros(capacity + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    for i in np.argsort(-prices / lengths, kind="stable"):
        if prices[i] <= 0:
            continue
        left, k = int(min(demand[i], capacity // lengths[i])), 1
        while left > 0:
            k = min(k, left)
            size, value = int(lengths[i]) * k, prices[i] * k
            take = best[:-size] + value if size else best
            better = take > best[size:] + 1e-12
            if better.any():
                best[size:] = np.where(better, take, best[size:])
                taken = np.zeros(capacity + 1, bool)
                taken[size:] = better
                steps.append((i, k, taken))
            left -= k
            k *= 2
    room = int(np.argmax(best))
    pattern = np.zeros(len(lengths))
    for i, k, taken in reversed(steps):
        if taken[room]:
            pattern[i] += k
            room -= int(lengths[i]) * k
    return float(best.max()), pattern


def _decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """First-fit by decreasing length on a histogram: whole runs of equal patterns at once."""
    plan, left = Plan(), {k: v for k, v in sorted(counts.items(), reverse=True) if v}
    while left:
        room, pattern = capacity, []
        for length, n in left.items():
            k = min(n, room // length)
            pattern += [length] * k
            room -= length * k
            if room < min(left):
                break
        copies = min(left[x] // pattern.count(x) for x in set(pattern))
        plan.patterns.append(pattern)
        plan.copies.append(copies)
        for x in set(pattern):
            left[x] -= copies * pattern.count(x)
            if not left[x]:
                del left[x]
    return plan


def solve(counts: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, rounds: int = ROUNDS) -> Plan:
    """Pack pieces of the given lengths and numbers. Column generation with a revised simplex, then rounding."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    if not counts:
        return Plan()
    start = _decreasing(counts, capacity)
    lengths, demand = np.array(list(counts)), np.array(list(counts.values()), float)
    floor = demand @ lengths / capacity
    if sum(start.copies) <= np.ceil(floor):
        return start
    # Each length starts with a pattern of its own; the greedy ones are offered as further columns.
    m = len(lengths)
    most = np.minimum(capacity // lengths, demand)
    basis = np.diag(most.astype(float))
    inverse, x = np.diag(1 / most), demand / most
    where = {int(v): i for i, v in enumerate(lengths)}
    offers = []
    for pattern in start.patterns:
        column = np.zeros(m)
        for v in pattern:
            column[where[v]] += 1
        offers.append(column)
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        column = None
        if offers:
            values = np.array([prices @ c for c in offers])
            if values.max() > 1 + 1e-9:
                column = offers.pop(int(values.argmax()))
            else:
                offers = []
        if column is None:
            value, column = _knapsack(lengths, prices, demand, capacity)
            bound = max(floor, (prices @ demand) / max(value, 1.0))
            if value <= 1 + 1e-9 or x.sum() - bound <= gap * x.sum():
                break
        move = inverse @ column
        ratio = np.where(move > 1e-10, x / np.where(move > 1e-10, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = np.maximum(x - step * move, 0)
        x[out] = step
        basis[:, out] = column
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    plan, left = Plan(), dict(counts)
    for j in np.argsort(-x, kind="stable"):
        pattern = [int(v) for v, k in zip(lengths, basis[:, j], strict=True) for _ in range(round(k))]
        copies = min([int(x[j] + 1e-9), *(left[v] // pattern.count(v) for v in set(pattern))])
        if copies > 0:
            plan.patterns.append(pattern)
            plan.copies.append(copies)
            for v in set(pattern):
                left[v] -= copies * pattern.count(v)
    rest = _decreasing(left, capacity)
    plan = Plan(plan.patterns + rest.patterns, plan.copies + rest.copies)
    return plan if sum(plan.copies) <= sum(start.copies) else start


def _assign(plan: Plan, capacity: int):
    places, first = plan.places()
    total = int(first[-1])

    def run(batches):
        for batch in batches:
            length, rank, fulls = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank", "full_before"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                own = np.flatnonzero(length == v)
                if v == capacity:
                    sequence[own] = total + fulls[own]
                    continue
                begin, pattern, n, at = places[int(v)]
                k = np.searchsorted(begin, rank[own], "right") - 1
                within = rank[own] - begin[k]
                sequence[own] = first[pattern[k]] + within // n[k]
                offset[own] = at[k] + within % n[k] * v
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, ranks: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids, then `end`; a full sequence of `capacity` ids is cut off as long as there is one, the rest
    is one piece. Pieces of a sequence lie end to end from offset 0. Null or empty text: the end alone. Null doc_id:
    packed like any other. Repeated rows are packed each on its own; ties in rank are between equal pieces. Other
    columns are ignored. Empty table: empty result. A tokenizer other than the default may come with its ranks.
    """
    spark = docs.sparkSession
    ranks = ranks or (default_ranks() if tokenizer is None else None)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = shared_checkpoint(docs.mapInArrow(_pieces(tokenizer or default_tokenizer(), ranks, capacity, end), PIECE))
    counts = {r.length: r.n for r in pieces.where(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = solve(counts, capacity)
    # Rank within a length without a task for each length: a count for each part of a length, then a rank in the part.
    part = F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32"), F.lit(shuffle_partitions(spark))).cast("int")
    pieces = pieces.withColumn("part", part)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(starts, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own"))
    ranked = ranked.withColumn("full_before", F.col("rank"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "full_before").mapInArrow(_assign(plan, capacity), f"{PIECE}, sequence_id bigint, offset bigint")
