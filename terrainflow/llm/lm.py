"""Language-model scores: a causal self-attention model on subword ids, and a unigram base over words.

Words are counted over all training documents: every task sends its distinct words once, packed by hash bucket.
The same counts give the frequency of every subword and of every pair of neighbours, which fix the model's slots, its
prior and the choice among rare ids.
The attention model is trained on windows that tile every training document, so every subword is a target once: in
each round all tasks train from the same parameters on their own windows of that round, and the results are averaged by
parameter block. Scoring cuts texts into overlapping windows and scores each subword once.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainflow.llm import attention
from terrainflow.llm.common import shared_checkpoint, shuffle_partitions, text_batches, word_ids, word_spans
from terrainflow.llm.repeats import ARROW_ROWS, FLUSH, ROWS, TEXT, Repeats, _rows, _text_blocks, read_text_block

COUNT, ASK, ANSWER, STRETCHES = 10, 11, 12, 13
#: Identifier of the end token of the base.
END_WORD = 0x5DEECE66D
END_ID = 50256
SUBWORDS = 50257
#: Keys of counts other than of single subwords: pairs in a word, first and last subwords of words.
PAIR, FIRST, LAST = 1 << 40, 1 << 41, 1 << 42
ROUNDS = (0.02, 0.014, 0.008, 0.004)
#: Bytes of distinct words (with 100 for each one) that a task remembers the ids of.
REMEMBERED = 64 << 20
#: Share of the counted words in what the score is mixed from; the attention model has the rest.
WORD_SHARE = 0.5
#: A place of a window after the end of its document.
PADDING = -1
#: Numbers in a block of parameters.
BLOCK = 8192

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoder(path: str):
    """A tokenizer of ordinary text from a file of ranks."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def encode_words(encode, begins: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each after a space, end to end, and how many each has. begins: which ids start with a space.

    Words are encoded in one text; where one holds rarer white space, its ids could not be told apart, and each is encoded alone.
    """
    texts = [w.decode() for w in words]
    flat = np.array(encode(" " + " ".join(texts)))
    first = np.flatnonzero(begins[flat])
    if len(first) == len(words):
        return flat, np.diff(np.append(first, len(flat)))
    found = [encode(" " + t) for t in texts]
    return np.array([i for x in found for i in x]), np.array([len(x) for x in found])


class WordEncoder:
    """Ids of words, each after a space; words met before are looked up."""

    def __init__(self, path: str):
        self.encode, self.begins = encoder(path).encode_ordinary, np.zeros(SUBWORDS, bool)
        self.begins[[i for b, i in load_ranks(path).items() if b[:1] == b" "]] = True
        self.forget()

    def forget(self):
        self.place, self.held = {}, 0
        self.ids, self.starts, self.sizes = (np.empty(0, np.int64) for _ in range(3))

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and how many each word has."""
        if self.held > REMEMBERED:
            self.forget()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            fresh = list(dict.fromkeys(words[i] for i in missing))
            flat, sizes = encode_words(self.encode, self.begins, fresh)
            self.place.update(zip(fresh, range(len(self.sizes), len(self.sizes) + len(fresh)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.ids, self.sizes = np.concatenate([self.ids, flat]), np.concatenate([self.sizes, sizes])
            self.held += sum(map(len, fresh)) + 100 * len(fresh)
            at[missing] = [self.place[words[i]] for i in missing]
        sizes = self.sizes[at]
        return self.ids[np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes


def sequences(encode: WordEncoder, body: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: all ids (each text between two ends), index of each text's first, ids of each word, words of each text."""
    words, n_words = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = body[a:b].split()  # bytes: at the six separators only
        words += own
        n_words.append(len(own))
    n_words = np.array(n_words, np.int64)
    flat, sizes = encode(words) if words else (np.empty(0, np.int64),) * 2
    upto = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.concatenate([[0], np.cumsum(n_words)])
    n = upto[edges[1:]] - upto[edges[:-1]]
    first = np.concatenate([[0], np.cumsum(n + 2)])
    out = np.full(first[-1], END_ID)
    out[np.repeat(first[:-1] + 1 - upto[edges[:-1]], n) + np.arange(len(flat))] = flat
    return out, first, sizes, n_words


def held_out_number(doc) -> bool:
    """Rows that nothing is learned from: crc32 of the id as text is 2 modulo 7, or there is no id."""
    return doc is None or zlib.crc32(str(doc).encode()) % 7 == 2


def squeeze(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def widen(payload: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(payload)


def planes(values: np.ndarray) -> np.ndarray:
    """Bytes of 64-bit numbers, all lowest ones first: they compress better."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def from_planes(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").ravel()


def _word_counts(buckets: int):
    """Distinct words of training documents with counts, by bucket; strings travel for the subword counts."""

    def run(batches):
        parts, held = [], 0

        def send():
            ids, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            words = [w for p in parts for w in p[2]]
            ids, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
            counts = np.bincount(inverse, counts).astype(np.int64)
            bucket = (ids % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(rows):
                    yield int(bucket[rows[0]]), COUNT, squeeze(np.array([len(rows)]), planes(ids[rows]), planes(counts[rows].view(np.uint64)), np.frombuffer(b" ".join(words[first[r]] for r in rows), np.uint8))

        def items():
            nonlocal parts, held
            for batch, lo, hi, data, offsets in text_batches(batches):
                docs = batch.column(0).slice(lo, hi - lo).to_pylist()
                learn = np.array([not held_out_number(d) for d in docs])
                data = _UPPER[data]
                starts, ends, first = word_spans(data, offsets)
                use = np.repeat(learn, np.diff(first))
                starts, ends = starts[use], ends[use]
                ids, where, counts = np.unique(word_ids(data, starts, ends), return_index=True, return_counts=True)
                body = data.tobytes()
                parts.append((np.append(ids, np.uint64(END_WORD)), np.append(counts, learn.sum()), [body[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)] + [b"."]))
                held += len(data)
                if held >= FLUSH["word"]:
                    yield from send()
                    parts, held = [], 0
            if parts:
                yield from send()

        yield from _rows(items(), 32)

    return run


def read_counts(payload: bytes):
    raw = widen(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return from_planes(raw, n, 8), from_planes(raw, n, 8 + 8 * n).view(np.int64), raw[8 + 16 * n :].split(b" ")


def _merge_counts(table: pa.Table) -> pa.Table:
    """One block for a bucket of words: the sums, and a spelling of each word."""
    parts = [read_counts(p) for p in table.column("payload").to_pylist()]
    ids, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)
    words = [w for p in parts for w in p[2]]
    body = squeeze(np.array([len(ids)]), planes(ids), planes(counts.view(np.uint64)), np.frombuffer(b" ".join(words[i] for i in first), np.uint8))
    return pa.table([[table.column("bucket")[0].as_py()], [COUNT], [body]], schema=ARROW_ROWS)


def _totals(path: str):
    """(id, n): how often each subword, pair, first and last subword occurs in the counted words; -1: all tokens, -2: distinct tokens."""

    def run(batches):
        encode, begins = encoder(path).encode_ordinary, np.zeros(SUBWORDS, bool)
        begins[[i for b, i in load_ranks(path).items() if b[:1] == b" "]] = True
        sums, tokens, distinct, more = np.zeros(SUBWORDS, np.int64), 0, 0, []
        for batch in batches:
            for payload in batch.column(2).to_pylist():
                ids, counts, words = read_counts(payload)
                tokens += int(counts.sum())
                distinct += int((counts > 0).sum())
                end = ids == END_WORD
                sums[END_ID] += int(counts[end].sum())
                use = np.flatnonzero(~end)
                for lo in range(0, len(use), 50_000):
                    own = use[lo : lo + 50_000]
                    flat, sizes = encode_words(encode, begins, [words[i] for i in own])
                    weight = np.repeat(counts[own], sizes)
                    sums += np.bincount(flat, weight, SUBWORDS).astype(np.int64)
                    ends = np.cumsum(sizes)
                    inner = np.ones(len(flat), bool)
                    inner[ends - 1] = False
                    inner = np.flatnonzero(inner)
                    keys = np.concatenate([PAIR + flat[inner] * 65536 + flat[inner + 1], FIRST + flat[ends - sizes], LAST + flat[ends - 1]])
                    more.append(_summed(keys, np.concatenate([weight[inner], counts[own], counts[own]])))
                if len(more) > 40:
                    more = [_summed(*map(np.concatenate, zip(*more, strict=True)))]
        some = np.flatnonzero(sums)
        keys, n = _summed(*map(np.concatenate, zip(*more, strict=True))) if more else (np.empty(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some, keys])), pa.array(np.concatenate([[tokens, distinct], sums[some], n]))], names=["id", "n"])

    return run


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, n).astype(np.int64)


class Slots:
    """Which subwords have a slot of their own, and how likely each other one is."""

    def __init__(self, counts: np.ndarray):
        self.ends = counts[END_ID]
        order = np.lexsort((np.arange(SUBWORDS), -counts))
        head = order[: attention.SLOTS - 1]
        self.slot = np.full(SUBWORDS, attention.SLOTS - 1, np.int16)
        self.slot[head] = np.arange(len(head))
        rest = counts + 0.5
        rest[head] = 0
        self.rare = np.where(rest > 0, np.log(np.maximum(rest, 1e-9) / rest.sum()), 0)
        slots = np.bincount(self.slot, counts, attention.SLOTS) + 0.5
        self.frequency = slots / slots.sum()

    def follows(self, totals: DataFrame) -> np.ndarray:
        """How often each slot follows each other one: pairs in words as counted, and words taken as independent."""
        shared = totals.sparkSession.sparkContext.broadcast(self.slot)

        def run(batches):
            size = attention.SLOTS
            sums, first, last = np.zeros(size * size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            for batch in batches:
                key, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                for base, top, into in ((PAIR, FIRST, sums), (FIRST, LAST, first), (LAST, 2 * LAST, last)):
                    own = (key >= base) & (key < top)
                    k = key[own] - base
                    at = shared.value[k >> 16].astype(np.int64) * size + shared.value[k & 65535] if into is sums else shared.value[k].astype(np.int64)
                    np.add.at(into, at, n[own])
            keys = np.concatenate([np.flatnonzero(sums), size * size + np.flatnonzero(first), size * size + size + np.flatnonzero(last)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([sums, first, last])[keys])], names=["id", "n"])

        size = attention.SLOTS
        out = totals.where(F.col("id") >= PAIR).mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS * (SLOTS + 2) rows
        counts = np.zeros(size * (size + 2))
        counts[np.asarray(out.column("id"))] = np.asarray(out.column("n"))
        inside, first, last = counts[: size * size].reshape(size, size), counts[size * size : size * size + size].copy(), counts[size * size + size :].copy()
        end, ends = self.slot[END_ID], self.ends
        last[end] += ends
        first[end] += ends
        after = last[:, None] * first / max(first.sum(), 1)
        words = np.delete(np.arange(size), end)
        after[end] = 0
        after[end, words] = ends * first[words] / max(first[words].sum(), 1)
        return inside + after


def _stretches(path: str, slots, rounds: int):
    """Windows of slots that tile every training document, by round, packed. Each has one slot in common with the one before, its given start."""
    width = attention.WIDTH

    def run(batches):
        encode, known = WordEncoder(path), slots.value.slot
        held: list[list] = [[] for _ in range(rounds)]

        def send(k):
            rows = np.concatenate(held[k])
            held[k].clear()
            return k, STRETCHES, squeeze(rows)

        def items():
            for batch, lo, hi, data, offsets in text_batches(batches):
                docs = batch.column(0).slice(lo, hi - lo).to_pylist()
                every, first, _, _ = sequences(encode, _UPPER[data].tobytes(), offsets)
                for doc, a, b in zip(docs, first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if held_out_number(doc):
                        continue
                    found = every[a:b]
                    n = -(-(len(found) - 1) // width)
                    tiled = np.full(n * width + 1, PADDING, np.int16)
                    tiled[: len(found)] = known[found]
                    rows = tiled[np.arange(n)[:, None] * width + np.arange(width + 1)]
                    phase = zlib.crc32(b"%d phase" % doc)
                    for k in range(min(n, rounds)):
                        held[(phase + k) % rounds].append(rows[k::rounds])
                for k in range(rounds):
                    if sum(map(len, held[k])) >= 20_000:
                        yield send(k)
            for k in range(rounds):
                if held[k]:
                    yield send(k)

        yield from _rows(items(), 8)

    return run


def _blocks_of(p) -> tuple[np.ndarray, list]:
    return np.concatenate([x.ravel() for x in p.values()]), [(k, x.shape) for k, x in p.items()]


def _parameters(flat, shapes):
    out, at = {}, 0
    for name, shape in shapes:
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def _train_round(shared, rate: float):
    """Parameters after this task's windows, in blocks, with the number of their targets as weight."""

    def run(batches):
        rows = [np.frombuffer(widen(p), np.int16).reshape(-1, attention.WIDTH + 1) for batch in batches for p in batch.column(2).to_pylist()]
        if rows:
            rows = np.concatenate(rows)
            p, base = shared.value
            flat, _ = _blocks_of(attention.train(p, base, rows, rate))
            parts = [flat[a : a + BLOCK].astype("<f4").tobytes() for a in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float((rows[:, 1:] != PADDING).sum())] * len(parts)), pa.array(parts, pa.binary())], names=["block", "weight", "numbers"])

    return run


def _average(table: pa.Table) -> pa.Table:
    weight = np.asarray(table.column("weight"))
    total = sum(np.frombuffer(x, "<f4").astype(float) * w for x, w in zip(table.column("numbers").to_pylist(), weight, strict=True))
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "weight": [float(weight.sum())], "numbers": pa.array([(total / weight.sum()).astype("<f4").tobytes()], pa.binary())})


def train_model(docs: DataFrame, slots: Slots, base, path: str) -> dict[str, np.ndarray]:
    """Rounds of training in all tasks; what comes back to the driver is one set of parameters a round."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(slots)
    stretches = shared_checkpoint(docs.mapInArrow(_stretches(path, shared, len(ROUNDS)), ROWS))
    p = attention.initial()
    for k, rate in enumerate(ROUNDS):
        now = spark.sparkContext.broadcast((p, base))
        done = stretches.where(F.col("bucket") == k).mapInArrow(_train_round(now, rate), "block int, weight double, numbers binary")
        blocks = {r.block: r.numbers for r in done.groupBy("block").applyInArrow(_average, "block int, weight double, numbers binary").collect()}
        if blocks:
            flat = np.concatenate([np.frombuffer(blocks[b], "<f4") for b in sorted(blocks)])
            p = _parameters(flat, _blocks_of(p)[1])
    return p


def bucket_words(texts: pa.Table, inverse: bool = False):
    """Of the texts of one document bucket: their blocks with word identifiers, the sorted distinct identifiers, and the place of each word among them."""
    blocks = []
    for payload in texts.column("payload").to_pylist():
        docs, valid, data, offsets = read_text_block(payload)
        data = _UPPER[data]
        starts, ends, first = word_spans(data, offsets)
        blocks.append((docs, valid, data, offsets, word_ids(data, starts, ends), first))
    every = np.concatenate([np.array([END_WORD], np.uint64), *(b[4] for b in blocks)])
    if not inverse:
        return blocks, np.unique(every), None
    known, at = np.unique(every, return_inverse=True)
    return blocks, known, at[1:]


def _asks(buckets: int):
    """Which counts a document bucket needs, by bucket of words."""

    def run(texts: pa.Table) -> pa.Table:
        own = texts.column("bucket")[0].as_py()
        _, known, _ = bucket_words(texts)
        bucket = (known % np.uint64(buckets)).astype(np.int64)
        out = [(b, ASK, squeeze(np.array([own]), planes(known[bucket == b]))) for b in np.unique(bucket).tolist()]
        return pa.Table.from_batches(_rows(out), schema=ARROW_ROWS)

    return run


def _answers(counted: pa.Table, asked: pa.Table) -> pa.Table:
    """Counts of the words that were asked for, in their order."""
    ids, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for payload in counted.column("payload").to_pylist():
        ids, counts, _ = read_counts(payload)
    out = []
    for bucket, payload in zip(asked.column("bucket").to_pylist(), asked.column("payload").to_pylist(), strict=True):
        raw = widen(payload)
        own, wanted = int(np.frombuffer(raw, np.int64, 1)[0]), from_planes(raw, (len(raw) - 8) // 8, 8)
        at = np.minimum(np.searchsorted(ids, wanted), max(len(ids) - 1, 0))
        found = np.where(ids[at] == wanted, counts[at], 0) if len(ids) else np.zeros(len(wanted), np.int64)
        out.append((own, ANSWER, squeeze(np.array([bucket]), planes(found.view(np.uint64)))))
    return pa.Table.from_batches(_rows(out), schema=ARROW_ROWS)


OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, prior_score double"
ARROW_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("prior_score", pa.float64())])


def mixed(model: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Natural log-probability of tokens under the mixture; counted: -inf for unknown words."""
    return np.logaddexp(np.log(1 - WORD_SHARE) + model, np.log(WORD_SHARE) + counted)


def _score(buckets: int, path: str, model, tokens: int, distinct: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        slots, base, p = model.value
        encode = WordEncoder(path)
        blocks, known, places = bucket_words(texts, True)
        counts = np.zeros(len(known), np.int64)
        bucket = (known % np.uint64(buckets)).astype(np.int64)
        for payload in answers.column("payload").to_pylist():
            raw = widen(payload)
            counts[bucket == int(np.frombuffer(raw, np.int64, 1)[0])] = from_planes(raw, (len(raw) - 8) // 8, 8).view(np.int64)
        value = np.log((counts + 1) / (tokens + distinct + 1))
        end = int(np.searchsorted(known, np.uint64(END_WORD)))
        out, done = [], 0
        for docs, valid, data, offsets, _, first in blocks:
            at = places[done : done + first[-1]]
            done += first[-1]
            found, begin, sizes, n_words = sequences(encode, data.tobytes(), offsets)
            # Tokens: the words of each text, then its end.
            is_word = np.ones(len(at) + len(docs), bool)
            last = np.cumsum(n_words + 1) - 1
            is_word[last] = False
            token, length = np.full(len(is_word), end), np.ones(len(is_word), np.int64)
            token[is_word], length[is_word] = at, sizes
            by_token, by_text = np.cumsum(length) - length, last - n_words
            sums = lambda x, where: np.add.reduceat(x, where)
            targets = np.ones(len(found), bool)
            targets[begin[:-1]] = False
            rare, slot = slots.rare[found[targets]], slots.slot[found]
            counted = np.where(counts[token] > 0, value[token], -np.inf)
            scores = [sums(mixed(sums(x + rare, by_token), counted), by_text) / np.log(10) for x in (attention.score_each(p, base, slot, begin), attention.score_prior(base, slot, begin))]
            ids_or_none = [int(d) if v else None for d, v in zip(docs, valid, strict=True)]
            columns = [ids_or_none, [held_out_number(d) for d in ids_or_none], n_words + 1, sums((counts[token] > 0).astype(np.int64), by_text), np.full(len(docs), tokens), sums(value[token], by_text) / np.log(10), *scores]
            out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW_OUT, strict=True)], schema=ARROW_OUT))
        return pa.Table.from_batches(out, schema=ARROW_OUT)

    return run


def score_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, prior_score, one row per input row.

    Learned from rows whose id is not held out (held_out_number); a null doc_id is scored and held out. A-Z is
    lower-cased; tokens are words, then one end. base_score: unigram with add-one smoothing. score: log10 probability
    of the words and the end: the attention model spells each word, and its probability is mixed with that of the counted
    word (WORD_SHARE). prior_score: the same without the attention, so score less prior_score is what it adds. Null or empty text: the end alone. Repeated rows: each is
    counted and scored. Ties (equal subword counts): the smaller id first. Empty table: empty result. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    path, buckets = ranks or default_ranks(), shuffle_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = shared_checkpoint(docs.mapInArrow(_word_counts(buckets), ROWS).groupBy("bucket").applyInArrow(_merge_counts, ROWS))
    summed = shared_checkpoint(counted.mapInArrow(_totals(path), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")))
    totals = {r.id: r.n for r in summed.where(F.col("id") < PAIR).collect()}  # at most SUBWORDS + 2 rows
    slots = Slots(np.array([totals.get(i, 0) for i in range(SUBWORDS)], float))
    base = attention.prior(slots.follows(summed), slots.frequency)
    model = spark.sparkContext.broadcast((slots, base, train_model(docs, slots, base, path)))
    texts = docs.mapInArrow(_text_blocks(Repeats(1, 1, "word", True, buckets)), ROWS)
    asks = texts.groupBy("bucket").applyInArrow(_asks(buckets), ROWS)
    answers = counted.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(_answers, ROWS)
    run = _score(buckets, path, model, totals.get(-1, 0), totals.get(-2, 0))
    return texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, OUT)


assert TEXT != COUNT  # kinds of blocks share a column
