import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrainflow.llm import attention as a
from terrainflow.llm import queries as q
from terrainflow.llm.lm import score_documents
from tests.llm.brute import WORD
from tests.llm.test_operators import messy


def model(seed=0):
    rng = np.random.default_rng(seed)
    base = a.prior(rng.poisson(0.3, (a.SLOTS, a.SLOTS)).astype(float), rng.dirichlet(np.ones(a.SLOTS)))
    p = a.initial(seed)
    return {k: x + (rng.standard_normal(x.shape) * 0.1).astype(np.float32) for k, x in p.items()}, base


def test_probabilities_sum_to_one():
    p, base = model()
    u, _ = a.hidden(p, np.array([[1, 5, 9] + [0] * (a.WIDTH - 3)]))
    every = np.arange(a.SLOTS)
    for place in (0, 2):
        value = a.log_probabilities(a.ready(p, base), np.repeat(u[place : place + 1], a.SLOTS, axis=0), np.full(a.SLOTS, 5), every)
        assert abs(np.exp(value.astype(float)).sum() - 1) < 1e-3


def test_gradients_against_differences():
    p, base = model(3)
    p = {k: x.astype(np.float64) for k, x in p.items()}
    base = {k: x.astype(np.float64) for k, x in base.items()}
    rng = np.random.default_rng(5)
    ids, target = rng.integers(0, a.SLOTS, (2, a.WIDTH)), rng.integers(0, a.SLOTS, (2, a.WIDTH))

    def loss(p):
        u, _ = a.hidden(p, ids)
        c, place = target.ravel() // a.PLACES, target.ravel() % a.PLACES
        x = u @ p["class_w"] + p["class_b"] + base["class"][ids.ravel()]
        y = np.einsum("nd,ndk->nk", u, p["slot_w"][c]) + p["slot_b"][c] + base["slot"][ids.ravel(), c]
        pick = lambda z, k: z[np.arange(len(z)), k] - np.log(np.exp(z).sum(axis=1))
        return -(pick(x, c) + pick(y, place)).mean()

    g = a.gradients(p, base, ids, target)
    for name, x in p.items():
        for _ in range(3):
            i = tuple(int(rng.choice(np.unique(np.nonzero(g[name])[k]))) if name == "embed" and k == 0 else int(rng.integers(0, n)) for k, n in enumerate(x.shape))
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][i] += 1e-5
            down[name][i] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[name][i]) < 1e-4, name


def test_places_after_the_end_do_not_train():
    p, base = model(3)
    rng = np.random.default_rng(6)
    rows = rng.integers(0, a.SLOTS, (2, a.WIDTH + 1))
    rows[1] = -1
    whole, padded = a.gradients(p, base, rows[:1, :-1], rows[:1, 1:]), a.gradients(p, base, rows[:, :-1], rows[:, 1:])
    for name in p:
        assert np.allclose(whole[name], padded[name], atol=1e-6), name


def test_windows_hold_every_subword_of_every_training_document():
    from types import SimpleNamespace

    import pyarrow as pa

    from terrainflow.llm import lm

    texts = ["one", None, "", "word " * 5, "Some more words here " * 40, "x " * a.WIDTH, "y " * (a.WIDTH - 1)] * 3
    slots = SimpleNamespace(value=SimpleNamespace(slot=(np.arange(lm.SUBWORDS) % a.SLOTS).astype(np.int16)))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    got = Counter()
    for out in lm._stretches(lm.default_ranks(), slots, len(lm.ROUNDS))([batch]):
        for payload in out.column(2).to_pylist():
            rows = np.frombuffer(lm.widen(payload), np.int16).reshape(-1, a.WIDTH + 1)
            got.update(zip(rows[:, :-1][rows[:, 1:] >= 0].tolist(), rows[:, 1:][rows[:, 1:] >= 0].tolist(), strict=True))
    encode, want = lm.encoder(lm.default_ranks()).encode_ordinary, Counter()
    for doc, text in enumerate(texts):
        words = (text or "").lower().split()
        ids = [lm.END_ID, *(encode(" " + " ".join(words)) if words else []), lm.END_ID]
        if not lm.held_out_number(doc):
            want.update((x % a.SLOTS, y % a.SLOTS) for x, y in zip(ids, ids[1:], strict=False))
    assert got == want


def test_every_slot_is_scored_once():
    p, base = model(1)
    rng = np.random.default_rng(2)
    for n in (2, 3, a.WIDTH, a.WIDTH + 1, a.WIDTH + 2, a.WIDTH + a.STRIDE + 1, 100):
        slots = rng.integers(0, a.SLOTS, n)
        total, seen = 0.0, 0
        size, begin = n - 1, 0
        while seen < size:
            window = np.minimum(begin + np.arange(a.WIDTH), size - 1)
            u, _ = a.hidden(p, slots[window][None])
            for k in range(a.WIDTH):
                at = begin + k
                if at < size and (begin == 0 or k >= a.WIDTH - a.STRIDE):
                    assert at == seen
                    total += float(a.log_probabilities(a.ready(p, base), u[k : k + 1], slots[at : at + 1], slots[at + 1 : at + 2])[0])
                    seen += 1
            begin += a.STRIDE
        assert abs(a.score(p, base, np.concatenate([slots, slots]), np.array([0, n, 2 * n]))[1] - total) < 1e-2


def test_scoring_takes_the_states_of_the_model_from_tables():
    """A window after another is asked for its new places only; scores that could overflow are bounded as in training."""
    for scale in (1, 40):
        p, base = model(4)
        p["query"] *= scale
        ready = a.ready(p, base)
        assert (ready["most"] > 60) or scale == 1
        ids = np.random.default_rng(7).integers(0, a.SLOTS, (5, a.WIDTH))
        whole = a.hidden(p, ids)[0].reshape(5, a.WIDTH, a.DIM)
        for begin in (0, a.WIDTH - a.STRIDE):
            got = a.states(ready, ids, begin).reshape(5, a.WIDTH - begin, a.DIM)
            assert np.allclose(got, whole[:, begin:], rtol=1e-3, atol=1e-3 * scale)


def brute_base(docs):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {d: [*WORD.findall(lower(t)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(w for d, ts in tokens.items() if not held[d] for w in ts)
    n, v = sum(counts.values()), len(counts)
    return {d: (held[d], len(ts), sum(counts[w] > 0 for w in ts), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ts)) for d, ts in tokens.items()}


def test_base_against_brute_force_and_held_out_scores(spark):
    path = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = brute_base(docs)
    rows = q.op3_attention_lm(spark, path).collect()
    assert len(rows) == len(docs)
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_held_out_texts_are_likelier_than_under_the_base_and_without_attention(spark, sf):
    """The base gives every unknown word the same probability, whatever its letters, so where many words are unknown only texts of known words compare."""
    held = q.op3_attention_lm(spark, f"/root/testdata/sf{sf}").where("held_out")
    row = held.agg(*[F.sum(F.when(F.lit(True) if sf == "0.1" else F.col("n_known") == F.col("n_tokens"), F.col(c))).alias(c) for c in ("score", "base_score")], F.sum("score").alias("all"), F.sum("prior_score").alias("prior")).first()
    print(sf, row)
    assert row.score > row.base_score and row["all"] > row.prior


def test_scores_against_brute_force(spark):
    """Text by text: ids from the tokenizer, log-probabilities slot by slot, words put together, mixed with their counts."""
    from types import SimpleNamespace

    import pyarrow as pa

    from terrainflow.llm import lm

    rng = np.random.default_rng(8)
    docs = [(i, t) for i, t in enumerate(["the cat sat", "The dog, the DOG!", "", None, "zebra " * 60, "a\u00a0b c", "unheard 12.5 don't " * 30])]
    p, base = model(4)
    slots = lm.Slots(rng.integers(0, 50, lm.SUBWORDS).astype(float))
    texts, counts = [], Counter(w for _, t in docs[:3] for w in (t or "").lower().split())
    counts[None] = 3
    total, distinct = sum(counts.values()), len(counts)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs])})
    for out in lm._text_blocks(lm.Repeats(1, 1, "word", True, 1))([batch]):
        texts.append(out)
    texts = pa.Table.from_batches(texts)
    _, known, _ = lm.bucket_words(texts)
    words = [w for _, t in docs for w in (t or "").lower().encode().split(b" ") if w]
    name = {int(lm.END_WORD): None}
    for w in words:
        name[int(lm.word_ids(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])] = w.decode()
    answer = lm.squeeze(np.array([0]), lm.planes(np.array([counts[name[int(k)]] for k in known], np.uint64)))
    answers = pa.Table.from_batches(lm._rows([(0, lm.ANSWER, answer)]), schema=lm.ARROW_ROWS)
    got = lm._score(1, lm.default_ranks(), SimpleNamespace(value=(slots, base, p)), total, distinct)(texts, answers).to_pylist()
    encode = lm.encoder(lm.default_ranks()).encode_ordinary
    for (_, t), r in zip(docs, got, strict=True):
        own = [w for w in (t or "").lower().split(" ") if w]
        units = [encode(" " + w) for w in own] + [[lm.END_ID]]
        ids = np.array([lm.END_ID, *(i for u in units for i in u)])
        each = np.diff([a.score(p, base, slots.slot[ids[:k]], np.array([0, k]))[0] if k > 1 else 0.0 for k in range(1, len(ids) + 1)]) + slots.rare[ids[1:]]
        at, score = 0, 0.0
        for w, u in zip([*own, None], units, strict=True):
            spelled = math.exp(each[at : at + len(u)].sum())
            score += math.log10((1 - lm.WORD_SHARE) * spelled + lm.WORD_SHARE * (counts[w] + 1) / (total + distinct + 1) * (counts[w] > 0))
            at += len(u)
        assert r["score"] == pytest.approx(score, rel=1e-3), t


def test_edges(spark):
    rows = score_documents(messy(spark)).collect()
    assert len(rows) == 7 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 4)} == {1}
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    assert score_documents(messy(spark).limit(0)).count() == 0


def test_words_in_one_text_have_the_ids_of_each_alone():
    from terrainflow.llm.lm import SUBWORDS, default_ranks, encode_words, encoder, load_ranks

    encode, begins = encoder(default_ranks()).encode_ordinary, np.zeros(SUBWORDS, bool)
    begins[[i for b, i in load_ranks(default_ranks()).items() if b[:1] == b" "]] = True
    plain = [w.encode() for w in ("the", "don't", "été", "###", "a,b", "12.5", "'s", "x" * 80, "日本", "|")]
    for words in (plain, [*plain, "a\u00a0b".encode(), "\u2003".encode(), "z".encode()]):
        flat, sizes = encode_words(encode, begins, words)
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [encode(" " + w.decode()) for w in words]
