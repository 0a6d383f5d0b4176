import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrainflow.llm import merkle, phrases, superminhash
from tests.llm.brute import WORD, sha

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- SuperMinHash ---------------------------------------------------------------------------------


def shingles(text):
    words = WORD.findall(lower(text))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1))))


def brute_components(docs):
    """[(doc_id, text)] -> the smallest doc_id that each row can reach."""
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    checked = set()
    for group in where.values():
        for k, i in enumerate(group):
            for j in group[:k]:
                if (i, j) not in checked:
                    checked.add((i, j))
                    if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                        label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(docs))]


def edited():
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randint(0, 3000)
    docs = [(900, ""), (901, " \t"), (902, "One two"), (903, "one  TWO"), (904, "one two three"), (905, None), (906, "One two THREE"), (907, "one")]
    for size in (6, 20, 60, 200, 400):
        base = [word() for _ in range(size)]
        for _ in range(40):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                text[rng.randrange(size)] = word()
            docs.append((len(docs), " ".join(text)))
    line = [word() for _ in range(15)]
    docs += [(len(docs) + 1000 + i, " ".join([word() for _ in range(rng.randint(3, 40))] + line)) for i in range(60)]
    return docs


def plain_signature(hashes, size):
    """The algorithm one shingle after another."""
    out = [2**64 - 1] * size
    for h in hashes:
        place = list(range(size))
        for rank in range(size):
            x = int(superminhash.mix(np.array([(h + (rank + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            k = rank + ((x & 0xFFFFFFFF) * (size - rank) >> 32)
            place[rank], place[k] = place[k], place[rank]
            out[place[rank]] = min(out[place[rank]], rank << 32 | x >> 32)
    return out


def test_superminhash_signature_is_that_of_the_plain_algorithm():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (1, 2, 7, 60)]
    doc = np.repeat(np.arange(4), [len(s) for s in sets])
    got = superminhash.signatures(doc, np.concatenate(sets), 4, 24)
    assert got.tolist() == [plain_signature(s.tolist(), 24) for s in sets]


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        common, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (170, 15, 15))
        sig = superminhash.signatures(np.repeat([0, 1], 185), np.concatenate([common, a, common, b]), 2)
        errors.append((sig[0] == sig[1]).mean() - 0.85)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


@pytest.mark.parametrize("bucket", [2, 32])
def test_superminhash_against_brute_force(spark, bucket):
    docs = edited()
    got = {r.doc_id: r for r in superminhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), bucket).collect()}
    want = brute_components(docs)
    assert {d: (got[d].component_id, got[d].n_shingles, got[d].kept) for d, _ in docs} == {d: (c, len(shingles(t)), d == c) for (d, t), c in zip(docs, want, strict=True)}


def test_superminhash_on_the_smallest_tables(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(path).collect()]
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicates(spark.read.parquet(path)).collect()}
    assert got == {d: c for (d, _), c in zip(docs, brute_components(docs), strict=True)}


def test_superminhash_edges(spark):
    long = " ".join(f"x{i}" for i in range(200_000))
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "A b c d"), (None, "q r s"), (2, None), (2, ""), (3, long), (4, long + " end"), (5, "z z z z z"), (6, "z z z")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"node": F.lit(1), "key": F.lit("x"), "keys": F.lit(2)})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in superminhash.near_duplicates(table).collect()), key=str)
    want = [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, False), (2, 0, 2, True), (2, 0, 2, True), (3, 199_998, 3, True), (4, 199_999, 3, False), (5, 1, 5, True), (6, 1, 5, False)]
    assert got == sorted(want, key=str)
    assert superminhash.near_duplicates(table.limit(0)).count() == 0


# --- phrases --------------------------------------------------------------------------------------


def brute_counts(docs):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, n


def brute_collocations(docs, least, top):
    f, n = brute_counts(docs)
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, ws), a in candidates.items():
        score, k = min(((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]])), k) for k in range(1, len(ws)))
        inside = any(m == lang and len(x) > len(ws) and 100 * b >= 80 * a and any(x[i : i + len(ws)] == ws for i in range(len(x))) for (m, x), b in candidates.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    rows = []
    for lang in n:
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def phrase_rows():
    rng = random.Random(9)
    docs = []
    for lang in ("en", "de", None):
        words = [f"{c}{lang or ''}" for c in ("The", "cat", "sat", "on", "é", "mat", "x'y", "Ünder", "dog", "ran")]
        for _ in range(60):
            text = ""
            for _ in range(rng.randint(0, 60)):
                text += rng.choice(words) + rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".\n", " \t ", "\r\n", "\x0b"])
            docs.append((lang, text + (" ".join(words[:6]) + " ") * rng.randint(0, 3)))
    return docs + [("en", None), ("en", ""), ("fr", " . "), ("en", docs[0][1])]


@pytest.mark.parametrize(("least", "top", "size"), [(3, 2000, 2 << 20), (8, 5, 64), (30, 2000, 2 << 20)])
def test_phrases_against_brute_force(spark, monkeypatch, least, top, size):
    monkeypatch.setattr(phrases, "SLICE", size)
    docs = phrase_rows()
    table = spark.createDataFrame(docs, "lang string, text string").withColumns({"phrase": F.lit("x"), "words": F.lit(1), "n": F.lit(2), "part": F.lit(3)})
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(table.repartition(3), least, top).collect())
    assert got == brute_collocations(docs, least, top)
    assert phrases.collocations(table.limit(0)).count() == 0


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SLICE", 50)
    texts = ["ab cd " * 30, "one two. three, four " * 20, "x", None, "a b c. " * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "und", "en", "en"]), pa.array(texts)], names=["lang", "text"])
    parts = list(phrases._parts([batch]))
    assert b"".join(p[2].tobytes() for p in parts) == "".join(t or "" for t in texts).encode()
    assert len(parts) > 10 and max(len(p[2]) for p in parts) <= 180
    got = Counter()
    for names, code, data, offsets in parts:
        for k, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            got += brute_counts([(names[code[k]], data[lo:hi].tobytes().decode())])[0]
    assert got == brute_counts(zip(["en", "de", "und", "en", "en"], texts, strict=True))[0]


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(3)
    for _ in range(20):
        keys = np.concatenate([rng.integers(0, 50, 3000), rng.integers(0, 10**9, 20_000)]).astype(np.uint64)
        rng.shuffle(keys)
        blocks = [phrases._pack(*np.unique(part, return_counts=True)) for part in np.array_split(keys, 37)]
        summary = phrases.Summary(len(keys) // 30 + 1)
        for b in blocks:
            summary.merge(*phrases._unpack(b))
        want = {int(k): int(c) for k, c in zip(*np.unique(keys, return_counts=True), strict=True) if c >= 30}
        assert len(summary.keys) <= summary.capacity and summary.removed < 30
        assert want.keys() <= set(summary.keys.tolist())
        found, n = phrases.frequent_keys(blocks, len(keys), 30)
        assert dict(zip(found.tolist(), n.tolist(), strict=True)) == want


def test_scores_of_large_counts_are_exact(spark):
    a, other = 7_000_000_000_000_000, 9_000_000_000_000_001
    row = spark.range(1).selectExpr(f"(cast({a}L as decimal(20, 0)) * 2000000) div (cast({a}L as decimal(20, 0)) + cast({other}L as decimal(20, 0))) s").first()
    assert row.s == 2_000_000 * a // (a + other)


# --- Merkle ---------------------------------------------------------------------------------------


def levels(nodes):
    """All levels of a tree from its leaves."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def brute_manifest(rows):
    """[(doc_id, text, lang, source, n_chars)] -> one tuple for each row."""

    def leaf(row, text):
        values = [row[0], row[3], row[2], row[4], text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    trees = defaultdict(list)
    for row in rows:
        trees[row[3]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    built = {s: levels([x[2] for x in trees[s]]) for s in names}
    top = levels([built[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, h, row) in enumerate(trees[s]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf(row, lower(row[1]) if row[1] is not None else None) if tampered else h
            proof = []
            for tree, at in ((built[s], i), (top, k)):
                for level in tree[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    left, right = run[: at % 16], run[at % 16 + 1 :]
                    proof += left + right
                    folded = sha("".join([*left, folded, *right]))
                    at //= 16
            out.append((row[0], h, built[s][-1][0], top[-1][0], sha("".join(proof)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def manifest(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit("t"), "idx": F.lit(1), "n": F.lit(2), "hash": F.lit("h"), "run": F.lit(3)})
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in columns) for r in merkle.merkle_manifest(table.repartition(5)).collect()), key=str)


@pytest.mark.parametrize("sizes", [(1,), (16, 1), (17, 300, 2), tuple([3] * 18), (257,)])
def test_manifest_against_brute_force(spark, sizes):
    rng = random.Random(4)
    rows = [(rng.randrange(10**6) * 40 + k, f"Text {rng.random()} ÀÉ", "en", None if k == 1 else f"s{k}é", 5) for k, n in enumerate(sizes) for _ in range(n)]
    assert manifest(spark, rows) == brute_manifest(rows)


def test_manifest_edges(spark):
    rows = [(5, "A", None, "s", None), (5, "A", None, "s", None), (5, "B", "en", "s", 1), (None, "Null", "en", "s", 4), (7, None, "en", None, 0), (8, "", "", "", 0), (9, "-", "-", "-", -1)]
    rows += [(k, "Up " * 50_000, "en", "long", 150_000) for k in range(3)]
    got = manifest(spark, rows)
    assert got == brute_manifest(rows)
    assert len({r[3] for r in got}) == 1
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tampering_is_found_by_every_proof(spark):
    rows = [(k, f"Text {k}" if k % 2 else f"text {k}", "en", f"s{k % 3}", 5) for k in range(100)]
    for r in manifest(spark, rows):
        changed = zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] % 2 == 1
        assert r[-1] is not changed
    assert hashlib.sha256(b"").hexdigest() == merkle_proof_of_one(spark)


def merkle_proof_of_one(spark):
    return manifest(spark, [(1, "x", "en", "s", 1)])[0][4]
