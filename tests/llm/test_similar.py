import random

import numpy as np
import pytest

from terrainflow.llm import similar
from tests.llm.brute import WORD

TEXTS = "/root/testdata/sf0.01/documents.parquet"


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def brute_groups(docs):
    """docs: {name: text}. The smallest name of each component."""
    sets = {d: shingles(t) for d, t in docs.items()}
    where = {}
    for d, s in sets.items():
        for x in s or [None]:
            where.setdefault(x, []).append(d)
    label = {d: d for d in docs}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    checked = set()
    for group in where.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if (a, b) not in checked:
                    checked.add((a, b))
                    if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                        a1, b1 = root(a), root(b)
                        label[max(a1, b1)] = min(a1, b1)
    return {d: root(d) for d in docs}


def edited():
    """Near copies of a few texts, some of them borderline, in crowded groups, with a common line in unrelated texts."""
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randint(0, 5000)
    line = [word() for _ in range(12)]
    docs, n = {900: "", 901: " \t", 902: "One two", 903: "one  TWO", 904: "one two three"}, 0
    for size in (7, 30, 90, 200):
        base = [word() for _ in range(size)]
        for _ in range(30):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                text[rng.randrange(size)] = word()
            docs[n] = " ".join(text)
            n += 1
    for _ in range(60):
        docs[n] = " ".join([word() for _ in range(rng.randint(5, 40))] + line)
        n += 1
    return docs


@pytest.mark.parametrize("bucket", [2, 32])
def test_groups_against_brute_force(spark, bucket):
    docs = edited()
    table = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)
    rows = similar.similar_components(table, bucket).collect()
    least = {}
    for r in rows:
        least[r.root] = min(least.get(r.root, r.doc_id), r.doc_id)
    assert len(rows) == len(docs)
    assert {r.doc_id: least[r.root] for r in rows} == brute_groups(docs)


def test_marks_let_every_similar_pair_pass():
    rng = np.random.default_rng(5)
    for size in (1, 5, 9, 40, 300, 3000):
        for _ in range(30):
            x = set(rng.integers(0, 2**63, size).tolist())
            lost = rng.integers(0, size // 5 + 1)
            y = set(list(x)[lost:]) | set(rng.integers(0, 2**63, rng.integers(0, size // 8 + 1)).tolist())
            sets = [np.array(sorted(z), np.uint64) for z in (x, y)]
            doc = np.repeat([0, 1], [len(z) for z in sets])
            a, b = similar.set_marks(doc, np.concatenate(sets), 2).view(np.uint64).tolist()
            differ = sum((p ^ q).bit_count() for p, q in zip(a, b, strict=True))
            assert differ <= len(x ^ y)
            if 5 * len(x & y) >= 4 * len(x | y):
                assert 9 * differ <= len(x) + len(y)


def test_marks_of_long_sets_that_differ_are_told_apart():
    """Sets of 1600 that share two thirds: had shingles only set bits, nearly all would be set in both."""
    rng = np.random.default_rng(6)
    shared = rng.integers(0, 2**63, 1070).astype(np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 2**63, 530).astype(np.uint64)])) for _ in range(2)]
    a, b = similar.set_marks(np.repeat([0, 1], [len(z) for z in sets]), np.concatenate(sets), 2).view(np.uint64).tolist()
    assert 9 * sum((p ^ q).bit_count() for p, q in zip(a, b, strict=True)) > sum(map(len, sets))


def test_fingerprints_link_copies_without_the_exact_search(spark, monkeypatch):
    rng = random.Random(11)
    docs = {}
    for n in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
        for k in range(6):
            text = list(base)
            text[rng.randrange(3000)] = f"x{k}"
            docs[10 * n + k] = " ".join(text)
    docs |= {100: "", 101: None}
    table = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    pairs = spark.createDataFrame([], "a bigint, b bigint")
    live = spark.createDataFrame([], "key bigint, node bigint, size int, most int, held_keys bigint")
    monkeypatch.setattr(similar, "_candidates", lambda docs, bucket: (pairs, live))
    roots = {r.doc_id: r.root for r in similar.similar_components(table).collect()}
    groups = [{roots[10 * n + k] for k in range(6)} for n in range(4)]
    assert len(roots) == len(docs) and roots[100] == roots[101] and len(set().union(*groups)) >= 4
    assert sum(map(len, groups)) <= 8  # of 24 texts that share words with five others each
    assert all(x.isdisjoint(y) for i, x in enumerate(groups) for y in groups[:i])


def test_pairs_are_not_verified_and_linked_in_one_task(spark, monkeypatch):
    """Each Python operator of a task has a worker of its own; four in an executor of two cores took it over its memory."""
    plans, components = [], similar.components

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges)

    monkeypatch.setattr(similar, "components", seen)
    docs = edited()
    table = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert similar.similar_components(table, 4).count() == len(docs)
    assert len(plans) > 1 and not any("MapInArrow" in p for p in plans)


def test_pipeline_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline as p

    docs = p.quality_rules(spark, spark.read.parquet(TEXTS), "").cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = brute_groups(texts)
    got = sorted(r.doc_id for r in p.near_duplicates(spark, docs, "").collect())
    assert got == sorted(set(groups.values()))


def test_rows_that_share_an_id_only_are_kept(spark):
    import corpus_pipeline as p

    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(7, one, "x", "y", 1), (7, one, "x", "y", 1), (7, two, "x", "y", 1), (8, two + " more", "x", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r.doc_id, r.text) for r in p.near_duplicates(spark, docs, "").collect()) == [(7, one), (7, two)]


def test_one_large_group_leaves_one_row(spark):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    docs = {}
    for n in range(240):
        text = list(base)
        for _ in range(n % 3 if n < 150 else 0):  # the rest are exact copies
            text[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        docs[n + 10] = " ".join(text)
    docs |= {1000 + n: " ".join([f"u{n}-{i}" for i in range(30)] + base[:12]) for n in range(20)}
    table = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(7)
    kept = sorted(r.doc_id for r in similar.one_of_each(table, 4).collect())
    assert kept == sorted(set(brute_groups(docs).values()))
