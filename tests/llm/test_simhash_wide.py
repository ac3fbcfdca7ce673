"""Near-duplicates by similarity against brute force, with large groups and odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import simhash, simhash_wide


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similar(a, b):
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both) and both > 0


def roots(sets, same):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if same(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_shingle_sets():
    texts = ["a b c d e f", "A  b\x0bc\td e", "a b", "a b ", "", None, "x " * 300, "é b É", "a b c d e a b c d e"]
    rows, hashes = simhash_wide.shingles_of(pa.array(texts))
    got = [set(hashes[rows == i].tolist()) for i in range(len(texts))]
    want = [brute_set(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert all((got[i] == got[j]) == (want[i] == want[j]) and len(got[i] & got[j]) == len(want[i] & want[j]) for i in range(len(texts)) for j in range(i))
    h = hashes[rows == 0]
    assert (simhash_wide.votes_of(h) == simhash_wide.votes_of(h, 1)).all()


@pytest.mark.parametrize("block", [512, 5])
def test_groups(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_wide, "BLOCK", block)
    monkeypatch.setattr(simhash_wide, "SMALL", 8 if block > 5 else 3)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 400))) for _ in range(40)]
    texts = base + [edited(rng, t, rng.randint(1, 1 + len(t.split()) // 30)) for t in base for _ in range(3)]
    texts += [edited(rng, base[0], 1) for _ in range(30)] + base[:4]
    texts += ["", None, " ", "one two", "One  two", "one three", "long " * 70_000, "long " * 69_999]
    df = spark.createDataFrame([*enumerate(texts), (None, "alone and null"), (None, base[1]), (3, texts[3])], "doc_id bigint, text string")
    df = df.withColumn("fp", F.lit(1)).withColumn("th", F.lit("x")).withColumn("n", F.lit(0))
    got = simhash_wide.near_duplicates(df).collect()
    assert len(got) == len(texts) + 3
    sets = [brute_set(t) for t in texts]
    want = roots(sets, lambda i, j: (texts[i] or "") == (texts[j] or "") or similar(sets[i], sets[j]))
    mine = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j]]
    assert np.mean([mine[i] == mine[j] for i, j in pairs]) >= 0.95
    assert all(want[c] == want[i] and c <= i for i, c in mine.items())
    kept = simhash.keep_one(df, near=simhash_wide.near_duplicates(df))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and sorted(i for i in ids if i is not None) == sorted(set(mine.values())) and ids.count(None) == 1
    assert simhash_wide.near_duplicates(df.limit(0)).count() == 0


def test_unequal_texts_stay_apart(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choices(vocabulary, k=300))
    df = spark.createDataFrame([(i, edited(rng, base, 20 + i % 20)) for i in range(60)], "doc_id bigint, text string")
    assert {r.component_id for r in simhash_wide.near_duplicates(df).collect()} == set(range(60))


def groups_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash_wide.near_duplicates(df).collect()}
    return [got[i] for i in range(len(texts))]


def test_pairs_among_texts_of_one_template(spark):
    rng = random.Random(13)
    own = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    template = own(200)
    texts = []
    for i in range(600):
        words = template[:170] + own(30)
        texts.append(" ".join(words))
        if i % 10 == 0:  # a partner that shares a part of its own words, too
            texts.append(" ".join(words[:184] + own(16)))
    sets = [brute_set(t) for t in texts]
    want = roots(sets, lambda i, j: similar(sets[i], sets[j]))
    assert 550 < len(set(want)) < len(texts)
    assert groups_of(spark, texts) == want


def test_isolated_pairs_at_the_threshold(spark):
    rng = random.Random(14)
    own = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(200):  # 90 shingles each, 80 in common: 0.8
        words = own(94)
        texts += [" ".join(words), " ".join(words[:84] + own(10))]
    assert similar(brute_set(texts[0]), brute_set(texts[1]))
    assert groups_of(spark, texts) == [i - i % 2 for i in range(len(texts))]


def test_marks_rule_out_no_link():
    rng = np.random.default_rng(15)
    sets, pairs = [], []
    for n in [1, 2, 5, 31, 32, 33, 64, 90, 127, 128, 129, 500, 4097]:
        for shared in sorted({n, n - 1, -(-8 * n // 9), (8 * n + 17) // 9, n // 2, 0}):
            if 0 <= shared <= n:
                both, own = rng.integers(0, 1 << 64, shared, np.uint64), [rng.integers(0, 1 << 64, k, np.uint64) for k in (n - shared, max(n - shared, n // 5))]
                pairs.append((len(sets), len(sets) + 1, shared))
                sets += [np.concatenate([both, x]) for x in own]
    n, marks = np.array([len(s) for s in sets]), [simhash_wide.marks_of(s) for s in sets]
    a, b, shared = np.array(pairs).T
    got = simhash_wide.can_link(n[a], pa.array([marks[i] for i in a], pa.binary()), n[b], pa.array([marks[i] for i in b], pa.binary()))
    linked = 9 * shared >= 4 * (n[a] + n[b])
    assert linked.sum() > 10 and got[linked].all()
    assert not got[(2 * shared <= np.minimum(n[a], n[b])) & (n[a] > 30)].any()


def test_sets_are_written_for_close_pairs_only(spark, monkeypatch):
    """Many texts that share a third of their shingles meet; their sets are not what is written."""
    rng = random.Random(16)
    own = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    template = own(100)
    texts = [" ".join(template + own(100)) for _ in range(150)]
    texts += [edited(rng, t, 2) for t in texts[:5]]
    rows, write = {}, simhash_wide.settle

    def settle(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash_wide, "settle", settle)
    monkeypatch.setattr(simhash_wide, "common_shingles", lambda *_: np.zeros(0, np.uint64))  # any order is without loss
    want = [*range(150), *range(5)]
    assert groups_of(spark, texts) == want
    assert rows["unjoined"] > 1000 and rows["sets"] <= 20
    # many parts give the same groups
    monkeypatch.setattr(simhash_wide, "LEAST", 1)
    monkeypatch.setattr(simhash_wide, "BY_SETS", 0.02)
    monkeypatch.setattr(simhash_wide, "BY_MARKS", 50)
    assert groups_of(spark, texts) == want
