"""Near-duplicate groups against all pairs of full sets."""

import random

import numpy as np
import pyarrow as pa

from quillon.llm import near_dedup as nd

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def family(rng, n, edits, words=60):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_same_groups_as_all_pairs(spark):
    rng = random.Random(4)
    texts = [None, "", "a b", "A b", "one", "one two three", "one two three", "Ä é", " \t\n", "z " * 3000]
    texts += family(rng, 40, 4) + family(rng, 12, 2, 25) + family(rng, 12, 1, 8) + family(rng, 30, 0, 1)
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[20]), (7, texts[7])]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows] + [(None, texts[20], "s")], "doc_id long, text string, rep string")
    out = nd.near_duplicates(docs).collect()
    want = brute(rows)
    assert len(out) == len(rows) + 1
    for r in out:
        assert r["component_id"] == (want[r["_q_id"]] if r["_q_id"] is not None else None)
    assert sorted(r["n_shingles"] for r in out if r["_q_id"] is not None) == sorted(len(shingles(t)) for _, t in rows)
    kept = {r["doc_id"] for r in nd.stage(spark, docs, "").collect()}
    assert kept == {d for d, c in want.items() if d == c} | {None}
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(9)
    a = [f"a{i}" for i in range(300)]
    errors = []
    for share in (0.5, 0.8, 0.9):
        b = a[: int(300 * share)] + [f"b{rng.random()}" for _ in range(300 - int(300 * share))]
        keys, counts = nd.shingle_sets(pa.array([" ".join(a), " ".join(b)]), 1)
        sig = nd.super_minhash(keys, counts)
        errors.append((sig[0] == sig[1]).mean() - len({*a} & {*b}) / len({*a} | {*b}))
    assert np.abs(errors).max() < 0.15
    assert (nd.super_minhash(keys, counts) < np.uint64(2**63)).all()


def test_copies_of_a_lost_original(spark):
    """No copy is central: most links are between copies that no hub has confirmed."""
    rng = random.Random(6)
    texts = []
    for edits in (3, 4):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(150):
            copy = list(base)
            for k in rng.sample(range(200), edits):
                copy[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    want = brute(rows)
    assert 1 < len(set(want.values())) < len(rows)
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["_q_id"]: r["component_id"] for r in got} == want


def test_crowded_bucket(spark):
    """Pages around one boilerplate core, just under the threshold with each other, and planted pairs just above it."""
    rng = random.Random(11)
    core = [f"c{i}" for i in range(240)]
    own = lambda: [f"o{rng.randrange(10**9)}" for _ in range(30)]
    texts = [" ".join(core + own()) for _ in range(200)]
    for _ in range(60):
        mine = own()
        texts += [" ".join(core + mine), " ".join(core + mine[:4] + own()[4:])]
    rows = list(enumerate(texts))
    want = brute(rows)
    assert len(set(want.values())) == len(rows) - 60
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r["_q_id"]: r["component_id"] for r in got} == want


def test_two_texts_of_one_document(spark):
    """A document of two different texts links the copies of both; columns of internal names are passed through."""
    rng = random.Random(12)
    a, b = family(rng, 8, 2), family(rng, 8, 2)
    rows = [(d, t) for d, t in enumerate(a + b)] + [(3, b[0]), (3, a[3])]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, _q_id string, component_id int")
    got = {r["_q_id"]: r["component_id"] for r in nd.near_duplicates(docs).collect()}
    assert got == brute(rows)
    assert nd.stage(spark, docs, "").columns == docs.columns
