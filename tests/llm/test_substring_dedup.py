"""Removed passages against brute force."""

import random

from quillon.llm import substring_dedup as sd


def brute(rows, n):
    """(n_words, n_removed, kept words) of each row; a null doc_id takes no part."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for p in range(len(w) - n + 1):
                key = tuple(w[p : p + n])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = {q for p in range(len(w) - n + 1) if d is not None and first[tuple(w[p : p + n])] < d for q in range(p, p + n)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(rng.randint(5, 30))] for _ in range(12)]
    rows = []
    for i in range(200):
        w = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w[k:k] = rng.choice(passages)
        rows.append((rng.randrange(150), rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(None, rows[5][1]), (-7, rows[9][1]), (10**15, rows[9][1]), (3, None), (4, ""), (5, " é ß  \t"), (6, "same " * 4000), (7, "same " * 4000), rows[0]]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, chunk int")
    for settings in ({}, {"range_bytes": 400, "group_suffixes": 50}):
        got = sd.remove_repeats(docs, window=8, **settings).collect()
        assert sorted([(r["doc_id"], r["_q_n_words"], r["_q_n_removed"], r["_q_kept"]) for r in got], key=repr) == brute(rows, 8)
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_heavy_prefixes_are_lengthened():
    counts = sd.np.zeros(1 << 16, sd.np.int64)
    counts[[3, 10, 11, 900]] = [5, 1000, 4, 3]
    first, parts, n = sd.prefix_groups(counts, 100)
    assert parts[10] == 10 and parts[3] == 1 and first[11] == first[900] == n - 1 == 11
