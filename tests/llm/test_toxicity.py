"""Compression distances: held-out accuracy and the defined cases."""

import random

from quillon.llm import toxicity


def corpus(seed, n):
    rng = random.Random(seed)
    usual = ["".join(rng.choice(["th", "er", "on", "an", "re", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad = ["grobnik", "vakuldo", "sputzen"]
    out = []
    for i in range(n):
        words = [rng.choice(usual) for _ in range(60)]
        y = int(i % 4 == 0)
        if y:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((" ".join(words), y))
    return out


def test_held_out_accuracy():
    data = corpus(3, 600)
    model = toxicity.train(data[:400])
    made = toxicity.Scorer(model)
    assert sum((made.score(t) >= 0.5) == y for t, y in data[400:]) >= 196


def test_defined_cases(spark):
    data = corpus(5, 200)
    rows = [(i, t) for i, (t, _) in enumerate(data)] + [(900, None), (901, ""), (902, "x" * 100_000), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(data)] + [(0, 1, None), (1, 0, 7), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r["_q_score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert got[900] == got[901]
    assert sum((got[i] >= 0.5) == y for i, (_, y) in enumerate(data)) >= 190
    empty = toxicity.learn(docs.limit(0), labels)
    assert {r["_q_score"] for r in toxicity.score(docs, empty).collect()} == {0.0}
