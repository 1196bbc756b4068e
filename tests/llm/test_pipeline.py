"""The pipeline against the same steps done by brute force on a small corpus."""

import hashlib
import random

import corpus_pipeline
import public_tokenizers
import tiktoken

from quillon.llm import bpe, toxicity
from tests.llm.test_near_dedup import brute


def remove_repeats(rows, n=50):
    words = {d: (t or "").split() for d, t in rows}
    first = {}
    for d in sorted(words):
        for p in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][p : p + n]), d)
    out = []
    for d, t in rows:
        gone = {q for p in range(len(words[d]) - n + 1) if first[tuple(words[d][p : p + n])] < d for q in range(p, p + n)}
        out.append((d, " ".join(w for i, w in enumerate(words[d]) if i not in gone) if gone else t))
    return out


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    usual = ["".join(rng.choice(["th", "er", "on", "an", "re", "ed", "ing"]) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(usual) for _ in range(n))
    items = [(i, text(20)) for i in range(5)]
    shared = text(70)
    rows, labels = [], []
    for i in range(240):
        t = text(rng.randint(30, 90))
        if i % 6 == 0:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["grobnik", "vakuldo", "sputzen"]))
            t = " ".join(w)
        elif i % 10 == 1:
            t = f"{t} {shared} {text(5)}"
        elif i % 10 == 2:
            t = f"{t} {rng.choice(items)[1]}"
        elif i % 10 == 3 and i > 20:
            t = rows[i - 10][1]
        rows.append((i, t))
        if i < 180:
            labels.append((i, 1, int(i % 6 == 0)))
    rows += [(500, None), (501, ""), (502, "short")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = toxicity.learn(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    made = toxicity.Scorer(model)
    rows = [(d, t) for d, t in rows if made.score(t or "") < 0.5]
    assert not any(d % 6 == 0 and d < 240 for d, _ in rows)
    groups = brute(rows)
    rows = [(d, t) for d, t in rows if groups[d] == d]
    rows = remove_repeats(rows)
    rows = [(d, t) for d, t in rows if not any(x in (t or "") for _, x in items)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})
    assert set(got) == {d for d, _ in rows}
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_stages_on_odd_tables(spark, tmp_path):
    """Columns of internal names, repeated rows, nulls in every column, one long text, and no rows at all."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(60)), "en", "s", 1, "x", 0.5, "y", i) for i in range(30)]
    rows += [rows[3], (None, "text without id", None, None, None, None, None, None, None), (40, None, None, None, None, None, None, None, None), (41, " ".join(word() for _ in range(20000)), None, "s", None, "x", None, "y", 2)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, _q_text string, _q_score double, `a b` string, component_id long"
    docs = spark.createDataFrame(rows, kind)
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a question that nobody asks here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = {tuple(r) for r in out.collect()}
        assert kept <= {tuple(r) for r in docs.collect()}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, str(tmp_path)).count() == len(rows)
    assert last(spark, docs.limit(0), str(tmp_path)).count() == 0
