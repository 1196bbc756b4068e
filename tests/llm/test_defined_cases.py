"""Every query on odd tables: nulls in every column, empty and very long texts, repeated rows, clashing column names, no rows."""

import random

import pytest

from quillon.llm import registry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, _q_score double, _q_text string, _q_id long, kept boolean, n_tokens long, `a b` string, rank int"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, score long, query_id long, q array<double>"
PAGES = "page_id long, url string, html string, host string, rule string, _q_text string, _q_host string, path string"
BENCHMARK = "item_id long, text string, hash long, doc_id long, total int"
LABELS = "doc_id long, quality int, toxic int, text string, y int"


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = {i: text(80) for i in range(40)}
    texts |= {50: None, 51: "", 52: " \t\n ", 53: text(30000), 54: "w" * 300_000, 55: "é🙂 x", 56: texts[5], 57: texts[5] + " tail", 58: texts[6].upper()}
    clash = (0.5, 0.5, "t", 7, True, 3, "ab", 1)
    documents = [(i, t, "en", f"s{i % 3}", 1, *clash) for i, t in texts.items()]
    documents += [documents[3], documents[3], (None, texts[8], None, None, None, *[None] * 8), (None, None, None, None, None, *[None] * 8), (60, texts[9], None, None, None, *[None] * 8)]
    vector = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    embeddings = [(i, vector(), 1, 1, 1, [1.0]) for i in range(0, 300, 10)]
    embeddings += [embeddings[0], embeddings[1], (400, None, None, None, None, None), (500, [], 1, 1, 1, None), (600, [float("nan")] * 6, 1, 1, 1, None), (None, vector(), 1, 1, 1, None), (700, embeddings[0][1], 1, 1, 1, None)]
    pages = [(i, f"http://www.example{i % 4}.com/en/{i}", f"<html lang='en'><body><p>{text(30)}</p></body></html>", "h", "r", "t", "h", "p") for i in range(20)]
    pages += [pages[2], (30, None, None, *[None] * 5), (31, "", "", *[None] * 5), (32, "no scheme", "<p>", *[None] * 5), (None, "http://a.com", "x", *[None] * 5), (33, "http://a.net/es/" + "x" * 200_000, "<p>" + text(20000), *[None] * 5)]
    return {
        "documents": (documents, DOCUMENTS),
        "embeddings": (embeddings, EMBEDDINGS),
        "pages": (pages, PAGES),
        "benchmark": ([(1, texts[7], 1, 1, 1), (2, None, 1, 1, 1), (None, "a b c d e f", 1, 1, 1), (3, "", 1, 1, 1), (1, texts[7], 1, 1, 1)], BENCHMARK),
        "labels": ([(i, 1, int(i % 4 == 0), "x", 1) for i in range(30)] + [(None, 1, 1, "x", 1), (3, None, None, None, None), (4, 1, 7, "x", 1), (5, 1, 1, "x", 1)], LABELS),
    }


@pytest.fixture(scope="module")
def folders(spark, odd, tmp_path_factory):
    made = {}
    for kind in ("odd", "empty"):
        made[kind] = str(tmp_path_factory.mktemp(kind))
        for name, (rows, schema) in odd.items():
            spark.createDataFrame(rows if kind == "odd" else [], schema).write.parquet(f"{made[kind]}/{name}.parquet")
    return made


#: The columns that each contract asks for, and the table whose rows are answered one by one.
CONTRACTS = {
    1: ("documents", "doc_id n_words n_removed kept_sha256"),
    2: ("documents", "doc_id"),
    3: (None, "query_id rank vec_id score"),
    4: ("documents", "doc_id held_out score predicted"),
    5: ("documents", "doc_id start n_tokens ids_crc32"),
    6: ("documents", "doc_id n_shingles component_id kept"),
    7: ("pages", "page_id host path rule verdict"),
    8: ("documents", "doc_id held_out n_tokens n_known train_tokens base_score score"),
    9: ("documents", "doc_id n_tokens ids_sha256 decoded_sha256"),
    10: (None, ""),
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_tables(spark, odd, folders, name):
    table, columns = CONTRACTS[int(name[2:].split("_")[0])]
    got = registry.QUERIES[name](spark, folders["odd"])
    rows = got.collect()
    assert set(columns.split()) <= set(got.columns)
    assert len(got.columns) == len(set(got.columns))
    if table:
        key = "page_id" if table == "pages" else "doc_id"
        count = lambda ids: sorted(ids, key=lambda i: (i is None, i or 0))
        assert count(r[key] for r in rows) == count(r[0] for r in odd[table][0])
    if name.startswith("op10"):  # every document and every page
        assert len(rows) == len(odd["documents"][0]) + len(odd["pages"][0])
    empty = registry.QUERIES[name](spark, folders["empty"])
    assert empty.columns == got.columns
    assert empty.collect() == []
