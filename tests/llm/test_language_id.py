"""Held-out accuracy, the weight of each evidence, and the defined cases."""

import random

from quillon.llm import language_id as li

SOUNDS = {"aa": ["th", "er", "ing", "on"], "bb": ["sch", "ung", "ein", "ch"], "cc": ["eau", "oi", "que", "ai"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_accuracy_and_evidence(spark):
    rng = random.Random(5)
    docs = [(i, text(rng, lang), lang, "s1") for i in range(300) for lang in [rng.choice(list(SOUNDS))]]
    d = spark.createDataFrame(docs + [(900, None, None, None), (901, "", "aa", "s9"), (None, "x", "bb", "s1")], "doc_id long, text string, lang string, source string")
    pages = []
    for i in range(150):
        lang = "bb" if i % 3 else "cc"
        pages.append((i, f"http://w{i % 4}.host{lang}.org/{lang}/{i}", f'<html lang="{lang}"><script>thth</script><p>{text(rng, lang, 15)}</p>'))
    pages += [(500, "http://w1.hostbb.org/x", ""), (501, "http://new.org/cc/1", '<html lang="cc">'), (502, None, None), (503, "nothing", "<p>")]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    names, table = li.learn(d)
    assert names == list(SOUNDS)
    out = li.identify(li.from_documents(d).unionByName(li.from_pages(p)), names, table).collect()
    assert len(out) == 303 + len(pages)
    by_doc = {r["doc_id"]: r for r in out if r["page_id"] is None}
    assert sum(by_doc[i]["_q_lang"] == lang for i, _, lang, _ in docs) >= 297
    by_page = {r["page_id"]: r for r in out if r["page_id"] is not None}
    assert by_page[500]["_q_lang"] == "bb" and by_page[501]["_q_lang"] == "cc"
    assert by_page[502]["_q_lang"] == by_page[503]["_q_lang"]
    assert all(0 < r["_q_posterior"] <= 1 for r in out)
    none, empty = li.learn(d.limit(0))
    assert none == [] and {r["_q_lang"] for r in li.identify(li.from_documents(d), none, empty).collect()} == {None}


def test_many_languages_and_the_suffix(spark):
    """More languages than any cap, an address suffix as the only evidence on a new host, repeated rows and clashing columns."""
    rng = random.Random(6)
    spelt = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)] for k in range(40)}
    say = lambda lang, n=60: " ".join(rng.choice(spelt[lang]) for _ in range(n))
    docs = [(i, say(f"l{i % 40:02d}"), f"l{i % 40:02d}", None) for i in range(400)]
    d = spark.createDataFrame([(*r, "x") for r in docs + docs[:5]], "doc_id long, text string, lang string, source string, _q_lang string")
    names, table = li.learn(d)
    assert names == sorted(spelt)
    out = li.identify(li.from_documents(d), names, table).collect()
    assert len(out) == 405
    assert sum(r["_q_lang"] == f"l{r['doc_id'] % 40:02d}" for r in out) >= 403
    pages = [(i, f"https://h{i}.l0{i % 2}t/p", f"<p>{say(f'l0{i % 2}')}</p>") for i in range(60)] + [(99, "https://new.l01t/", ""), (98, "https://w.l00t/" + "a" * 20000, None)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["_q_lang"] for r in li.identify(li.from_pages(p), names, table).collect()}
    assert got[99] == "l01" and got[98] == "l00"
