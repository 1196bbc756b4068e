"""Verdicts against a direct reading of the rules, and exactness of the cascade."""

import random

from pyspark.sql import functions as F

from quillon.llm import url_filter as uf


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fit) if fit else None
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_verdicts(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/", "https://com", "http://a.example.com/en/x?y#z", "http://www.EXAMPLE.com/en/", "http://xwww.example.com/en/", "http://notexample.com/en/1", "ftp://b.net/es/", "ftp://b.net/es", "http://b.net/fr/?q=/es/", "http://net/fr/a", "a://b://net/es/", "http://x.net:80/es/", "http://É.COM/ü", "http://u@q.org/fr/", "http://a..com/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")
    out = uf.judge(pages).collect()
    assert len(out) == len(urls) * 2
    for r in out:
        assert (r["_q_host"], r["_q_path"], r["_q_rule"], r["_q_verdict"]) == plain(r["url"], uf.RULES), r["url"]
    assert uf.judge(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    rng = random.Random(3)
    universe = [f"k{i}" for i in range(400)]
    listed = rng.sample(universe, 100) + ["elsewhere"]
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    for bits in (16, 3):
        uf.BITS_PER_KEY, keep = bits, uf.BITS_PER_KEY
        try:
            made = uf.Cascade(frame(listed), frame(universe))
            found = {r["key"] for r in frame(universe).where(made.member(F.col("key"))).collect()}
        finally:
            uf.BITS_PER_KEY = keep
        assert found == set(listed) & set(universe)
    assert len(made.levels) > 1
