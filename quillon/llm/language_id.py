"""Language identification by fusing evidence in Bayes' way.

For each text and language l: log P(l | everything) is, up to a constant, the log
prior of l on the text's host, plus the log likelihoods of the declared markup
language, of the language part of the address's path and of the address's suffix
(the host's last label) under l, plus the tempered log likelihood of the text's
letters. The letters' model is trained on a bounded, labelled sample of every
labelled language (``SAMPLE`` documents each, of the smallest hash of doc_id,
held-out documents excluded). All else is counted over all rows by grouped
aggregation; a row counts for each language by the share that its letters alone
give it, so that ambiguous rows count for several: how often each declared
language, path part and suffix goes with each language, and, hierarchically
smoothed, how often each host has each language (host, then its domain, then all
rows).

Defined cases: null and empty texts, missing or unknown declarations, addresses
and hosts are no evidence, so a row with none gets the overall prior; very long
texts enter whole; rows and repeated rows are kept one by one and count each; an
empty table gives no rows; without labelled documents the language is null. Ties
go to the language first in alphabetical order. Extra columns are ignored by the
query and passed through by ``identify``, which uses names that begin with _q_.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import documents, forget, released, written
from .url_filter import host_and_path
from .words import LOWER, slices, text_bytes

SAMPLE = 1000
#: Neighbouring letter groups overlap, so their likelihood counts for less; and at most so much in all.
TEMPER, MOST = 0.3, 60.0
SMOOTH = 5.0
_BITS = 16


def letters(column) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed letter groups of three bytes, each one's text, and the number of texts."""
    data, offsets = text_bytes(column)
    b = LOWER[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), len(offsets) - 1
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(32 - _BITS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[:-2] == text[2:]
    return code[inside].astype(np.int64), text[:-2][inside], len(offsets) - 1


def train(rows: list[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and the log probability of each letter group in each."""
    names = sorted({lang for lang, _ in rows})
    table = np.full((len(names), 1 << _BITS), 0.1)
    for k, name in enumerate(names):
        code, _, _ = letters(pa.array([t for lang, t in rows if lang == name], pa.string()))
        table[k] += np.bincount(code, minlength=1 << _BITS)
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if names else table.astype(np.float32)


def held_out(modulus: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """A model of every labelled language from at most ``sample`` of its documents."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))  # tasks keep sample rows of a language each
    ids = known.select("doc_id", "lang").withColumn("_i", place).where(F.col("_i") <= sample).select("doc_id").distinct()
    ids = written(ids, "sample-ids")  # its size is known then, so that it is broadcast while it is small
    rows = known.select("doc_id", "text", "lang").join(ids, "doc_id").select("text", "lang").collect()  # sample rows of each language
    forget(ids)
    return train(sorted((r["lang"], r["text"]) for r in rows))


def _likelihood(table: np.ndarray, passed: list[str]):
    def run(batches):
        for part in slices(batches, 1 << 20, "_q_text"):
            code, text, n = letters(part.column("_q_text"))
            total = np.stack([np.bincount(text, table[k][code], n) for k in range(len(table))], axis=1) if len(table) else np.zeros((n, 0))
            total *= TEMPER
            total -= total.max(axis=1, keepdims=True) if len(table) else 0
            out = part.select(passed).append_column("_q_log", pa.array(list(np.maximum(total, -MOST)), pa.list_(pa.float64())))
            yield from out.to_batches()

    return run


def identify(items: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """items with _q_lang and _q_posterior; items: any columns besides _q_text, _q_declared, _q_address, _q_suffix, _q_host, _q_domain."""
    passed = [c for c in items.columns if c != "_q_text"]
    used = ["_q_declared", "_q_address", "_q_suffix", "_q_host", "_q_domain"]
    schema = items.drop("_q_text").schema.add("_q_log", ArrayType(DoubleType()))
    if not names:
        return items.drop("_q_text", *used).withColumns({"_q_lang": F.lit(None).cast("string"), "_q_posterior": F.lit(None).cast("double")})
    told = written(items.mapInArrow(released(_likelihood(table, passed)), schema), "language-evidence")
    size = len(names)
    exps = F.transform("_q_log", F.exp)
    voted = told.withColumn("_q_e", exps).withColumn("_q_z", F.aggregate("_q_e", F.lit(0.0), lambda a, x: a + x)).withColumn("_q_p", F.transform("_q_e", lambda x: x / F.col("_q_z")))
    sums = F.array(*[F.sum(F.get("_q_p", F.lit(k))) for k in range(size)])
    overall = np.array(voted.agg(sums.alias("n")).first()["n"] or [0.0] * size, dtype=float)
    overall = np.where(np.isnan(overall), 0.0, overall)
    prior = (overall + 1) / (overall.sum() + size)
    at = lambda c: F.array_position(F.lit(names), F.col(c)).cast("int") - 1
    tables = {}
    for c in ("_q_declared", "_q_address"):  # a row for each language
        cells = np.ones((size, size)) * SMOOTH / size
        for r in voted.where(F.col(c).isin(names)).groupBy(c).agg(sums.alias("n")).collect():
            cells[names.index(r[c])] += r["n"]
        tables[c] = F.from_json(F.lit(json.dumps(np.log(cells / cells.sum(axis=0, keepdims=True)).tolist())), "array<array<double>>")
    numbers = lambda x: F.array(*[F.lit(float(v)) for v in x])
    none = numbers([0.0] * size)
    log_of = lambda c: F.when(at(c) >= 0, F.get(tables[c], at(c))).otherwise(none)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    # a suffix's likelihood, smoothed by its share of all rows
    every = numbers(overall + SMOOTH)
    suffix = voted.where("_q_suffix is not null").groupBy("_q_suffix").agg(sums.alias("n"))
    common = total("n") / F.lit(float(max(overall.sum(), 1e-9)))
    suffix = suffix.select("_q_suffix", F.zip_with("n", every, lambda x, y: F.log((x + F.lit(SMOOTH) * common + 1e-12) / y)).alias("_q_told"))
    domain = voted.where("_q_domain is not null").groupBy("_q_domain").agg(sums.alias("domain_n"))
    host = voted.where("_q_host is not null").groupBy("_q_host", "_q_domain").agg(sums.alias("host_n"))
    level = numbers(prior)
    share = lambda n, parent: F.zip_with(n, parent, lambda x, p: (x + F.lit(SMOOTH) * p) / (total(n) + F.lit(SMOOTH)))
    priors = host.join(domain, "_q_domain", "left").select("_q_host", F.col("_q_domain").alias("d"), share(F.col("host_n"), F.coalesce(share(F.col("domain_n"), level), level)).alias("p"))
    priors = priors.groupBy("_q_host").agg(F.min_by("p", F.coalesce("d", F.lit(""))).alias("_q_prior"))
    joined = told.join(priors, "_q_host", "left").join(suffix, "_q_suffix", "left")
    log = add(add(F.transform(F.coalesce("_q_prior", level), lambda x: F.log(x)), F.col("_q_log")), add(F.coalesce("_q_told", none), add(log_of("_q_declared"), log_of("_q_address"))))
    joined = joined.withColumn("_q_sum", log).withColumn("_q_top", F.array_max("_q_sum"))
    best = F.array_position("_q_sum", F.col("_q_top")).cast("int") - 1
    posterior = 1 / F.aggregate("_q_sum", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_q_top")))
    out = joined.withColumns({"_q_lang": F.get(F.lit(names), best), "_q_posterior": posterior})
    return out.drop("_q_log", "_q_sum", "_q_top", "_q_prior", "_q_told", *used)


def visible(html: Column) -> Column:
    """A page's text: without scripts, styles, comments and tags."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(out, r"(?s)<[^>]*>", " ")


def from_pages(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    short = lambda c: F.nullif(F.lower(F.regexp_extract(c, r"^([A-Za-z]{2,3})", 1)), F.lit(""))
    declared = short(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1))
    labels = F.split(host, r"\.")
    return pages.select(
        F.lit(None).cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint").alias("page_id"), visible(F.col("html")).alias("_q_text"), declared.alias("_q_declared"),
        short(F.regexp_extract(path, r"^/([A-Za-z]{2,3})(?:/|$)", 1)).alias("_q_address"),
        F.nullif(F.regexp_extract(host, r"\.([^.:]*[^.:0-9][^.:]*)(?::\d+)?$", 1), F.lit("")).alias("_q_suffix"), F.nullif(host, F.lit("")).alias("_q_host"),
        F.nullif(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."), F.lit("")).alias("_q_domain"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("page_id"), F.col("text").alias("_q_text"), none.alias("_q_declared"), none.alias("_q_address"), none.alias("_q_suffix"), F.concat(F.lit("source:"), "source").alias("_q_host"), F.lit("source:").alias("_q_domain"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (doc_id) and every page (page_id) with its language and that language's posterior."""
    docs = documents(spark, sf_dir)
    names, table = learn(docs)
    items = from_documents(docs).unionByName(from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return identify(items, names, table).select("doc_id", "page_id", F.col("_q_lang").alias("lang"), F.col("_q_posterior").alias("posterior"))


QUERIES: dict[str, Callable] = {"op10_language_id": op10_language_id}
ORACLE: dict[str, str] = {}
