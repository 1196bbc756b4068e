"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic text and one on
windows of ordinary text. A window is one word in lower case. It is compressed
between fixed carriers (so that a frame's fixed cost cancels out and its last bytes,
where no matches are sought, are theirs) once with each dictionary; the window's distance is the bytes that the toxic dictionary saves
over the ordinary one. A document is known by its two largest distances and the
share of windows over a calibrated distance; a logistic curve, calibrated on
labelled documents that trained no dictionary, makes that a score.

The training sample is bounded: at most ``SAMPLE_TOXIC`` and ``SAMPLE_ORDINARY``
labelled documents, those of the smallest hash of doc_id, texts whole. The
toxic dictionary is trained on those windows of toxic texts whose beginning has
significantly more neighbourhoods (word before, word after) in toxic texts than
in ordinary ones, so that one text copied many times cannot fill it; what both
sides share is the common part of both dictionaries, so that it tells nothing. Everything else covers all rows.

Defined cases: null and empty texts score as a text without windows; a label
other than 0 or 1 and a null doc_id are no label; of several labels for a
document toxic counts; without labels of both classes all scores are 0.0;
a null doc_id is not held out; very long texts are scored whole; equal scores are
equal, and of windows of equal distance all count; repeated rows are scored each; an
empty table gives no rows. Rows and extra columns are kept as they are.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, released, shielded
from .words import slices

SAMPLE_TOXIC = 1500
SAMPLE_ORDINARY = 4500
TOXIC_BYTES = 4096
SHARED_BYTES = 16384
CARRIER = b" of and the in that "
CACHE_WINDOWS = 100_000
#: A beginning of a window is typical of toxic text if chance gives it so many neighbourhoods there less often than this.
CHANCE = 1e-7
STEM = range(4, 11)
_WORD = re.compile(r"[^\W\d_]+")


def windows(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: float
    weights: tuple[float, ...]

    def key(self) -> int:
        return hash((self.toxic, self.ordinary))


class Scorer:
    """Distances of windows, remembered up to a bound, and scores of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.cache: dict[str, int] = {}
        self.toxic, self.ordinary = self._side(model.toxic), self._side(model.ordinary)

    @staticmethod
    def _side(content: bytes):
        dictionary = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=15, hash_log=14, chain_log=14, search_log=6
        )
        made = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how)
        return made.compress, len(made.compress(CARRIER + CARRIER))

    def distance(self, word: str) -> int:
        window = CARRIER + b" " + word.encode() + b" " + CARRIER
        (ordinary, least_o), (toxic, least_t) = self.ordinary, self.toxic
        return (len(ordinary(window)) - least_o) - (len(toxic(window)) - least_t)

    def distances(self, text: str) -> list[int]:
        cache = self.cache
        if len(cache) > CACHE_WINDOWS:
            cache.clear()
        found = windows(text)
        for w in set(found).difference(cache):
            cache[w] = self.distance(w)
        return [cache[w] for w in found]

    def features(self, text: str) -> np.ndarray:
        d = np.array(self.distances(text), dtype=float)
        if not len(d):
            return np.zeros(5)
        top = np.append(np.sort(d)[::-1][:3], [0.0, 0.0])
        over = [int((d >= t).sum()) for t in (1, 2, self.model.threshold)]
        return np.array([max(top[0], 0.0), max(top[1], 0.0), min(over[1], 4), min(over[2], 4), min(1.0, 20 * over[0] / len(d))])

    def score(self, text: str) -> float:
        if not self.model.weights:
            return 0.0
        w = np.array(self.model.weights)
        return float(1 / (1 + np.exp(-np.clip(w[0] + self.features(text) @ w[1:], -30, 30))))


def neighbourhoods(texts: list[str]) -> set[tuple[str, str, str]]:
    """Every window with the words before and after it."""
    seen = set()
    for t in texts:
        found = windows(t)
        seen.update(zip(["", *found], found, [*found[1:], ""], strict=False))
    return seen


def stems(seen: set[tuple[str, str, str]]) -> Counter:
    """In how many different neighbourhoods each beginning of a window stands; a whole window ends with a space."""
    out: Counter = Counter()
    for _, w, _ in seen:
        if len(w) > 2:
            out[w + " "] += 1
            out.update(w[:n] for n in STEM if n < len(w))
    return out


def typical(toxic: Counter, ordinary: Counter) -> set[str]:
    """Beginnings that stand in significantly more toxic neighbourhoods (an upper bound of the binomial tail)."""
    n, m = sum(v for k, v in toxic.items() if k[-1] == " "), sum(v for k, v in ordinary.items() if k[-1] == " ")
    share = n / max(1, n + m)
    out = set()
    for w, a in toxic.items():
        b = ordinary.get(w, 0)
        q = a / (a + b)
        if a >= 3 and q > share:
            rest = (1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0
            if (a + b) * (q * math.log(q / share) + rest) > -math.log(CHANCE) and q > min(0.9, 4 * share):
                out.add(w)
    return out


def dictionary(chosen: Counter, size: int) -> bytes:
    """A dictionary trained on the chosen windows, in lines of 16; windows that the trainer leaves out go before, the commonest last."""
    windows = [f" {w} ".encode() for w, a in sorted(chosen.items()) for _ in range(min(a, 1000))]
    random.Random(len(windows)).shuffle(windows)
    try:
        trained = zstandard.train_dictionary(size, [b"".join(windows[i : i + 16]) for i in range(0, len(windows), 16)], k=32, d=6)
        content = trained.as_bytes()[-size:]
    except zstandard.ZstdError:  # too few windows to train on
        content = b""
    for w, _ in sorted(chosen.items(), key=lambda x: (-x[1], x[0])):
        if len(content) + len(w) + 2 > size:
            break
        if f" {w} ".encode() not in content:
            content = f" {w} ".encode() + content
    return content or b" " * 8


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Penalised logistic regression by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ ((p - y)) + 0.05 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(texts: list[tuple[str, int]]) -> Model:
    """texts: (text, label) in a fixed order. Of each class every third text calibrates, the others train dictionaries."""
    sides = [[(t, y) for t, y in texts if bool(y) == side] for side in (True, False)]
    fit = [x for side in sides for i, x in enumerate(side) if i % 3]
    rest = [x for side in sides for x in side[::3]]
    toxic, ordinary = neighbourhoods([t for t, y in fit if y]), neighbourhoods([t for t, y in fit if not y])
    if not toxic or not ordinary:
        return Model(b" " * 8, b" " * 8, 1.0, ())
    chosen = typical(stems(toxic), stems(ordinary))
    own = Counter(w for _, w, _ in toxic if w + " " in chosen or any(w[:n] in chosen for n in STEM))
    usual = Counter(w for _, w, _ in ordinary if w not in own)
    shared = dictionary(Counter({w: n for w, n in usual.items() if n > 1}), SHARED_BYTES)
    plain = Model(dictionary(own, TOXIC_BYTES) + shared, shared, 1.0, ())
    scorer = Scorer(plain)
    y = np.array([label for _, label in rest])
    largest = np.array([max(scorer.distances(t), default=0) for t, _ in rest])
    steps = range(1, 9)
    threshold = float(max(steps, key=lambda s: ((largest >= s) == y)[y == 1].mean() + ((largest >= s) == y)[y == 0].mean() if 0 < y.sum() < len(y) else 0))
    scorer = Scorer(Model(plain.toxic, plain.ordinary, threshold, ()))
    return Model(plain.toxic, plain.ordinary, threshold, _logistic(np.array([scorer.features(t) for t, _ in rest]), y))


def held_out(modulus: int = 5, remainder: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, ordinary: int = SAMPLE_ORDINARY) -> Model:
    """A model from a bounded sample of the labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y")).where(~held_out())
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("y = 1").orderBy(*by_hash).limit(toxic).unionByName(known.where("y = 0").orderBy(*by_hash).limit(ordinary))
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")  # the sample is bounded by its two limits
    rows = sorted({(r["doc_id"], r["text"], r["y"]) for r in found.collect()}, key=lambda r: (hash_order(r[0]), r[0], r[1]))
    return train([(t, y) for _, t, y in rows])


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % 2**64 >> 11


_SCORERS: dict[Model, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """One scorer for each worker and model."""
    if model not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model] = Scorer(model)
    return _SCORERS[model]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``_q_score``."""

    def run(batches):
        made = scorer(model)
        for table in slices(batches, text=text):
            values = [made.score(t or "") for t in table.column(text).to_pylist()]
            yield from table.append_column("_q_score", pa.array(values, pa.float64())).to_batches()

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField("_q_score", T.DoubleType())]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("_q_score").alias("score"), (F.col("_q_score") >= 0.5).cast("int").alias("predicted"))


@shielded
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score under 0.5; the labels of sf_dir train the model on the stage's own documents."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where("_q_score < 0.5").drop("_q_score")


QUERIES: dict[str, Callable] = {"op4_toxicity": op4_toxicity}
ORACLE: dict[str, str] = {}
