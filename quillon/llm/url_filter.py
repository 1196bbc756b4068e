"""URL filters by Bloom filter cascades, in DataFrame functions only.

A rule lists a key, its host and path put together; a url may be fitted by the
keys made of its host or any parent domain and of any beginning of its path that
is as long as some rule's path. The corpus's distinct keys are the complete
universe. A cascade's first level encodes the listed keys; the second encodes the
keys of the universe that the first lets through although they are not listed;
the third encodes the listed keys that the second lets through; and so on until
nothing wrong is left. A key is in the set exactly if the first level that
rejects it is an even one, so every key of the universe is judged rightly
without any join. There is one cascade of blocking keys and one of allowing keys.

What reaches the driver is the bits of each level (16 for each key it encodes; the
first level follows the rule list, the others the first level's errors), and a
plan holds them as constants.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
case; path: then up to ``?``, ``#`` or the end. Defined cases: null and urls
without ``://`` have an empty host and path and fit no rule; where no rule fits the
verdict is ``allow`` and the rule null; of fitting rules the longest key wins, and
a rule listed as both allows. Extra columns and repeated rows
are kept; very long urls are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
HASHES = 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    place = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(place, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(place, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def keys_of(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys that could fit, longest first: the host and its parent domains with each beginning of the path."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substr(path, F.lit(1), F.lit(n))) for n in path_lengths]), lambda p: p.isNotNull())
    made = F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat(h, p)))))
    longest = F.transform(made, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(longest), lambda s: s["k"]))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """Where a key's bits are, by double hashing."""
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    a, b = F.pmod(a, F.lit(bits)), F.pmod(b, F.lit(bits))
    return [F.pmod(a + b * F.lit(i), F.lit(bits)) for i in range(HASHES)]


class Level:
    """One Bloom filter: its number of bits and the words that hold them."""

    def __init__(self, number: int, keys: DataFrame):
        n = keys.count()
        self.number, self.bits = number, max(64, -(-n * BITS_PER_KEY // 64) * 64)
        at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, self.bits))).alias("at"))
        word = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))).alias("v"))
        self.words = [0] * (self.bits // 64)
        for r in word.collect():  # BITS_PER_KEY bits for each key of the level
            self.words[r["word"]] = r["v"]

    def has(self, key: Column) -> Column:
        words = F.lit(self.words)
        held = [F.getbit(F.get(words, (p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _positions(key, self.number, self.bits)]
        out = held[0]
        for h in held[1:]:
            out = out & h
        return out


class Cascade:
    """Exact membership of the keys of a universe in a list of keys."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        """Both have the distinct strings ``key``; listed keys outside of the universe do no harm."""
        self.levels: list[Level] = []
        inside, outside = listed, universe.join(listed, "key", "left_anti")
        while inside.limit(1).count():
            level = Level(len(self.levels), inside)
            self.levels.append(level)
            # what the level lets through wrongly is what the next one encodes
            inside, outside = outside.where(level.has(F.col("key"))), inside

    def member(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)  # passed by all levels: the last one's kind
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def judge(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """pages with _q_host, _q_path, _q_rule and _q_verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    lengths = sorted({len(p) for _, _, p in rules})
    split = pages.withColumns({"_q_host": host, "_q_path": path})
    keyed = split.withColumn("_q_keys", keys_of(F.col("_q_host"), F.col("_q_path"), lengths))
    universe = keyed.select(F.explode("_q_keys").alias("key")).distinct().persist()
    table = spark.createDataFrame([(v, h + p) for v, h, p in rules], "verdict string, key string")
    allow = table.where("verdict = 'allow'").select("key").distinct()
    block = table.where("verdict = 'block'").select("key").distinct().join(allow, "key", "left_anti")
    allowing, blocking = Cascade(allow, universe), Cascade(block, universe)
    universe.unpersist()
    fits = F.filter("_q_keys", lambda k: allowing.member(k) | blocking.member(k))
    out = keyed.withColumn("_q_rule", F.get(fits, F.lit(0)))
    return out.withColumn("_q_verdict", F.when(F.col("_q_rule").isNotNull() & blocking.member(F.col("_q_rule")), "block").otherwise("allow")).drop("_q_keys")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return out.select("page_id", F.col("_q_host").alias("host"), F.col("_q_path").alias("path"), F.col("_q_rule").alias("rule"), F.col("_q_verdict").alias("verdict"))


QUERIES: dict[str, Callable] = {"op7_url_filter": op7_url_filter}
_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = {
    "op7_url_filter": f"""
WITH r(v, h, p) AS (VALUES {_RULES_SQL}),
s AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM s),
m AS (SELECT page_id, host, path, (SELECT arg_max(struct_pack(rule := h || p, v := v), length(h || p)) FROM r
             WHERE (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.p)) AS best FROM q)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM m""",
}
