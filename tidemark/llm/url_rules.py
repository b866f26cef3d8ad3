"""URL rules by Bloom filter cascades, in DataFrame functions only.

A rule is a host and a path prefix. It fits the host and its subdomains where the URL's path starts with
the rule's; of several the longest wins (of equally long ones the greater key). A URL's candidate keys are
all its host suffixes joined with its path's beginnings of the lengths that rules have.

A cascade holds a set of listed keys exactly over a universe, here all candidate keys of the corpus. Level 1
is a Bloom filter of the listed keys; level 2 one of the universe's keys that pass level 1 without being
listed; level 3 one of the listed keys that pass level 2; and so on until nothing passes. A key is listed
if the first level that it fails is an even one. Membership joins nothing: the filters are scalar subqueries. Lists
whose filters would exceed ``max_filter_bytes`` are split by hash of the key into shards that don't; every shard is a
cascade of its own over its part of the keys. Then the shards' passes go over the corpus's distinct hosts and paths, which carry the
best rule so far along, and the rows meet these results once, whatever the number of shards.

One pass over the corpus finds the keys that pass either list's level 1; the deeper levels shrink by half
each and never read the corpus again.

Cases: rules with a null host or path or another verdict don't count; null URLs and those without ``://`` have an empty host and path and fit no rule; such rows and all
others without a rule get the ``default`` verdict; repeated rows are judged each; null ids pass through; a
key listed both ways blocks; columns of the names ``host path rule verdict`` are replaced, all
others stay; empty tables of pages or rules work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import dealt_join
from .common import materialize, remove

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    return pages.drop(*(c for c in ("host", "path", "rule", "verdict") if c in pages.columns)).withColumns({"host": F.translate(F.regexp_extract(url, "^(?s).*?://([^/?#]*)", 1), UPPER, LOWER), "path": F.regexp_extract(url, "^(?s).*?://[^/?#]*([^?#]*)", 1)})


def candidate_keys(lengths: list[int]) -> Column:
    """All keys of a row's ``host`` and ``path`` that a rule with a path of one of the lengths could have."""
    known = f"array({', '.join(map(str, sorted(lengths)))})" if lengths else "cast(array() as array<int>)"
    return F.expr(f"flatten(transform(sequence(1, size(split(host, '[.]'))), i -> transform(filter({known}, l -> l <= length(path)), l -> concat(array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'), substring(path, 1, l)))))")


@dataclass
class Level:
    """One Bloom filter: its words as a one-row table, its bits and hash functions."""

    words: DataFrame
    bits: int
    hashes: int
    number: int

    def positions(self, key: Column) -> list[Column]:
        h = F.xxhash64(key, F.lit(self.number))
        one, two = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33)
        return [(one + two * i) % self.bits for i in range(self.hashes)]

    def passes(self, key: Column, words: Column) -> Column:
        out = F.lit(True)
        for p in self.positions(key):
            out = out & (F.getbit(F.element_at(words, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1)
        return out


def build_level(keys: DataFrame, count: int, number: int, bits_per_key: int) -> Level:
    """The filter of ``keys`` (one column, ``key``): set bits are merged by word, then put in order."""
    spark = keys.sparkSession
    words = max(1, -(-count * bits_per_key // 64))
    level = Level(keys, words * 64, max(1, round(0.69 * words * 64 / max(1, count))) if count * bits_per_key > 64 else 4, number)
    set_bits = keys.select(F.explode(F.array_distinct(F.array(*level.positions(F.col("key"))))).alias("p"))
    merged = set_bits.groupBy(F.floor(F.col("p") / 64).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("w"))
    dense = spark.range(words).join(merged, "id", "left").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")))), lambda x: x["w"]).alias("words"))
    level.words, _ = materialize(dense, "bloom-level")
    return level


@dataclass
class Cascade:
    levels: list[Level]

    def contains(self, key: Column, words: list[Column]) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[k].passes(key, words[k]), F.lit(k % 2 == 1)).otherwise(out)
        return out


def deepen(first: Level | None, listed: DataFrame, passed: DataFrame, bits_per_key: int = 3) -> Cascade:
    """The cascade above level 1: ``passed`` are the unlisted keys of the universe that pass it."""
    if first is None:
        return Cascade([])
    levels, here, there, dropped = [first], passed, listed, []
    while n := here.count():
        if len(levels) > 60:
            raise ValueError("the cascade doesn't end; are there keys both listed and unlisted?")
        level = build_level(here, n, len(levels) + 1, bits_per_key)
        levels.append(level)
        left, path = materialize(_passing(there, level), "cascade-keys")
        here, there = left, here
        dropped.append(path)
    for path in dropped:
        remove(listed.sparkSession, path)
    return Cascade(levels)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    return keys.withColumn("__w", level.words.scalar()).where(level.passes(F.col("key"), F.col("__w"))).select("key")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", bits_per_key: int = 16, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``. ``rules`` has ``host, path, verdict`` (allow or block)."""
    spark = pages.sparkSession
    keyed = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')").select(F.concat("host", "path").alias("key"), F.length("path").alias("length"), "verdict")
    keyed = keyed.groupBy("key").agg(F.max("verdict").alias("verdict"), F.min("length").alias("length"), F.max("length").alias("longest"))
    keyed, keyed_path = materialize(keyed, "url-rules")
    lengths = [r[0] for r in keyed.select(F.explode(F.array("length", "longest"))).distinct().collect()]  # as many as rules have path lengths
    count = keyed.count()
    shards = max(1, -(-count * bits_per_key // (8 * max(1, max_filter_bytes))))
    df, columns = with_parts(pages, url_col), with_parts(pages, url_col).columns
    none = F.lit(None).cast(BEST)
    if shards == 1:
        judged = _judge_shard(df.withColumn("__best", none), keyed, candidate_keys(lengths), bits_per_key)
        df = judged if judged is not None else df.withColumn("__best", none)
    else:
        # one shard's filters at a time, over the corpus's distinct hosts and paths; pages meet their result once
        at = F.struct(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).alias("__at")
        held, held_path = materialize(df.groupBy("host", "path").agg(F.count("*").alias("__n")).withColumn("__best", none), "url-paths")
        for number in range(shards):
            part = keyed.where(_shard("key", shards) == number)
            judged = _judge_shard(held, part, _of_shard(candidate_keys(lengths), shards, number), bits_per_key)
            if judged is not None:
                before = held_path
                held, held_path = materialize(judged, "url-paths")
                remove(spark, before)
        df = dealt_join(df.withColumn("__at", at), held.select(at, "__n", "__best"), "__at", [f.name for f in df.schema if "map<" not in f.dataType.simpleString()], "__n", df.count())
    remove(spark, keyed_path)
    best = F.col("__best")
    verdict = F.when(best.isNull(), default).when(best["blocked"], "block").otherwise("allow")
    return df.select(*columns, best["key"].alias("rule"), verdict.alias("verdict"))


BEST = "struct<n: int, key: string, blocked: boolean>"


def _shard(key, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(shards)).cast("int")


def _of_shard(keys: Column, shards: int, number: int) -> Column:
    return F.filter(keys, lambda key: _shard(key, shards) == number) if shards > 1 else keys


def _judge_shard(df: DataFrame, keyed: DataFrame, keys: Column, bits_per_key: int) -> DataFrame | None:
    """``df`` with ``__best`` raised to the longest of its keys that the rules list, if longer; None without rules."""
    spark = df.sparkSession
    counts = {r["verdict"]: r["count"] for r in keyed.groupBy("verdict").count().collect()}
    kinds = [v for v in ("allow", "block") if counts.get(v)]
    if not kinds:
        return None
    listed = {v: keyed.where(F.col("verdict") == v).select("key") for v in kinds}
    first = {v: build_level(listed[v], counts[v], 1, bits_per_key) for v in kinds}
    # the corpus's keys that pass a level 1, once: the rest of the universe needs no level beyond it
    universe = df.select("host", "path", *(first[v].words.scalar().alias(f"__{v}") for v in kinds))
    universe = universe.select(F.explode(F.array_distinct(keys)).alias("key"), *(f"__{v}" for v in kinds))
    hits = universe.select("key", *(first[v].passes(F.col("key"), F.col(f"__{v}")).alias(v) for v in kinds)).where(" OR ".join(kinds)).withColumn("__is", F.lit(None).cast("string"))
    known = keyed.select("key", *(F.lit(False).alias(v) for v in kinds), F.col("verdict").alias("__is"))
    hits = hits.distinct().union(known).groupBy("key").agg(*(F.bool_or(v).alias(v) for v in kinds), F.max("__is").alias("__is"))
    hits, hits_path = materialize(hits, "cascade-hits")
    cascades = {v: deepen(first[v], listed[v], hits.where(F.col(v) & ~F.col("__is").eqNullSafe(F.lit(v))).select("key")) for v in kinds}
    remove(spark, hits_path)
    columns, inside = df.columns, {}
    for v in kinds:
        names = [f"__{v}{k}" for k in range(len(cascades[v].levels))]
        df = df.withColumns({n: lv.words.scalar() for n, lv in zip(names, cascades[v].levels, strict=True)})
        inside[v] = lambda key, v=v, names=names: cascades[v].contains(key, [F.col(n) for n in names])
    fits = F.filter(keys, lambda key: F.greatest(*(inside[v](key) for v in kinds)) if len(kinds) > 1 else inside[kinds[0]](key))
    df = df.withColumn("__own", F.array_max(F.transform(fits, lambda key: F.struct(F.length(key).alias("n"), key.alias("key")))))
    blocked = inside["block"](F.col("__own.key")) if "block" in kinds else F.lit(False)
    own = F.when(F.col("__own").isNotNull(), F.struct(F.col("__own.n").alias("n"), F.col("__own.key").alias("key"), blocked.alias("blocked")))
    return df.withColumn("__best", F.greatest("__best", own)).select(*columns)
