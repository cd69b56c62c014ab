"""URL rules through a blocked Bloom filter and an exact hash join, in DataFrame functions only.

A rule is a canonical (host, path) key. A URL can only meet rules whose host is one
of its own host's suffixes and whose path is a prefix of its own path with a length
that occurs among the rules. Those few keys are tested against the filter inside the
scan; only possible hits reach the join, which removes the false ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased. Path: then up to ``?``, ``#``. Without ``://`` or for null: empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\u0000"), path)


def _masks(key: Column) -> Column:
    """Three bits of a block of 64."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", h, F.lit(6 * k)).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def block_table(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """b, m: the words of 64 bits that are not zero, of ``blocks``; each key sets three bits in one word."""
    return keys.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("b")).agg(F.bit_or(_masks(F.col(key))).alias("m"))


def blocked_bloom(keys: DataFrame, key: str, blocks: int) -> list[int]:
    """All ``blocks`` words as a list. Built by an aggregation, ``blocks`` rows at most."""
    words = [0] * blocks
    for r in block_table(keys, key, blocks).collect():
        words[r.b] = r.m
    return words


def size_for(n: int, least: int = 256) -> int:
    """Words for ``n`` keys: 16 bits a key."""
    return max(least, n // 4)


def may_contain(key: Column, words: list[int]) -> Column:
    mask = _masks(key)
    table = F.array(*[F.lit(w).cast("long") for w in words])
    return F.get(table, F.pmod(F.xxhash64(key), F.lit(len(words))).cast("int")).bitwiseAND(mask) == mask


def possible(keyed: DataFrame, key: str, table: DataFrame, blocks: int, broadcast: bool) -> DataFrame:
    """Rows whose key may be among those of the table of blocks: ``may_contain`` as a join."""
    rows = keyed.withColumn("b", F.pmod(F.xxhash64(key), F.lit(blocks)))
    met = rows.join(F.broadcast(table) if broadcast else table, "b")
    return met.where(F.col("m").bitwiseAND(_masks(F.col(key))) == _masks(F.col(key))).drop("b", "m")


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url: str = "url", blocks: int = 256, default: str = "allow", broadcast_rows: int = 100_000, literal_blocks: int = 8192) -> DataFrame:
    """Per row: id, host, path, the longest rule that fits (``host + path``; else null), verdict.

    A rule fits its host and all subdomains where the URL's path starts with the rule's;
    of rules of one length the longer host wins, then ``block``. URLs that no rule
    fits get ``default``, and so does every URL where there is no rule. Null and malformed
    URLs have an empty host and path. Hosts are compared with A-Z lower-cased, rules' and URLs'.
    Repeated rows give repeated rows, no row gives none; only ``id_col`` and ``url`` are read. The rules are joined by
    broadcast only where they are counted to be at most ``broadcast_rows``. The filter
    grows with the rules: up to ``literal_blocks`` words are part of the scan, more are a
    table of blocks, which is broadcast up to ten times ``broadcast_rows`` (16 bytes each).
    """
    spark: SparkSession = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    listed = rules.select(
        _key(ascii_lower(F.col("host")), F.col("path")).alias("_key"),
        F.concat(ascii_lower(F.col("host")), F.col("path")).alias("rule"), F.col("verdict"), F.length("host").alias("_h"), F.length(F.concat("host", "path")).alias("_n"),
    )
    listed = listed.groupBy("_key").agg(F.max_by(F.struct("rule", "verdict", "_h", "_n"), "verdict").alias("_r"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # at most the length of a URL
    n = listed.count()
    blocks = size_for(n, blocks)

    host, path = host_and_path(F.col(url))
    seen = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    # suffixes a.b.c, b.c, c of the host
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = [k for k in lengths]
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring(F.col("path"), 1, k)) for k in fits]), lambda p: p.isNotNull()) if fits else F.array().cast("array<string>")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _key(s, p))))
    # the verdict depends on host and path alone: join their distinct pairs, exactly
    if blocks <= literal_blocks:
        words = blocked_bloom(listed, "_key", blocks)
        seen = seen.withColumn("_hits", F.filter(keys, lambda k: may_contain(k, words)))
        pairs = seen.where(F.size("_hits") > 0).select("host", "path", "_hits").groupBy("host", "path").agg(F.first("_hits").alias("_hits"))
        pairs = pairs.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.explode("_hits").alias("_key"))
    else:
        small = blocks <= 10 * broadcast_rows
        keyed = seen.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.explode(keys).alias("_key"))
        pairs = possible(keyed if small else keyed.distinct(), "_key", block_table(listed, "_key", blocks), blocks, small).distinct()
        seen = seen.withColumn("_hits", F.lit(None).cast("array<string>"))
    joined = pairs.join(F.broadcast(listed) if n <= broadcast_rows else listed, "_key")
    best = joined.groupBy("_host", "_path").agg(F.max_by("_r", F.struct("_r._n", "_r._h", "_r.verdict")).alias("_best"))
    may = seen.where("_hits IS NULL OR size(_hits) > 0")
    out = may.join(best, (may["host"] == best["_host"]) & (may["path"] == best["_path"]), "left")
    out = out.select(id_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
    # pages that the filter rules out are moved nowhere
    none = seen.where("size(_hits) = 0").select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return out.unionByName(none)
