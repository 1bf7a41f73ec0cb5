"""URL filters as a sort-merge range join with nested rules.

A rule is a host and a path prefix; it fits its host and all subdomains. The canonical key of a host and
a path is the reversed host, a separator and the path, so a rule is an interval of keys: all keys that
begin with its own. A url has one key for each suffix of its host (com, example.com, www.example.com), so
whatever rule fits it does so on one of its keys. Distinct keys, each once however many urls have it, and rules are dealt by key range, with splitters
sampled from the keys, and sorted; a sweep keeps the stack of rules whose intervals are open, and the top of the stack
is the longest rule of that key. A rule that is still open at a splitter is copied into each range it reaches into.
Of a url's keys, the longest rule (host and path together, ties to the longer host) wins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_names, shuffle_width, spread_join, stored

#: Ends the host in a key: below every character of a url that is printed.
END = "\x01"
SAMPLE_PER_RANGE = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; '' if null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; '' if null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a table of rules."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _past(prefix: str) -> str | None:
    """The least string above every string that begins with `prefix`; None if there is none."""
    prefix = prefix.rstrip(chr(0x10FFFF))
    return prefix[:-1] + chr(ord(prefix[-1]) + 1) if prefix else None


def _lookup(keys: DataFrame, rules: DataFrame, ranges: int) -> DataFrame:
    """(key, rule, verdict) of the deepest open rule on each of the distinct (key) rows, without those on which none is open."""
    n = keys.count()
    share = min(1.0, 2 * ranges * SAMPLE_PER_RANGE / max(1, n))
    sampled = sorted(r["key"] for r in keys.sample(share, seed=7).limit(4 * ranges * SAMPLE_PER_RANGE).collect())
    cuts = sorted({sampled[len(sampled) * i // ranges] for i in range(1, ranges)}) if sampled else []

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["bucket"] = [bisect_right(cuts, k) for k in pdf["key"]]
            yield pdf

    def deal_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = [_past(k) for k in pdf["key"]]
            pdf["bucket"] = [list(range(bisect_right(cuts, k), (len(cuts) if e is None else bisect_left(cuts, e)) + 1)) for k, e in zip(pdf["key"], ends, strict=True)]
            yield pdf.explode("bucket").astype({"bucket": "int32"})

    shape = "key string, rule string, verdict string"
    nothing = F.lit(None).cast("string")
    asked = keys.select("key", nothing.alias("rule"), nothing.alias("verdict")).mapInPandas(deal, f"{shape}, bucket int")
    ruled = (
        rules.select(F.concat(reversed_host(F.col("host")), F.lit(END), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict")
        .groupBy("key")
        .agg(F.min("rule").alias("rule"), F.max("verdict").alias("verdict"))
        .mapInPandas(deal_rules, f"{shape}, bucket int")
    )

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[str, str, str]] = []
        bucket = None
        for pdf in batches:
            out = []
            for key, rule, verdict, at in zip(pdf["key"], pdf["rule"], pdf["verdict"], pdf["bucket"], strict=True):
                if at != bucket:
                    stack, bucket = [], at
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if rule is not None:
                    stack.append((key, rule, verdict))
                elif stack:
                    out.append((key, stack[-1][1], stack[-1][2]))
            yield pd.DataFrame(out, columns=["key", "rule", "verdict"])

    both = asked.unionByName(ruled).repartition(ranges, "bucket").sortWithinPartitions("bucket", "key", F.col("rule").isNull())
    return both.mapInPandas(sweep, shape)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule (null where none fits) and verdict (the rule's, else `default`).

    Existing columns of these names are replaced, others pass through. A null url, or one without ://, has an empty host and
    path, which no rule fits. Rules with a null or empty host are left out. Where two
    rules have one host and path, `block` wins over `allow`. Equal (host, path) pairs, repeated rows too, are judged once; urls are read whole,
    however long. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    rules = rules.filter("host <> ''").select("verdict", "host", F.coalesce("path", F.lit("")).alias("path"))
    rules = rules.withColumn("verdict", F.when(F.col("verdict") == "block", "~block").otherwise(F.col("verdict")))
    pages = pages.drop("host", "path", "rule", "verdict").withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    (id_,) = free_names(pages, "id_")
    pages = pages.withColumn(id_, F.concat("host", F.lit(END), "path"))
    targets = pages.filter("host <> ''").select(F.col(id_).alias("id"), "host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffix = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice(F.col("labels"), 1, i), "."))
    keys = targets.withColumn("labels", F.reverse(labels)).select("id", "path", F.explode(suffix).alias("suffix")).select("id", F.length("suffix").alias("host_len"), F.concat("suffix", F.lit(END), "path").alias("key"))
    keys = stored(keys)  # a key such as com and / stands in as many rows as there are hosts
    found = stored(_lookup(keys.select("key").distinct(), rules, shuffle_width(spark)))
    best = spread_join(keys, found, "key", ["id"]).groupBy("id").agg(F.max(F.struct(F.length("rule").alias("n"), "host_len", "rule", "verdict")).alias("best"))
    best = best.select(F.col("id").alias(id_), F.col("best.rule").alias("rule"), F.regexp_replace("best.verdict", "^~", "").alias("verdict"))
    judged = spread_join(pages, best, id_, [c for c in pages.columns if c not in ("host", "path", id_)] or [id_], how="left")
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop(id_)
