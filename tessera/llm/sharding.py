"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

A key goes to the first virtual node clockwise of its hash; keys that a full shard can't take go on
clockwise to the next shard that has room. Which keys overflow follows from the counts of keys per
ring segment alone, so the driver walks the ring over `shards x vnodes` counts (times the salts) and
never over keys. Within a segment keys are ordered by salt and hash; a prefix stays with the segment's
own shard and the rest is handed on in runs. Equal texts lie apart under law `rows`, as counts alone decide there. One shuffle by (segment, salt) ranks the keys.

The bound on a shard's load is ceil(load_factor * mean). At load_factor 1 each shard takes exactly
floor or ceil of the mean, so counts differ by one at most (law `rows`); movement is least at larger factors.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_names, stored

RING_BITS = 52
SALTS = 8


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of each virtual node, in ring order; a shard's nodes don't depend on the other shards."""
    place = lambda s, v: int(hashlib.sha256(f"{s}/{v}".encode()).hexdigest()[:13], 16)
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def limits(total: int, shards: int, load_factor: float) -> list[int]:
    """The most keys of each shard; they add up to `total` at least."""
    if load_factor <= 1:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-int(-(load_factor * total) // shards)] * shards


def walk(counts: list[list[int]], owners: list[int], room: list[int]) -> list[list[tuple[int, int, int]]]:
    """Per segment, runs (first rank, shard, first slot) that cover its keys; counts: per segment and salt.

    First every shard keeps what its own segments hold, in ring order, up to its limit; then what is
    left over moves clockwise. Two turns around the ring place everything.
    """
    n, used = len(owners), [0] * len(room)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    done = [0] * n
    sizes = [sum(c) for c in counts]

    def give(segment: int, shard: int) -> None:
        m = min(sizes[segment] - done[segment], room[shard] - used[shard])
        if m > 0:
            runs[segment].append((done[segment], shard, used[shard]))
            used[shard] += m
            done[segment] += m

    for segment in range(n):
        give(segment, owners[segment])
    waiting: list[int] = []
    for step in range(2 * n):
        at = step % n
        if step < n and done[at] < sizes[at]:
            waiting.append(at)
        while waiting and used[owners[at]] < room[owners[at]]:
            give(waiting[-1], owners[at])
            if done[waiting[-1]] == sizes[waiting[-1]]:
                waiting.pop()
    return runs


def _table(values: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def shard(rows: DataFrame, key: str, order: list[str], shards: int = 40, vnodes: int = 64, load_factor: float = 1.25, salts: int = SALTS) -> DataFrame:
    """`rows` with shard (int) and slot (long, gapless from 0 in each shard).

    The ring position is a hash of `key` (null counts as a value of its own). Rows with equal keys
    share a segment, where salts by their place in the table spread them over tasks; fully identical
    rows are interchangeable. An empty table gives an empty result. Other columns pass through, whatever their names, but for
    shard and slot, which are replaced.
    """
    rows = rows.drop("shard", "slot")
    at_, segment_, salt_, rank_, run_, before_, runs_ = free_names(rows, "at_", "segment_", "salt_", "rank_", "run_", "before_", "runs_")
    spark = rows.sparkSession
    nodes = ring(shards, vnodes)
    owners = [s for _, s in nodes]
    # A coarse index over the ring's leading bits, then a short list of the nodes in that cell.
    bits = max(1, (len(nodes) - 1).bit_length())
    cells: list[list[int]] = [[] for _ in range(1 << bits)]
    for i, (p, _) in enumerate(nodes):
        cells[p >> (RING_BITS - bits)].append(i)
    positions = [p for p, _ in nodes]
    first = [bisect.bisect_left(positions, c << (RING_BITS - bits)) for c in range(1 << bits)]
    inside = [[positions[i] for i in c] for c in cells]
    at = F.shiftrightunsigned(F.xxhash64(F.lit("ring"), F.col(key)), 64 - RING_BITS)
    cell = F.shiftright(F.col(at_), RING_BITS - bits).cast("int") + 1
    segment = F.pmod(
        F.element_at(_table(first, "array<int>"), cell) + F.size(F.filter(F.element_at(_table(inside, "array<array<bigint>>"), cell), lambda p: p < F.col(at_))),
        F.lit(len(nodes)),
    )
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    placed = stored(rows.withColumn(at_, at).withColumn(segment_, segment.cast("int")).withColumn(salt_, salt))  # written once, so each row keeps its salt
    counts = [[0] * salts for _ in nodes]
    for r in placed.groupBy(segment_, salt_).count().collect():  # at most shards x vnodes x salts rows
        counts[r[segment_]][r[salt_]] = r["count"]
    total = sum(map(sum, counts))
    runs = walk(counts, owners, limits(total, shards, load_factor))
    before = [[sum(c[:i]) for i in range(salts)] for c in counts]
    lookup = spark.createDataFrame(
        [(i, before[i], [{"a": a, "s": s, "b": b} for a, s, b in runs[i]]) for i in range(len(nodes)) if runs[i]],
        f"`{segment_}` int, `{before_}` array<bigint>, `{runs_}` array<struct<a: bigint, s: int, b: bigint>>",
    )
    window = Window.partitionBy(segment_, salt_).orderBy(at_, key, *order)
    ranked = placed.withColumn(rank_, F.row_number().over(window).cast("long") - 1)
    rank = F.col(rank_) + F.element_at(before_, F.col(salt_) + 1)
    run = F.element_at(F.filter(runs_, lambda x: x["a"] <= F.col(rank_)), -1)
    return (
        ranked.join(F.broadcast(lookup), segment_)  # shards x vnodes rows
        .withColumn(rank_, rank)
        .withColumn(run_, run)
        .select(*rows.columns, F.col(f"{run_}.s").alias("shard"), (F.col(f"{run_}.b") + F.col(rank_) - F.col(f"{run_}.a")).alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 40, vnodes: int = 64, load_factor: float = 1.0) -> DataFrame:
    """Documents on the ring by doc_id: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    size: UTF-8 bytes of the text, a null text none, plus 16. text_crc32: of those bytes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    law = "rows" if load_factor <= 1 else "bounded"
    return shard(rows, "doc_id", ["size", "text_crc32"], shards, vnodes, load_factor).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
