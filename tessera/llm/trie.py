"""Prefix trie of conversations by distributed MSD radix partitioning over dictionary-encoded turns.

Conversations become rows of at most SEGMENT turn ids, so none is ever one value or one group. Equal rows below one node count once. Level s takes the
turns s * SEGMENT to (s + 1) * SEGMENT of the conversations that still share their node with another:

  - A bucket holds the rows below one node. One of more than LOCAL rows is dealt out by its next turn id, each value a node and a bucket of its own, and
    so on until buckets are local; then their nodes are known natively, by grouping.
  - Local buckets are finished by multikey quicksort: three-way partitions by the id at one depth, whose middle part is a node and goes on one turn deeper.
    A task streams through its buckets and holds one at a time.
  - A conversation that shares its node with none at the end of a level is a chain and needs no further sorting.

Sums over subtrees come back up the same way: from local buckets to the buckets they were dealt from, from a level to the rows of the level above.
Levels grow with the longest prefix that two conversations share, not with the data.

Turns are numbered by a dictionary of (role, text), told apart by SHA-256; text leaves the plan in the first scan. Hot turns, copies and long conversations
are dealt to several tasks wherever rows meet what is known of them (`common.spread_join`); ranks within a conversation come from range partitions and offsets.
The list of a node's last members is hashed as a stream, pieces of it joined beforehand; as SHA-256 is sequential, the bytes of one node's list pass
through one task, in pieces, never together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_width, spread_join, stored

#: Turns in a segment; rows in a bucket that one task finishes; ids in a piece of a list to hash; nodes a batch.
SEGMENT, LOCAL, PIECE, BATCH = 64, 1024, 512, 16384
NOTHING = hashlib.sha256(b"").hexdigest()


def encoded_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, rank, id, size): the turns of each conversation numbered from 0 in the order of `turn`, null first, equal ones by their SHA-256.

    id is the same for equal (role, text), null counting as empty; size is the text's UTF-8 bytes. Rows without conv_id are of no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    slim = stored(rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size")))
    dictionary = stored(slim.groupBy("digest").agg(F.first("size").alias("size")).withColumn("id", F.monotonically_increasing_id()))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    lots = slim.select("conv_id", "turn", "digest").repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    lots = stored(lots.select("conv_id", "digest", F.spark_partition_id().alias("lot"), F.monotonically_increasing_id().alias("place")))
    parts = lots.groupBy("conv_id", "lot").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per lot at most
    ranked = lots.join(parts.withColumn("before", before), ["conv_id", "lot"]).select("conv_id", (F.col("place") - F.col("first") + F.col("before")).alias("rank"), "digest")
    return spread_join(stored(ranked), dictionary, "digest", ["conv_id", "rank"]).drop("digest")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, place, id, size, total), (conv_id, total)): each conversation c with the first crc32(c) % 9 turns of c - c % 5 in place of as many of its own."""
    heads = 9
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    c = F.col("conv_id")
    plan = counts.withColumn("base", c - c % 5).withColumn("h", F.crc32(c.cast("string").cast("binary")) % heads)
    lengths = counts.filter(c % 5 == 0).select(c.alias("base"), F.col("n").alias("n_base"))
    plan = plan.join(lengths, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("total", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = stored(plan.select("conv_id", "base", "h", "m", "total"))
    own = spread_join(turns, plan, "conv_id", ["rank"]).filter("rank >= h").select("conv_id", (F.col("rank") - F.col("h") + F.col("m")).alias("place"), "id", "size", "total")
    lent = turns.filter((c % 5 == 0) & (F.col("rank") < heads)).select(c.alias("base"), "rank", "id", "size")
    lent = lent.join(plan, "base").filter("rank < h").select("conv_id", F.col("rank").alias("place"), "id", "size", "total")
    return own.unionByName(lent), plan.select("conv_id", "total")


def segments(turns: DataFrame, totals: DataFrame) -> DataFrame:
    """(conv_id, segment, ids, sizes, total): arrays of at most SEGMENT turns; a conversation without turns has one empty segment."""
    placed = turns.groupBy("conv_id", F.floor(F.col("place") / SEGMENT).cast("long").alias("segment")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "size"))).alias("t"), F.max("total").alias("total"))
    placed = placed.select("conv_id", "segment", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"), "total")
    none = F.array().cast("array<long>")
    return placed.unionByName(totals.filter("total = 0").select("conv_id", F.lit(0).cast("long").alias("segment"), none.alias("ids"), none.alias("sizes"), "total"))


def list_hashes(rows: DataFrame) -> DataFrame:
    """(rep, ends): SHA-256 of each rep's decimal conv_ids, ascending and joined by commas. `rows`: (rep, conv_id)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, held = None, []
        out: list[tuple[int, int, str]] = []
        for batch in batches:
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != rep or len(held) == PIECE:
                    if held:
                        out.append((rep, held[0], ",".join(map(str, held))))
                    rep, held = r, []
                held.append(c)
            if len(out) >= PIECE:
                yield _table(out, ["rep", "first", "piece"])
                out = []
        if held:
            out.append((rep, held[0], ",".join(map(str, held))))
        if out:
            yield _table(out, ["rep", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None
        for batch in batches:
            out = []
            for r, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if r != rep:
                    if state:
                        out.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield _table(out, ["rep", "ends"])
        if state:
            yield _table([(rep, state.hexdigest())], ["rep", "ends"])

    width = shuffle_width(rows.sparkSession)
    cut = rows.select("rep", "conv_id").repartitionByRange(width, "rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(pieces, "rep long, first long, piece string")
    return cut.repartition(width, "rep").sortWithinPartitions("rep", "first").mapInArrow(digests, "rep long, ends string")


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)


def quicksort(rows: list[dict], depth: int, bucket: int) -> list[list]:
    """The nodes of a bucket, its top first: [conv_id, depth, parent's conv_id, n_convs, n_children, n_leaves, saved, ends].

    `rows` lie below the node (`bucket`, `depth`) and differ; each has ids, sizes, rep, n, ends, and what lies below its end: children, leaves, saved. The top's own n_convs and saved are not known here.
    """
    nodes, parents = [[bucket, depth, None, 0, 0, 0, 0, None]], [-1]
    work = [(rows, 0, 0)]
    while work:
        part, at, node = work.pop()
        if len(part) == 1 and at < len(part[0]["ids"]):  # one row alone: a chain
            row = part[0]
            for size in row["sizes"][at:]:
                nodes[node][4] += 1
                nodes.append([row["rep"], nodes[node][1] + 1, nodes[node][0], row["n"], 0, 0, (row["n"] - 1) * size, None])
                parents.append(node)
                node = len(nodes) - 1
            at = len(row["ids"])
        ended = [r for r in part if len(r["ids"]) == at]
        for row in ended:  # one at most
            nodes[node][7] = row["ends"]
            nodes[node][4] += row["children"]
            nodes[node][5] += row["leaves"]
            nodes[node][6] += row["saved"]
        part = [r for r in part if len(r["ids"]) > at] if ended else part
        if part:
            pivot = part[len(part) // 2]["ids"][at]
            less, more = [r for r in part if r["ids"][at] < pivot], [r for r in part if r["ids"][at] > pivot]
            same = [r for r in part if r["ids"][at] == pivot] if less or more else part
            n = sum(r["n"] for r in same)
            nodes[node][4] += 1
            nodes.append([min(r["rep"] for r in same), nodes[node][1] + 1, nodes[node][0], n, 0, 0, (n - 1) * same[0]["sizes"][at], None])
            parents.append(node)
            work += [(side, at, node) for side in (less, more) if side]
            work.append((same, at + 1, len(nodes) - 1))
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        nodes[i][5] = nodes[i][5] if nodes[i][4] else 1
        nodes[parents[i]][5] += nodes[i][5]
        nodes[parents[i]][6] += nodes[i][6]
    return nodes


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, top boolean"
_COLUMNS = [c.split()[0] for c in NODE.split(", ")]
_ROW = ["bucket", "depth", "rep", "ids", "sizes", "n", "ends", "children", "leaves", "saved"]


def finished(rows: DataFrame) -> DataFrame:
    """The nodes of local buckets (columns NODE), tops marked: rows (_ROW) of one bucket meet in one task."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(_ROW))]
            for values in zip(*columns, strict=True):
                row = dict(zip(_ROW, values, strict=True))
                if held and held[0]["bucket"] != row["bucket"]:
                    out += [(*n, i == 0) for i, n in enumerate(quicksort(held, held[0]["depth"], held[0]["bucket"]))]
                    held = []
                held.append(row)
                if len(out) >= BATCH:
                    yield emitted(out)
                    out = []
        if held:
            out += [(*n, i == 0) for i, n in enumerate(quicksort(held, held[0]["depth"], held[0]["bucket"]))]
        if out:
            yield emitted(out)

    def emitted(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], _COLUMNS)

    return rows.select(*_ROW).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(finish, NODE)


def level(rows: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables of nodes below the buckets' tops, what the tops sum up: bucket, children, leaves, saved, ends) of rows `depth` turns deep."""
    local, dealt, stops = [], [], []
    while True:
        big = stored(rows.groupBy("bucket").count().filter(F.col("count") > LOCAL).select("bucket", F.lit(True).alias("big")))
        if big.isEmpty():
            local.append(rows)
            break
        marked = spread_join(rows, big, "bucket", ["rep"], how="left")
        local.append(marked.filter("big is null").drop("big"))
        marked = marked.filter("big").drop("big")
        stops.append(marked.filter("size(ids) = 0").select("bucket", "children", "leaves", "saved", "ends"))
        going = stored(marked.filter("size(ids) > 0").withColumn("digit", F.struct("bucket", F.element_at("ids", 1).alias("id"))))
        groups = going.groupBy("digit").agg(F.min("bucket").alias("parent"), F.min("rep").alias("child"), F.sum("n").alias("n"), F.first(F.element_at("sizes", 1)).alias("size"))
        groups = stored(groups)
        dealt.append(groups)
        rest = [F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))).alias(c) for c in ("ids", "sizes")]
        going = spread_join(going, groups.select("digit", "child"), "digit", ["rep"]).withColumn("bucket", F.col("child")).withColumn("depth", F.col("depth") + 1)
        rows = stored(going.select(*[c for c in _ROW if c not in ("ids", "sizes")], *rest).select(*_ROW))
    union = local[0]
    for more in local[1:]:
        union = union.unionByName(more)
    done = stored(finished(union))
    sums = ["bucket", "children", "leaves", "saved", "ends"]
    tops = done.filter("top").select("depth", F.col("conv_id").alias("bucket"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), "ends")
    nodes, below = [done.filter("not top").drop("top")], None
    for j in range(len(dealt), -1, -1):
        known = tops.filter(F.col("depth") == depth + j).select(*sums)
        if below is not None:  # buckets that were dealt out: their nodes' sums, and the row that ends at their top
            up = below.groupBy(F.col("parent_conv_id").alias("bucket")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"))
            up = up.unionByName(stops[j]).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")], F.max("ends").alias("ends"))
            known = known.unionByName(up)
        if not j:
            return nodes, known
        below = dealt[j - 1].select(F.col("parent").alias("parent_conv_id"), F.col("child").alias("bucket"), "n", "size").join(known, "bucket")
        below = stored(
            below.select(
                F.col("bucket").alias("conv_id"), F.lit(depth + j).cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
                F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).alias("n_leaves"), ((F.col("n") - 1) * F.col("size") + F.col("saved")).alias("saved_tokens"), "ends",
            )
        )
        nodes.append(below)
    raise AssertionError


def prefix_trie(turns: DataFrame, totals: DataFrame) -> DataFrame:
    """The trie's nodes (columns NODE but top) over (conv_id, place, id, size, total) and (conv_id, total)."""
    whole = stored(segments(turns, totals))
    root = whole.agg(F.min("conv_id").alias("least"), F.count(F.when(F.col("segment") == 0, 1)).alias("n")).first()
    if not root["n"]:
        return turns.sparkSession.createDataFrame([], NODE).drop("top")
    active, levels, nodes = whole.filter("segment = 0").select("conv_id", F.lit(root["least"]).cast("long").alias("bucket")), [], []
    while True:
        s = len(levels)
        end = (s + 1) * SEGMENT
        rows = active.join(whole.filter(F.col("segment") == s), "conv_id") if s else whole.filter("segment = 0").withColumn("bucket", F.lit(root["least"]).cast("long"))
        text = F.concat_ws(",", F.col("bucket").cast("string"), F.transform("ids", lambda x: x.cast("string")))
        rows = rows.withColumn("key", F.unhex(F.sha2(text.cast("binary"), 256)))
        distinct = stored(rows.groupBy("key").agg(F.min("bucket").alias("bucket"), F.min("conv_id").alias("rep"), F.first(F.struct("ids", "sizes")).alias("t"), F.count("*").alias("n"), F.max("total").alias("total")))
        shared = distinct.filter("n > 1").select("key", "rep")
        members = stored(spread_join(rows.select("key", "conv_id", "total"), shared, "key", ["conv_id"]).select("rep", "conv_id", "total"))
        ends = list_hashes(members.filter(F.col("total") <= end)).withColumnRenamed("ends", "listed")
        alone = F.when((F.col("n") == 1) & (F.col("total") <= end), F.sha2(F.col("rep").cast("string").cast("binary"), 256))
        levels.append(stored(distinct.join(ends, "rep", "left").select("bucket", "rep", F.col("t.ids").alias("ids"), F.col("t.sizes").alias("sizes"), "n", "total", F.coalesce("listed", alone).alias("ends"))))
        chains = distinct.filter((F.col("n") == 1) & (F.col("total") > end)).select(F.col("rep").alias("conv_id"))
        rest = spread_join(whole.filter(F.col("segment") > s), chains, "conv_id", ["segment"]).select("conv_id", "segment", "total", F.posexplode("ids").alias("i", "id"))
        depth, last = F.col("segment") * SEGMENT + F.col("i") + 1, F.col("segment") * SEGMENT + F.col("i") + 1 == F.col("total")
        nodes.append(
            rest.select(
                "conv_id", depth.alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).alias("ends"),
            )
        )
        active = members.filter(F.col("total") > end).select("conv_id", F.col("rep").alias("bucket"))
        if active.isEmpty():
            break
    tops = None
    for s in range(len(levels) - 1, -1, -1):
        goes_on = (F.col("n") == 1) & (F.col("total") > (s + 1) * SEGMENT)
        rows = levels[s].withColumn("depth", F.lit(s * SEGMENT).cast("long"))
        alone = F.when(goes_on, 1).otherwise(0).cast("long")
        if tops is None:
            rows = rows.withColumn("children", alone).withColumn("leaves", alone).withColumn("saved", F.lit(0).cast("long"))
        else:
            rows = rows.join(tops.select(F.col("bucket").alias("rep"), *[F.col(c).alias(f"{c}_") for c in ("children", "leaves", "saved")]), "rep", "left")
            rows = rows.withColumn("children", F.coalesce("children_", alone)).withColumn("leaves", F.coalesce("leaves_", alone)).withColumn("saved", F.coalesce("saved_", F.lit(0).cast("long")))
        more, tops = level(stored(rows.select(*_ROW)), s * SEGMENT)
        tops = stored(tops)
        nodes += more
    top = tops.select(
        F.col("bucket").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(root["n"]).cast("long").alias("n_convs"),
        F.col("children").alias("n_children"), F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends",
    )
    for table in nodes:
        top = top.unionByName(table)
    return top


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id are left out; repeated rows are repeated turns; null roles and texts are empty ones; other columns are not read. No conversations, no nodes, not even a root.
    c % 5 is SQL's, so it is negative for negative ids.
    """
    turns, totals = rebuilt_turns(encoded_turns(conversations))
    nodes = prefix_trie(turns, totals)
    return nodes.withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))).drop("ends")
