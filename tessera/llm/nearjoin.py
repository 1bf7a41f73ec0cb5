"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Texts become sets of hashed word 5-grams; texts with one set are one class from the start. Each set has a signature of `LEVELS`
minima (16 bits each) in each of `tries` prefix tries. A trie is kept as its sorted list of signatures: all signatures are
dealt by range of (trie, signature, set) and sorted, so a node that holds a third of all sets is cut into several ranges, and
the longest prefix that a set shares with any other is the longer of those that it shares with its two neighbours.

The forest is descended from whole signatures upwards. At a depth, the sets below one node are candidates; those that are not linked yet are
verified against one head of the node, the set that meets most others there (ties: the smallest set number), so an original goes before its copies. Then the
recall so far is estimated from the verified links: one of similarity s is found at this depth with p = 1 - (1 - s^depth)^tries, so it
stands for 1 / p links; one link at the threshold is added for what has not been seen. While the estimate is below the target, the
matched prefixes are shortened, to the longest depth at which these links speak for the target. The shortest depth reaches the target at the threshold itself, whatever the links are.

Nodes are never expanded into all pairs. Where verified links leave several components below one node of the last depth, members of different
components are compared by sketches, a block of members against another block in each task. Components that may hold a link between
each other become one group; a task sends at most one row for each component it joins, and not the pairs.

All links lie within these groups, so there every set is compared with every other, block against block again: a task holds two
blocks of shingle sets, counts what is common by a matrix product and returns one row for each set: its number of links and the
smallest set that it hangs together with. These rows make the classes and the counts. Copies are not expanded: a set counts as many times as it has rows.

Verification compares whole shingle sets; sets whose sizes alone rule the threshold out are not compared, nor are those whose
sketches (one bit of each of many minima) differ by six standard deviations more than sets at the threshold do: 256 bits from the
tries' minima with the heads, 2048 bits afterwards, which only the sets that are left there get.
Components are found by label propagation with pointer jumping over stored tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dealt_join, forget, free_names, mix64, parts_of, shuffle_width, sifted, spread_join, stored

WORDS, THRESHOLD, TRIES, LEVELS, RECALL, BLOCK, SKETCH, WIDE = 5, 0.8, 32, 8, 0.9999, 512, 256, 2048
#: A pass holds about 30 bytes for each byte of its texts, and tables as long.
PASS_BYTES, BLOCK_SHINGLES = 1 << 20, 1 << 20
_BASE = 0x2545F4914F6CDD1D
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Letters, digits and all bytes of other scripts make words; the rest separates them.
_IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def found_at(similarity: float, depth: int, tries: int = TRIES) -> float:
    """The chance that two sets share a prefix of `depth` values in one of the tries."""
    return 1 - (1 - similarity**depth) ** tries


def shortest_depth(threshold: float = THRESHOLD, tries: int = TRIES, recall: float = RECALL) -> int:
    """The longest prefix, at most a whole signature, that reaches the target recall at the threshold."""
    return next((d for d in range(LEVELS, 1, -1) if found_at(threshold, d, tries) >= recall), 1)


def estimated_recall(similarities: dict[float, int], depth: int, threshold: float = THRESHOLD, tries: int = TRIES) -> float:
    """The share of all links that a depth finds, judged by the links that it found (similarity: number) and one more at the threshold."""
    found = 1 + sum(similarities.values())
    missed = sum(n * (1 / max(found_at(s, depth, tries), 1e-9) - 1) for s, n in [(threshold, 1), *similarities.items()])
    return found / (found + missed)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.full(size, b, dtype=np.uint64)) for b in (_BASE, inverse))
    return _POWERS[size]


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of each lower-cased text; text i has hashes[offsets[i]:offsets[i + 1]].

    Texts of fewer words have one shingle of all of them; texts without words none.
    """
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = _IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    word = mix64((total[stop] - total[start]) * inverse[start])
    owner = np.searchsorted(ends, start, side="left")
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(max(0, len(word) - words + 1), dtype=np.uint64)
    for j in range(words):
        rolled += mix64(word[j : j + len(rolled)] + np.uint64(j + 1)) if len(rolled) else rolled
    rolled = mix64(rolled)
    parts = []
    for i, n in enumerate(counts):
        a = first[i]
        if n >= words:
            parts.append(np.unique(rolled[a : a + n - words + 1]))
        elif n:
            parts.append(mix64(np.array([sum(int(x) * (2 * j + 3) for j, x in enumerate(mix64(word[a : a + n]))) % (1 << 64)], dtype=np.uint64)))
        else:
            parts.append(np.empty(0, dtype=np.uint64))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def signature_bits(hashes: np.ndarray, offsets: np.ndarray, tries: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 2 tries): of each trie LEVELS minima of 16 bits as two words, the first value in the highest bits; (texts, SKETCH / 64): bits of the first minima.

    Rows of texts without shingles mean nothing.
    """
    filled = np.flatnonzero(np.diff(offsets))
    words, sketch = np.zeros((len(offsets) - 1, 2 * tries), dtype=np.uint64), np.zeros((len(offsets) - 1, SKETCH // 64), dtype=np.uint64)
    if not len(filled):
        return words, sketch
    seeds = mix64(np.arange(1, 2 * tries * LEVELS + 1, dtype=np.uint64)).reshape(tries * LEVELS, 2)
    value, shifted = np.empty_like(hashes), np.empty_like(hashes)
    for drawn in range(tries * LEVELS):
        np.bitwise_xor(hashes, seeds[drawn, 1], out=value)
        value *= seeds[drawn, 0] | np.uint64(1)
        value ^= np.right_shift(value, np.uint64(32), out=shifted)
        least = mix64(np.minimum.reduceat(value, offsets[filled]))
        words[filled, drawn // 4] |= (least >> np.uint64(48)) << np.uint64(48 - 16 * (drawn % 4))
        if drawn < SKETCH:
            sketch[filled, drawn // 64] |= ((least >> np.uint64(17)) & np.uint64(1)) << np.uint64(drawn % 64)
    return words, sketch


def wide_sketches(hashes: np.ndarray, offsets: np.ndarray, bits: int = WIDE) -> np.ndarray:
    """(texts, bits / 64): one bit of each of `bits` minima of other hash functions; no text may be without shingles."""
    out = np.zeros((len(offsets) - 1, bits // 64), dtype=np.uint64)
    if not len(out):
        return out
    seeds = mix64(np.arange(1 << 20, (1 << 20) + 2 * bits, dtype=np.uint64)).reshape(bits, 2)
    for i in range(bits):
        value = (hashes ^ seeds[i, 1]) * (seeds[i, 0] | np.uint64(1))
        value ^= value >> np.uint64(32)
        bit = (mix64(np.minimum.reduceat(value, offsets[:-1])) >> np.uint64(17)) & np.uint64(1)
        out[:, i // 64] |= bit << np.uint64(i % 64)
    return out


def far_apart(threshold: float, bits: int = SKETCH, deviations: float = 6.0) -> int:
    """The most bits in which sketches of sets at the threshold differ."""
    p = (1 - threshold) / 2
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(x.as_py() or "").lower().encode("utf-8", "surrogatepass") for x in batch.column(column)]


def _passes(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, last, texts) of runs of rows; only one run's texts are held at a time."""
    first = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > first and size + n > PASS_BYTES:
            yield first, i, _texts(batch.slice(first, i - first), column)
            first, size = i, 0
        size += n
    if batch.num_rows > first:
        yield first, batch.num_rows, _texts(batch.slice(first), column)


def _set_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 2): a 128-bit key of each shingle set."""
    sums = np.zeros((len(hashes) + 1, 2), dtype=np.uint64)
    np.cumsum(hashes, out=sums[1:, 0])
    np.cumsum(mix64(hashes), out=sums[1:, 1])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)


def _list_array(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.view(np.int64).ravel()))


def signatures(docs: DataFrame, words: int, tries: int) -> DataFrame:
    """(doc_id, text_hash, set_a, set_b, n, words, sketch) of each (doc_id, text_hash, text): a 128-bit key of the shingle set, its size, signatures and sketch."""
    names = ["doc_id", "text_hash", "set_a", "set_b", "n", "words", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _passes(batch, 2):
                hashes, offsets = shingles(texts, words)
                signature, sketch = signature_bits(hashes, offsets, tries)
                sets = _set_keys(hashes, offsets)
                columns = [pa.array(sets[:, 0]), pa.array(sets[:, 1]), pa.array(np.diff(offsets), pa.int32()), _list_array(signature), _list_array(sketch)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], names=names)

    return docs.mapInArrow(run, "doc_id long, text_hash long, set_a long, set_b long, n int, words array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(set, shingles array<long>) of those (set, set_a, set_b, text) whose text has the shingle set with this key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.stack([batch.column(c).to_numpy() for c in (1, 2)], axis=1) if batch.num_rows else np.empty((0, 2), np.int64)
            for a, b, texts in _passes(batch, 3):
                hashes, offsets = shingles(texts, words)
                same = (_set_keys(hashes, offsets) == wanted[a:b]).all(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["set", "shingles"]).filter(pa.array(same))

    return docs.select("set", "set_a", "set_b", "text").mapInArrow(run, "set long, shingles array<long>")


def sorted_leaves(sets: DataFrame, shortest: int, tries: int = TRIES) -> DataFrame:
    """(trie, hi, lo, set, matched) of (set, words): the leaves of every trie that share `shortest` values at least with another.

    hi and lo are a signature; matched is the number of leading values that the leaf shares with one of its neighbours in the sorted
    trie. The first and the last leaf of a range, whose neighbour lies elsewhere, count as wholly matched; a node with one leaf is no node.
    """
    leaf = F.array(*[F.struct(F.lit(t).alias("trie"), F.col("words")[2 * t].alias("hi"), F.col("words")[2 * t + 1].alias("lo")) for t in range(tries)])
    leaves = sets.select("set", F.inline(leaf)).select("trie", "hi", "lo", "set")
    dealt = leaves.repartitionByRange(shuffle_width(sets.sparkSession), "trie", "hi", "lo", "set").sortWithinPartitions("trie", "hi", "lo", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_shared = None, LEVELS  # the row that waits for its next one, and what it shares with the one before
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if last is None else pa.concat_tables([last, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            after = _shared_levels(*(rows.column(c).to_numpy() for c in range(3)))
            before = np.concatenate([[last_shared], after])
            yield from _leaves(rows.slice(0, rows.num_rows - 1), np.maximum(before[:-1], after), shortest)
            last, last_shared = rows.slice(rows.num_rows - 1), int(before[-1])
        if last is not None:
            yield from _leaves(last, np.array([LEVELS]), shortest)

    return dealt.mapInArrow(run, "trie int, hi long, lo long, set long, matched int")


def _shared_levels(trie: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """How many leading values each signature shares with the next one; none across tries."""
    levels = np.zeros(max(0, len(trie) - 1), dtype=np.int64)
    same = trie[1:] == trie[:-1]
    for word in (hi, lo):
        differ = (word[1:] ^ word[:-1]).view(np.uint64)
        for shift in (48, 32, 16, 0):
            same &= differ >> np.uint64(shift) == 0
            levels += same
    return levels


def _leaves(rows: pa.Table, matched: np.ndarray, shortest: int) -> Iterator[pa.RecordBatch]:
    kept = rows.append_column("matched", pa.array(matched, pa.int32())).filter(pa.array(matched >= shortest))
    yield from kept.combine_chunks().to_batches()


def node_of(depth: int):
    """The key of the node at `depth` above a leaf (trie, hi, lo)."""
    whole = (F.col("hi"), F.shiftrightunsigned("lo", 16 * (LEVELS - depth)) if depth < LEVELS else F.col("lo")) if depth > LEVELS // 2 else (F.shiftrightunsigned("hi", 16 * (LEVELS // 2 - depth)), F.lit(0))
    return F.xxhash64("trie", *whole)


def sketched(sets: DataFrame) -> DataFrame:
    """(set, sketch) of each (set, shingles): the wide sketch of each set, none of them empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1).to_pylist()
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                sketch = wide_sketches(np.concatenate([np.array(x, dtype=np.int64) for x in lists]).view(np.uint64), offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), _list_array(sketch)], names=["set", "sketch"])

    return sets.select("set", "shingles").mapInArrow(run, "set long, sketch array<long>")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in `links` (a, b): the smallest id of its component."""
    both = stored(links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct())
    table = labels = stored(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")))
    while True:
        near = spread_join(both, labels.select(F.col("id").alias("other"), "label"), "other", ["id"]).groupBy("id").agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("label", "near").alias("new"), "label")
        # Labels that are hot by now are those that will be looked up most.
        far = spread_join(lower, labels.select(F.col("id").alias("new"), F.col("label").alias("far")), "new", ["id"], counted=labels.select(F.col("label").alias("new")))
        after = stored(far.select("id", F.least("new", "far").alias("new"), "label"))
        changed = after.filter("new <> label").limit(1).count()
        forget(table)
        table, labels = after, after.select("id", F.col("new").alias("label"))
        if not changed:
            forget(both)
            return labels


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float, counted: DataFrame) -> DataFrame:
    """Those (a, b) whose shingle sets have at least the threshold's Jaccard similarity, with it; an `a` of many pairs (in `counted`, a stored table) is dealt to several tasks."""
    both = pairs.join(vectors.select(F.col("set").alias("b"), F.col("shingles").alias("_b")), "b")
    both = spread_join(both, vectors.select(F.col("set").alias("a"), F.col("shingles").alias("_a")), "a", ["b"], counted)
    common = F.size(F.array_intersect("_a", "_b"))
    similarity = common / (F.size("_a") + F.size("_b") - common)
    return both.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group of equal leading `keys` columns (no nulls); a group's rows follow each other."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        values = [rows.column(k).to_numpy() for k in range(keys)]
        starts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1 if rows.num_rows > 1 else np.empty(0, np.int64)
        at = 0
        for start in starts:
            yield rows.slice(at, int(start) - at)
            at = int(start)
        held = rows.slice(at)
    if held is not None and held.num_rows:
        yield held


def in_blocks(members: DataFrame, group: str) -> DataFrame:
    """`members` (`group`, set, blocks, ...) with columns i, j, own in front: each goes to all pairs of the blocks of its group that hold its own.

    blocks is the number of blocks of the group; the rows of one (group, i, j) are in one partition and follow each other.
    """
    rest = [c for c in members.columns if c not in (group, "blocks")]
    dealt = members.withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *rest)
    return dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a column of lists."""
    column = column.combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def joined(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): labels that hang together by members that meet below a node and may be similar; of (node, set, size, label, n, sketch), size being the node's."""
    most = far_apart(threshold, WIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            own, label, n = (rows.column(c).to_numpy() for c in ("own", "label", "n"))
            sketch = _lists(rows.column("sketch"))[0].view(np.uint64).reshape(len(own), -1)
            names, place, counts = np.unique(label, return_inverse=True, return_counts=True)
            root = place.copy()
            for x in np.flatnonzero(place != np.argmax(counts)):  # each pair of different labels has an end outside the most frequent one
                y = np.flatnonzero((root != root[x]) & (np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x])))
                y = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int32) <= most]
                if len(y):
                    met = np.unique(np.append(root[y], root[x]))
                    root[np.isin(root, met)] = met[0]
            moved = np.unique(np.stack([root, place])[:, root != place], axis=1)
            if moved.size:
                yield pa.RecordBatch.from_arrays([pa.array(names[moved[0]]), pa.array(names[moved[1]])], names=["a", "b"])

    members = members.select("node", "set", F.ceil(F.col("size") / block).cast("int").alias("blocks"), "label", "n", "sketch")
    return in_blocks(members, "node").mapInArrow(run, "a long, b long")


def _common(values: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 4096) -> np.ndarray:
    """How many values lists `a` and `b` (indices) have in common, as a matrix; `step` distinct values are held at a time."""
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lengths)), lengths)
    met = counts > 1
    column, row = (np.cumsum(met) - 1)[column[met[column]]], row[met[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(a), len(b)))
    for low in range(0, int(met.sum()), step):
        first, last = np.searchsorted(column, [low, low + step])
        part = np.zeros((len(lengths), step), dtype=np.float32)
        part[row[first:last], column[first:last] - low] = 1
        out += part[a] @ part[b].T
    return out


def linked(members: DataFrame, counted: DataFrame, threshold: float, block: int) -> DataFrame:
    """(set, near, links) of (label, set, rows, n, shingles), one for each pair of blocks: the rows of those sets there that are at or
    above the threshold, and the smallest set there that a chain of such links leads to (set itself, if to none smaller).

    Blocks hold at most `block` members and BLOCK_SHINGLES shingles on average, but one member at least. `counted`: a stored table with the labels of the members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            i, j, own, set_, rows = (group.column(c).to_numpy() for c in ("i", "j", "own", "set", "rows"))
            values, n = _lists(group.column("shingles"))
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            common = _common(values, n, a, b)
            links = np.zeros((len(set_), len(set_)), dtype=bool)
            links[np.ix_(a, b)] = common / (n[a][:, None] + n[b][None, :] - common) >= threshold
            links |= links.T
            np.fill_diagonal(links, False)
            by_set = np.argsort(set_)
            links = links[np.ix_(by_set, by_set)]
            set_, near, before = set_[by_set], np.arange(len(set_)), None
            while before is None or (near != before).any():
                before = near
                near = np.minimum(near, np.where(links, near[None, :], len(set_)).min(axis=1, initial=len(set_)))
                near = near[near]
            yield pa.RecordBatch.from_arrays([pa.array(set_), pa.array(set_[near]), pa.array(links @ rows[by_set])], names=["set", "near", "links"])

    each = F.count(F.lit(1))
    number = F.greatest(F.ceil(each / block), F.least(F.ceil(F.sum("n") / BLOCK_SHINGLES), each))
    sizes = members.groupBy("label").agg(number.cast("int").alias("blocks"))
    return in_blocks(spread_join(members, sizes, "label", ["set"], counted), "label").mapInArrow(run, "set long, near long, links long")


def _classed(docs: DataFrame, words: int, threshold: float, tries: int, recall: float, block: int) -> DataFrame:
    """(doc_id, text_hash, n, class, class_id, n_links), a row for each of `docs` (doc_id, text).

    class is null, class_id the row's own doc_id and n_links 0 for rows without a shingle or an id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = stored(signatures(docs, words, tries))
    known = rows.filter("doc_id is not null and n > 0")
    first = [F.first(c).alias(c) for c in ("n", "words", "sketch")]
    # Written once, so each set keeps its number.
    sets = stored(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"), *first).withColumn("set", F.monotonically_increasing_id()))
    sizes = sets.select("set", "n", "sketch", "rows")
    leaves = stored(sorted_leaves(sets, shortest_depth(threshold, tries, recall), tries))
    # The sets with a neighbour; one row of each is read again for its shingles. An id with several texts fits several sets, of which `shingle_sets` keeps the text's own.
    wanted = stored(sets.join(leaves.select("set").distinct(), "set", "left_semi").select("set", "set_a", "set_b", F.col("low").alias("doc_id")))
    n_wanted = wanted.count()
    vectors = stored(shingle_sets(sifted(docs, wanted, "doc_id", n_wanted).join(wanted, "doc_id"), words))
    if vectors.count() > n_wanted:  # repeated rows
        vectors = stored(vectors.dropDuplicates(["set"]))

    other = sizes.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    differ = F.aggregate(F.zip_with("sketch", "sketch_a", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    possible = (F.least("n", "n_a") >= F.lit(threshold) * F.greatest("n", "n_a")) & (differ <= far_apart(threshold))
    links, labels, depth, shortest = None, None, LEVELS, shortest_depth(threshold, tries, recall)
    while True:
        at = leaves.filter(F.col("matched") >= depth).select(node_of(depth).alias("node"), "set")
        at = at.withColumn("label", F.col("set")) if labels is None else at.join(labels.withColumnRenamed("id", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
        at = stored(at)
        open_ = at.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("node", "size")
        placed = stored(spread_join(at, open_, "node", ["set"]).withColumn("parts", parts_of("size", at.count())))
        meets = placed.groupBy("set").agg(F.sum("size").alias("meets"))
        heads = placed.join(meets, "set").groupBy("node").agg(F.max(F.struct("meets", (-F.col("set")).alias("minus"), "label")).alias("x"), F.first("parts").alias("parts")).select("node", "parts", (-F.col("x.minus")).alias("a"), F.col("x.label").alias("label_a"))
        pairs = stored(dealt_join(placed, heads, "node", ["set"], "parts").filter("label <> label_a").select("a", "set").distinct())
        near = spread_join(pairs.join(sizes.drop("rows"), "set"), other, "a", ["set"], pairs).filter(possible)
        new = stored(verified(near.select("a", F.col("set").alias("b")), vectors, threshold, pairs))
        links = new if links is None else links.unionByName(new)
        labels = components(links)
        similar = {r["s"]: r["count"] for r in links.groupBy(F.round("similarity", 2).alias("s")).count().collect()}  # at most 101 numbers
        if depth <= shortest or estimated_recall(similar, depth, threshold, tries) >= recall:
            break
        depth = next((d for d in range(depth - 1, shortest, -1) if estimated_recall(similar, d, threshold, tries) >= recall), shortest)

    placed = placed.drop("label").join(labels.withColumnRenamed("id", "set"), "set", "left").select("node", "set", "size", "parts", F.coalesce("label", "set").alias("label"))
    placed = stored(placed)
    split = placed.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.first("parts").alias("parts")).filter("low <> high").select("node", "parts")
    apart = stored(dealt_join(placed, split, "node", ["set"], "parts"))
    wide = stored(sketched(vectors.join(apart.select("set").distinct(), "set", "left_semi")))
    maybe = joined(apart.join(sizes.select("set", "n"), "set").join(wide, "set"), threshold, block)
    groups = components(stored(links.select("a", "b").unionByName(maybe)))
    held = vectors.join(groups.withColumnRenamed("id", "set"), "set").join(sizes.select("set", "rows", "n"), "set")
    found = stored(linked(held.select("label", "set", "rows", "n", "shingles"), groups, threshold, block))

    labels = components(found.filter("near <> set").select(F.col("set").alias("a"), F.col("near").alias("b")))
    counts = found.groupBy("set").agg(F.sum("links").alias("links"))
    classes = sets.select("set_a", "set_b", "set", "low", "rows").join(labels.withColumnRenamed("id", "set"), "set", "left").join(counts, "set", "left")
    classes = stored(classes.select("set_a", "set_b", "low", F.coalesce("label", "set").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links")))
    lowest = classes.groupBy("class").agg(F.min("low").alias("class_id"))
    classes = (spread_join(classes, lowest, "class", ["set_a"]).select(F.struct("set_a", "set_b").alias("key"), "class", "class_id", "n_links"))
    keyed = known.select("doc_id", "text_hash", "n", F.struct("set_a", "set_b").alias("key"))
    placed_rows = spread_join(keyed, classes, "key", ["doc_id"]).select("doc_id", "text_hash", "n", "class", "class_id", "n_links")
    alone = rows.filter("doc_id is null or n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return placed_rows.unionByName(alone)


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tries: int = TRIES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of `docs` (doc_id, text).

    class_id is the smallest doc_id of the component; n_links counts the other rows with an id whose shingle sets have at least
    the threshold's similarity with the row's own, copies among them. Texts
    without words (null and empty ones too) are classes of their own without links, as are rows with a null id,
    whose class is null. Repeated rows get the same result each, and link to each other; rows that share an id but not the text are
    rows like any others. Texts are compared whole, however long. An empty table gives an empty result. Other columns are not read.
    """
    return _classed(docs, words, threshold, tries, recall, block).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tries: int = TRIES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row of `docs` for each class, with all its columns: that with the smallest doc_id, of several texts with it that with the lowest hash.

    Rows without an id or without words stay. Of rows that repeat id and text one stays, whichever; rows of one id with different
    texts that are no near duplicates all stay.
    """
    rows = stored(_classed(docs, words, threshold, tries, recall, block))
    id_, hash_ = free_names(docs, "id_", "hash_")
    best = rows.filter("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select(F.col("x.doc_id").alias(id_), F.col("x.text_hash").alias(hash_))
    best = stored(best)
    worded = rows.filter("class is not null").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    bare = rows.filter("class is null and doc_id is not null").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(hash_, F.xxhash64("text"))
    kept = keyed.join(best.unionByName(bare), [id_, hash_], "left_semi")
    if worded.join(best, [id_, hash_], "left_semi").count() > best.count():  # rows that repeat id and text
        one = keyed.join(best, [id_, hash_], "left_semi").dropDuplicates([id_, hash_])
        kept = one.unionByName(keyed.join(bare, [id_, hash_], "left_semi"))
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
