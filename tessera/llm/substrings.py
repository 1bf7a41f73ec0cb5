"""Exact substring deduplication over sorted suffixes.

A byte goes if a `length`-byte string that covers it also starts in a document with a smaller id. Sorting a
suffix at every byte would shuffle many times the corpus, so suffixes are taken at anchors only: the positions
whose 16 leading bytes hash lowest among the neighbours. The choice depends on the bytes of a window alone, so
equal windows hold equal anchors, and every window of `length` bytes holds one. About one suffix in 17 remains.

  1. Splitters sampled from the anchors' leading 16 bytes cut the suffixes into ranges. Each range sorts its suffixes
     by multikey quicksort (word by word, only ties go deeper). Splitters are whole 16-byte
     prefixes, so suffixes that could match never lie on two sides of a boundary: the comparison across
     boundaries is decided by where the boundaries lie. Suffixes whose prefix starts in two documents remain.
  2. Those fetch their context (all windows around the anchor) from the texts and go to the same ranges, where equal
     windows meet and the smallest document of each is found: hashes of windows propose, their bytes decide; a mask says which windows of the anchor go.
  3. Masks return to the texts, which lose what the windows cover.

No prefix gathers all its anchors in one task, even where a third of all rows share a passage:
  - A task that sees one context in several documents sends it for the smallest only, as the others lose all
    of it whatever the rest of the corpus holds. That folds the inside of a passage. Anchors within 34 bytes of its start or
    50 of its end have another context in every document and don't fold.
  - In step 1 a task that sees a prefix in two documents knows it is shared: its range gets two rows with their count,
    the anchors go straight to their homes.
  - In step 2 a prefix with many anchors (`hot_size`, counted in step 1) is met window by window: each home takes the smallest
    document of every window, and only these windows meet, dealt by their hash. At most HOT_PER_RANGE prefixes a range are so hot.
What one document repeats within itself is not folded. Everywhere hashes only propose, and bytes decide.
What is shuffled are compressed arrays, one for each task and range; texts travel once for step 2 and once for step 3.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_names, mix64, shuffle_width, stored

LENGTH, PREFIX, PAD = 50, 16, 64
NAMES = ("n_bytes", "n_removed", "n_spans", "kept")
#: Bytes of text that one numpy pass covers, and anchors that one task gathers before it sends them.
PASS_BYTES, FLUSH = 1 << 20, 1 << 20
RANGES_PER_PARTITION, SAMPLE_DOCS, SAMPLE_ANCHORS = 2, 8, 8
#: Anchors with one prefix above which their windows are dealt one by one: HOT at least, and so many that no more than HOT_PER_RANGE such prefixes can exist for each range.
HOT, HOT_PER_RANGE = 1 << 15, 512
MARK, TEXT, ANCHOR, CONTEXT, SENT_HOME, WINDOW, HOT_PREFIX = range(7)
SHAPE = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
SHIPPED = "to int, kind int, blob binary"


def wrap(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unwrap(blob: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def shipment(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[], [], []], SHAPE.types, strict=True)], schema=SHAPE)


def spread(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions) of each distinct value."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(to[part[0]]), part


def multikey_order(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of groups of equal keys): three-way radix quicksort with 8-byte words as characters.

    Each pass sorts by one word; only runs of equal words go on to the next one, all at once.
    """
    order = np.argsort(words[0], kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = words[0][order[1:]] != words[0][order[:-1]]
    for word in words[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        inner = np.lexsort((word[order[at]], group))
        order[at] = order[at[inner]]
        value = word[order[at]]
        new[at[1:]] |= value[1:] != value[:-1]
    return order, np.flatnonzero(new)


def _slide(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values, span = pick(values[:-span], values[span:]), span * 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


class Buffer:
    """Documents as one byte array, zeros between them."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = PAD + np.concatenate([[0], np.cumsum(self.sizes + PAD)[:-1]]).astype(np.int64)
        zeros = bytes(PAD)
        self.bytes = np.frombuffer(zeros + zeros.join(texts) + zeros, np.uint8)

    def words(self, kind: str = "<u8") -> np.ndarray:
        return np.ndarray((len(self.bytes) - 7,), dtype=kind, buffer=self.bytes, strides=(1,))

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, document) of every anchor."""
        width, word = length - PREFIX + 1, self.words()
        n = len(self.bytes) - PREFIX + 1
        h = word[:n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += word[8 : 8 + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        rank = (h >> np.uint64(32)).astype(np.uint32)
        del h
        rank |= np.uint32(1)
        best = _slide(rank, width, np.minimum)
        inside = np.zeros(len(best) + 1, dtype=np.int8)
        whole = self.sizes >= length
        np.add.at(inside, self.starts[whole], 1)
        np.add.at(inside, self.starts[whole] + self.sizes[whole] - length + 1, -1)
        best *= np.cumsum(inside[:-1], dtype=np.int8).astype(np.uint32)
        padded = np.zeros(len(best) + 2 * (width - 1), dtype=np.uint32)
        padded[width - 1 : width - 1 + len(best)] = best
        at = np.flatnonzero(_slide(padded, width, np.maximum) == rank)
        return at, np.searchsorted(self.starts, at, side="right") - 1

    def context_hash(self, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
        """Of all bytes of the windows around each anchor, and of how many of them the document has."""
        word, left = self.words(), length - PREFIX
        inside = at - self.starts[doc]
        h = mix64((np.minimum(inside, left) << 8 | np.minimum(self.sizes[doc] - inside, length)).astype(np.uint64))
        for offset in [*range(-left, length - 8, 8), length - 8]:
            h ^= word[at + offset]
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        return h


def whole_mask(inside: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Bit a: the window that starts a bytes before the anchor lies in the document."""
    high = np.minimum(length - PREFIX, inside).astype(np.uint64)
    low = np.maximum(0, inside + length - size).astype(np.uint64)
    one = np.uint64(1)
    return ((one << (high + one)) - one) & ~((one << low) - one)


def range_of(w0: np.ndarray, w1: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The number of splitters (rows of two words) that are not above each prefix."""
    low, high = np.searchsorted(cuts[:, 0], w0, side="left"), np.searchsorted(cuts[:, 0], w0, side="right")
    out = low.copy()
    while len(tied := np.flatnonzero((out < high) & (cuts[np.minimum(out, len(cuts) - 1), 1] <= w1) if len(cuts) else [])):
        out[tied] += 1
    return out.astype(np.int32)


def earliest(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row a row of the smallest document among those with its hash; a row of the smallest document is its own."""
    order = np.lexsort((doc, h))
    out = np.empty(len(h), dtype=np.int64)
    if len(h):
        starts = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
        out[order] = np.repeat(order[starts], np.diff(np.append(starts, len(h))))
        own = doc[out] == doc
        out[own] = np.flatnonzero(own)
    return out


def first_windows(h: np.ndarray, doc: np.ndarray, context: np.ndarray, rows: np.ndarray, low: int, length: int) -> np.ndarray:
    """Whether the bytes [low, low + length) of each context lie in no context of a smaller document; hashes propose, bytes decide."""
    first = earliest(h, doc)
    later = np.flatnonzero(first != np.arange(len(h)))
    out = np.ones(len(h), dtype=bool)
    out[later] = False
    for at in range(0, len(later), 1 << 15):
        x = later[at : at + (1 << 15)]
        if (context[rows[x], low : low + length] != context[rows[first[x]], low : low + length]).any():
            _, same = np.unique(np.ascontiguousarray(context[rows, low : low + length]).view(f"V{length}").ravel(), return_inverse=True)
            return earliest(same, doc) == np.arange(len(h))
    return out


def shared_here(w0: np.ndarray, w1: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each row's prefix lies in two documents; of these prefixes the rows of the smallest and the largest document, and how many rows they have."""
    order, starts = multikey_order([w0, w1])
    sizes = np.diff(np.append(starts, len(order)))
    ranked = order[np.lexsort((doc[order], np.repeat(np.arange(len(starts)), sizes)))]
    low, high = ranked[starts], ranked[starts + sizes - 1]
    two = doc[low] != doc[high]
    shared = np.empty(len(order), dtype=bool)
    shared[order] = np.repeat(two, sizes)
    return shared, np.stack([low[two], high[two]]), sizes[two]


def hot_size(n_bytes: int, ranges: int) -> int:
    """Anchors with one prefix above which it is hot. As there are no more anchors than bytes, at most HOT_PER_RANGE * ranges prefixes are."""
    return max(HOT, -(-n_bytes // (HOT_PER_RANGE * ranges)))


def is_hot(word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether each row of two words is among the rows of `hot`."""
    out = np.zeros(len(hot) + len(word), dtype=bool)
    if len(hot):
        both = np.concatenate([hot, word])
        order, starts = multikey_order([both[:, 0], both[:, 1]])
        out[order] = np.repeat(np.logical_or.reduceat(order < len(hot), starts), np.diff(np.append(starts, len(order))))
    return out[len(hot) :]


def distinct(*columns: np.ndarray) -> np.ndarray:
    """Positions of one row of each distinct row."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    return order[new]


def window_hashes(context: np.ndarray, whole: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(a, rows that have a window a bytes before their anchor, hashes of these windows); the hash depends on the window's bytes alone."""
    left, base = length - PREFIX, 0x2545F4914F6CDD1D
    inverse = pow(base, -1, 1 << 64)
    table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
    power = np.cumprod(np.full(context.shape[1], base, dtype=np.uint64))
    prefix = np.zeros((len(context), context.shape[1] + 1), dtype=np.uint64)
    for j in range(context.shape[1]):  # a polynomial over scrambled bytes, modulo 2^64
        prefix[:, j + 1] = prefix[:, j] + table[context[:, j]] * power[j]
    for a in range(left + 1):
        have = np.flatnonzero(whole >> np.uint64(a) & np.uint64(1))
        shift = np.uint64(pow(inverse, left - a, 1 << 64))
        yield a, have, (prefix[have, left - a + length] - prefix[have, left - a]) * shift


def window_masks(context: np.ndarray, whole: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Bit a: the window that starts a bytes before the anchor also lies, as far before its anchor, in a smaller document."""
    mask = np.zeros(len(context), dtype=np.uint64)
    for a, have, h in window_hashes(context, whole, length):
        later = ~first_windows(h, doc[have], context, have, length - PREFIX - a, length)
        mask[have[later]] |= np.uint64(1) << np.uint64(a)
    return mask


def least_windows(context: np.ndarray, whole: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(mask as of window_masks among these rows; row, a and hash of the windows of the smallest document)."""
    mask, found = np.zeros(len(context), dtype=np.uint64), []
    for a, have, h in window_hashes(context, whole, length):
        first = first_windows(h, doc[have], context, have, length - PREFIX - a, length)
        mask[have[~first]] |= np.uint64(1) << np.uint64(a)
        found.append((have[first], np.full(int(first.sum()), a, dtype=np.uint8), h[first]))
    return mask, *(np.concatenate(c) for c in zip(*found, strict=True))


def later_windows(h: np.ndarray, window: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions of the windows whose bytes also lie in a smaller document."""
    return np.flatnonzero(~first_windows(h, doc, window, np.arange(len(h)), 0, window.shape[1]))


def same_context(x: np.ndarray, y: np.ndarray, text: np.ndarray, place: np.ndarray, whole: np.ndarray, length: int) -> np.ndarray:
    """Whether the anchors x and y (numbers of rows) have the same windows around them, byte for byte."""
    around, same = np.arange(PREFIX - length, length), whole[x] == whole[y]
    for at in range(0, len(x), 1 << 15):
        i, j = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
        same[at : at + (1 << 15)] &= (text[place[i][:, None] + around] == text[place[j][:, None] + around]).all(axis=1)
    return same


def masks_of_prefix_groups(order: np.ndarray, starts: np.ndarray, context: np.ndarray, whole: np.ndarray, doc: np.ndarray, length: int, at_once: int = 1 << 14) -> np.ndarray:
    """window_masks over runs of whole groups, about `at_once` rows at a time."""
    mask = np.zeros(len(order), dtype=np.uint64)
    ends = np.append(starts[1:], len(order))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + at_once, side="right")))
        rows = order[starts[at] : ends[to - 1]]
        mask[rows] = window_masks(context[rows], whole[rows], doc[rows], length)
        at = to
    return mask


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [x.as_py() or b"" for x in column]


def _passes(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, last, texts) of runs of rows; only one run's texts are held at a time."""
    first = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_pylist()):
        if i > first and size + n > PASS_BYTES:
            yield first, i, _texts(batch.slice(first, i - first), name)
            first, size = i, 0
        size += n
    if batch.num_rows > first:
        yield first, batch.num_rows, _texts(batch.slice(first), name)


def _emptied(parts: list[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
    """The columns of `parts`, one after the other; a column's parts go once they are put together."""
    columns = [list(c) for c in zip(*parts, strict=True)]
    parts.clear()
    for i in range(len(columns)):
        yield np.concatenate(columns[i])
        columns[i] = None


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, decoded: bool = False, names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: what is left).

    The key is an integer. Null texts count as empty; rows with a null key keep everything and take nothing
    from others. Rows with equal keys don't take from each other. Documents shorter than `length` bytes stay.
    Other columns pass through; columns of the four new names, or what `names` calls them, are replaced. An empty table gives an empty result. `decoded` puts what is left into the text column
    instead of `kept`, without the characters that a cut went through; uncut texts stay as they are.
    """
    if not PREFIX <= length <= PREFIX + 63 or length > PAD:
        raise ValueError("length must lie between 16 and 64")
    spark, left = docs.sparkSession, length - PREFIX
    width = shuffle_width(spark)
    ranges = width * RANGES_PER_PARTITION
    docs = docs.drop(*names)
    hash_at, home_at = free_names(docs, "__hash", "__home")
    # Rows are told apart by their key; only where keys repeat does a hash of the text travel along.
    repeated = docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).count()
    # Rows without a key get no marks: any home does.
    keyed = docs.withColumn(hash_at, F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(text) if repeated else F.lit(0).cast("long")))
    keyed = keyed.withColumn(home_at, F.pmod(F.xxhash64(key, hash_at), F.lit(width)).cast("int"))
    lean = keyed.select(F.col(key).cast("long").alias("doc"), F.col(hash_at).alias("__hash"), F.col(home_at).alias("__home"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & (F.octet_length("text") >= length))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_ in _texts(batch, "text"):
                buffer = Buffer([text_])
                at, _ = buffer.anchors(length)
                word = buffer.words(">u8")
                at = at[np.argsort(mix64(word[at].astype(np.uint64)))[:SAMPLE_ANCHORS]] if len(at) > SAMPLE_ANCHORS else at
                yield pa.RecordBatch.from_arrays([pa.array(word[at + o].astype(np.uint64).view(np.int64)) for o in (0, 8)], names=["w0", "w1"])

    n, n_bytes = lean.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    hot_from = hot_size(n_bytes, ranges)
    picked = lean.select("text").sample(min(1.0, SAMPLE_DOCS * ranges / max(1, n)), seed=11).mapInArrow(sample, "w0 long, w1 long").collect()  # a few pairs of words a range
    pairs = np.array([(r["w0"], r["w1"]) for r in picked], dtype=np.int64).reshape(-1, 2).view(np.uint64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    cuts = np.unique(pairs[np.arange(1, ranges) * len(pairs) // ranges], axis=0) if len(pairs) else pairs

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, ...]] = []
        owners: list[tuple[np.ndarray, ...]] = []
        passes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            doc_of, hash_of, home_of, size_of = _emptied(owners)
            h, row, inside, place = _emptied(gathered)
            text_ = np.concatenate(passes)
            passes.clear()
            inside, doc, hash_, home = inside.astype(np.int64), doc_of[row], hash_of[row], home_of[row]
            before, whole = earliest(h, doc), whole_mask(inside, size_of[row], length)
            del row
            later = np.flatnonzero(before != np.arange(len(h)))
            gone = later[same_context(later, before[later], text_, place, whole, length)]
            first, rows = np.ones(len(h), dtype=bool), []
            first[gone] = False
            word = np.ndarray((len(text_) - 7,), dtype=">u8", buffer=text_, strides=(1,))
            w0, w1 = word[place].astype(np.uint64), word[place + 8].astype(np.uint64)
            del h, before, later, text_, place, word
            for home_, part in spread(home[gone]):
                x = gone[part]
                rows.append((home_, MARK, wrap(doc[x], hash_[x], inside[x].astype(np.uint32), whole[x])))
            kept = np.flatnonzero(first)
            shared, ends, sizes = shared_here(w0[kept], w1[kept], doc[kept])
            known = kept[shared]
            for home_, part in spread(home[known]):
                x = known[part]
                rows.append((home_, SENT_HOME, wrap(doc[x], hash_[x], inside[x].astype(np.uint32))))
            # Rows that stand for anchors sent home have no home; the first of the two carries their count.
            open_, stand = kept[~shared], kept[ends.ravel()]
            sent, weight = np.concatenate([open_, stand]), np.concatenate([np.ones(len(open_), np.int64), sizes, np.zeros(len(sizes), np.int64)])
            to = np.concatenate([home[open_], np.full(len(stand), -1, home.dtype)])
            for range_, p in spread(range_of(w0[sent], w1[sent], cuts)):
                x = sent[p]
                rows.append((range_, ANCHOR, wrap(w0[x], w1[x], doc[x], hash_[x], to[p], inside[x].astype(np.uint32), weight[p])))
            return shipment(rows)

        held = n_text = n_rows = 0
        for batch in batches:
            docs_, hashes, homes = (batch.column(i).to_numpy() for i in range(3))
            for a, b, texts in _passes(batch, "text"):
                buffer = Buffer(texts)
                at, doc = buffer.anchors(length)
                gathered.append((buffer.context_hash(at, doc, length), (n_rows + doc).astype(np.int32), (at - buffer.starts[doc]).astype(np.uint32), at + n_text))
                owners.append((docs_[a:b], hashes[a:b], homes[a:b], buffer.sizes))
                passes.append(buffer.bytes)
                held, n_text, n_rows = held + len(at), n_text + len(buffer.bytes), n_rows + b - a
                if held >= FLUSH:
                    yield flush()
                    held = n_text = n_rows = 0
        if gathered:
            yield flush()

    def by_range(batches: Iterator[pa.RecordBatch], works: dict[int, Callable]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by `to` and kind; the work of a kind gets the columns of each range; marks and what goes home pass through."""
        at, parts = None, []
        for batch in batches:
            for to, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind not in works:
                    yield shipment([(to, ANCHOR if kind == SENT_HOME else kind, blob)])
                    continue
                if (to, kind) != at and parts:
                    yield works[at[1]]([np.concatenate(c) for c in zip(*parts, strict=True)])
                    parts = []
                at = to, kind
                parts.append(unwrap(blob))
        if parts:
            yield works[at[1]]([np.concatenate(c) for c in zip(*parts, strict=True)])

    def find_shared(columns: list[np.ndarray]) -> pa.RecordBatch:
        w0, w1, doc, hash_, home, inside, weight = columns
        order, starts = multikey_order([w0, w1])
        two = np.minimum.reduceat(doc[order], starts) != np.maximum.reduceat(doc[order], starts)
        x = order[np.repeat(two, np.diff(np.append(starts, len(order)))) & (home[order] >= 0)]
        rows = [(home_, ANCHOR, wrap(doc[x[p]], hash_[x[p]], inside[x[p]])) for home_, p in spread(home[x])]
        if len(many := order[starts[two & (np.add.reduceat(weight[order], starts) > hot_from)]]):
            rows.append((0, HOT_PREFIX, wrap(w0[many], w1[many])))
        return shipment(rows)

    def find_masks(columns: list[np.ndarray]) -> pa.RecordBatch:
        context, whole, doc, hash_, home, inside = columns
        word = np.ascontiguousarray(context[:, left : left + PREFIX]).view(">u8").astype(np.uint64)
        order, starts = multikey_order([word[:, 0], word[:, 1]])
        mask = masks_of_prefix_groups(order, starts, context, whole, doc, length)
        x = np.flatnonzero(mask)
        return shipment([(home_, MARK, wrap(doc[x[p]], hash_[x[p]], inside[x[p]], mask[x[p]])) for home_, p in spread(home[x])])

    def find_window_masks(columns: list[np.ndarray]) -> pa.RecordBatch:
        h, window, a, doc, hash_, home, inside = columns
        x = later_windows(h, window, doc)
        return shipment([(home_, MARK, wrap(doc[x[p]], hash_[x[p]], inside[x[p]], np.uint64(1) << a[x[p]].astype(np.uint64))) for home_, p in spread(home[x])])

    def send_texts(batches: Iterator[pa.RecordBatch], home: str) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            rows = []
            for to, part in spread(batch.column(batch.schema.get_field_index(home)).to_numpy()):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.take(pa.array(part)))
                rows.append((to, TEXT, sink.getvalue().to_pybytes()))
            yield shipment(rows)

    def at_home(batches: Iterator[pa.RecordBatch], marks: int, work: Callable, done: Callable) -> Iterator[pa.RecordBatch]:
        """Of each home, first its marks, then its texts; work(found, batch) for each batch of texts, done(home) at its end."""
        at, parts, found = None, [], None
        for shipped in batches:
            for to, kind, blob in zip(*(c.to_pylist() for c in shipped.columns), strict=True):
                if to != at:
                    if at is not None:
                        yield from done(at)
                    at, parts, found = to, [], None
                if kind == marks:
                    parts.append(unwrap(blob))
                elif kind == TEXT:
                    if found is None:
                        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else []
                        order = np.lexsort((columns[1], columns[0])) if parts else np.empty(0, np.int64)
                        columns = [c[order] for c in columns]
                        new = np.flatnonzero(np.concatenate([[True], (np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)])) if parts else []
                        ends = [*new[1:], len(order)] if parts else []
                        found = {(int(columns[0][a]), int(columns[1][a])): (a, b) for a, b in zip(new, ends, strict=True)}, columns
                        parts = []
                    yield from work(found, pa.ipc.open_stream(blob).read_next_batch())
        if at is not None:
            yield from done(at)

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, ...]] = []

        def work(found, batch):
            spans, columns = found
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            at = [spans.get(k) for k in keys]
            have = [i for i, a in enumerate(at) if a is not None]
            for a, b, texts in _passes(batch.take(pa.array(have, pa.int64())), "text"):
                buffer = Buffer(texts)
                rows = np.concatenate([np.arange(*at[have[i]]) for i in range(a, b)])
                doc = np.repeat(np.arange(b - a), [at[have[i]][1] - at[have[i]][0] for i in range(a, b)])
                inside = columns[2][rows].astype(np.int64)
                place = buffer.starts[doc] + inside
                h = buffer.context_hash(place, doc, length)
                gathered.append((h, buffer.bytes[place[:, None] + np.arange(-left, length)], whole_mask(inside, buffer.sizes[doc], length), columns[0][rows], columns[1][rows], columns[2][rows]))
            return ()

        def done(home):
            if not gathered:
                return
            h, context, whole, doc, hash_, inside = _emptied(gathered)
            before = earliest(h, doc)
            later = np.flatnonzero(before != np.arange(len(h)))
            same = [(context[x] == context[before[x]]).all(axis=1) & (whole[x] == whole[before[x]]) for x in np.array_split(later, len(later) // (1 << 15) + 1)]
            gone = later[np.concatenate(same)]
            first, rows = np.ones(len(h), dtype=bool), []
            first[gone] = False
            kept = np.flatnonzero(first)
            if len(gone):
                rows.append((home, MARK, wrap(doc[gone], hash_[gone], inside[gone], whole[gone])))
            word = np.ascontiguousarray(context[kept, left : left + PREFIX]).view(">u8").astype(np.uint64)
            homes = np.full(len(doc), home, dtype=np.int32)
            many = is_hot(word, hot_prefixes)
            hot_rows, kept, word = kept[many], kept[~many], word[~many]
            for start in range(0, len(hot_rows), HOT):
                x = hot_rows[start : start + HOT]
                mask, row, a, h = least_windows(context[x], whole[x], doc[x], length)
                if len(lost := np.flatnonzero(mask)):
                    rows.append((home, MARK, wrap(doc[x[lost]], hash_[x[lost]], inside[x[lost]], mask[lost])))
                y = x[row]
                once = distinct(doc[y], hash_[y], inside[y].astype(np.int64) - a)  # a window with several such anchors
                for bucket, part in spread((mix64(h[once]) % np.uint64(ranges)).astype(np.int32)):
                    p = once[part]
                    window = context[y[p][:, None], left - a[p].astype(np.int64)[:, None] + np.arange(length)]
                    rows.append((bucket, WINDOW, wrap(h[p], window, a[p], doc[y[p]], hash_[y[p]], homes[y[p]], inside[y[p]])))
            for range_, part in spread(range_of(word[:, 0], word[:, 1], cuts)):
                x = kept[part]
                rows.append((range_, CONTEXT, wrap(context[x], whole[x], doc[x], hash_[x], homes[x], inside[x])))
            yield shipment(rows)

        yield from at_home(batches, ANCHOR, work, done)

    passed, text_at = list(docs.columns), docs.columns.index(text)

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(found, batch):
            spans, columns = found
            schema = batch.schema
            keys = zip(batch.column(schema.get_field_index(key)).to_pylist(), batch.column(schema.get_field_index(hash_at)).to_pylist(), strict=True)
            texts, sizes, removed, runs, kept = _texts(batch, text), [], [], [], []
            for k, t in zip(keys, texts, strict=True):
                sizes.append(len(t))
                if (span := spans.get(k)) is None:
                    removed.append(0)
                    runs.append(0)
                    kept.append(t)
                    continue
                at, mask = columns[2][span[0] : span[1]].astype(np.int64), columns[3][span[0] : span[1]]
                window, bit = np.nonzero((mask[:, None] >> np.arange(left + 1, dtype=np.uint64)) & np.uint64(1))
                starts = np.unique(at[window] - bit)
                change = np.zeros(len(t) + 1, dtype=np.int32)
                change[starts] += 1
                change[starts + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
                kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
            columns_ = [batch.column(schema.get_field_index(c)) for c in passed]
            if decoded:
                texts_ = pa.array([k.decode("utf-8", "ignore") if n else x.as_py() for k, n, x in zip(kept, removed, columns_[text_at], strict=True)], columns_[text_at].type)
                columns_[text_at], kept = texts_, [None] * len(kept)
            yield pa.RecordBatch.from_arrays([*columns_, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=[*passed, *names])

        yield from at_home(batches, MARK, work, lambda home: ())

    def dealt(shipped: DataFrame) -> DataFrame:
        return shipped.repartition(width, "to").sortWithinPartitions("to", "kind")

    def anchors_and_marks() -> tuple[DataFrame, DataFrame, np.ndarray]:
        sent = stored(dealt(lean.mapInArrow(send_anchors, SHIPPED)).mapInArrow(lambda x: by_range(x, {ANCHOR: find_shared}), SHIPPED))
        found = [unwrap(r["blob"]) for r in sent.filter(F.col("kind") == HOT_PREFIX).select("blob").collect()]
        # at most HOT_PER_RANGE a range, whatever the size of the input
        return sent.filter(F.col("kind") == ANCHOR), sent.filter(F.col("kind") == MARK), np.concatenate([np.stack(x, axis=1) for x in found]) if found else np.empty((0, 2), np.uint64)

    shared, early, hot_prefixes = anchors_and_marks()
    # Anchors sort before texts at their homes; marks of both steps pass on.
    first_kind = F.when(F.col("kind") == TEXT, TEXT + 10).otherwise(F.col("kind"))
    to_home = lambda a, b: a.unionByName(b).withColumn("_first", first_kind).repartition(width, "to").sortWithinPartitions("to", "_first").drop("_first")
    contexts = to_home(shared, lean.mapInArrow(lambda x: send_texts(x, "__home"), SHIPPED)).mapInArrow(send_contexts, SHIPPED)
    late = stored(dealt(contexts).mapInArrow(lambda x: by_range(x, {CONTEXT: find_masks, WINDOW: find_window_masks}), SHIPPED))
    marks = early.unionByName(late)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return to_home(marks, keyed.mapInArrow(lambda x: send_texts(x, home_at), SHIPPED)).mapInArrow(cut_texts, f"{schema}, `{names[0]}` long, `{names[1]}` long, `{names[2]}` long, `{names[3]}` binary")


def removal_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of remove_repeated."""
    rows = remove_repeated(docs.select("doc_id", "text"), length=length)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
