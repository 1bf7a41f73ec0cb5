"""Best-fit packing of token sequences.

Documents are tokenised where they lie; what is shuffled is one small row per piece. All bins are
planned on the histogram of piece lengths, which has at most `capacity` entries whatever the input
holds, and each piece then finds its bin from its rank among the pieces of its length. So the driver
sees counts only, never pieces, and no task sees all pieces of one length: ranks are taken within
(length, salt) and shifted by the counts of the salts before. Pieces that fill a sequence need no rank: each is one.

Planning, in the order of the method:
  1. lengths above a third of the capacity meet at most twice per bin: the longest takes the longest
     partner that still fits;
  2. the other lengths, longest first, go to the bins with the smallest gap that holds them, and to
     new bins where no gap does.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_names, stored

SALTS = 64
#: Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file (tokenizers' JSON).

    The file's vocabulary lists the merges in rank order, so tiktoken's faster merge loop gives the
    same ids; texts that its pattern engine refuses or that hold an added token (such as <|endoftext|>) go to
    the tokenizers library itself, which gives added tokens their own ids.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, added = content["model"]["vocab"], content.get("added_tokens") or []
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(shown[c] for c in word): i for word, i in vocabulary.items() if not word.startswith("<|")}
        self.path, self.exact = path, None
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.added and self.added.search(text):
            return self.library_ids(text)
        try:
            return np.array(self.encoding.encode_ordinary(text), dtype="<u4")
        except BaseException as error:
            if type(error).__name__ != "PanicException":  # what the engine raises on texts it refuses; no subclass of Exception and importable from nowhere
                raise
            return self.library_ids(text)

    def library_ids(self, text: str) -> np.ndarray:
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every document: its ids, then `end_id`, cut into pieces of at most `capacity`.

    A null text counts as empty and yields the end id alone. Repeated rows and repeated keys yield
    their pieces each time. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe(vocabulary)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for i in range(batch.num_rows):
                ids = np.append(encoder.ids(batch.column(1)[i].as_py() or ""), np.uint32(end_id)).astype("<u4")
                doc = batch.column(0)[i].as_py()
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    for column, value in zip(out, (doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first bin, offset): the pieces of a length with these ranks
    lie in consecutive bins at one offset. At most a few runs for each length and gap."""
    left = {length: n for length, n in counts.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    open_bins: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
    gaps: list[int] = []
    bins = 0

    def take(length: int, n: int, first_bin: int, offset: int) -> None:
        runs.append((length, used[length], n, first_bin, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first_bin: int, n: int) -> None:
        if gap and n:
            if not open_bins[gap]:
                insort(gaps, gap)
            open_bins[gap].append((first_bin, n))

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= capacity - a and left[x] > (x == a)), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            take(a, n, bins, 0)
            if b is not None:
                take(b, n, bins, a)
            leave(capacity - a - (b or 0), bins, n)
            bins += n
    for a in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[a]:
            at = bisect_left(gaps, a)
            if at == len(gaps):
                each = capacity // a
                n = max(1, left[a] // each)
                fit = min(each, left[a])
                for j in range(fit):
                    take(a, n, bins, j * a)
                leave(capacity - fit * a, bins, n)
                bins += n
                continue
            gap = gaps[at]
            first, n = open_bins[gap].popleft()
            m = min(n, left[a])
            if m < n:
                open_bins[gap].appendleft((first + m, n - m))
            if not open_bins[gap]:
                gaps.pop(at)
            take(a, m, first, capacity - gap)
            leave(gap - a, first, m)
    return runs


def pack(pieces: DataFrame, capacity: int = 1024, salts: int = SALTS) -> DataFrame:
    """`pieces` with sequence_id and offset. Lengths lie between 1 and `capacity`.

    Pieces as long as the capacity are sequences of their own and are not ranked. The others get a salt by their place in the table, so
    that no (length, salt) gathers equal rows; there are `salts` of them, and more from `salts` x 2^20 pieces on. Columns of `pieces` pass
    through, whatever their names, but for sequence_id and offset, which are replaced. An empty table gives an empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    kept = [f.name for f in pieces.schema]
    place_at, salt_at, rank_at = free_names(pieces, "place_", "salt_", "rank_")
    table = stored(pieces.withColumn(place_at, F.xxhash64(F.monotonically_increasing_id())))  # written once, so each piece keeps its place
    salts = max(salts, min(4096, table.count() >> 20))
    salted = table.filter(F.col("length") < capacity).withColumn(salt_at, F.pmod(place_at, F.lit(salts)).cast("int"))
    count = np.zeros((capacity + 1, salts), dtype=np.int64)
    for row in salted.groupBy("length", salt_at).count().collect():  # at most capacity x salts rows
        count[row["length"], row[salt_at]] = row["count"]
    base = np.cumsum(count, axis=1) - count
    runs = np.array(sorted(plan_bins({i: int(n) for i, n in enumerate(count.sum(axis=1))}, capacity)), dtype=np.int64).reshape(-1, 5)
    span = np.int64(1) << np.int64(44)
    starts = runs[:, 0] * span + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", salt_at, rank_at))
            rank = base[length, salt] + rank - 1
            run = np.searchsorted(starts, length * span + rank, side="right") - 1
            sequence = runs[run, 3] + rank - runs[run, 1]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(runs[run, 4])], names=[*kept, "sequence_id", "offset"])

    order = Window.partitionBy("length", salt_at).orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn(rank_at, F.row_number().over(order).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = ranked.mapInArrow(place, f"{schema}, sequence_id long, `offset` long")
    bins = int((runs[:, 3] + runs[:, 2]).max(initial=0))
    full = table.filter(F.col("length") >= capacity).select(*kept, (F.monotonically_increasing_id() + bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise, cut and pack whole documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(token_pieces(docs, vocabulary, capacity, end_id), capacity)
