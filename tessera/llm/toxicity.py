"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Two words are as similar as the three-character subsequences that they share, gaps allowed and paid for by their length (the
gap-weighted subsequence kernel over stretches of up to `SPAN` characters, normalised; a word's two ends count as characters). An
insult with characters put in, or with another ending, keeps most of its subsequences. A sentence is as toxic as its most toxic word,
a text as its most toxic sentence.

Training, on the driver, on at most `per_class` labelled texts of either class: the words that labelled texts of one class share and
the other lacks start as witnesses of toxic texts (also with a character put in); landmarks are picked among witnesses, ordinary words
and the most mistakable words of other texts, each as far as possible from those before; a linear machine over the Nystroem features is fitted by multiple-instance rounds, in which each toxic text's best word is its
witness and all words of other texts are negative. The scores of whole texts then give the probability by logistic calibration.

Machine and landmarks together weigh each subsequence by one number, so a word costs one look-up for each of its subsequences.
Prediction runs where the texts lie; words are remembered in a table of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.language import remainder

DECAY, SPAN, WIDTH, STRIDE, LANDMARKS = 0.6, 6, 20, 10, 256
#: Bound of the fit alone: labelled texts of a class, all of whose words count; ordinary words among which the landmarks of their kind are chosen. Scores know no bound.
PER_CLASS, ORDINARY = 1200, 1000
ROUNDS, REMEMBERED = 4, 400_000
#: Share of the best word's evidence from which a word of the same text is a witness too.
STRONG = 0.7
#: One letter at a time, as in i d i o t.
SPACED = re.compile(r"(?:\b[^\W\d_]\b[\s.*_-]{1,3}){3,}[^\W\d_]\b")


def tokens(text: str | None) -> set[str]:
    """The distinct lower-cased pieces of a text between white space, and its spelled-out words joined."""
    low = (text or "").lower()
    found = set(low.split())
    found.update("".join(filter(str.isalpha, m.group())) for m in SPACED.finditer(low))
    return found


def pieces(word: str) -> list[str]:
    """A word without the punctuation around it, in overlapping stretches if it is long."""
    word = word.strip("\"'`.,;:!?()[]{}<>|/\\%&$#*-_~+=«»“”…")
    if len(word) <= WIDTH:
        return [word] if word else []
    return [word[i : i + WIDTH] for i in range(0, len(word) - STRIDE, STRIDE)]


@dataclass
class Subsequences:
    """Numbers for the subsequences of three of some words, all of their letters included.

    Other words are numbered by them too: what they have besides is in no such word and adds nothing to a kernel value with one.
    """

    letters: np.ndarray  # code point -> letter, 0: in none of the words
    size: int
    known: np.ndarray | None = None  # sorted subsequences, where all triples of letters would be too many

    @classmethod
    def of(cls, words: list[str], dense: int = 1 << 18) -> Subsequences:
        letters = np.zeros(0x110000, dtype=np.int32)
        letters[[1, 2, *sorted({ord(c) for w in words for c in w})]] = 1
        letters = np.cumsum(letters, dtype=np.int32) * letters
        size = int(letters.max()) + 1
        if size**3 <= dense:
            return cls(letters, size)
        plain = [np.unique(cls(letters, size).numbers(words[at : at + 1024], plain_only=True)) for at in range(0, len(words), 1024)]
        known = np.unique(np.concatenate(plain))
        return cls(letters, size, known[known >= 0])

    @property
    def rows(self) -> int:
        return self.size**3 if self.known is None else len(self.known)

    def numbers(self, words: list[str], plain_only: bool = False):
        """(words x subsequences) numbers, -1 where there is none; their weights; each word's own norm."""
        width = max(map(len, words)) + 2
        points = np.zeros((len(words), width), dtype=np.int64)
        for i, w in enumerate(words):
            points[i, : len(w) + 2] = [1, *map(ord, w), 2]
        letters = self.letters[points].astype(np.int64)
        plain, coded, weights = [], [], []
        for far in range(2, min(SPAN, width)):
            for near in range(1, far):
                a, b, c = (slice(0, width - far), slice(near, width - far + near), slice(far, width))
                whole = points[:, c] > 0
                plain.append(np.where(whole, (points[:, a] << 42) | (points[:, b] << 21) | points[:, c], -1))
                x, y, z = letters[:, a], letters[:, b], letters[:, c]
                if self.known is None:
                    coded.append(np.where(whole & (x > 0) & (y > 0) & (z > 0), (x * self.size + y) * self.size + z, -1))
                weights.append(np.full(width - far, DECAY ** (far + 1), dtype=np.float32))
        weight = np.concatenate(weights)
        every = np.concatenate(plain, axis=1)
        if plain_only:
            return every
        if self.known is not None:
            place = np.minimum(np.searchsorted(self.known, every), len(self.known) - 1)
            coded = [np.where(self.known[place] == every, place, -1)]
        order = np.argsort(every, axis=1, kind="stable")
        every = np.take_along_axis(every, order, axis=1)
        new = np.ones(every.shape, dtype=bool)
        new[:, 1:] = every[:, 1:] != every[:, :-1]
        group = np.cumsum(new.ravel()) - 1
        sums = np.bincount(group, weights=np.where(every >= 0, weight[order], 0).ravel())
        owner = np.arange(len(words)).repeat(every.shape[1])[new.ravel()]
        return np.concatenate(coded, axis=1), weight, np.sqrt(np.maximum(np.bincount(owner, weights=sums**2, minlength=len(words)), 1e-12))

    def table(self, landmarks: list[str]) -> np.ndarray:
        """(subsequences, landmarks): each landmark's normalised weight of each subsequence; the last row, for none, is zero."""
        numbers, weight, norm = self.numbers(landmarks)
        out = np.zeros((self.rows + 1, len(landmarks)), dtype=np.float32)
        for i, row in enumerate(numbers):
            np.add.at(out[:, i], row[row >= 0], weight[row >= 0] / norm[i])
        return out

    def apply(self, words: list[str], table: np.ndarray, at_once: int = 1024, dtype: type = np.float32) -> np.ndarray:
        """(words, columns of the table): kernel values, or any weighted sum of them."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out = np.zeros((len(words), table.shape[1]), dtype=dtype)
        for at in range(0, len(order), at_once):
            part = order[at : at + at_once]
            numbers, weight, norm = self.numbers([words[i] for i in part])
            if table.shape[1] == 1:
                out[part, 0] = (table[numbers, 0] @ weight) / norm
            else:
                for i in range(0, len(part), 128):
                    out[part[i : i + 128]] = np.matmul(weight, table[numbers[i : i + 128]]) / norm[i : i + 128, None]
        return out


@dataclass
class Machine:
    subsequences: Subsequences
    landmarks: list[str]
    weights: np.ndarray  # of each subsequence: landmarks, Nystroem map and machine in one
    bias: float
    slope: float
    shift: float

    def decide(self, words: list[str]) -> np.ndarray:
        return self.subsequences.apply(words, self.weights)[:, 0] + self.bias if words else np.empty(0)

    def probability(self, decision: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -30, 30))))


def spread_out(words: list[str], number: int) -> list[str]:
    """`number` of the words, the first and then each the least similar to those before."""
    subsequences, width = Subsequences.of(words), max(map(len, words))
    numbers, norm = [], []
    for at in range(0, len(words), 1024):  # padded to one width, so that all blocks have the same weights
        found, weight, size = subsequences.numbers([*words[at : at + 1024], "x" * width])
        numbers.append(found[:-1].astype(np.int32))
        norm.append(size[:-1])
    numbers, norm = np.concatenate(numbers), np.concatenate(norm)
    chosen, near = [0], np.full(len(words), -1.0)
    while True:
        last = np.zeros(subsequences.rows + 1, dtype=np.float32)
        np.add.at(last, numbers[chosen[-1]][numbers[chosen[-1]] >= 0], weight[numbers[chosen[-1]] >= 0] / norm[chosen[-1]])
        near = np.maximum(near, (last[numbers] @ weight) / norm)
        nxt = int(near.argmin())
        if len(chosen) == min(number, len(words)) or nxt in chosen:
            return [words[i] for i in chosen]
        chosen.append(nxt)


def _machine(x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 25, block: int = 2048) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss over the `rows` of x, by Newton steps on the rows inside the margin, gathered by blocks."""
    n = x.shape[1]
    w = np.zeros(n + 1)
    penalty = np.diag(np.append(np.full(n, ridge), 1e-6))
    weight = weight / weight.sum()
    for _ in range(steps):
        h, g = penalty.copy(), np.zeros(n + 1)
        for at in range(0, len(rows), block):
            part, ys, ws = x[rows[at : at + block]].astype(np.float64), y[at : at + block], weight[at : at + block]
            inside = ys * (part @ w[:-1] + w[-1]) < 1
            part = np.hstack([part[inside], np.ones((int(inside.sum()), 1))])
            weighed = (part * ws[inside, None]).T
            h, g = h + weighed @ part, g + weighed @ ys[inside]
        new = np.linalg.solve(h, g)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def train(samples: list[tuple[str, int]], clean_share: float | None = None, landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 1) -> Machine | None:
    """Fit on (text, 0 or 1) samples; None unless both classes have words. All words of all samples are fitted on; all witnesses, all mistakable words and ORDINARY drawn others
    may become landmarks. clean_share: of label 0 where the sample comes from, if it differs."""
    rng = np.random.default_rng(seed)
    same: dict[str, str] = {}  # one object for each word, however many texts have it
    bags = [(sorted(same.setdefault(p, p) for p in {p for w in tokens(t) for p in pieces(w)}), label) for t, label in sorted(samples)]
    toxic, clean = [b for b, label in bags if label and b], [b for b, label in bags if not label and b]
    if not toxic or not clean:
        return None
    seen, other = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    # A share of occurrences under toxic labels, weighed by how many there are; a few letters' beginning counts with the word.
    stem, stem_other = Counter(s for b in toxic for s in {w[:5] for w in b}), Counter(s for b in clean for s in {w[:5] for w in b})
    ratio = len(toxic) / len(clean)
    gain = lambda p, n: p * np.log((p + 0.1) / (n * ratio + 0.5)) if p > n * ratio else 0.0
    value = {w: gain(seen[w], other[w]) + gain(stem[w[:5]], stem_other[w[:5]]) for w in seen}
    # A text's witnesses are all of its words that tell nearly as much as its best one: several insults in one text are all learned.
    best = [max(value[w] for w in b) for b in toxic]
    witness = strong = [w for b, most in zip(toxic, best, strict=True) for w in b if value[w] >= STRONG * most and value[w] > 0] or [max(b) for b in toxic]
    del same, stem, stem_other, value
    plain = sorted(other)
    plain = [plain[i] for i in rng.permutation(len(plain))]
    words = sorted({w for b in toxic for w in b})

    def changed(word: str) -> str:
        at = int(rng.integers(1, max(2, len(word))))
        return word[:at] + chr(int(rng.integers(97, 123))) + word[at:]

    hard: list[str] = []
    for turn in range(2):  # the second time with the mistakable words as landmarks
        common = [w for w, _ in Counter(witness).most_common()]
        marks = spread_out(common, landmarks // 2) + (spread_out(hard, landmarks // 4) if hard else [])
        marks += spread_out(plain[:ORDINARY], landmarks - len(marks))
        marks = list(dict.fromkeys(marks))
        subsequences = Subsequences.of(marks)
        table = subsequences.table(marks)
        values, vectors = np.linalg.eigh(subsequences.apply(marks, table).astype(np.float64))
        good = values > 1e-6
        root = vectors[:, good] / np.sqrt(values[good])
        altered = [changed(w) for w in witness if w not in other and len(w) > 3]
        words = sorted({*words, *witness, *plain, *altered})
        place = {w: i for i, w in enumerate(words)}
        x = None  # the first turn's goes before the second's is made
        x = subsequences.apply(words, table @ root.astype(np.float32), dtype=np.float16)  # the largest array of the fit; its norms are below one
        toxic_at, clean_at = [[place[w] for w in b if w in place] for b in toxic], [[place[w] for w in b if w in place] for b in clean]
        never = np.array(sorted({i for b in clean_at for i in b}))
        clean_words = set(never.tolist())
        positive, negative = [place[w] for w in witness], []
        for _ in range(rounds):
            count, worst = Counter(positive), Counter(negative)
            at = np.array(sorted(count))
            at = at[[i not in clean_words for i in at]]
            if not len(at):
                return None
            other_way = np.array([place[w] for w in altered if place[w] not in clean_words], dtype=np.int64)
            rows = np.concatenate([at, other_way, never])
            base = np.full(len(never), 1 / len(never))
            if worst:
                base = 0.5 * base + np.array([worst[i] for i in never]) / len(negative)
            share = np.array([count[i] for i in at])
            weight = np.concatenate([share / share.sum(), np.full(len(other_way), 0.15 / max(1, len(other_way))), base])
            w, bias = _machine(x, rows, np.where(np.arange(len(rows)) < len(at) + len(other_way), 1.0, -1.0), weight)
            decision = np.concatenate([x[i : i + 16384].astype(np.float32) @ w.astype(np.float32) for i in range(0, len(x), 16384)]) + bias
            positive = [b[int(decision[b].argmax())] for b in toxic_at if b] + [place[w] for w in strong]
            negative = [b[int(decision[b].argmax())] for b in clean_at if b]
        witness = [words[i] for i in positive]
        hard = [words[i] for i in sorted(set(negative), key=lambda i: -decision[i])[:200]]
    scores = np.array([decision[b].max() if b else bias for b in toxic_at + clean_at])
    labels = np.array([1.0] * len(toxic_at) + [0.0] * len(clean_at))
    share = len(clean_at) / len(labels) if clean_share is None else clean_share
    weigh = np.where(labels > 0, (1 - share) / len(toxic_at), share / len(clean_at)) * len(labels)
    slope, shift = 1.0, 0.0
    for _ in range(60):  # logistic calibration, with a little ridge so that separable scores stay finite
        p = 1 / (1 + np.exp(-np.clip(slope * scores + shift, -30, 30)))
        e = weigh * (p - labels)
        g = np.array([(e * scores).sum() + 1e-2 * slope, e.sum()])
        c = weigh * p * (1 - p) + 1e-9
        h = np.array([[(c * scores * scores).sum() + 1e-2, (c * scores).sum()], [(c * scores).sum(), c.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, shift = slope - move[0], shift - move[1]
    return Machine(subsequences, marks, table @ (root @ w).astype(np.float32)[:, None], bias, float(max(slope, 0.1)), float(shift))


class Scorer:
    """Scores of words, remembered up to a bound."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def texts(self, texts: list[str | None]) -> list[float]:
        found = [tokens(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = sorted({w for f in found for w in f if w not in self.known})
        parts = [pieces(w) for w in fresh]
        flat = [p for ps in parts for p in ps]
        distinct = sorted(set(flat))
        decided = dict(zip(distinct, self.machine.decide(distinct).tolist(), strict=True))
        for w, ps in zip(fresh, parts, strict=True):
            self.known[w] = max((decided[p] for p in ps), default=-np.inf)
        return [max(map(self.known.__getitem__, f), default=-np.inf) for f in found]


def score_texts(docs: DataFrame, machine: Machine | None, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (score >= 0.5). Texts without words, null ones too, score 0, as does everything without a machine.

    Rows are scored one by one. Other columns pass through; columns of the two names are replaced.
    """
    docs = docs.drop("score", "predicted")
    at, names = docs.columns.index(text), [*docs.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine) if machine else None
        for batch in batches:
            scores: list[float] = []
            for first in range(0, batch.num_rows, 256):
                texts = batch.column(at).slice(first, 256).to_pylist()
                decisions = scorer.texts(texts) if scorer else [-np.inf] * len(texts)
                scores += [machine.probability(d) if np.isfinite(d) else 0.0 for d in decisions]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[tuple[str, int]], float]:
    """At most `per_class` (text, label) of each class and the share of label 0 among all labels.

    Twice as many ids are drawn on the small side, `labels` (doc_id, label), those that hash lowest, the same in every run; only their texts are fetched,
    one for each id. Ids with a null text or none don't count, repeated labels count once. Only hashes below a bound that leaves about four times as many ids
    as are wanted of a class are ranked, so a class of any size sends few rows to the task that ranks it.
    """
    labels = labels.filter("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    order = Window.partitionBy("label").orderBy("h", "doc_id")
    bound = {label: min((1 << 63) - 1, (1 << 64) * 4 * per_class // n - (1 << 63)) for label, n in counts.items()}
    low = F.col("h") <= F.when(F.col("label") == 0, F.lit(bound.get(0, 0))).otherwise(F.lit(bound.get(1, 0)))
    drawn = labels.withColumn("h", F.xxhash64("doc_id")).filter(low).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2 * per_class)
    texts = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(drawn.select("doc_id", "label", "h")), "doc_id")  # 4 x per_class rows
    found = sorted((r["label"], r["h"], r["doc_id"], r["text"]) for r in texts.groupBy("label", "h", "doc_id").agg(F.min("text").alias("text")).collect())
    out = [(t, label) for wanted in counts for t, label in [(t, label) for label, _, _, t in found if label == wanted][:per_class]]
    return out, counts.get(0, 0) / max(1, sum(counts.values()))


def toxicity_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): trained on labelled rows whose crc32(doc_id) mod 5 is not 0; a null doc_id is neither."""
    known = labels.filter(remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    machine = train(*labelled_sample(docs, known))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score_texts(docs.select("doc_id", "text"), machine).select("doc_id", held.alias("held_out"), "score", "predicted")
