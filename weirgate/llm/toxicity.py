"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A text is a line of signs: letters and digits, one blank between words, marks left out. It is seen through windows, the short
sentences that the machine is trained on: every word and every two neighbours, with the blanks around and between them. The kernel
of two windows counts their common subsequences of three signs, blanks included; a subsequence weighs ``DECAY`` to the
power of the length it is spread over (at most ``SPREAD``), so gaps, inserted signs and a blank inside a word cost weight and
don't hide it. A window's features are its kernels with the landmarks, whitened (Nyström). The machine (squared hinge, Newton steps) is
linear in them, and the kernel is an inner product over subsequences, so after training the landmarks fold into one table
of a weight per subsequence. Margins of all windows of a text are then differences of running sums along its line.

Labels belong to documents, while a few windows make a document toxic. So training goes in rounds: the windows around telling
words (by a log-likelihood ratio over the labelled documents) begin as positive ones, and a hash-picked window of every clean document as
negative one; then each document shows its worst window to the machine that was learned, which is added with the document's label
(for toxic ones, where the machine agrees). A quarter of the labelled documents is kept from the machine; on them a logistic curve is fitted
to the worst margin and the logarithms of the number of windows and of those that the machine calls toxic, so that a
long text isn't worse by its length, nor for one odd word.

Training reads at most ``sample`` labelled documents, those with the smallest hashes of their ids. That is its only bound.

Defined cases: a text without windows scores by the curve like one with the margin of an empty window; labels that are
null or not 0 or 1 aren't used; an id that is labelled repeatedly is toxic if one of its labels is, and of documents
that share an id one text is learned, the smallest; without two classes every score is the share of label 1
(0 without any). Very long words are seen through overlapping windows. Ties between windows go to the first. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_out, steps, texts, tidy, written

DECAY = 0.6
# The longest stretch of signs that a subsequence of three is spread over.
SPREAD = 8
# Signs of the kernel: the blank, 26 letters, the digits as one, and 36 places that all others share by their code.
SIGNS = 64
BLANK, DIGIT = 0, 27
# Longer words are seen through windows of this many signs, each half a window from the next.
LONGEST_WORD = 24
LANDMARKS, ROUNDS = 256, 4
COST = 1.0

_SPELLED = re.compile(r"(?<!\S)\w(?:[^\w\n]{1,3}\w){2,}(?![^\s.,;:!?])")
_INNER = re.compile(r"[^\w\s]+")


@dataclass(frozen=True)
class Model:
    """A weight per subsequence, and the curve from what is seen of a text (``seen``) to a score."""

    weights: np.ndarray
    bias: float
    curve: tuple[float, ...]

    def score(self, margin: np.ndarray, windows: np.ndarray, hits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(seen(margin, windows, hits) @ np.array(self.curve), -50, 50)))


def seen(margin: np.ndarray, windows: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The worst margin of each text, 1, and for those with toxic windows 1 and the logarithms of their number and of all windows."""
    some = hits > 0
    return np.stack((margin, np.ones(len(margin)), some, np.log1p(hits), some * np.log1p(windows)), axis=1)


def constant(score: float) -> Model:
    shift = float(np.clip(np.log(max(score, 1e-22) / max(1 - score, 1e-22)), -50, 50))
    return Model(np.zeros(SIGNS**3, np.float32), 0.0, (0.0, shift, 0.0, 0.0, 0.0))


def plain(text: str) -> str:
    """A text in lower case, without marks, with spelled words ("i d i o t", "i.d.i.o.t") joined."""
    text = text.lower()
    text = _SPELLED.sub(lambda run: "".join(filter(str.isalnum, run[0])), text)
    return " ".join(_INNER.sub("", text).replace("_", "").split())


def _table() -> np.ndarray:
    """The sign of each code point below 2^16; higher ones share places by the same rule."""
    code = np.arange(1 << 16)
    signs = (28 + code % 36).astype(np.uint8)
    signs[ord("a") : ord("z") + 1] = np.arange(1, 27)
    signs[ord("0") : ord("9") + 1] = DIGIT
    signs[ord(" ")] = BLANK
    return signs


_SIGN_OF = _table()


def line(plains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The signs of plain texts with a blank before and behind each one, and where each begins (at its first blank)."""
    joined = "".join(f" {t} " for t in plains)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    signs = np.where(points < 1 << 16, _SIGN_OF[np.minimum(points, 0xFFFF)], 28 + points % 36).astype(np.int32)
    starts = np.cumsum([0, *(len(t) + 2 for t in plains)])
    return signs, starts


def windows(signs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows of all texts begin and end, blanks included, and the text of each, text by text."""
    blank = np.flatnonzero(signs == BLANK)
    a, b = blank[:-1], blank[1:] + 1
    word = b - a > 2
    a, b = a[word], b[word]
    text = np.searchsorted(starts, a, "right") - 1
    # Two neighbours: the blank between them is the end of one and the start of the other.
    two = np.flatnonzero((text[1:] == text[:-1]) & (b[1:] - a[:-1] <= 2 * LONGEST_WORD))
    long = np.flatnonzero(b - a > LONGEST_WORD + 2)
    half = LONGEST_WORD // 2
    pieces = -(-(b[long] - a[long] - LONGEST_WORD) // half)
    at = np.repeat(a[long], pieces) + half * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    short = b - a <= LONGEST_WORD + 2
    begin = np.concatenate((a[short], a[two], at))
    end = np.concatenate((b[short], b[two + 1], np.minimum(at + LONGEST_WORD, np.repeat(b[long], pieces))))
    own = np.concatenate((text[short], text[two], np.repeat(text[long], pieces)))
    order = np.lexsort((end, begin, own))
    return begin[order], end[order], own[order]


def _norms(most: int) -> np.ndarray:
    """The norm of a window by its length, with each of its subsequences as one of its own."""
    length = np.arange(most + 1)[:, None]
    spread = np.arange(3, SPREAD + 1)[None, :]
    square = (np.maximum(0, length - spread + 1) * (spread - 2) * DECAY ** (2.0 * spread)).sum(1)
    return np.sqrt(np.maximum(square, 1e-9))


_NORMS = _norms(4 * LONGEST_WORD)


def margins(signs: np.ndarray, begin: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The inner product of each window with a weight per subsequence, without the bias."""
    out = np.zeros(len(begin))
    middle = signs << 6
    for spread in range(3, SPREAD + 1):
        n = len(signs) - spread + 1
        if n <= 0:
            break
        outer = (signs[:n] << 12) | signs[spread - 1 : spread - 1 + n]
        here = np.zeros(n, np.float32)
        for j in range(1, spread - 1):
            here += weights[outer | middle[j : j + n]]
        sums = np.concatenate(([0.0], np.cumsum(here, dtype=np.float64)))
        out += DECAY**spread * (sums[np.minimum(np.maximum(end - spread + 1, begin), n)] - sums[np.minimum(begin, n)])
    return out / _NORMS[end - begin]


def _worst(plains: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of each text the worst margin, the number of windows and of toxic ones, and the worst window (or nothing)."""
    signs, starts = line(plains)
    begin, end, own = windows(signs, starts)
    margin = margins(signs, begin, end, model.weights) + model.bias
    number, hits = np.bincount(own, minlength=len(plains)), np.bincount(own[margin > 0], minlength=len(plains))
    worst, shown = np.full(len(plains), model.bias), [""] * len(plains)
    if len(own):
        order = np.lexsort((-margin, own))
        first = order[np.searchsorted(own[order], np.flatnonzero(number))]
        worst[own[first]] = margin[first]
        for i in first.tolist():
            text = own[i]
            shown[text] = f" {plains[text]} "[begin[i] - starts[text] : end[i] - starts[text]]
    return worst, number, hits, shown


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "__text"):
            at = batch.schema.get_field_index("__text")
            worst, number, hits, _ = _worst([plain(t) for t in texts(batch.column(at))], model)
            scores = pa.array(model.score(worst, number, hits), pa.float64())
            columns = [c for j, c in enumerate(batch.columns) if j != at]
            names = [n for j, n in enumerate(batch.schema.names) if j != at]
            yield pa.RecordBatch.from_arrays([*columns, scores], [*names, "__score"])

    return run


def score(df: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """The rows with their score, a double from 0 to 1, in a new last column."""
    rows = df.withColumn("__text", F.col(text_col).cast("string"))
    schema = df.withColumn("__score", F.lit(0.0)).schema
    return rows.mapInArrow(tidy(_scored(model)), schema).withColumnRenamed("__score", into)


# -- training ------------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of either label have a word."""
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def table() -> pa.RecordBatch:
        every = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(every, pa.string()), *(pa.array([c[w] for w in every], pa.int64()) for c in counts)]
        return pa.RecordBatch.from_arrays(columns, ["word", "clean", "toxic"])

    for batch in batches:
        for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            counts[label].update({w[:LONGEST_WORD] for w in plain(text).split() if len(w) > 2})
        if len(counts[0]) + len(counts[1]) > 400_000:
            yield table()
            counts[0].clear()
            counts[1].clear()
    yield table()


def _shown(model: Model | None, telling: set[str], seed: int):
    """What each document shows: its worst window by the model, or without one a window around each telling word or a picked one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            plains, labels, parts = [plain(t) for t in texts(batch.column(0))], batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = []
            if model:
                worst, number, hits, shown = _worst(plains, model)
                rows = list(zip(labels, parts, worst.tolist(), number.tolist(), hits.tolist(), shown, strict=True))
            else:
                for text, label, part in zip(plains, labels, parts, strict=True):
                    words = text.split()
                    if label:
                        own = [f" {w} " for w in words if w in telling]
                    else:
                        own = [f" {words[(seed * len(words) + len(text)) * 7919 % len(words)]} "] if words else []
                    rows += [(label, part, 0.0, len(words), 0, w) for w in own]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(SHOWN)
            yield rows_out(SHOWN, columns)

    return run


SHOWN = pa.schema([("label", pa.int32()), ("part", pa.int32()), ("margin", pa.float64()), ("n", pa.int64()), ("hits", pa.int64()), ("shown", pa.string())])
SHOWN_DDL = "label int, part int, margin double, n long, hits long, shown string"


def spectrum(window: str) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of a window and their weights, normalised; equal ones added up."""
    signs = line([window[1:-1]])[0] if len(window) > 1 and window[0] == window[-1] == " " else line([window])[0][1:-1]
    index, weight = [], []
    for spread in range(3, SPREAD + 1):
        n = len(signs) - spread + 1
        for j in range(1, spread - 1) if n > 0 else ():
            index.append((signs[:n] << 12) | (signs[j : j + n] << 6) | signs[spread - 1 : spread - 1 + n])
            weight.append(np.full(n, DECAY**spread))
    if not index:
        return np.zeros(0, np.int64), np.zeros(0)
    own, group = np.unique(np.concatenate(index), return_inverse=True)
    return own, np.bincount(group, weights=np.concatenate(weight)) / _norms(len(signs))[-1]


def kernels(examples: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel of every window with every landmark."""
    known = np.unique(np.concatenate([spectrum(x)[0] for x in landmarks])) if landmarks else np.zeros(0, np.int64)
    table = np.zeros((len(known) + 1, len(landmarks)), np.float32)
    for j, landmark in enumerate(landmarks):
        index, weight = spectrum(landmark)
        table[np.searchsorted(known, index), j] = weight
    out = np.zeros((len(examples), len(landmarks)), np.float32)
    for i, example in enumerate(examples):
        index, weight = spectrum(example)
        at = np.searchsorted(known, index)
        some = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == index)
        out[i] = weight[some].astype(np.float32) @ table[at[some]]
    return out


def _svm(features: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss; the last feature is the constant one."""
    rows = np.hstack((features, np.ones((len(features), 1)))).astype(np.float64)
    theta = np.zeros(rows.shape[1])
    ridge = np.eye(rows.shape[1])
    ridge[-1, -1] = 1e-6
    before = None
    for _ in range(30):
        active = labels * (rows @ theta) < 1
        if before is not None and (active == before).all():
            break
        before = active
        own = rows[active] * weight[active, None]
        theta = np.linalg.solve(ridge + own.T @ rows[active], own.T @ labels[active])
    return theta[:-1], float(theta[-1])


def _curve(rows: np.ndarray, label: np.ndarray) -> tuple[float, ...]:
    """The logistic curve through labelled rows of ``seen``, slightly drawn to one that rises with the margin alone.

    It never rises with the number of windows, nor falls with the margin or with toxic windows.
    """
    drawn, ridge = np.array([2.0, 0.0, 0.0, 0.0, 0.0]), np.array([2.0, 1e-3, 0.1, 0.1, 0.1])
    free = np.ones(len(drawn), bool)
    while True:
        theta, own = drawn * free, rows[:, free]
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(rows @ theta, -30, 30)))
            slope = own.T @ (p - label) + ridge[free] * (theta - drawn)[free]
            step = np.linalg.solve(own.T @ (own * (p * (1 - p))[:, None]) + np.diag(ridge[free]), slope)
            theta[free] -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        wrong = free & ((theta < 0) & np.array([True, False, False, True, False]) | (theta > 0) & np.array([False] * 4 + [True]))
        if not wrong.any():
            return tuple(theta.tolist())
        free &= ~wrong


def held_out(id_column: Column) -> Column:
    """The documents that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _inserted(word: str, rng: np.random.Generator) -> list[str]:
    """Windows of a word with a sign inserted at one place, and with a blank there."""
    at = int(rng.integers(1, len(word)))
    sign = "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))]
    return [f" {word[:at]}{sign}{word[at:]} ", f" {word[:at]} {word[at:]} "]


def _fit(positive: dict[str, int], negative: dict[str, int], landmarks: list[str]) -> Model:
    examples = [*positive, *negative]
    sign = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    features = kernels(examples, landmarks)
    own = kernels(landmarks, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    whiten = vectors * (1 / np.sqrt(np.maximum(values, 1e-3)))
    times = np.array([*positive.values(), *negative.values()], np.float64) ** 0.5
    totals = times[sign > 0].sum(), times[sign < 0].sum()
    balance = COST * times * np.where(sign > 0, len(sign) / (2 * totals[0]), len(sign) / (2 * totals[1]))
    theta, bias = _svm(features @ whiten, sign, balance)
    # The machine as a weight for each subsequence.
    per_landmark, weights = whiten @ theta, np.zeros(SIGNS**3)
    for value, landmark in zip(per_landmark, landmarks, strict=True):
        index, weight = spectrum(landmark)
        weights[index] += value * weight
    return Model(weights.astype(np.float32), bias, (2.0, 0.0, 0.0, 0.0, 0.0))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample: int = 20_000, seed: int = 11
) -> Model:
    """A model of at most ``sample`` labelled documents that aren't held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    picked = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # A sample of bounded size meets the documents where they are; a repeated id has one row.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label"))
    # Part 0 is for the curve alone.
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4)).cast("int")
    rows = written(rows.select("text", "label", part.alias("part")), "toxic-sample")
    share = rows.agg(F.avg("label").alias("share"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    if share.low == share.high:
        return constant(float(share.low or 0))
    learned = rows.where("part > 0")

    counted = learned.select("text", "label").mapInArrow(tidy(_counted), "word string, clean long, toxic long").groupBy("word")
    counted = written(counted.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-words")
    # A word tells the labels apart if its log-likelihood ratio is beyond what the luckiest of so many words has.
    p, total = share.share, F.col("toxic") + F.col("clean")
    term = lambda n, expected: F.when(n > 0, n * F.ln(n / expected)).otherwise(0.0)
    ratio = 2 * (term(F.col("toxic"), total * p) + term(F.col("clean"), total * (1 - p)))
    lift = (F.col("toxic") + p) / (total + 1)
    telling_from = 2 * float(np.log(counted.where(total > 1).count() + 2))
    telling = counted.where((ratio >= telling_from) & (lift >= max(0.5, p))).orderBy(F.desc("toxic"), "word").toArrow()
    words = telling.column("word").to_pylist()  # at most one word per ten labelled documents and subsequent word of theirs
    if not words:
        return constant(float(p))
    rng = np.random.default_rng(seed)
    positive: dict[str, int] = {}
    for word, n in zip(words, telling.column("toxic").to_pylist(), strict=True):
        positive[f" {word} "] = n
        for bent in _inserted(word, rng):
            positive[bent] = 1
    begun = learned.mapInArrow(tidy(_shown(None, set(words), seed)), SHOWN_DDL).where("label = 0").groupBy("shown").count().toArrow()  # a window per document
    negative = dict(zip(begun.column("shown").to_pylist(), begun.column("count").to_pylist(), strict=True))
    negative = {w: n for w, n in negative.items() if w not in positive}
    model = None
    for _ in range(ROUNDS):
        if not negative:
            return constant(float(p))
        clean, toxic = sorted(negative), sorted(positive, key=lambda w: (-positive[w], w))
        spread = [clean[i] for i in rng.permutation(len(clean))[: LANDMARKS // 2]]
        model = _fit(positive, negative, toxic[: LANDMARKS // 2] + spread)
        told = learned.mapInArrow(tidy(_shown(model, set(), seed)), SHOWN_DDL).where("shown <> ''")
        for row in told.groupBy("label", "shown").agg(F.count(F.lit(1)).alias("n"), F.max("margin").alias("margin")).collect():  # a window per document
            if row.label == 0 and row.margin > -1:
                negative[row.shown] = row.n
                positive.pop(row.shown, None)
            elif row.label == 1 and row.margin > 0 and row.shown not in negative:
                positive[row.shown] = row.n
    kept = rows.where("part = 0").mapInArrow(tidy(_shown(model, set(), seed)), SHOWN_DDL).select("label", "margin", "n", "hits").toArrow()  # a row per document
    label, margin, number, hits = (kept.column(c).to_numpy().astype(np.float64) for c in ("label", "margin", "n", "hits"))
    return Model(model.weights, model.bias, _curve(seen(margin, number, hits), label) if len(label) else model.curve)
