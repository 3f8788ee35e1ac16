"""Toxic documents by a subsequence string kernel and a support vector machine.

Instances are words, bags are documents: a toxic document holds at least one toxic word. The
kernel counts shared character subsequences of ``ORDER`` letters, each weighed down with the
length it is spread over, so an insult with inserted or missing letters still resembles itself.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

ORDER = 4
SPREAD = 8
DECAY = 0.7
LETTERS = 32
LANDMARKS = 192
INSULTS = 1500
ROUNDS = 5
SAMPLE_ROWS = 4000
CACHE_WORDS = 200_000
GROUP_WORDS = 50_000
CELLS = 20_000
THRESHOLD = 0.7

# --- fixed values: signs that stand for a letter ------------------------------
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
EDGES = ".,;:!?\"'()[]{}<>|-–—…«»“”‘’*#%&$@/\\=+_~`^"
MARK = "{"
NO_LETTERS = re.compile(r"[\W\d_]+")
_PLAIN = lambda c: not unicodedata.combining(c)
SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S){3,}[.,;:!?]*(?!\S)")


def units(text: str | None) -> set[str]:
    """The words of a whole text, and runs of single characters put together."""
    lower = (text or "").lower()
    found = set(lower.split())
    if SINGLES.search(lower):
        found.update("".join(run.split()) for run in SINGLES.findall(lower))
    return found


def letters(word: str) -> str:
    """A word's base letters: accents, signs and look-alikes resolved."""
    word = word.strip(EDGES)
    if word.isascii() and word.isalpha():
        return word
    if not word.isascii():
        word = "".join(filter(_PLAIN, unicodedata.normalize("NFKD", word)))
    return word if word.isalpha() else NO_LETTERS.sub("", word.translate(LOOKALIKES))


def framed(word: str) -> str:
    """The base letters between two marks, so that a word's ends count as letters."""
    return f"{MARK}{letters(word)}{MARK}"


def _codes(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of letter numbers."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)
    basic = (points >= 97) & (points <= 123)  # a to z and the mark
    return np.asfortranarray(np.where(basic, points - 96, 28 + points % 4).astype(np.int32))


def _patterns(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences of a view of so many letters, and their weights.

    Weights shrink with the length a subsequence is spread over, and have norm one.
    """
    rows = np.array(list(combinations(range(length), ORDER)), np.int32).reshape(-1, ORDER)
    weights = DECAY ** (rows[:, -1] - rows[:, 0] + 1.0)
    return rows, weights / np.sqrt((weights * weights).sum())


def _unit(length: int) -> float:
    """What a plain weight is multiplied by in a view of so many letters."""
    rows, weights = _patterns(length)
    return float(weights[0] / DECAY ** (rows[0, -1] - rows[0, 0] + 1.0))


def _numbers(codes: np.ndarray, positions: np.ndarray) -> np.ndarray:
    number = codes[:, positions[0]]
    for p in positions[1:]:
        number = number * LETTERS + codes[:, p]
    return number


def _views(word: str) -> list[str]:
    """The pieces of a word the kernel compares: itself, or each SPREAD letters of a long one."""
    return [word[i:i + SPREAD] for i in range(max(1, len(word) - SPREAD + 1))]


def _features(views: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Per subsequence of the views of one length: rows, feature numbers and weight."""
    by_length: dict[int, list[int]] = {}
    for i, view in enumerate(views):
        by_length.setdefault(len(view), []).append(i)
    for length, rows in by_length.items():
        if length >= ORDER:
            codes = _codes([views[i] for i in rows], length)
            for positions, weight in zip(*_patterns(length)):
                yield np.array(rows), _numbers(codes, positions), float(weight)


class Landmarks:
    """The kernel of any views with the chosen ones."""

    def __init__(self, views: list[str]):
        parts = list(_features(views))
        self.numbers = np.unique(np.concatenate([numbers for _, numbers, _ in parts]))
        self.place = np.full(LETTERS ** ORDER, len(self.numbers), np.int32)
        self.place[self.numbers] = np.arange(len(self.numbers))
        self.values = np.zeros((len(self.numbers) + 1, len(views)), np.float32)
        for rows, numbers, weight in parts:
            np.add.at(self.values, (self.place[numbers], rows), weight)

    def kernel(self, views: list[str]) -> np.ndarray:
        out = np.zeros((len(views), self.values.shape[1]), np.float32)
        for rows, numbers, weight in _features(views):
            out[rows] += weight * self.values[self.place[numbers]]
        return out


@dataclass(frozen=True)
class Model:
    """Landmarks and their weights folded into one weight per subsequence, and the two curves."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def table(self) -> np.ndarray:
        dense = np.zeros(LETTERS ** ORDER, np.float32)
        dense[self.numbers] = self.weights
        return dense

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.offset, -60, 60)))


class WordScores:
    """Margins of words; each distinct word is scored once while it stays in the table."""

    def __init__(self, model: Model):
        self.dense, self.bias, self.known = model.table(), model.bias, {}
        self.scales = {length: _unit(length) for length in range(ORDER, SPREAD + 1)}

    def make_room(self) -> None:
        """Forgets all words if there are too many: only between groups of texts."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()

    def learn(self, words: set[str]) -> None:
        by_length: dict[int, dict[str, list[str]]] = {}
        for word in words:
            base = word if word[:1] == MARK else framed(word)
            by_length.setdefault(len(base), {}).setdefault(base, []).append(word)
        for length, bases in by_length.items():
            names = list(bases)
            step = max(1, CELLS // length)
            for at in range(0, len(names), step):
                part = names[at:at + step]
                for base, margin in zip(part, self._margins(part, length).tolist()):
                    for word in bases[base]:
                        self.known[word] = margin

    def _margins(self, words: list[str], length: int) -> np.ndarray:
        """Each word's best view: a long word is read through a sliding view, so length does not dilute it."""
        if length < ORDER:
            return np.full(len(words), self.bias)
        span = min(length, SPREAD)
        scale = self.scales[span]
        codes = np.zeros((len(words), length + SPREAD - 1), np.int32, order="F")
        codes[:, :length] = _codes(words, length)
        # Sums over the subsequences that begin at each letter, by the letter they end at.
        ending = [np.zeros((len(words), length), np.float32, order="F") for _ in range(SPREAD)]
        at = [codes[:, shift:shift + length] for shift in range(SPREAD)]
        for second in range(1, SPREAD - 2):
            two = at[0] * LETTERS + at[second]
            for third in range(second + 1, SPREAD - 1):
                three = (two * LETTERS + at[third]) * LETTERS
                for last in range(third + 1, SPREAD):
                    ending[last] += self.dense[three + at[last]]
        for last in range(ORDER - 1, SPREAD):
            ending[last] *= np.float32(scale * DECAY ** (last + 1))
            if last > ORDER - 1:
                ending[last] += ending[last - 1]
        views = length - span + 1
        total = np.zeros((len(words), views), np.float32, order="F")
        for start in range(span - ORDER + 1):
            total += ending[span - 1 - start][:, start:start + views]
        return total.max(axis=1).astype(float) + self.bias

    def highest(self, found: set[str] | tuple[str, ...]) -> float:
        if not found:
            return self.bias
        known = self.known
        return max(known[word] for word in found)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the rows inside the margin."""
    rows = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(rows.shape[1])
    ridge = np.eye(rows.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (rows @ w) < 1
        a, c = rows[active], cost[active][:, None]
        new = np.linalg.solve(ridge + a.T @ (c * a), a.T @ (c[:, 0] * y[active]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], w[-1]


def _platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, with the usual soft targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    soft = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([((p - soft) * margins).sum() + 1e-3 * a, (p - soft).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def train(bases: list[tuple[str, ...]], labels: np.ndarray, landmarks: int = LANDMARKS, seed: int = 7) -> Model:
    """A model from each document's distinct framed words and 0/1 labels.

    Words whose presence tells toxic from other documents start as positive instances; then the
    machine is fitted and the clean documents' highest words join the negatives, several times.
    With one class only, or no word of two toxic documents that tells them apart, every text gets the
    toxic share.
    """
    # Copies of a text say no more than one.
    kept = sorted({(int(label), base) for base, label in zip(bases, labels)})
    bases, labels = [base for _, base in kept], np.array([label for label, _ in kept], dtype=int)
    share = float(labels.mean()) if len(labels) else 0.0
    constant = Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 1.0, math.log((share + 1e-3) / (1 - share + 1e-3)))
    good, bad = Counter(), Counter()
    for found, label in zip(bases, labels):
        (bad if label else good).update(found)
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return constant
    # Pieces of words, too: an invented insult shows as a stem with many endings.
    stems_bad, stems_good = Counter(), Counter()
    for found, label in zip(bases, labels):
        (stems_bad if label else stems_good).update({word[i:i + n] for word in found for n in (4, 5) for i in range(len(word) - n + 1)})

    # Evidence (a log likelihood ratio) that would not turn up by chance among so many pieces.
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    needed = math.log(100.0 * (1 + len(stems_bad)))

    def gain(count: int, clean: int) -> float:
        inside = count / (count + clean)
        if inside <= 0.9:
            return 0.0
        return count * math.log(inside / share) + (clean * math.log((1 - inside) / (1 - share)) if clean else 0.0)

    def telling(count: int, clean: int) -> bool:
        return gain(count, clean) > needed

    stems = {stem for stem, count in stems_bad.items() if telling(count, stems_good[stem])}
    positive = Counter()
    for word, count in bad.items():
        if len(word) >= ORDER and (telling(count, good[word]) or good[word] == 0 and any(word[i:i + n] in stems for n in (4, 5) for i in range(len(word) - n + 1))):
            positive[word] = count
    trust = 1.0
    if not positive:
        # Too few documents for that: the words with the most evidence there is, if more than one
        # document has them, for as much as it is worth beside the bar.
        found = {word: gain(count, good[word]) for word, count in bad.items() if count > 1 and len(word) >= ORDER}
        most = max(found.values(), default=0.0)
        positive.update({word: bad[word] for word, value in found.items() if value > 0 and value >= 0.9 * most})
        trust = most / needed
    if not positive:
        return constant
    rng = np.random.default_rng(seed)
    clean = sorted(word for word in good if len(word) >= ORDER)
    weight = np.array([good[word] for word in clean], float)
    picks = rng.choice(len(clean), min(3000, len(clean)), replace=False, p=weight / weight.sum()) if clean else []
    negative = {clean[i] for i in picks}

    # Landmarks: views of positive words that share no stem with one chosen before, then clean words.
    ranked = [word for word, _ in sorted(positive.items(), key=lambda item: (-item[1], item[0]))[:INSULTS]]
    chosen, seen = [], set()
    for word in ranked:
        for view in _views(word):
            if len(chosen) < landmarks * 3 // 4 and len(view) >= ORDER and view[:5] not in seen:
                seen.add(view[:5])
                chosen.append(view)
    chosen += [word[:SPREAD] for word in sorted(negative, key=lambda w: (-good[w], w))[:landmarks - len(chosen)]]
    marks = Landmarks(chosen)
    values, vectors = np.linalg.eigh(marks.kernel(chosen).astype(float))
    large = values > 1e-5 * values.max()
    whiten = vectors[:, large] / np.sqrt(values[large])

    insult_views = [_views(word) for word in ranked]
    flat = [view for views in insult_views for view in views]
    bounds = np.cumsum([0, *(len(views) for views in insult_views)])
    toxic_rows = marks.kernel(flat) @ whiten
    strength = np.linalg.norm(toxic_rows, axis=1)
    clean_rows = marks.kernel([view for word in sorted(negative) for view in _views(word)]) @ whiten
    model = constant
    for _ in range(ROUNDS):
        # The strongest view of each insult stands for it.
        best = np.array([first + int(np.argmax(strength[first:end])) for first, end in zip(bounds, bounds[1:])])
        x = np.vstack([toxic_rows[best], clean_rows])
        y = np.concatenate([np.ones(len(best)), -np.ones(len(clean_rows))])
        w, bias = _svm(x, y, np.where(y > 0, 40.0 * trust, 10.0))
        strength = toxic_rows @ w
        weights = marks.values[:-1].astype(float) @ (whiten @ w)
        model = Model(marks.numbers, weights, float(bias), 1.0, 0.0)
        scores = WordScores(model)
        scores.learn(set(good))
        hard = sorted((word for word in good if scores.known[word] > -0.6 and len(word) >= ORDER and word not in negative),
                      key=lambda word: (-scores.known[word], word))[:INSULTS]
        if not hard:
            break
        negative.update(hard)
        clean_rows = np.vstack([clean_rows, marks.kernel([view for word in hard for view in _views(word)]) @ whiten])
    scores = WordScores(model)
    margins = []
    for at in range(0, len(bases), 500):
        scores.learn(set().union(*bases[at:at + 500]))
        margins += [scores.highest(found) for found in bases[at:at + 500]]
    slope, offset = _platt(np.array(margins), labels.astype(float))
    return Model(model.numbers, model.weights, model.bias, slope, offset)


MODEL = "numbers binary, weights binary, bias double, slope double, offset double"


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from a bounded sample of labelled rows: at most ``sample_rows`` of each class.

    The caller passes rows already bounded (see ``sample``) or few; texts are read whole where they
    lie. Their distinct words meet in one task, which trains and gives back the model: the driver
    holds no sample. Rows without a label of 0 or 1 do not count.
    """
    words = F.pandas_udf(
        lambda texts: pd.Series([sorted({framed(word) for word in units(t)}) for t in texts]), "array<string>")
    rows = labelled.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), words(text).alias("words"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Each distinct word is held once, however many documents have it.
        bags = sorted(
            (int(value), tuple(map(sys.intern, found))) for batch in batches for value, found in zip(batch["label"], batch["words"]))
        model = train([found for _, found in bags], np.array([value for value, _ in bags], dtype=int))
        yield pd.DataFrame({
            "numbers": [model.numbers.astype(np.int64).tobytes()], "weights": [model.weights.astype(float).tobytes()],
            "bias": [float(model.bias)], "slope": [float(model.slope)], "offset": [float(model.offset)],
        })

    found = rows.repartition(1).mapInPandas(learn, MODEL).first()
    if found is None:
        return train([], np.zeros(0, int))
    return Model(
        np.frombuffer(found.numbers, np.int64), np.frombuffer(found.weights, float), found.bias, found.slope, found.offset)


def sample(labels: DataFrame, key: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` keys of each class, those of the smallest hash: the same ones in every run."""
    known = labels.filter(F.col(key).isNotNull()).select(F.col(key), F.col(label))
    parts = [
        known.filter(F.col(label) == value).distinct().orderBy(F.xxhash64(key), key).limit(rows) for value in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def held_out(key: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the key as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def score_of(text: str | Column, model: Model) -> Column:
    """The probability, from 0 to 1, that a text is toxic, from the highest margin of its words."""

    @F.pandas_udf("double")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = WordScores(model)
        for batch in batches:
            margins: list[float] = []
            held: list[set[str]] = []
            n = 0
            # Words of some texts at a time, however many rows a batch has.
            for i, text in enumerate(batch):
                held.append(units(text))
                n += len(held[-1])
                if n > GROUP_WORDS or i == len(batch) - 1:
                    scores.make_room()
                    scores.learn(set().union(*held).difference(scores.known))
                    margins += [scores.highest(words) for words in held]
                    held, n = [], 0
            yield pd.Series(model.probability(np.array(margins)))

    return values(text)


def learned(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = SAMPLE_ROWS,
) -> Model:
    """A model from the labelled documents that are not held out."""
    chosen = F.broadcast(sample(labels.filter(~held_out(key)), key, label, rows).withColumnRenamed(key, "_key"))
    return fit(docs.select(key, text).join(chosen, F.col(key) == F.col("_key")).select(text, label), text, label)


def score_documents(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: key, ``held_out``, ``score`` and ``predicted`` (score at least ``threshold``).

    Whole texts are read, once; a text without words gets the score of the bias alone. Null
    keys are not held out and never learned from; repeated rows get equal scores; without usable
    labels all texts get the same score, below the threshold.
    """
    model = learned(docs, labels, key, text, label, rows)
    return docs.select(F.col(key), held_out(key).alias("held_out"), score_of(text, model).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold."""
    return docs.filter(score_of(text, learned(docs, labels, key, text, label, rows)) < threshold)
