"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two units (words, mostly) sums, over all subsequences of three characters that both have, the product of their weights; an
occurrence that spans s characters weighs DECAY**s, up to SPAN. Inserted characters and gaps thus lower the similarity a little, and
do not hide a word. The kernel is divided by a norm of each unit's length.

The machine is linear in the Nyström features of m landmarks: f(x) = w . K^(-1/2) k(x). As each entry of k(x) is itself a sum
over subsequences, the m landmarks collapse into one weight for each subsequence, and a unit is scored by looking up its own.
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

from cellweft.llm.common import hold, pick, release, tidy

DECAY, SPAN = 0.7, 7
#: Units longer than WIDTH are seen through windows of WIDTH characters that overlap by half.
WIDTH = 32
#: Character classes: 0 separates only, 1 to 26 are a to z, the last is that of a unit's ends, others are shared by other letters (those of Latin-1 have one each).
CLASSES = 64
#: Documents of each label that the machine is fitted on, at most, and its landmarks, at most.
FIT_DOCS, LANDMARKS = 3000, 320
#: Units of a toxic document that are taken as evidence in a round of fitting, at most.
WITNESSES = 4
#: Marks both ends of a unit, from which signs are stripped first.
EDGE, SIGNS = "\x02", ".,;:!?\"'()[]{}*#$%&|<>-_+=~/\\"
_PAIRS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]

# Digits and signs that stand for letters in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


def _class(code: int) -> int:
    char = chr(code).lower()
    char = DISGUISES.get(char, char)
    if len(char) == 1 and "a" <= char <= "z":
        return ord(char) - 96
    if char == EDGE:
        return CLASSES - 1
    return 27 + ord(char[0]) % (CLASSES - 28) if char.isalpha() else 0


_classes: list[np.ndarray] = []


def coded(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Class codes of the units' windows, padded by 0, and the unit to which each window belongs."""
    units = [f"{EDGE}{u.strip(SIGNS)}{EDGE}" for u in units]
    if not _classes:
        _classes.append(np.array([0 if 0xD800 <= c < 0xE000 else _class(c) for c in range(0x3000)], np.int32))
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _classes[0]
    codes = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 27 + points % np.uint32(CLASSES - 28)).astype(np.int32)
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    starts = np.cumsum(lengths) - lengths
    extra = np.maximum(0, -(-(lengths - WIDTH) // (WIDTH // 2)))
    owner = np.repeat(np.arange(len(units)), extra + 1)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
    start = number * (WIDTH // 2)
    at = start[:, None] + np.arange(WIDTH)[None, :]
    inside = at < lengths[owner][:, None]
    flat = np.minimum(starts[owner][:, None] + at, max(0, len(codes) - 1))
    return np.where(inside, codes[flat] if len(codes) else 0, 0), owner


def occurrences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape of a subsequence: the subsequence at each position (0 if there is none), and its weight."""
    for i, j in _PAIRS:
        a, b, c = codes[:, :-j], codes[:, i : i - j], codes[:, j:]
        yield np.where((a > 0) & (b > 0) & (c > 0), (a * CLASSES + b) * CLASSES + c, 0), DECAY ** (j + 1)


def norms(codes: np.ndarray) -> np.ndarray:
    """The norm that a window of so many letters would have if no subsequence occurred twice."""
    total = np.full(len(codes), 1e-2)
    for seen, weight in occurrences(codes):
        total += (seen > 0).sum(1) * weight**2
    return np.sqrt(total)


def unit_scores(units: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """f of each unit; of a long one, the largest of its windows."""
    out = np.full(len(units), -np.inf)
    for k in range(0, len(units), 10_000):
        codes, owner = coded(units[k : k + 10_000])
        total = np.zeros(len(codes))
        for seen, weight in occurrences(codes):
            total += weights[seen].sum(1) * weight
        np.maximum.at(out, owner + k, total / norms(codes) + bias)
    return out


_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


def units_of(text: str | None) -> list[str]:
    """Lower-case words, and runs of three or more single characters (a spaced-out word) joined."""
    text = (text or "").lower()
    return text.split() + [m[0].replace(" ", "").replace("\t", "") for m in _SPACED.finditer(text)]


def sentence_of(text: str, unit: str) -> str | None:
    """The first sentence of a text that has a unit."""
    return next((s for s in re.split(r"(?<=[.!?])\s+|\n", text) if unit in units_of(s)), None)


@dataclass
class Machine:
    """A fitted machine: a weight for each subsequence, the bias, and the calibration from f to a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    landmarks: list[str]

    def probability(self, f: np.ndarray | float) -> np.ndarray | float:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(f, -3, 3) + self.offset, -30, 30)))


class _Kernel:
    """Nyström features over a list of landmark units."""

    def __init__(self, landmarks: list[str]) -> None:
        codes, _ = coded([z[: WIDTH - 2] for z in landmarks])
        self.columns = np.unique(np.concatenate([seen.ravel() for seen, _ in occurrences(codes)] + [np.zeros(1, np.int64)]))
        self.landmarks = self._rows(codes)
        values, vectors = np.linalg.eigh((self.landmarks @ self.landmarks.T).astype(np.float64))
        keep = values > 1e-4 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), len(self.columns)), np.float32)
        row = np.arange(len(codes))[:, None]
        for seen, weight in occurrences(codes):
            at = np.minimum(np.searchsorted(self.columns, seen), len(self.columns) - 1)
            hit = (self.columns[at] == seen) & (seen > 0)
            np.add.at(out, (np.broadcast_to(row, seen.shape)[hit], at[hit]), weight)
        out /= norms(codes)[:, None].astype(np.float32)
        return out

    def features(self, units: list[str]) -> np.ndarray:
        parts = [np.zeros((0, self.root.shape[1]))]
        for k in range(0, len(units), 250):
            parts.append(self._rows(coded([u[: WIDTH - 2] for u in units[k : k + 250]])[0]) @ self.landmarks.T @ self.root)
        return np.vstack(parts)

    def collapsed(self, w: np.ndarray) -> np.ndarray:
        """The weight of each subsequence under the linear weights w."""
        out = np.zeros(CLASSES**3)
        out[self.columns] = self.landmarks.T @ (self.root @ w)
        out[0] = 0
        return out


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss (y is 1 or -1, c the costs), by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-4
    for _ in range(steps):
        gap = 1 - y * (z @ w)
        on = gap > 0
        grad = ridge * w - z[on].T @ (c[on] * y[on] * gap[on])
        step = np.linalg.solve((z[on] * c[on, None]).T @ z[on] + np.diag(ridge), grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _diverse(units: list[str], most: int, alike: float = 0.92) -> list[str]:
    """The first ``most`` units that are not nearly equal to one before them."""
    units = list(dict.fromkeys(u[: WIDTH - 2] for u in units))[: 2 * most]
    if not units:
        return []
    rows = _Kernel(units).landmarks
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    chosen: list[int] = []
    for i in range(len(units)):
        if len(chosen) < most and rows[i].any() and (not chosen or (rows[chosen] @ rows[i]).max() < alike):
            chosen.append(i)
    return [units[i] for i in chosen]


def disguised(unit: str, rng: np.random.Generator) -> list[str]:
    """A unit with a sign between all letters, with one sign, and with one letter, put in."""
    if len(unit) < 4:
        return []
    k = int(rng.integers(1, len(unit)))
    sign, letter = ".-_*"[int(rng.integers(4))], chr(97 + int(rng.integers(26)))
    return [sign.join(unit), unit[:k] + sign + unit[k:], unit[:k] + letter + unit[k:]]


def fit(bags: list[list[str]], labels: np.ndarray, landmarks: int = LANDMARKS, rounds: int = 4, seed: int = 3) -> Machine:
    """Fit on documents, given as their units, and their labels.

    Labels are those of documents, as sentences have none. A document's label says that some sentence of it, and some unit of that, is toxic, or that none is. Rounds alternate: take as
    positive each toxic document's witnesses, the units with the largest f (at first, those that toxic documents have most in excess); as negative
    the units of clean documents with the largest f (4,000) and a random draw (4,000); choose landmarks among both; fit the machine. Fitting sees the first WIDTH - 2 characters of a long
    unit; scoring sees all of it.
    """
    rng = np.random.default_rng(seed)
    bags = [list(dict.fromkeys(b)) for b in bags]
    toxic = [b for b, y in zip(bags, labels) if y and b]
    clean = [b for b, y in zip(bags, labels) if not y and b]
    rate = float(np.clip((labels.sum() + 1) / (len(labels) + 2), 1e-3, 1 - 1e-3))
    if not toxic or not clean:
        return Machine(np.zeros(CLASSES**3), 0.0, 0.0, float(np.log(rate / (1 - rate))), [])
    pos, neg = Counter(u for b in toxic for u in b), Counter(u for b in clean for u in b)
    excess = {u: (n / len(toxic) - neg[u] / len(clean)) / np.sqrt((n + neg[u] + 1) / (len(toxic) + len(clean))) for u, n in pos.items()}
    level = max(1e-9, np.quantile([max(excess[u] for u in b) for b in toxic], 0.2))
    witnesses = [u for b in toxic for u in sorted(b, key=lambda u: (-excess[u], u))[:WITNESSES] if excess[u] >= level]
    names = sorted(neg)
    drawn = [names[i] for i in rng.choice(len(names), min(len(names), 4000), replace=False)]
    hard: list[str] = sorted(neg, key=lambda u: (-neg[u], u))[:1000]
    where = {u: i for i, u in enumerate(sorted(pos.keys() | neg.keys()))}
    vocabulary, is_clean = list(where), np.array([u in neg for u in where])
    machine = None
    for _ in range(rounds):
        counts = Counter(w for w in witnesses if w not in neg or pos[w] > 3 * neg[w])
        chosen = _diverse(sorted(counts, key=lambda u: (-counts[u], u)), landmarks * 3 // 4)
        chosen += _diverse(hard[: landmarks // 8] + drawn[: landmarks // 8], landmarks // 4)
        if not counts or not chosen:
            break
        kernel = _Kernel(chosen)
        for u in list(counts):
            for v in disguised(u, rng):
                if v not in neg:
                    counts[v] += 0.6 * counts[u]
        positives, negatives = list(counts), list(dict.fromkeys(hard + drawn))
        x = kernel.features(positives + negatives)
        y = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
        cost = np.r_[np.minimum(10.0, [counts[u] for u in positives]), np.full(len(negatives), 1.0)]
        cost[: len(positives)] *= max(1.0, 0.25 * len(negatives) / cost[: len(positives)].sum())
        w, bias = _svm(x, y, cost * 2)
        machine = Machine(kernel.collapsed(w), bias, 1.0, 0.0, chosen)
        scores = unit_scores(vocabulary, machine.weights, bias)
        best = [sorted(b, key=lambda u: (-scores[where[u]], u))[:WITNESSES] for b in toxic]
        witnesses = [u for b in best for k, u in enumerate(b) if scores[where[u]] > (0 if k else -0.5)]
        ranked = np.argsort(-np.where(is_clean, scores, -np.inf), kind="stable")[:4000]
        hard = [vocabulary[i] for i in ranked if is_clean[i]]
    if machine is None:
        return Machine(np.zeros(CLASSES**3), 0.0, 0.0, float(np.log(rate / (1 - rate))), [])
    top = np.array([max((scores[where[u]] for u in b), default=-3.0) for b in bags])
    w, offset = _calibrate(np.clip(top, -3, 3), np.asarray(labels, float))
    return Machine(machine.weights, machine.bias, w, offset, machine.landmarks)


def _calibrate(f: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a probability, by logistic regression with smoothed targets."""
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    target, z, w = np.where(y > 0, up, down), np.c_[f, np.ones(len(f))], np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-4])
        w = w - np.clip(np.linalg.solve(h, z.T @ (p - target) + np.array([1e-2, 1e-4]) * w), -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit on at most ``fit_docs`` documents of each label: those with the smallest hashes of their ids.

    ``labels`` should hold the rows to learn from only. Null labels and ids are unused; of repeated labels the largest counts, of repeated documents one. The
    driver gets the distinct units of the sampled texts, whose number the bound limits.
    """
    known = pick(labels, id=id_col, label=label_col).dropna().groupBy("id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("id"), "id"]
    sample = known.where("label > 0").orderBy(*order).limit(fit_docs).union(known.where("label = 0").orderBy(*order).limit(fit_docs))
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").alias("of"), "text")
    rows = rows.join(F.broadcast(sample), F.col("of") == F.col("id")).select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [list(dict.fromkeys(units_of(t.as_py()))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.list_(pa.string()))], ["id", "label", "units"])

    machine = _fitted(rows.mapInArrow(split, "id long, label int, units array<string>"), landmarks)
    release()
    return machine


def _fitted(rows: DataFrame, landmarks: int) -> Machine:
    """The machine of the documents in ``rows`` (id, label, units). What the driver holds of them is free again when this returns."""
    same: dict[str, str] = {}  # one string for each unit
    found: dict[int, tuple[int, list[str]]] = {}
    for r in rows.toArrow().to_batches(max_chunksize=64):
        for ident, label, units in zip(*(r.column(k) for k in range(3))):
            found[ident.as_py()] = label.as_py(), [same.setdefault(u, u) for u in units.as_py()]
    bags = [found[i] for i in sorted(found)]
    return fit([units for _, units in bags], np.array([label for label, _ in bags], np.int64), landmarks)


class _Scores(dict):
    """f of units seen by this worker; starts anew when full."""

    LIMIT = 120_000


_seen: dict[int, _Scores] = {}


def _top_units(machine: Machine, token: int, texts: pa.Array) -> tuple[list[float], list[str | None]]:
    """f of each text's most toxic unit, and that unit; a worker keeps the scores of units that it has seen."""
    hold("toxicity", _seen.clear)
    if token not in _seen:
        _seen.clear()
        _seen[token] = _Scores()
    seen, tops, words = _seen[token], [], []
    for k in range(0, len(texts), 256):
        bags = [units_of(t.as_py()) for t in texts.slice(k, 256)]
        if len(seen) > _Scores.LIMIT:
            seen.clear()
        new = list({u for b in bags for u in b}.difference(seen))
        if new:
            seen.update(zip(new, unit_scores(new, machine.weights, machine.bias).tolist()))
        for b in bags:
            best = max(b, key=seen.__getitem__) if b else None
            words.append(best)
            tops.append(seen[best] if b else -3.0)
    return tops, words


def _token(machine: Machine) -> int:
    return int(np.abs(machine.weights).sum() * 1e6) ^ hash((machine.bias, machine.slope, machine.offset))


def without_toxic(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the machine does not predict to be toxic.

    Each row is judged by its own text, in one scan without a join or shuffle. Null and empty texts have no units and get the least score of all.
    """
    shared, token, at = docs.sparkSession.sparkContext.broadcast(machine), _token(machine), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = m.probability(np.array(_top_units(m, token, batch.column(at))[0]))
            yield batch.filter(pa.array(p < 0.5, pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, score (0 to 1), predicted (1 if score >= 0.5, else 0), unit (the most toxic one), sentence (where predicted is 1, the first that has this unit).

    Units of whole texts are scored; a text's score is that of its most toxic sentence, and a sentence's that of its most toxic unit, so a text's is the largest of its units'. The machine (a
    weight for each of CLASSES**3 subsequences) is broadcast. Rows are independent: no shuffle; a worker scores each distinct unit
    once, in vectors.

    Null and empty texts have no units and get the least score of all. Null ids and repeated rows are passed through. Extra columns
    are ignored. An empty table gives an empty result.
    """
    shared, token = docs.sparkSession.sparkContext.broadcast(machine), _token(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            tops, words = _top_units(m, token, batch.column(1))
            p = m.probability(np.array(tops))
            toxic = p >= 0.5
            where = [sentence_of(t.as_py(), w) if y and w else None for t, w, y in zip(batch.column(1), words, toxic)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(toxic.astype(np.int32)), pa.array(words, pa.string()), pa.array(where, pa.string())], [id_col, "score", "predicted", "unit", "sentence"])

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    return rows.mapInArrow(tidy(score), f"`{id_col}` long, score double, predicted int, unit string, sentence string")


def held_out(ident: Column) -> Column:
    """Whether a document is kept from training: a fifth of all, by the CRC of its id as text."""
    return F.crc32(ident.cast("string").cast("binary")) % 5 == 0
