"""Toxicity by a subsequence string kernel, a Nyström map and a linear support vector machine.

The sentences the kernel compares are words and spelled-out runs of single letters, brought down to
their letters. Two strings are similar if they share subsequences of three and four letters; a
subsequence counts less the farther it is spread, so letters put in between or left out lower the
similarity but do not end it. Landmark strings span the feature space; the machine is linear in it,
which makes its decision a weighted sum over the subsequences of a string, kept as two tables.

Only documents carry labels. Strings are labelled from them: toxic are those too frequent in
toxic documents to be chance, and those needed to explain the rest; strings of clean documents are
clean; and both sides are extended by what a first machine gets most wrong. A
document is as toxic as its most toxic string; a logistic curve on documents not used before turns
that into a probability.

Training takes at most ``MAX_TOXIC`` + ``MAX_CLEAN`` labelled documents, those with the smallest
hashes of their id, never rows with ``crc32(doc_id) % 3 = 1``. Scoring reads every text whole.

Limit: the kernel tells the letters a to z apart; every other letter or digit is one of six codes. Texts in
scripts other than Latin have an alphabet of six, in which toxic and clean strings may not be told apart.

Defined results: a null or empty text has no strings and gets the score of that; labels that are
null or without an id are not used, an id with several labels is toxic if one says so; without
toxic or clean labels to learn from every score is the share of toxic labels (0 without labels);
each document row is scored for itself.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossledger.llm.common import map_batches, map_rows

MAX_TOXIC, MAX_CLEAN = 1000, 2000
LANDMARKS = 192
DECAY = 0.6
REACH = {3: 5, 4: 7}  # longest stretch of a subsequence, by its length
LETTERS = 32
LONGEST = 14  # longer words are seen through overlapping windows of this length
THRESHOLD = 0.7
FLOOR = -0.6  # lower decisions do not tell documents apart
CACHE_WORDS = 200_000
TOGETHER = 4096  # rows of a matrix worked on at once while fitting, on the driver



def letters_of(word: str) -> str:
    return word.lower() if word.isalnum() else "".join([c for c in word.lower() if c.isalnum()])


def raw_strings(text: str | None) -> set[str]:
    """The distinct words of a text, and runs of single letters as one word."""
    if not text:
        return set()
    words = text.split()
    found = set(words)
    single = [i for i, w in enumerate(words) if len(w) == 1]
    start = 0
    for end in range(1, len(single) + 1):
        if end == len(single) or single[end] != single[end - 1] + 1:
            if end - start >= 3:
                found.add("".join([words[i] for i in single[start:end]]))
            start = end
    return found


def _windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


_PLANS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _plan(length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and weights of the subsequences of ``size`` letters in a word of ``length``."""
    if (length, size) not in _PLANS:
        kept = [c for c in combinations(range(length), size) if c[-1] - c[0] < REACH[size]]
        places = np.array(kept, np.int64).reshape(-1, size)
        weights = DECAY ** (places[:, -1] - places[:, 0] + 1.0) if len(kept) else np.empty(0)
        _PLANS[length, size] = places, weights
    return _PLANS[length, size]


def subsequences(words: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words of equal length: their rows in ``words``, codes of subsequences, scaled weights."""
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    for length, members in by_length.items():
        places, weights = _plan(length, size)
        if not len(places):
            continue
        scaled = weights / np.sqrt((weights * weights).sum())
        for start in range(0, len(members), 4096):
            rows = np.array(members[start : start + 4096])
            points = np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le"), "<u4").reshape(-1, length)
            codes = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % 6).astype(np.int64)
            code = codes[:, places[:, 0]]
            for j in range(1, size):
                code = code * LETTERS + codes[:, places[:, j]]
            yield rows, code, scaled


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The mean of the normalised kernels of both subsequence lengths, words by landmarks."""
    out = np.zeros((len(words), len(landmarks)))
    for size in REACH:
        parts = [(code.ravel(), np.repeat(rows, code.shape[1]), np.tile(scaled, len(rows)))
                 for rows, code, scaled in subsequences(landmarks, size)]
        if not parts:
            continue
        codes, owners, weights = (np.concatenate(p) for p in zip(*parts))
        known, at = np.unique(codes, return_inverse=True)
        grid = np.zeros((len(known), len(landmarks)))
        np.add.at(grid, (at, owners), weights)
        for rows, code, scaled in subsequences(words, size):
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            row, place = np.nonzero(known[at] == code)  # few subsequences are in any landmark
            for some in np.array_split(np.arange(len(row)), len(row) // TOGETHER + 1):
                if len(some):
                    r, first = np.unique(row[some], return_index=True)
                    shared = grid[at[row[some], place[some]]] * scaled[place[some], None]
                    out[rows[r]] += np.add.reduceat(shared, first, axis=0) / len(REACH)
    return out


@dataclass
class Machine:
    """Decision values of strings, and the curve from a document's strings to a probability."""

    tables: dict[int, np.ndarray]
    bias: float
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def decide(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), min(self.bias, -0.5))  # of words without subsequences, too
        done = np.zeros(len(words))
        for size, table in self.tables.items():
            for rows, code, scaled in subsequences(words, size):
                done[rows] += table[code] @ scaled
                out[rows] = self.bias + done[rows]
        return out

    def decide_raw(self, raw: list[str]) -> np.ndarray:
        """The highest decision over the windows of each raw word; ``-1`` without letters."""
        owners, parts = [], []
        for i, word in enumerate(raw):
            letters = letters_of(word)
            if len(letters) <= LONGEST:
                owners.append(i)
                parts.append(letters)
            else:
                for part in _windows(letters):
                    owners.append(i)
                    parts.append(part)
        out = np.full(len(raw), -1.0)
        if parts:
            np.maximum.at(out, np.array(owners), self.decide(parts))
        return out

    def probability(self, highest: float, above: int) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * highest + c * np.log1p(above), -30, 30))))


def document_features(decisions: list[float]) -> tuple[float, int]:
    """The highest decision, but at least FLOOR, and the number of those above 0."""
    return max([FLOOR, *decisions]), sum([d > 0 for d in decisions])


def _svm(features: np.ndarray, labels: np.ndarray, strength: float = 30.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss and balanced classes, by Newton steps."""
    x = features  # the last column is 1, for the bias
    share = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels < 0).sum()))
    cost = strength * len(labels) * share / 10
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    for _ in range(rounds):
        margin = 1 - labels * (x @ w)
        on = np.flatnonzero(margin > 0)
        gradient, curvature = keep @ w, keep.copy()
        for start in range(0, len(on), TOGETHER):
            part = on[start : start + TOGETHER]
            xo, co = x[part], cost[part]
            gradient -= 2 * xo.T @ (co * labels[part] * margin[part])
            curvature += 2 * (xo * co[:, None]).T @ xo
        step = np.linalg.solve(curvature, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _one_of_each_family(bags: list[set[str]]) -> list[set[str]]:
    """Copies and near copies count once: bags that agree in two of four least hashes of long words."""
    seen: set[tuple] = set()
    kept = []
    for words in bags:
        long = [w.encode() for w in words if len(w) >= 8]
        least = [min((zlib.crc32(w, seed), w) for w in long) for seed in range(4)] if long else []
        bands = {(i, *least[i : i + 2]) for i in (0, 2)} if least else {("all", *sorted(words))}
        if not bands & seen:
            kept.append(words)
        seen |= bands
    return kept


def _explaining(toxic: list[set[str]], clean: Counter, cleans: int) -> list[str]:
    """Strings that mark toxic documents: those too frequent there to be chance, then those needed
    to explain the documents that hold none of them."""
    toxic = _one_of_each_family(toxic)
    counts = Counter(w for words in toxic for w in words)
    share = max(len(toxic), 1) / (max(len(toxic), 1) + max(cleans, 1))
    enough = max(2, int(np.ceil(np.log(1e-4) / np.log(share))))
    rare = {w for w, n in counts.items() if clean[w] * 20 <= n and len(w) >= 3}
    chosen = sorted(w for w in rare if counts[w] >= enough)
    marks = set(chosen)
    left = [words & rare for words in toxic if not words & marks]
    counts = Counter(w for words in left for w in words)
    least = max(2, enough // 3)
    while counts:
        word, gain = max(counts.items(), key=lambda item: (item[1], item[0]))
        if gain < least:
            break
        chosen.append(word)
        rest = []
        for words in left:
            if word in words:
                counts.subtract(words)
            else:
                rest.append(words)
        left = rest
        counts = +counts
    return chosen


def _fit(positive: list[str], negative: list[str], seed: int) -> Machine:
    rng = np.random.default_rng(seed)
    half = LANDMARKS // 2
    pick = lambda words, n: [words[i] for i in sorted(rng.permutation(len(words))[:n])]
    landmarks = pick(positive, half) + pick(negative, LANDMARKS - min(half, len(positive)))
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks) + 1e-6 * np.eye(len(landmarks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    labels, shown = np.r_[np.ones(len(positive)), -np.ones(len(negative))], positive + negative
    features = np.ones((len(shown), len(landmarks) + 1))
    for start in range(0, len(shown), TOGETHER):
        features[start : start + TOGETHER, :-1] = kernel(shown[start : start + TOGETHER], landmarks) @ root
    weights, bias = _svm(features, labels)
    share = root @ weights / len(REACH)
    tables = {}
    for size in REACH:
        table = np.zeros(LETTERS**size)
        for rows, code, scaled in subsequences(landmarks, size):
            np.add.at(table, code, share[rows][:, None] * scaled)
        tables[size] = table
    return Machine(tables, bias)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.05 * w)
    return w


def train(labelled: list[tuple[int, list[str]]], toxic_share: float, seed: int = 3) -> Machine:
    """``labelled``: label and distinct raw words of each training document, in a fixed order."""
    # Long strings are learned as they are scored: through their windows, in both classes.
    one: dict[str, str] = {}
    parts = {w: [one.setdefault(p, p) for p in _windows(letters_of(w))] for w in {w for _, words in labelled for w in words}}
    bags = [(y, {p for w in words for p in parts[w]} - {""}) for y, words in labelled]
    del parts, one
    learn = [b for i, b in enumerate(bags) if i % 3]
    toxic = [w for y, w in learn if y]
    clean = Counter(w for y, words in learn if not y for w in words)
    flat = Machine({}, -1.0, (float(np.log(max(toxic_share, 1e-9) / max(1 - toxic_share, 1e-9))), 0.0, 0.0))
    positive = _explaining(toxic, clean, sum(not y for y, _ in learn))
    if not positive or not clean:
        return flat
    rng = np.random.default_rng(seed)
    pool = sorted(w for w in clean if len(w) >= 3)
    if not pool:
        return flat
    shown = positive
    negative = [pool[i] for i in sorted(rng.permutation(len(pool))[:12_000])]
    machine = _fit(shown, negative, seed)
    for _ in range(3):
        scores = machine.decide(pool)
        worst = [pool[i] for i in np.argsort(-scores, kind="stable")[:2500]]
        negative = sorted(set(negative) | set(worst))
        counts = Counter(w for words in toxic for w in words if w not in clean and len(w) >= 3)
        doubt = sorted(w for w, n in counts.items() if n >= 2)
        if doubt:
            found = machine.decide(doubt)
            shown = sorted(set(shown) | {w for w, f in zip(doubt, found) if f > 0.25})
        machine = _fit(shown, negative, seed)
    held = [b for i, b in enumerate(labelled) if i % 3 == 0]
    every = sorted({w for _, words in held for w in words})
    value = dict(zip(every, machine.decide_raw(every).tolist()))
    x, y = [], []
    for label, words in held:
        highest, above = document_features([value[w] for w in words])
        x.append((highest, float(np.log1p(above))))
        y.append(label)
    y = np.array(y, float)
    if len(set(y.tolist())) < 2:
        machine.curve = (0.0, 4.0, 0.5)
        return machine
    # the sample has more toxic documents than the labels; weights bring their share back
    weight = np.where(y > 0, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    machine.curve = tuple(_logistic(np.array(x), y, weight))
    return machine


def held_out(id_column):
    return F.crc32(id_column.cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Machine:
    """Train on a bounded sample of the labelled documents outside the held-out third."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where(
        "id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    toxic_share = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = F.xxhash64("id"), F.col("id")
    chosen = [r for y, n in ((1, max_toxic), (0, max_clean))
              for r in known.where(F.col("toxic") == y).orderBy(*order).limit(n).collect()]
    sample = docs.sparkSession.createDataFrame(chosen, "id bigint, toxic int")  # at most max_toxic + max_clean rows
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), "id")

    def words(rows: Iterator[dict]) -> Iterator[tuple]:
        for row in rows:
            yield row["id"], row["toxic"], "\n".join(sorted(raw_strings(row["text"])))

    found = map_rows(text, {"id": "bigint", "toxic": "int", "words": "string"}, words, size=64).collect()
    order_of = {r["id"]: i for i, r in enumerate(sorted(chosen, key=lambda r: hash((r["id"] * 2654435761) % (1 << 32))))}
    found.sort(key=lambda r: (order_of[r["id"]], r["words"]))
    one: dict[str, str] = {}  # each word is held once, however many documents have it
    labelled = []
    while found:
        row = found.pop()
        labelled.append((row["toxic"], [one.setdefault(w, w) for w in row["words"].split("\n")] if row["words"] else []))
    return train(labelled[::-1], float(toxic_share))


class Scorer:
    """Scores texts with a machine; recent words are kept, with decisions only for those above FLOOR."""

    def __init__(self, machine: Machine):
        self.machine, self.known, self.near, self.value = machine, set(), set(), {}

    def __call__(self, texts: list[str | None]) -> list[float]:
        """One score for each text; the new words of all of them are decided together."""
        bags = [raw_strings(text) for text in texts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.near, self.value = set(), set(), {}
        new = list(set().union(*bags) - self.known)
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            decided = self.machine.decide_raw(part)
            self.known.update(part)
            self.value.update((part[i], float(decided[i])) for i in np.flatnonzero(decided > FLOOR))
        if new:
            self.near = set(self.value)
        return [self.machine.probability(*document_features([self.value[w] for w in words & self.near])) for words in bags]


BATCH = 128  # texts scored together
_SCORERS: dict[str, Scorer] = {}


def _scorer(name: str, machine) -> Scorer:
    """The scorer of this Python worker, kept from task to task; only the latest machine's stays."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(machine.value)
    return _SCORERS[name]


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per document row: id, whether it is held out, the score and the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, **options))

    name = uuid.uuid4().hex

    def score(rows: Iterator[dict]) -> Iterator[tuple]:
        scorer = _scorer(name, shared)
        for part in batched(rows, BATCH):
            for row, value in zip(part, scorer([row["text"] for row in part])):
                yield row["doc_id"], row["held_out"], value, int(value >= threshold)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"))
    return map_rows(slim, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}, score)


def without_toxic(docs: DataFrame, labels: DataFrame, *, labelled_docs: DataFrame | None = None, text_col: str = "text",
                  threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; all columns stay.

    The machine learns from ``labelled_docs``, by default from ``docs`` themselves.
    """
    source = docs if labelled_docs is None else labelled_docs
    shared = docs.sparkSession.sparkContext.broadcast(fit(source, labels, text_col=text_col, **options))

    name = uuid.uuid4().hex
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, shared)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                scores = scorer(part.column(place).to_pylist())
                if (kept := part.filter(pa.array([s < threshold for s in scores]))).num_rows:
                    yield kept

    return map_batches(docs, keep, docs.schema)
