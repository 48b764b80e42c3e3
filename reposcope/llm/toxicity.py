"""Toxic passages: maximum-scoring segments of token log-odds.

Token scores are log-odds of standing in a toxic document, with two Dirichlet priors: a token's is
centred at the odds of its first letters, theirs at the share of toxic documents; a constant drift is taken off, so that the expected score is negative. One pass over
a document finds all maximal scoring segments. Scores of segments of clean text follow an
extreme-value law: P(S >= x) = 1 - exp(-K n exp(-lambda x)); lambda solves E[exp(lambda s)] = 1 over
the clean tokens, K comes from the clean documents' best segments. The document's score is a
logistic function of the normalised best segment.

Tokens are counted in a fixed number of hashed cells. Labelled rows are a bounded sample.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.llm.common import free_name, parts

#: Labelled rows to learn from, at most: those with the smallest hashes of their ids.
SAMPLE = 200_000
CELLS = 1 << 20
#: Dirichlet prior: documents seen beforehand with each token, toxic or clean as all documents are.
PRIOR = 10.0
STEM = 4
DRIFT = 1.0
TOP = 8.0
#: Entries of a task's table of known words; a full table is emptied, and the end of the task drops it.
CACHE_ROWS = 120_000
_WORD = re.compile(r"[^\W_]+")
_STEP = 0.05


def _cell(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) & (CELLS - 1)


class _Cells(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_ROWS:
            self.clear()
        made = self[word] = _cell(word)
        return made


class _Scores(dict):
    def __init__(self, counts: np.ndarray, rows: np.ndarray):
        super().__init__()
        self.counts, self.base = counts, (rows + 1.0) / (rows.sum() + 2.0)

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_ROWS:
            self.clear()
        clean, toxic = (float(x) for x in self.counts[:, _cell(word)])
        stem_clean, stem_toxic = (float(x) for x in self.counts[:, _cell("^" + word[:STEM])])
        of_stem = stem_clean + stem_toxic + PRIOR
        a = clean + PRIOR * (stem_clean + PRIOR * self.base[0]) / of_stem
        b = toxic + PRIOR * (stem_toxic + PRIOR * self.base[1]) / of_stem
        made = self[word] = min(math.log(b / self.base[1]) - math.log(a / self.base[0]), TOP) - DRIFT
        return made



def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time: candidates are kept with the
    sums before and after them; a candidate is joined to the last earlier one that starts lower, if
    that one ends lower too."""
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(np.r_[False, positive, False]))
    total = np.r_[0.0, np.cumsum(scores, dtype=np.float64)]
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, earlier one that starts lower
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        low, high = float(total[start]), float(total[end])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, h - b) for s, e, b, h, _ in found]


@dataclass
class Model:
    """Documents of the sample with each cell's tokens and stems (clean, toxic), all documents, and
    the calibration."""

    counts: np.ndarray
    rows: np.ndarray
    rate: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float] = (-2.0, 1.0)
    _known: _Scores | None = field(default=None, repr=False)

    def scores(self, found: list[str]) -> np.ndarray:
        if self._known is None:
            self._known = _Scores(self.counts, self.rows)
        return np.fromiter(map(self._known.__getitem__, found), dtype=np.float64, count=len(found))

    def forget(self) -> None:
        self._known = None

    def excess(self, best: float, n: int) -> float:
        """Normalised best score: below 0 for most clean documents."""
        return self.rate * best - self.log_k - math.log(max(n, 1))

    def passages(self, text: str | None, level: float = 0.01) -> list[dict]:
        """Significant passages: character spans, score and P-value, in order."""
        if not text:
            return []
        lower = text.lower()
        spans = [m.span() for m in _WORD.finditer(lower if len(lower) == len(text) else text)]
        scores = self.scores([text[a:b].lower() for a, b in spans])
        out = []
        for s, e, x in segments(scores):
            p = -math.expm1(-math.exp(min(50.0, -self.excess(x, len(spans)))))
            if p <= level:
                out.append({"start": spans[s][0], "end": spans[e - 1][1], "score": x, "p": p})
        return out

    def best(self, text: str | None) -> tuple[float, int]:
        found = words(text)
        return max((x for _, _, x in segments(self.scores(found))), default=0.0), len(found)

    def probability(self, best: float, n: int) -> float:
        z = self.weights[0] + self.weights[1] * max(min(self.excess(best, n), 50.0), -20.0)
        return 1 / (1 + math.exp(-max(min(z, 40.0), -40.0)))


def sampled(labels: DataFrame, docs: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(text, toxic, part): the labelled training rows. Rows whose crc32 of the id as text is
    divisible by 5 are held out; part is 0 to 3 for the others. Several labels of an id: toxic if one
    says so; labels other than 0 and 1, null labels and null ids teach nothing. The bounded label
    table is broadcast, so no text is shuffled."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    rows = labels.where("toxic in (0, 1) and doc_id is not null").withColumn("part", held - 1).where("part >= 0")
    rows = rows.groupBy("doc_id", "part").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "part")


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Token counts come from parts 0 to 2 of the sample, the calibration from part 3."""
    sample = sampled(labels, docs, limit)
    spark = docs.sparkSession

    def tokens(batches):
        counts, rows, cell_of = np.zeros((2, CELLS), dtype=np.int32), np.zeros(2, dtype=np.int64), _Cells()
        for batch in parts(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set(words(text))
                cells = list({cell_of[w] for w in found} | {cell_of["^" + w[:STEM]] for w in found})
                counts[toxic, cells] += 1
                rows[toxic] += 1
        at = np.flatnonzero(counts.any(axis=0))
        for a in range(0, len(at), 200_000):
            part = at[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(counts[t, part].astype(np.int64)) for t in (0, 1))], ["cell", "clean", "toxic"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array(rows[:1]), pa.array(rows[1:])], ["cell", "clean", "toxic"])

    counted = sample.where("part < 3").select("text", "toxic").mapInArrow(tokens, "cell bigint, clean bigint, toxic bigint")
    counts, rows = np.zeros((2, CELLS)), np.zeros(2)
    for r in counted.groupBy("cell").agg(F.sum("clean"), F.sum("toxic")).toLocalIterator():
        (rows if r[0] < 0 else counts[:, r[0]])[:] = r[1], r[2]
    model = Model(counts.astype(np.int32), rows)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches):
        own = shared.value
        for batch in parts(batches, 1024):
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scores = own.scores(words(text))
                best = max((x for _, _, x in segments(scores)), default=0.0)
                rows.append((toxic, round(best, 2), int(math.log2(max(len(scores), 1)) * 4), np.bincount(np.clip(((scores + 20) / _STEP).astype(int), 0, 799), minlength=800)))
            tokens = sum((r[3] for r in rows if not r[0]), np.zeros(800, dtype=np.int64))
            at = np.flatnonzero(tokens)
            kinds = [pa.array([0] * len(rows) + [1] * len(at)), pa.array([r[0] for r in rows] + [0] * len(at)), pa.array([r[1] for r in rows] + [0.0] * len(at)), pa.array([r[2] for r in rows] + at.tolist()), pa.array([1] * len(rows) + tokens[at].tolist())]
            yield pa.RecordBatch.from_arrays(kinds, ["kind", "toxic", "best", "cls", "n"])
        own.forget()

    measured = sample.where("part = 3").select("text", "toxic").mapInArrow(measure, "kind bigint, toxic bigint, best double, cls bigint, n bigint")
    binned = measured.groupBy("kind", "toxic", F.round("best", 1).alias("best"), "cls").agg(F.sum("n").alias("n")).collect()
    _calibrate(model, binned)
    return model


def _calibrate(model: Model, binned: list) -> None:
    tokens = [((r["cls"] + 0.5) * _STEP - 20, r["n"]) for r in binned if r["kind"] == 1]
    docs = [(r["toxic"], r["best"], 2 ** (r["cls"] / 4), r["n"]) for r in binned if r["kind"] == 0]
    if tokens and any(s > 0 for s, _ in tokens):
        s, n = (np.array(x, dtype=np.float64) for x in zip(*tokens, strict=True))
        low, high = 0.05, 5.0
        for _ in range(60):  # E[exp(rate s)] = 1 has one root above 0, as the mean is below it
            rate = (low + high) / 2
            low, high = (rate, high) if (n * np.exp(rate * s)).sum() < n.sum() else (low, rate)
        model.rate = rate
    clean = [(b, size, n) for t, b, size, n in docs if not t and b > 0]
    if clean:
        total = sum(n for *_, n in clean)
        model.log_k = sum(n * (model.rate * b - math.log(max(size, 1))) for b, size, n in clean) / total - 0.5772156649
    if not {t for t, *_ in docs} >= {0, 1}:
        return
    x = np.array([max(min(model.excess(b, round(size)), 50.0), -20.0) for _, b, size, _ in docs])
    y, w = np.array([float(t) for t, *_ in docs]), np.array([float(n) for *_, n in docs])
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (w * (y - p)) - 0.1 * beta
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        beta += np.clip(move, -2, 2)
    model.weights = (float(beta[0]), max(float(beta[1]), 1e-3))


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns of every row, then ``name`` double, which none of ``keep`` may be called (see
    ``passages`` for the spans). Null and empty texts have the score of an empty text. Texts are read
    whole; rows are never grouped, so repeated rows and ties are scored alike; an empty table gives no
    rows."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.counts, model.rows, model.rate, model.log_k, model.weights))

    def run(batches):
        own = shared.value
        for batch in parts(batches):
            found = [own.probability(*own.best(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.float64())], [*keep, name])
        own.forget()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col("text").alias(free_name("text", keep)), *keep).mapInArrow(run, f"{kinds}, `{name}` double")


def passages(docs: DataFrame, model: Model, level: float = 0.01) -> DataFrame:
    """(doc_id, start, end, passage_score, p) of every significant passage, character offsets; null and
    empty texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.counts, model.rows, model.rate, model.log_k, model.weights))
    names = ["doc_id", "start", "end", "passage_score", "p"]

    def run(batches):
        for batch in parts(batches):
            rows = [(d, x["start"], x["end"], x["score"], x["p"]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in shared.value.passages(t, level)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start bigint, end bigint, passage_score double, p double")
