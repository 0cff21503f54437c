"""Quality classifier: a linear support vector machine on naive Bayes features.

Texts are seen as sets of byte n-grams (2 to 4 bytes of UTF-8), hashed to BUCKETS, and, if
that serves better, also of runs of equal words (the same word 2 to 8 times in a row,
whatever the word; longer runs count as 8). Which of the two is decided by cross-validation
within the fit sample (``choose_family``), so no held-out row has a say. Each n-gram's
indicator is scaled by its log-count ratio between the classes, rows have unit length, and
a linear hinge-loss model is fitted by dual coordinate descent (Wang and Manning 2012; Hsieh
et al. 2008). A logistic curve turns margins into scores from 0 to 1.

The log-count ratios count every labelled training row. The hinge-loss model is fitted on
the driver on at most ``fit_rows`` labelled documents, half of them of each class as far as
there are, chosen by hash of the id among the labels whose documents are there: a row
takes at most BUCKETS / 8 bytes, so the bound in memory is 32 KB a row. The logistic curve
weighs them by the frequencies of all labelled rows. Scoring reads whole texts.

Edge cases: null texts are empty; texts without n-grams get the score of the bias; null
labels and null ids are left out of training; labels of one class only, or of absent
documents only, give that class's frequency (0.5 without any) as every score; an id
labelled twice with different labels counts as both; repeated rows count
each time, but the fit sample has one row for an id; an empty table gives an empty result. Added columns replace input columns of their name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

BUCKETS = 1 << 18
ORDERS = (2, 3, 4)
#: Lengths of runs of one word that are n-grams of their own.
REPEATS = range(2, 9)
FIT_ROWS = 4_000
#: Folds of the choice between the families of features.
CHOICE_FOLDS = 3
#: Labels up to which they are broadcast (some 75 bytes each, so 150 MB); beyond, texts are joined by a shuffle.
BROADCAST_LABELS = 2_000_000


_REPEAT_BUCKETS = np.array([zlib.crc32(f"{n} equal words".encode()) % BUCKETS for n in REPEATS])


def _longest_run(words: list[str]) -> int:
    """The most times in a row that a word stands, counted up to the last of REPEATS."""
    longest, run = min(len(words), 1), 1
    for same in map(eq, words, islice(words, 1, None)):
        run = run + 1 if same else 1
        if run > longest:
            longest = run
            if longest == REPEATS[-1]:
                break
    return longest


class Indicators:
    """text -> sorted distinct n-gram buckets, those of runs of equal words included."""

    def __init__(self):
        self.seen = np.zeros(BUCKETS, np.bool_)

    def __call__(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        seen = self.seen
        for at in range(0, len(raw), 1 << 20):
            b = raw[at : at + (1 << 20) + max(ORDERS) - 1].astype(np.uint32)
            code = b
            for n in range(2, max(ORDERS) + 1):
                if len(b) < n:
                    break
                code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
                if n in ORDERS:
                    seen[(code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(14)] = True
        seen[_REPEAT_BUCKETS[: max(_longest_run(text.split()) - 1, 0)]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        return found


@dataclass
class QualityModel:
    weight: np.ndarray  # of each bucket, already times its log-count ratio
    square: np.ndarray  # of each bucket's log-count ratio
    bias: float
    slope: float
    shift: float
    runs: bool = False  # whether runs of equal words count; their weights are zero else

    def margin(self, found: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[found].sum(dtype=np.float64)))
        return self.bias + (float(self.weight[found].sum(dtype=np.float64)) / norm if norm else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -60, 60))))


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights over unit rows of ratio-scaled indicators, by dual coordinate descent.

    Each class has the same total cost, so that the rarer isn't drowned.
    """
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    share = np.array([(y < 0).sum(), (y > 0).sum()])
    limit = np.where(y > 0, cost * len(y) / (2 * share[1]), cost * len(y) / (2 * share[0]))
    rng = np.random.default_rng(seed)
    norms = np.array([np.sqrt((ratio[r] ** 2).sum()) for r in rows])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = ratio[r] / norms[i] if norms[i] else ratio[r]
            slope = y[i] * (w[r] @ x + bias) - 1
            # A row has unit length, and the bias adds one.
            new = min(max(alpha[i] - slope / ((1.0 if norms[i] else 0.0) + 1.0), 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                bias += step
                moved += abs(step)
                alpha[i] = new
        if moved < 1e-3 * len(rows) ** 0.5:
            break
    return w, bias


def fit_logistic(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve (Platt 1999), by Newton steps on smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        d, h = weight * (p - goal), weight * np.maximum(p * (1 - p), 1e-12)
        g = np.array([(d * margins).sum() + 1e-6 * a, d.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def log_ratio(by: np.ndarray) -> np.ndarray:
    """Log-count ratios from the rows of each class with each bucket."""
    p, q = 1 + by[1], 1 + by[0]
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[by.sum(axis=0) == 0] = 0.0
    return ratio


def without_runs(ratio: np.ndarray) -> np.ndarray:
    """Features of ratio zero take no part."""
    out = ratio.copy()
    out[_REPEAT_BUCKETS] = 0.0
    return out


def choose_family(rows: list[np.ndarray], y: np.ndarray, folds: int = CHOICE_FOLDS, seed: int = 0) -> bool:
    """Whether runs of equal words lower the errors of cross-validation on these rows, each class weighing the same.

    Counts, ratios and models of a fold come from the other folds' rows alone.
    """
    if min((y > 0).sum(), (y < 0).sum()) < 2 * folds:
        return False
    part = np.empty(len(y), np.int64)
    rng = np.random.default_rng(seed)
    for side in (-1.0, 1.0):
        at = np.flatnonzero(y == side)
        part[rng.permutation(at)] = np.arange(len(at)) % folds
    wrong = [0.0, 0.0]
    for fold_ in range(folds):
        fit, test = np.flatnonzero(part != fold_), np.flatnonzero(part == fold_)
        by = np.zeros((2, BUCKETS))
        for i in fit:
            by[int(y[i] > 0), rows[i]] += 1
        full = log_ratio(by)
        for runs, ratio in enumerate((without_runs(full), full)):
            w, bias = fit_hinge([rows[i] for i in fit], y[fit], ratio, rounds=6)
            model = QualityModel(w * ratio, ratio**2, bias, 1.0, 0.0)
            for i in test:
                wrong[runs] += (model.margin(rows[i]) * y[i] <= 0) / (y == y[i]).sum()
    return wrong[1] < wrong[0]


def training_labels(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    return known.filter(fold(F.col("doc_id"), folds) != held_out_fold).distinct()


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, label): texts move only if the labels are too many to broadcast."""
    few = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.join(F.broadcast(labels) if few else labels, "doc_id").select("text", "label")


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class, and of each class those with each bucket: (2,), (2, BUCKETS)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, ns = Indicators(), np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows[label, found(text.as_py())] += 1
                ns[label] += 1
        at = np.flatnonzero(rows.any(axis=0))
        # The rows of each class travel in a bucket of their own, after the others.
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BUCKETS).astype(np.int32)), pa.array(np.append(rows[0, at], ns[0])), pa.array(np.append(rows[1, at], ns[1]))], names=["bucket", "n0", "n1"])

    # A task adds at most BUCKETS rows to the shuffle, some 3 MB, however large its share of the texts.
    counted = labelled.mapInArrow(count, "bucket int, n0 long, n1 long")
    table = counted.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    by = np.zeros((2, BUCKETS + 1))
    at = table["bucket"].to_numpy()
    by[0, at], by[1, at] = table["n0"].to_numpy(), table["n1"].to_numpy()
    return by[:, BUCKETS], by[:, :BUCKETS]


def _fit_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fit_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    # Only labels whose documents are there; as many of each class as fit, more of one if the other has fewer.
    present = labels.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    low, high = (present.filter(F.col("label") == side).orderBy(*order).limit(fit_rows).toArrow() for side in (0, 1))
    half = fit_rows // 2
    n_low = min(len(low), max(half, fit_rows - len(high)))
    chosen = pa.concat_tables([low.slice(0, n_low), high.slice(0, min(len(high), fit_rows - n_low))])
    chosen = docs.sparkSession.createDataFrame(chosen)

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        found, out = Indicators(), []
        for text in texts:
            bits = np.zeros(BUCKETS, np.uint8)
            bits[found(text.as_py())] = 1
            out.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        return pa.array(out, pa.binary())

    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", packed("text").alias("bits"), F.xxhash64("text").alias("h"))
    # Of rows that share an id one is taken, so that the bound holds.
    least = rows.groupBy("doc_id", "label").agg(F.min(F.struct("h", "bits")).alias("least"))
    rows = least.select("doc_id", "label", "least.bits").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    unpacked = [np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8))).astype(np.int32) for b in rows["bits"].to_pylist()]
    return unpacked, np.where(rows["label"].to_numpy() == 1, 1.0, -1.0)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> QualityModel:
    """labels: (doc_id, label), as training_labels gives them."""
    bounded_batches(docs.sparkSession)
    ns, by = class_counts(_labelled(docs, labels, id_col, text_col))
    if not ns.min():
        share = float(ns[1] / ns.sum()) if ns.sum() else 0.5
        shift = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return QualityModel(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, shift)
    rows, y = _fit_sample(docs, labels, id_col, text_col, fit_rows)
    return fit_model(rows, y, ns, by)


def fit_model(rows: list[np.ndarray], y: np.ndarray, ns: np.ndarray, by: np.ndarray) -> QualityModel:
    """From the fit sample and the counts over all labelled rows."""
    runs = choose_family(rows, y)
    ratio = log_ratio(by)
    if not runs:
        ratio = without_runs(ratio)
    w, bias = fit_hinge(rows, y, ratio)
    model = QualityModel(w * ratio, ratio**2, bias, 1.0, 0.0)
    weight = np.where(y > 0, ns[1] / (y > 0).sum(), ns[0] / (y < 0).sum()) / ns.sum()
    slope, shift = fit_logistic(np.array([model.margin(r) for r in rows]), y, weight * len(y))
    return QualityModel((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(bias), slope, shift, runs)


def quality_score(model: QualityModel, docs: DataFrame, text_col: str = "text") -> Column:
    """The score of each whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the data

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        found, m = Indicators(), shared.value
        return pa.array([m.score(found(t.as_py())) for t in texts], pa.float64())

    return scores(text_or_empty(text_col))


def keep_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The input's rows that score at least that much."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col, fit_rows=fit_rows)
    return docs.filter(quality_score(model, docs, text_col) >= least)
