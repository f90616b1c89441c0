"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

One weight for each hashed feature (words and word pairs of the lower-cased text, and the shapes of words as they stand,
by term frequency) is shared by all grades; ordered thresholds t_1 < ... < t_K give P(grade >= k) = sigmoid(w.x - t_k), hence the expected grade and the
tail probability by which texts are selected. The model is fitted on the driver, on a bounded sample of labelled rows
(``max_rows``, those of smallest hashed identifier, so reruns agree); every row is scored on the executors with the
weight vector, whose size is fixed by ``bits``.

Defined cases: a null, empty or wordless text has no features and gets what the thresholds alone give; labelled rows
with a null grade or no text row are left out, and one whose identifier several rows share speaks for the smallest of
their texts (null if all are null); with fewer than two grades among the labels all texts get the one grade
(none: grade 0); repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trimmed

BITS, MAX_ROWS, PASSES, PRIOR, LEAST_DOCS = 20, 6000, 150, 0.3, 3
CACHE_WORDS = 200_000
_CACHE: dict[bytes, tuple[int, int]] = {}
_RUNS = re.compile(rb"(.)\1+", re.S)
#: Letters by case, digits and bytes beyond ASCII each become one sign; marks stay as they are.
_SIGNS = bytes(97 if chr(c).islower() and c < 128 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def _hashes(word: bytes) -> tuple[int, int]:
    """Of a word as it stands: the hash of it in lower case without marks at its ends, and that of its shape."""
    found = _CACHE.get(word)
    if found is None:
        if len(_CACHE) >= CACHE_WORDS:
            _CACHE.clear()
        low = word.lower()
        shape = _RUNS.sub(rb"\1", word.translate(_SIGNS))
        found = _CACHE[word] = xxhash.xxh64_intdigest(low.strip(b".,;:!?\"'()") or low, 7), xxhash.xxh64_intdigest(shape, 8)
    return found


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and weights: log-scaled counts of words, of neighbouring pairs and of shapes (runs of one
    kind of letter are one sign of it). Weights aren't divided by length, so a few telling words count alike in short
    and very long texts."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    known = _CACHE.get
    both = [known(w) or _hashes(w) for w in words]
    h, shapes = (np.fromiter(x, np.uint64, len(words)) for x in zip(*both, strict=True))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] >> np.uint64(3))
    found, counts = np.unique(np.concatenate([h, pairs, shapes]) >> np.uint64(64 - bits), return_counts=True)
    return found.astype(np.int64), 1 + np.log(counts)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending
    bits: int

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def likelihood(theta: np.ndarray, index: np.ndarray, value: np.ndarray, row: np.ndarray, y: np.ndarray, wide: int, prior: float) -> tuple[float, np.ndarray]:
    """The mean negative log posterior and its gradient. ``theta``: ``wide`` weights (normal, standard deviation
    ``prior``), the first threshold, and the gaps to the others before softplus; row ``row`` has ``value`` at ``index``."""
    n = len(y)
    w, base, raw = theta[:wide], theta[wide], theta[wide + 1 :]
    t = base + np.concatenate([[0], np.cumsum(np.logaddexp(0, raw))])
    score = np.bincount(row, value * w[index], n)
    tail = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -40, 40)))
    edge = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
    at = np.arange(n)
    p = np.maximum(edge[at, y] - edge[at, y + 1], 1e-12)
    slope = np.concatenate([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))], axis=1)
    up, down = slope[at, y] / p / n, slope[at, y + 1] / p / n
    d_t = np.zeros((n, len(t) + 2))
    d_t[at, y] += up
    d_t[at, y + 1] -= down
    d_t = d_t[:, 1:-1].sum(axis=0)
    d_w = np.bincount(index, value * (down - up)[row], wide) + w / (prior**2 * n)
    d_raw = [d_t[k:].sum() / (1 + np.exp(-raw[k - 1])) for k in range(1, len(t))]
    return float(-np.log(p).mean() + (w**2).sum() / (2 * prior**2 * n)), np.concatenate([d_w, [d_t.sum()], d_raw])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], bits: int = BITS, passes: int = PASSES, prior: float = PRIOR, least_docs: int = LEAST_DOCS) -> Model:
    """Full-batch Adam on the posterior; thresholds are kept ordered as a first one and positive gaps.

    Features of fewer than ``least_docs`` rows keep weight zero: they would only learn single rows by heart. The prior
    keeps all others small unless many rows speak for them, at any number of rows.
    """
    y = np.asarray(grades, np.int64)
    top = int(y.max()) if len(y) else 0
    weights = np.zeros(1 << bits)
    if top == 0:
        return Model(weights, np.zeros(0), bits)
    sizes = np.array([len(i) for i, _ in rows])
    index, value, row = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.repeat(np.arange(len(rows)), sizes)
    common = (np.bincount(index, minlength=1 << bits) >= least_docs)[index]
    used, index = np.unique(index[common], return_inverse=True)
    value, row = value[common], row[common]
    share = np.array([((y >= k).sum() + 1) / (len(y) + 2) for k in range(1, top + 1)])
    start = np.log(1 / share - 1)
    theta = np.concatenate([np.zeros(len(used)), [start[0]], np.log(np.expm1(np.maximum(np.diff(start), 1e-3)))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, passes + 1):
        _, grad = likelihood(theta, index, value, row, y, len(used), prior)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.05 * (1 - step / (passes + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[used] = theta[: len(used)]
    return Model(weights, theta[len(used)] + np.concatenate([[0], np.cumsum(np.logaddexp(0, theta[len(used) + 1 :]))]), bits)


def train(df: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", bits: int = BITS, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows; ``graded`` has id_col and an integer grade from 0."""
    labels = graded.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{grade_col}`").cast("int").alias("_grade")).filter("_id is not null and _grade >= 0")
    picked = labels.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(max_rows)
    texts = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))

    def run(batches):
        for batch in batches:
            made = [features(t.as_py(), bits) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))], ["id", "grade", "i", "v"])

    # A label whose identifier several rows share speaks for the smallest of their texts.
    once = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_grade").agg(F.min("_text").alias("_text"))
    found = once.mapInArrow(trimmed(run), "id string, grade int, i array<int>, v array<float>").toArrow()
    order = np.argsort(found.column("id").to_numpy(zero_copy_only=False).astype(str), kind="stable")
    rows = [(np.asarray(found.column("i")[k].values, dtype=np.int64), np.asarray(found.column("v")[k].values, dtype=float)) for k in order.tolist()]
    return fit(rows, [found.column("grade")[k].as_py() for k in order.tolist()], bits)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", tail: int = 2, least: float = 0.5) -> DataFrame:
    """One row per input row: id_col, expected_grade, tail_probability of grade >= ``tail``, kept (it is at least ``least``)."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T.StructType.fromDDL("expected_grade double, tail_probability double, kept boolean").fields])
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches):
        weights, thresholds = shared.value
        own = Model(weights, thresholds, model.bits)
        for batch in batches:
            values = np.array([float((weights[i] * v).sum()) for i, v in (features(t.as_py(), own.bits) for t in batch.column(1))])
            tails = own.tails(values)
            chance = tails[:, tail - 1] if len(thresholds) >= tail else np.full(len(values), float(tail <= 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(chance), pa.array(chance >= least)], [id_col, "expected_grade", "tail_probability", "kept"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), schema)
