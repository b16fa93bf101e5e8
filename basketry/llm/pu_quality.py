"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; unlabelled web text is everything
without a label; labels 0 are never used.  With class prior q the model g
minimises the non-negative unbiased risk (Kiryo et al., 2017)

    q * E_P[l(g)] + max(0, E_U[l(-g)] - q * E_P[l(-g)])

with the logistic loss l, so sigmoid(g) grows with the chance of label 1; the
valley between the classes is then put at the accepting score.  The prior is
estimated from positives and unlabelled text alone: above any score lie at
least q times as large a share of the unlabelled texts as of the positives, and
just as large a share where no negative lies, so q is the least ratio of the
two shares (the slope at the end of the ROC curve), over positives that the
scoring model has not seen.  g is
linear in counts of byte classes, word repetition and word lengths (and their
square roots); the text's words, language, source and id are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .common import fold, text_slices, utf8

#: Bounds of the training sample: documents are taken by the order of a hash of their id.
MAX_POSITIVES, MAX_UNLABELLED = 4000, 8000
#: A document is accepted from this score on.
ACCEPT = 0.3

#: Byte classes that are counted: each punctuation mark, then kinds of letters, digits, space and line ends.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _classes() -> tuple[np.ndarray, int]:
    table = np.full(256, len(_MARKS) + 5, np.int64)  # bytes of letters beyond ASCII
    table[:0x20] = len(_MARKS) + 4
    table[0x20] = len(_MARKS) + 3
    table[ord("0") : ord("9") + 1] = len(_MARKS) + 2
    table[ord("a") : ord("z") + 1] = len(_MARKS) + 1
    table[ord("A") : ord("Z") + 1] = len(_MARKS)
    for i, b in enumerate(_MARKS):
        table[b] = i
    return table, len(_MARKS) + 6


_CLASS, N_CLASSES = _classes()
N_FEATURES = 2 * (N_CLASSES + 8)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of features per text; an empty text gives zeros."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    x = np.bincount(doc * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(size, 1)[:, None]
    starts, ends, owner = flat.word_bounds(data, off)
    h, _ = flat.word_hashes(data, off)
    words = np.bincount(owner, minlength=n)
    some = np.maximum(words, 1)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    length = ends - starts
    mean = np.bincount(owner, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) / some - mean**2, 0))
    first = np.searchsorted(owner, np.arange(n + 1))
    distinct, top, pairs = np.zeros(n), np.zeros(n), np.zeros(n)
    pair = flat.mix(h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1])
    for d in range(n):
        a, b = first[d], first[d + 1]
        if a < b:
            distinct[d], top[d] = _repeats(h[a:b])
            pairs[d] = _repeats(pair[a : b - 1])[0] if b - a > 1 else 1
    more = np.column_stack(
        [
            np.bincount(owner, again, n) / some,
            1 - distinct / some,
            # repetition that is more than a text of this length has anyway
            np.log1p(distinct) / np.log1p(some),
            top / some,
            1 - pairs / np.maximum(words - 1, 1),
            mean / 20,
            spread / 20,
            np.log1p(words) / 10,
        ]
    )
    more[words == 0] = 0
    x = np.hstack([x, more])
    return np.hstack([x, np.sqrt(np.maximum(x, 0))])


def _repeats(h: np.ndarray) -> tuple[int, int]:
    """Number of distinct values and of the most frequent one."""
    s = np.sort(h)
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
    return len(at) - 1, int(np.diff(at).max())


@dataclass
class Model:
    """Linear model over standardised features; ``prior`` is the estimated share of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


#: Positives that an estimate of the prior takes at least; shares of held-out positives that its ratios look at.
LEAST_POSITIVES, SHARES = 20, (0.3, 0.95)


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled rows; 0.5 where there are too few rows to tell."""
    if len(p) < LEAST_POSITIVES or not len(u):
        return 0.5
    found = []
    for own in (0, 1):  # half of the rows train, the others tell
        half, part = np.arange(len(p)) % 2 == own, np.arange(len(u)) % 2 == own
        if not part.any() or part.all():
            return 0.5
        m = _minimised(p[half], u[part], 0.5, rounds=200)
        seen, all_ = np.sort(m.margin(p[~half])), np.sort(m.margin(u[~part]))
        at = seen[(np.linspace(1 - SHARES[1], 1 - SHARES[0], 50) * len(seen)).astype(int)]
        positive = 1 - np.searchsorted(seen, at) / len(seen)
        ratio = (1 - np.searchsorted(all_, at) / len(all_)) / positive
        # the least of ten neighbours' means: a single ratio profits from chance
        found.append(float(np.convolve(ratio, np.full(10, 0.1), "valid").min()))
    return float(np.clip(np.mean(found), 0.01, 0.99))


def fit(p: np.ndarray, u: np.ndarray, prior: float | None = None) -> Model:
    """Minimise the non-negative PU risk; ``prior`` None: estimated.  Without positives or unlabelled rows the prior is the score."""
    prior = estimated_prior(p, u) if prior is None else float(np.clip(prior, 0.01, 0.99))
    if not len(p) or not len(u):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), float(np.log(prior / (1 - prior))), prior)
    m = _minimised(p, u, prior)
    return Model(m.mean, m.scale, m.weights, m.bias + _shift(m.margin(u), prior), prior)


def risk(w: np.ndarray, px: np.ndarray, ux: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk of weights ``w``: of positives as positives, and of negatives (below 0: the model fits noise)."""
    gp, gu = px @ w, ux @ w
    return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()


def _minimised(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative risk."""
    both = np.vstack([p, u])
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = 1.0
    px, ux = (np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))] for x in (p, u))
    w = np.zeros(px.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        sp, su = 1 / (1 + np.exp(-px @ w)), 1 / (1 + np.exp(-ux @ w))
        grad_negative = ux.T @ su / len(u) - prior * (px.T @ sp) / len(p)
        grad_positive = -prior * (px.T @ (1 - sp)) / len(p)
        # where the negative risk falls below 0, step back from it
        grad = grad_positive + grad_negative if risk(w, px, ux, prior)[1] >= 0 else -grad_negative
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def _shift(g: np.ndarray, prior: float, width: float = 0.05) -> float:
    """What moves the valley between the classes to the accepting score.

    The prior says which share of the unlabelled rows lies below it; the valley
    is the widest gap between neighbouring values within ``width`` of that rank.
    """
    g = np.sort(g)
    lo, hi = (int(np.clip((1 - prior + d) * len(g), 0, len(g) - 1)) for d in (-width, width))
    if hi <= lo:
        return 0.0
    at = lo + int(np.argmax(np.diff(g[lo : hi + 1])))
    return float(np.log(ACCEPT / (1 - ACCEPT)) - (g[at] + g[at + 1]) / 2)


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, held_out: int = 0, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on a bounded sample of the documents outside the held-out fold.

    ``labels`` has doc_id and quality (1, 0; other values and nulls count as
    unlabelled).  Without unlabelled documents the labelled ones, of either
    label, stand in as unlabelled.
    """
    learn = F.col("doc_id").isNotNull() & (fold("doc_id", mod) != held_out)
    marked = labels.where("quality in (0, 1)").where(learn).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = docs.where(learn).select("doc_id").distinct()
    positive = _sampled(own.join(marked.where("quality = 1"), "doc_id", "left_semi"), max_positives).withColumn("kind", F.lit(1))
    free = own.join(marked, "doc_id", "left_anti")
    if free.isEmpty():
        free = own
    unlabelled = _sampled(free, max_unlabelled).withColumn("kind", F.lit(0))
    sample = positive.unionByName(unlabelled)
    # at most max_positives + max_unlabelled ids
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole):
                x = features(*utf8(b.column(b.schema.get_field_index("text")))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("kind")), pa.array([r.tobytes() for r in x], pa.binary())], ["kind", "x"])

    got = rows.select("kind", "text").mapInArrow(run, "kind int, x binary").toArrow()
    kind = got.column("kind").to_numpy() if got.num_rows else np.zeros(0, int)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
    x = x[np.lexsort((*x.T[:2], kind))]
    kind = np.sort(kind)
    return fit(x[kind == 1], x[kind == 0])


def scored(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (null: empty); all other columns stay."""
    keep = [f for f in docs.schema.fields if f.name != to]
    schema = T.StructType([*keep, T.StructField(to, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in keep]
        for whole in batches:
            for b in text_slices(whole):
                s = model.score(features(*utf8(b.column(b.schema.get_field_index("text")))))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(s)], [*names, to])

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts are scored as texts without words; rows with a null
    doc_id are scored, count as not held out and never train; repeated rows
    score alike; an empty table gives no rows; other columns are left behind.
    """
    model = train(docs, labels)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with the columns of ``docs`` (whatever their names)."""
    to = "score"
    while to in docs.columns:
        to += "_"
    return scored(docs, train(docs, labels), to).where(F.col(to) >= ACCEPT).select(*[F.col(f"`{c}`") for c in docs.columns])
