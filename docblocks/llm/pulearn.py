"""Op 1: quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network by the non-negative risk: with class
prior p, positives P and unlabelled U, the risk is
p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)]), l being the logistic loss, so that sigmoid(g) is
a probability. The prior is estimated first: a classifier of P against U orders texts, and p is the
least ratio of U's to P's share above any cut, with a margin for chance.

Features are measures of the text alone: shares of kinds of characters, word lengths, repeats of
words, word runs and lines. They are computed on the executors over whole texts.

Training uses bounded samples, MAX_POSITIVE and MAX_UNLABELLED rows, the first by a hash of the id;
rows of other labels are not used. Scoring covers every row.

Results for odd inputs: null and empty texts have all features 0 and get the score of that point;
without any positive, every score is 0.5; ties and repeated rows score alike; of rows that share an
id, the sample takes one; an empty table gives no rows; further columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import IS_SPACE, U64, Words, chunks, gram_hashes, mix, repeats, sums_by_row
from .lines import line_spans
from .tables import unused

MAX_POSITIVE = 6000
MAX_UNLABELLED = 12000
HIDDEN = 16
EPOCHS = 400
#: Punctuation counted one by one (fixed values); any other is counted together.
MARKS = b"!?.,;:|#$%&*<>(){}[]\"'/\\=+-_@~^`"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(MARKS)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_PROSE = np.zeros(256, dtype=bool)
_PROSE[list(b".,;:")] = True
_LOUD = np.zeros(256, dtype=bool)
_LOUD[list(b"!?")] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of measures for each text."""
    rows = len(offsets) - 1
    words = Words(data, offsets, lower=True)
    n = np.diff(words.first).astype(float)
    solid = np.maximum(sums_by_row(~IS_SPACE[data], offsets), 1).astype(float)
    some = np.maximum(n, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return sums_by_row(mask[data], offsets) / solid

    lengths = (words.ends - words.starts).astype(float)
    by_row = lambda mask: np.bincount(words.row[mask], minlength=rows) / some
    hashes = words.hashes()
    keyed = hashes ^ mix(words.row.astype(U64))
    distinct = np.bincount(words.row[np.unique(keyed, return_index=True)[1]], minlength=rows)
    same_row = words.row[1:] == words.row[:-1]
    doubled = np.append(False, (hashes[1:] == hashes[:-1]) & same_row)
    k = 4
    grams = gram_hashes(hashes, k)
    whole = np.flatnonzero(words.row[: len(grams)] == words.row[k - 1 :])
    again = whole[repeats(grams[whole] ^ mix(words.row[whole].astype(U64)))]
    row, _, _, count, line_hash = line_spans(data, offsets, words)
    n_lines = np.bincount(row, minlength=rows)
    kept = np.bincount(row[np.unique(line_hash ^ mix(row.astype(U64)), return_index=True)[1]], minlength=rows)
    ends = data[words.ends - 1] if len(words) else data[:0]
    begins = data[words.starts] if len(words) else data[:0]
    out = np.column_stack(
        [
            np.log1p(n),
            share(_SYMBOL),
            share(_PROSE),
            share(_LOUD),
            share(_SYMBOL & ~_PROSE & ~_LOUD),
            share(_UPPER),
            share(_DIGIT),
            solid / some,
            by_row(lengths <= 1),
            by_row(lengths >= 12),
            by_row(_SYMBOL[ends] & ~_PROSE[ends]),
            by_row(_PROSE[ends]),
            by_row(_UPPER[begins]),
            by_row(_SYMBOL[begins]),
            distinct / some,
            np.log1p(distinct) / np.maximum(np.log1p(n), 1),
            by_row(doubled),
            np.bincount(words.row[again], minlength=rows) / some,
            1 - kept / np.maximum(n_lines, 1),
            np.log1p(n / np.maximum(n_lines, 1)),
        ]
    )
    out[n == 0] = 0
    return out


N_FEATURES = 20


@dataclass
class Network:
    """Standardisation, one hidden layer and an output; ``prior`` is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _train(net: Network, steps: int, slope) -> None:
    """Adam on the slopes that ``slope(logits)`` gives for stacked rows."""
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z = slope.rows
    for t in range(1, steps + 1):
        hidden = np.tanh(z @ params[0] + params[1])
        d = slope(hidden @ params[2] + params[3][0])
        back = np.outer(d, params[2]) * (1 - hidden * hidden)
        grads = [z.T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ d + 1e-4 * params[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] -= 0.02 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(params[3][0])


class _NonNegativeRisk:
    """Slopes of the non-negative risk over positives then unlabelled rows."""

    def __init__(self, p: np.ndarray, u: np.ndarray, prior: float):
        self.rows, self.n, self.m, self.prior = np.vstack([p, u]), len(p), len(u), prior

    def __call__(self, g: np.ndarray) -> np.ndarray:
        gp, gu = g[: self.n], g[self.n :]
        d = np.empty_like(g)
        negative = np.logaddexp(0, gu).mean() - self.prior * np.logaddexp(0, gp).mean()
        if negative >= 0:
            d[: self.n] = self.prior * (_sigmoid(gp) - 1 - _sigmoid(gp)) / self.n
            d[self.n :] = _sigmoid(gu) / self.m
        else:  # step back out of the part that overfits
            d[: self.n] = self.prior * _sigmoid(gp) / self.n
            d[self.n :] = -_sigmoid(gu) / self.m
        return d


class _Against:
    """Slopes of plain logistic loss, positives against unlabelled, each half the weight."""

    def __init__(self, p: np.ndarray, u: np.ndarray):
        self.rows, self.n, self.m = np.vstack([p, u]), len(p), len(u)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        d = _sigmoid(g)
        d[: self.n] = (d[: self.n] - 1) / (2 * self.n)
        d[self.n :] /= 2 * self.m
        return d


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of shares above a cut: U holds at least that part of whatever P holds."""
    cuts = np.quantile(positive, np.linspace(0, 0.4, 81))
    fp = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    fu = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    margin = 0.3 * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    return float(np.clip(np.min((fu + margin * np.sqrt(fu * (1 - fu))) / np.maximum(fp - margin * np.sqrt(fp * (1 - fp)), 1e-3)), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    positive, unlabelled = rng.permutation(positive), rng.permutation(unlabelled)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    z = lambda x: np.clip((x - mean) / scale, -8, 8)
    p, u = z(positive), z(unlabelled)

    def fresh() -> Network:
        return Network(mean, scale, rng.normal(0, 0.4, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0, 0.5)

    guesses = []
    for fold in (0, 1):  # judged on the other half, so that what is learnt by heart doesn't count
        first = fresh()
        _train(first, EPOCHS // 2, _Against(p[fold::2], u[fold::2]))
        other = 1 - fold
        if len(p) > 1 and len(u) > 1:
            guesses.append(estimate_prior(first.logit(positive[other::2]), first.logit(unlabelled[other::2])))
    prior = float(np.mean(guesses)) if guesses else 0.5
    net = fresh()
    net.prior = prior
    _train(net, EPOCHS, _NonNegativeRisk(p, u, prior))
    return net


def _featured(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in chunks(batch.column(batch.num_columns - 1)):
                x = features(data, at)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([c.slice(first, end - first) for c in batch.columns[:-1]] + [lists], [*batch.schema.names[:-1], "__x"])

    return source.mapInArrow(run, f"{schema}, __x array<double>")


def first_ids(frame: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most ``n`` distinct ids, the first by a hash: the bounded sample that training sees."""
    ids = frame.select(F.col(id_col).alias("__id")).where("__id is not null")
    return ids.orderBy(F.xxhash64("__id", F.lit("sample")), "__id").limit(n).distinct()


def train(docs: DataFrame, positives: DataFrame, unlabelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Network | None:
    """Fit on bounded samples; ``positives`` and ``unlabelled`` hold ids of ``docs``. None without positives."""
    chosen = first_ids(positives, id_col, max_positive).withColumn("__p", F.lit(True))
    others = first_ids(unlabelled, id_col, max_unlabelled).withColumn("__u", F.lit(True))
    wanted = chosen.join(others, "__id", "full")
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    rows = _featured(texts.join(F.broadcast(wanted), F.col("__doc") == F.col("__id")), "__text", ["__id", "__p", "__u"])
    rows = rows.groupBy("__id").agg(F.min("__x").alias("__x"), F.first("__p").alias("__p"), F.first("__u").alias("__u")).orderBy("__id").collect()  # a row an id: bounded
    p = np.array([r["__x"] for r in rows if r["__p"]])
    u = np.array([r["__x"] for r in rows if r["__u"]])
    return fit(p, u) if len(p) and len(u) else None


def score(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, then score (with underscores behind where that name is taken)."""
    name = unused("score", docs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {name} double"
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in chunks(batch.column(where)):
                found = net.score(features(data, at)) if net else np.full(end - first, 0.5)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def auc(label: np.ndarray, value: np.ndarray) -> float:
    """Area under the curve, ties counted half."""
    order = np.argsort(value, kind="stable")
    _, inverse, count = np.unique(value[order], return_inverse=True, return_counts=True)
    mean_rank = np.cumsum(count) - (count - 1) / 2
    ranks = np.empty(len(value))
    ranks[order] = mean_rank[inverse]
    pos = label.astype(bool)
    n, m = pos.sum(), (~pos).sum()
    return float((ranks[pos].sum() - n * (n + 1) / 2) / (n * m)) if n and m else float("nan")


__all__ = ["Network", "auc", "estimate_prior", "features", "fit", "score", "train"]
