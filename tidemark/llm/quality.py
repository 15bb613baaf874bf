"""Quality classifier by positive-unlabelled learning.

Trusted positives are the rows labelled 1 in the training folds; unlabelled are rows of
the corpus as it is, whatever their labels.  Rows labelled 0 are never used as such.

The class prior (share of positives among the unlabelled) is estimated first: a
logistic model tells positives from unlabelled, and the prior is the smallest ratio of
the unlabelled to the positive share above any of its thresholds that at
least two fifths of the positives reach.  The smallest errs to the low side, which lowers
scores of positives a little; a prior that is too large would leave negatives undecided.  Then a small network is fitted that minimises the non-negative
unbiased risk  prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])  with logistic loss; where the
second term falls below zero its gradient is reversed.
"""

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import feature_rows, fold, marked, scored, smallest, training_labels

#: Bounds of the fit's samples of labelled positives and of unlabelled rows.
POSITIVES, UNLABELLED = 8000, 8000

_SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()\-]+")
_WIDTH = 19


def features(t: str) -> list[float]:
    """Dense features of a text in any language; of no words, zeros."""
    w = t.split()
    n = len(w)
    if not n:
        return [0.0] * _WIDTH
    counts = Counter(w)
    chars = len(t)
    letters = marked(str.isalpha)(t)
    upper = sum(map(str.isupper, w))
    repeats = sum(a == b for a, b in zip(w, w[1:]))
    thirds = list(zip(w, w[1:], w[2:]))
    lines = [x for x in t.split("\n") if x.strip()]
    runs = _SYMBOLS.findall(t)
    odd = sum(map(len, runs))
    bangs = t.count("!")
    return [
        np.log1p(n),
        chars / n / 10,
        len(counts) / n,
        np.log1p(n) * len(counts) / n,
        max(counts.values()) / n,
        repeats / n,
        np.log1p(repeats),
        1 - len(set(thirds)) / len(thirds) if thirds else 0.0,
        1 - len(set(lines)) / len(lines),
        odd / chars,
        len(runs) / n,
        np.log1p(len(runs)),
        t.count("|") / n,
        bangs / n,
        upper / n,
        letters / chars,
        sum(map(t.count, "0123456789")) / chars,
        (t.count(".") + t.count(",")) / n,
        t.count("http") / n,
    ]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(p: np.ndarray, u: np.ndarray, least: float = 0.4) -> float:
    """The share of positives among u: the smallest U/P ratio of tail shares, over the scores of both."""
    cuts = np.quantile(p, np.linspace(0, 1 - least, 91))
    above_p = 1 - np.searchsorted(np.sort(p), cuts, side="left") / len(p)
    above_u = 1 - np.searchsorted(np.sort(u), cuts, side="left") / len(u)
    return float(np.clip(np.min(above_u / above_p), 0.02, 0.98))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    layers: list
    prior: float

    def score(self, texts: list) -> np.ndarray:
        if not len(self.layers):
            return np.full(len(texts), self.prior)
        x = np.clip((np.array([features(t) for t in texts]) - self.mean) / self.scale, -8, 8)
        a, b, c, d = self.layers
        h = np.tanh((x[:, :, None] * a).sum(axis=1) + b)  # summed row by row: a matrix product's last digits depend on how many rows it has
        return _sigmoid((h * c).sum(axis=1) + d)


def _forward(x, layers):
    a, b, c, d = layers
    h = np.tanh(x @ a + b)
    return h, h @ c + d


def fit(p: np.ndarray, u: np.ndarray, hidden: int = 12, steps: int = 400, rate: float = 0.03, seed: int = 7) -> QualityModel:
    """Fit to the features of positives and of unlabelled rows; with neither, a constant model."""
    if not len(p) or not len(u):
        return QualityModel(np.zeros(0), np.ones(0), [], 0.5)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    w = np.zeros(p.shape[1] + 1)
    x = np.hstack([np.vstack([p, u]), np.ones((len(p) + len(u), 1))])
    y = np.r_[np.ones(len(p)), np.zeros(len(u))]
    for _ in range(200):
        w -= 0.5 * (x.T @ (_sigmoid(x @ w) - y) / len(x) + 1e-3 * w)
    z = x @ w
    prior = class_prior(z[: len(p)], z[len(p) :])
    rng = np.random.default_rng(seed)
    layers = [rng.normal(size=(p.shape[1], hidden)) / np.sqrt(p.shape[1]), np.zeros(hidden), rng.normal(size=hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in layers], [np.zeros_like(q) for q in layers]
    both = np.vstack([p, u])
    n = len(p)
    for step in range(1, steps + 1):
        h, f = _forward(both, layers)
        s = _sigmoid(f)
        negative = np.logaddexp(0, f[n:]).mean() - prior * np.logaddexp(0, f[:n]).mean()
        if negative >= 0:
            g = np.r_[prior * (s[:n] - 1) / n - prior * s[:n] / n, s[n:] / len(u)]
        else:
            g = np.r_[prior * s[:n] / n, -s[n:] / len(u)]
        back = np.outer(g, layers[2]) * (1 - h * h)
        grads = [both.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])]
        for k, (q, d) in enumerate(zip(layers, grads)):
            d = d + 1e-4 * q
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            q -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, layers, prior)


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 11) -> QualityModel:
    """Fit on at most so many labelled positives of the training folds and so many unlabelled rows.

    Rows with equal ids and texts count once.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    trusted = smallest(training_labels(labels, id, label, 1), id, seed, positives).select(F.col(id).alias("id"))
    trusted = smallest(rows.join(F.broadcast(trusted), "id", "left_semi"), "id", seed, positives, "text")
    p = feature_rows(trusted, "text", features, []).collect()
    u = feature_rows(smallest(rows, "id", seed + 1, unlabelled, "text"), "text", features, []).collect()
    return fit(*(np.array([r.x for r in x], float).reshape(len(x), _WIDTH) for x in (p, u)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id: str = "doc_id", text: str = "text", label: str = "quality", **bounds) -> DataFrame:
    """docs' columns and held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    The score depends on the text alone.  Null and empty texts count as texts without
    words and get a score too; without labels or rows to learn from every score is 0.5.
    An id with differing labels is no positive.  Rows may repeat.  An empty table gives an empty
    result.
    """
    model = learn(docs, labels, id, text, label, **bounds)
    added = {"held_out": fold(id) == 0, "score": scored(docs, text, model.score)}
    return docs.withColumns(added).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with docs' columns."""
    model = learn(docs, labels, id, text, **bounds)
    return docs.where(scored(docs, text, model.score) >= threshold)
