"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from the training folds: whole words and word beginnings that
mark toxic texts (the lower bound of smoothed log-odds of document frequency, near copies
of a text counting once).  Features of a text are the
densities and counts of lexicon words by strength, of words that are lexicon
words only once disguises (digits and signs for letters, letters set apart) are undone, second-person
words and lexicon words near them, capitals, punctuation and obfuscation rates.  Trees
are boosted on logistic loss; their sums are calibrated on a fold that they have
not seen, by pooling adjacent violators.
"""

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import feature_rows, fold, marked, scored, smallest, training_labels
from .common import checkpointed

#: Bounds of the fit's sample: labelled rows of each class in the training folds.
ROWS_OF_A_CLASS = 6000
#: Bound of the lexicon.
LEXICON = 2000

# Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch euer ihr sie tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split())
# Signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "_": "", "-": "", "+": "t"})

_WORD = re.compile(r"[^\W\d_]+")
_DISGUISED = re.compile(r"[^\W\d_][@$*!+_.\-0-9]+[^\W\d_]")
_APART = re.compile(r"\b(?:[^\W\d_][ .\-*_]){3,}[^\W\d_]\b")
_PREFIXES = (4, 5, 6)
_WIDTH = 20


def terms(word: str) -> list[str]:
    """The word and its beginnings (marked by a star)."""
    return [word] + [word[:k] + "*" for k in _PREFIXES if len(word) > k]


def sketch(t: str) -> int:
    """Smallest hash of four words in a row; near copies of a text mostly share it."""
    w = t.lower().split()
    return min((zlib.crc32(" ".join(w[i : i + 4]).encode()) for i in range(max(1, len(w) - 3))), default=0)


def words_of(t: str) -> list[str]:
    return _WORD.findall(t.lower())


class Strengths(dict):
    """Words and the largest log-odds of their terms, remembered."""

    def __init__(self, lexicon: dict):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = s = max((self.lexicon.get(x, 0.0) for x in terms(word)), default=0.0)
        return s


class Features:
    """Turns a text into numbers, given the log-odds of lexicon terms."""

    def __init__(self, lexicon: dict):
        self.lexicon, self.known = lexicon, Strengths(lexicon)

    def __reduce__(self):
        return Features, (self.lexicon,)

    def __call__(self, t: str) -> list[float]:
        low = t.lower()
        w = _WORD.findall(low)
        n = len(w)
        if not n:
            return [0.0] * _WIDTH
        strength = self.known.__getitem__
        s = list(map(strength, w))
        hits = [i for i, x in enumerate(s) if x > 0]
        strong = sum(x > 3 for x in s)
        second = [i for i, x in enumerate(w) if x in SECOND_PERSON]
        near = 0
        if hits and second:
            at = np.searchsorted(second, hits)
            gaps = [min([abs(second[k] - h) for k in (a - 1, a) if 0 <= k < len(second)]) for a, h in zip(at, hits)]
            near = sum(g <= 5 for g in gaps)
        disguised = [x for x in low.split() if not x.isalpha() and _DISGUISED.search(x)]
        apart = _APART.findall(low)
        undone = [_WORD.findall(x.translate(LEET)) for x in disguised] + [["".join(_WORD.findall(x))] for x in apart]
        veiled = max((strength(y) for x in undone for y in x), default=0.0)
        chars, raw = len(t), t.split()
        upper = sum(map(str.isupper, raw))
        bangs, asks = t.count("!"), t.count("?")
        return [
            len(hits) / n,
            np.log1p(len(hits)),
            strong / n,
            np.log1p(strong),
            max(s),
            sum(s) / n,
            sum(s) / len(hits) if hits else 0.0,
            len(second) / n,
            near / n,
            np.log1p(near),
            upper / len(raw),
            marked(str.isupper)(t) / chars,
            bangs / n,
            asks / n,
            (t.count("*") + t.count("#") + t.count("@")) / n,
            len(disguised) / n,
            len(apart) / n,
            veiled,
            np.log1p(n),
            sum(map(len, w)) / n,
        ]


def learn_lexicon(sample: DataFrame, most: int = LEXICON) -> dict:
    """At most `most` terms and their log-odds, less 1.64 standard errors, from sample (text, y).

    A term must stand in two toxic texts at least, and in one in a hundred; only such terms
    are counted in the other texts.  All counts are of texts, over the whole sample.
    """

    def count(known: frozenset | None):
        def run(batches):
            for x in batches:
                got: dict = {}
                for t in x.column("text").to_pylist():
                    found = {k for w in set(words_of(t or "")) for k in terms(w)}
                    for k in found if known is None else found & known:
                        got[k] = got.get(k, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["term", "n"])

        return run

    sums = lambda y, known: sample.where(F.col("y") == y).select("text").mapInArrow(count(known), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    once = F.pandas_udf(lambda t: t.map(lambda x: sketch(x or "")), "bigint")
    sample = checkpointed(sample.select("y", "text", once("text").alias("sketch")).dropDuplicates(["y", "sketch"]))
    some = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, mild = some.get(1, 0), some.get(0, 0)
    least = max(2, toxic // 100)
    bad = {r.term: r.n for r in sums(1, None).where(F.col("n") >= least).collect()}  # a few hundred terms a text, each in one text of a hundred: bounded
    good = {r.term: r.n for r in sums(0, frozenset(bad)).collect()} if mild else {}
    odds = {}
    for k, n in bad.items():
        a, b = n + 0.5, good.get(k, 0) + 0.5
        odds[k] = float(np.log(a / (toxic + 1)) - np.log(b / (mild + 1)) - 1.64 * np.sqrt(1 / a + 1 / b))
    top = sorted((k for k in odds if odds[k] > 0.5), key=lambda k: (-odds[k], k))[:most]
    return {k: odds[k] for k in top}


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 3.0):
    """(first score, trees); a tree is (features, cuts, leaves) of a complete binary tree."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    base = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
    score = np.full(len(y), np.log(base / (1 - base)))
    start, out, width = score[0], [], bins + 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        split, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            n = 2**level
            best = np.full(n, 1e-9)
            for f in range(x.shape[1]):
                k = node * width + binned[:, f]
                gs, hs, cs = (np.bincount(k, v, n * width).reshape(n, width).cumsum(axis=1) for v in (g, h, np.ones(len(y))))
                gl, hl, cl = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                gr, hr, cr = gs[:, -1:] - gl, hs[:, -1:] - hl, cs[:, -1:] - cl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                gain[(cl < least) | (cr < least)] = 0
                at = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(n), at] > best):
                    if at[i] < len(edges[f]):
                        best[i] = gain[i, at[i]]
                        split[n - 1 + i], cut[n - 1 + i] = f, edges[f][at[i]]
            here = n - 1 + node
            node = node * 2 + (x[np.arange(len(y)), split[here]] > cut[here])
        leaves = -np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + 1)
        leaves *= rate
        score = score + leaves[node]
        out.append((split, cut, leaves))
    return start, out


def tree_sums(x: np.ndarray, start: float, trees: list) -> np.ndarray:
    score, rows = np.full(len(x), start), np.arange(len(x))
    for split, cut, leaves in trees:
        node = np.zeros(len(x), np.int64)
        for level in range(int(np.log2(len(leaves)))):
            here = 2**level - 1 + node
            node = node * 2 + (x[rows, split[here]] > cut[here])
        score += leaves[node]
    return score


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, mean of y) of the weighted isotonic fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    u, k = np.unique(x[order], return_inverse=True)
    w = np.bincount(k, weight[order])
    v = np.bincount(k, (weight * y)[order]) / w
    pools: list = []
    for a, b, c in zip(u, v, w):
        pools.append([a, a, b, c])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            _, hi, m, n = pools.pop()
            p = pools[-1]
            pools[-1] = [p[0], hi, (p[2] * p[3] + m * n) / (p[3] + n), p[3] + n]
    xs = np.array([q for p in pools for q in ((p[0], p[1]) if p[1] > p[0] else (p[0],))])
    ys = np.array([q for p in pools for q in ((p[2], p[2]) if p[1] > p[0] else (p[2],))])
    return xs, ys


@dataclass
class ToxicityModel:
    lexicon: dict
    start: float
    trees: list
    knots: tuple

    def score(self, texts: list) -> np.ndarray:
        if getattr(self, "turn", None) is None:
            self.turn = Features(self.lexicon)
        z = tree_sums(np.array([self.turn(t) for t in texts]).reshape(len(texts), _WIDTH), self.start, self.trees)
        p = np.interp(z, *self.knots) if len(self.knots[0]) else 1 / (1 + np.exp(-z))
        return np.clip(0.98 * p + 0.02 / (1 + np.exp(-np.clip(z, -30, 30))), 0, 1)  # the calibrated steps keep the trees' order


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows_of_a_class: int = ROWS_OF_A_CLASS, seed: int = 13) -> ToxicityModel:
    """Fit on at most so many rows of each class of the training folds; rows with equal ids and texts count once.

    Trees are fitted on three of the four folds and calibrated on the other; rows are weighted
    so that both classes count as they do among all labelled rows of the training folds.
    """
    marked = training_labels(labels, id, label)
    counts = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [smallest(marked.where(F.col("y") == y), id, seed, rows_of_a_class) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1]).select(F.col(id).alias("id"), "y", (fold(id) == 1).alias("kept_back"))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id")
    rows = smallest(rows.where("y = 0"), "id", seed, rows_of_a_class, "text").unionByName(smallest(rows.where("y = 1"), "id", seed, rows_of_a_class, "text"))
    fitted = rows.where(~F.col("kept_back"))
    some = {r.y: r.n for r in fitted.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not some.get(0) or not some.get(1):
        return ToxicityModel({}, -3.0 if not some.get(1) else 3.0, [], (np.zeros(0), np.zeros(0)))
    lexicon = learn_lexicon(fitted)
    got = feature_rows(rows, "text", Features(lexicon), ["y", "kept_back"]).collect()
    x, y, back = np.array([r.x for r in got], float), np.array([r.y for r in got], float), np.array([r.kept_back for r in got])
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    weight /= weight.mean()
    start, trees = boost(x[~back], y[~back], weight[~back])
    cal = back if 0 < y[back].sum() < back.sum() else np.ones(len(y), bool)
    knots = isotonic(tree_sums(x[cal], start, trees), y[cal], weight[cal])
    return ToxicityModel(lexicon, start, trees, knots)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id: str = "doc_id", text: str = "text", label: str = "toxic", **bounds) -> DataFrame:
    """docs' columns and held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    The score depends on the text alone.  Null and empty texts count as texts without
    words and get a score too; with labels of one class only, or none, every score is the same.
    An id with differing labels counts as the smaller.  Rows may repeat.  An empty table gives an
    empty result.
    """
    model = learn(docs, labels, id, text, label, **bounds)
    added = {"held_out": fold(id) == 0, "score": scored(docs, text, model.score)}
    return docs.withColumns(added).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
