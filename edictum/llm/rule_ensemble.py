"""A quality classifier made of sparse rules over text statistics.

Statistics: counts of words, of distinct words and of byte classes of a whole text. Rules: the paths
of small gradient-boosted trees, each a conjunction of comparisons. Weights: logistic
regression with a lasso penalty over the rules' 0/1 values. The model is a short list of rules,
compiled into one Spark column over the statistics; labels, language, source and id are no
part of it. It is fitted on the driver from statistics of at most ``max_rows`` labelled texts
(a sample by hash); scoring covers every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictum.llm.workspace import OWN, apart
from edictum.shipping import ship_package

#: Byte classes of UTF-8 text; their counts are the raw statistics.
CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "blank": b" \t\v\f\r", "line": b"\n",
    "stop": b".?!", "pause": b",;:", "symbol": b"#$%&*+/<=>@\\^_`{|}~", "quote": b"\"'()[]-", "lead": bytes(range(0xC2, 0xF5)),
}
RAW = ("bytes", "words", "distinct", *CLASSES)
#: Longest pieces of a text that are counted at once.
STRIDE = 1 << 22


_CLASS = np.array([[b in members for members in CLASSES.values()] for b in range(256)], dtype=np.int64)


def raw_statistics(texts: pa.Array) -> np.ndarray:
    """A row of RAW counts for each text; null counts as empty."""
    out = np.zeros((len(texts), len(RAW)), dtype=np.int64)
    for row, text in zip(out, texts.cast(pa.large_binary()).to_pylist()):
        if text:
            words = text.split()
            row[:3] = len(text), len(words), len(set(words))
            for at in range(0, len(text), STRIDE):
                row[3:] += np.bincount(np.frombuffer(text, np.uint8, min(STRIDE, len(text) - at), at), minlength=256) @ _CLASS
    return out


def statistics_column(text: Column | str) -> Column:
    """The RAW counts as a struct column."""

    @F.arrow_udf(", ".join(f"{n} bigint" for n in RAW))
    def of(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in raw_statistics(texts).T], list(RAW))

    return of(text)


#: Features: (name, numerator, denominator); 1 is added to denominators.
RATIOS = [(f"{n}_share", n, "bytes") for n in CLASSES] + [("word_length", "bytes", "words"), ("line_words", "words", "line"), ("stop_words", "words", "stop"), ("symbol_words", "symbol", "words"), ("upper_lower", "upper", "lower"), ("distinct_share", "distinct", "words")]
FEATURES = ["words", *(n for n, _, _ in RATIOS)]


def feature_matrix(raw: np.ndarray) -> np.ndarray:
    """Features of rows of RAW counts."""
    x = raw.astype(np.float64)
    at = {n: i for i, n in enumerate(RAW)}
    return np.stack([x[:, at["words"]], *(x[:, at[a]] / (x[:, at[b]] + 1) for _, a, b in RATIOS)], axis=1)


def feature_columns(stats: str) -> dict[str, Column]:
    """The same features over a struct column of RAW counts."""
    f = lambda n: F.col(f"{stats}.{n}").cast("double")
    return {"words": f("words")} | {n: f(a) / (f(b) + 1) for n, a, b in RATIOS}


@dataclass(frozen=True)
class Test:
    """A comparison: feature <= at, or > at."""

    feature: int
    at: float
    above: bool


@dataclass(frozen=True)
class Model:
    """Score: logistic of ``bias`` plus the weights of the rules that hold."""

    bias: float
    rules: tuple[tuple[tuple[Test, ...], float], ...]

    def column(self, features: dict[str, Column]) -> Column:
        """The score as a Spark column."""
        cols = [features[n] for n in FEATURES]
        one = lambda t: cols[t.feature] > t.at if t.above else cols[t.feature] <= t.at
        total = reduce(lambda a, b: a + b, [F.when(reduce(lambda a, b: a & b, map(one, tests)), F.lit(w)).otherwise(F.lit(0.0)) for tests, w in self.rules], F.lit(self.bias))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same score of rows of features."""
        return 1 / (1 + np.exp(-(self.bias + sum((w * holds(tests, x) for tests, w in self.rules), np.zeros(len(x))))))


def holds(tests: tuple[Test, ...], x: np.ndarray) -> np.ndarray:
    """Where all comparisons hold."""
    out = np.ones(len(x), dtype=bool)
    for t in tests:
        out &= (x[:, t.feature] > t.at) == t.above
    return out


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: tuple[Test, ...], least: int, found: dict, value: np.ndarray) -> None:
    """Grow one tree by the best gain over binned features; every node but the root is a rule."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    value[rows] = -g / (h + 1.0)
    if path:
        found.setdefault(path)
    if depth == 0 or len(rows) < 2 * least:
        return
    best = (1e-6, None, None)
    for j, e in enumerate(edges):
        if not len(e):
            continue
        b = bins[rows, j]
        gs, hs, ns = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (gradient[rows], hessian[rows], np.ones(len(rows))))
        gain = np.where((ns >= least) & (len(rows) - ns >= least), gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
        if gain.max() > best[0]:
            best = (gain.max(), j, int(gain.argmax()))
    _, j, k = best
    if j is None:
        return
    for above in (False, True):
        _grow(x, bins, edges, gradient, hessian, rows[(bins[rows, j] > k) == above], depth - 1, (*path, Test(j, float(edges[j][k]), above)), least, found, value)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-3, rounds: int = 400) -> Model:
    """Fit to rows of features and labels 0 or 1. Without rows, or with one label only, the score is constant."""
    n = len(y)
    if not n or y.min() == y.max():
        rate = (y.sum() + 1) / (n + 2) if n else 0.5
        return Model(float(np.log(rate / (1 - rate))), ())
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)  # bin k holds values up to edge k
    found: dict[tuple[Test, ...], None] = {}
    f = np.full(n, np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p, value = 1 / (1 + np.exp(-f)), np.zeros(n)
        _grow(x, bins, edges, p - y, p * (1 - p), np.arange(n), depth, (), max(5, n // 500), found, value)
        f += 0.3 * value
    rules = list(found)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((n, 0))
    center = z.mean(axis=0)
    zc = z - center
    w = v = np.zeros(len(rules))
    b = np.log(y.mean() / (1 - y.mean()))
    step, t = 4 * n / max(np.linalg.norm(zc, 2) ** 2, 1e-9) if rules else 1.0, 1.0
    for _ in range(rounds):  # accelerated proximal gradient; the bias is not penalised
        r = 1 / (1 + np.exp(-(zc @ v + b))) - y
        b -= 4 * r.mean()
        u = v - step * (zc.T @ r) / n
        u = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = u + (t - 1) / t2 * (u - w), u, t2
    kept = [i for i in range(len(rules)) if w[i]]
    return Model(float(b - center @ w), tuple((rules[i], float(w[i])) for i in kept))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of doc_id as text, modulo 4, is 2; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000) -> Model:
    """Fit on at most ``max_rows`` labelled documents, the least by a hash of their doc_id.

    Labels other than 0 and 1 and rows without doc_id are ignored; of several labels of a
    document the more frequent counts, of ties 0; of several texts, that of the least hash, so
    that a model follows from its tables. Labels of documents that aren't there are ignored, and
    null texts are learnt from as empty ones. Only statistics reach the driver.
    """
    ship_package(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.avg(label_col) > 0.5).cast("int").alias("__label"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text").join(F.broadcast(sample), F.col("__doc") == F.col("__id"))
    stats = texts.select("__id", "__label", F.xxhash64("text").alias("__h"), statistics_column("text").alias("s"))
    got = stats.groupBy("__id", "__label").agg(F.min_by("s", "__h").alias("s")).select("__id", "__label", "s.*").toArrow()
    got = got.sort_by("__id")
    raw = np.stack([got[n].to_numpy() for n in RAW], axis=1) if got.num_rows else np.zeros((0, len(RAW)), dtype=np.int64)
    return fit(feature_matrix(raw), got["__label"].to_numpy().astype(np.float64))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; null texts are scored as empty ones. A column named as the score is replaced."""
    ship_package(docs.sparkSession)
    stats = apart(docs).select(OWN, statistics_column(F.col(f"{OWN}.`{text_col}`")).alias("stats"))
    score = model.column(feature_columns("stats")).alias(score_col)
    return stats.select(*(score if c == score_col else F.col(f"{OWN}.`{c}`") for c in docs.columns), *([] if score_col in docs.columns else [score]))
