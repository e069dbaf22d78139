"""Quality classifier: a generalised additive model with pairwise terms, fitted by cyclic boosting of shallow trees."""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table, tune

#: Labelled rows that a fit uses at most: those with the least md5 of their id.
MAX_ROWS = 20_000
THRESHOLD, FOLDS = 0.3, 5
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAF = 150, 60, 0.1, 20

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "exclaims", "bars", "points", "spaces", "breaks", "high",
    "distinct_words", "repeats", "distinct_lines", "entropy", "longest_word",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([
    _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"*#$%&@^~<>{}[]\\_=+"), _class(b"!?"), _class(b"|/"), _class(b".,;:'\"()-"),
    _class(SPACES), _class(b"\n"), _class(bytes(range(128, 256))),
])


def features(texts: list[str | None]) -> np.ndarray:
    """One row a text, from its whole bytes, words and lines; null counts as empty, whose features are all 0."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, t in zip(out, texts, strict=True):
        if not t:
            continue
        raw = t.encode("utf-8", "surrogatepass")
        n = len(raw)
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        share = counts[counts > 0] / n
        words, lines = raw.split(), raw.split(b"\n")
        k = max(1, len(words))
        row[0], row[1], row[2] = np.log1p(n), np.log1p(len(words)), n / k
        row[3:12] = _CLASSES @ counts / n
        row[12] = len(set(words)) / k
        row[13] = sum(map(operator.eq, words, words[1:])) / k
        row[14] = len(set(lines)) / len(lines)
        row[15] = -(share * np.log2(share)).sum()
        row[16] = max(map(len, words), default=0)
    return np.round(out, 9)


class AdditiveModel:
    """Sum of one lookup table a feature and one a chosen pair; a row's score is the logistic of the sum of its bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.cuts = [self._cuts(c, BINS) for c in x.T] if len(x) else [np.zeros(0)] * len(FEATURES)
        self.coarse = [self._cuts(c, PAIR_BINS) for c in x.T] if len(x) else [np.zeros(0)] * len(FEATURES)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        p = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        self.base = np.log(p / (1 - p))
        if len(y):
            self._fit(x, y)

    @staticmethod
    def _cuts(c: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(c, np.arange(1, n) / n, method="higher"))

    def _bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(cuts, x.T, strict=True)]

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        fine, f = self._bins(x, self.cuts), np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j, b in enumerate(fine):
                p = 1 / (1 + np.exp(-f))
                step = self._tree(np.bincount(b, y - p, len(self.tables[j])), np.bincount(b, p * (1 - p), len(self.tables[j])), np.bincount(b, minlength=len(self.tables[j])))
                self.tables[j] += step
                f += step[b]
        coarse = self._bins(x, self.coarse)
        p = 1 / (1 + np.exp(-f))
        gains = []
        for i in range(len(coarse)):
            for j in range(i + 1, len(coarse)):
                gains.append((-self._quarter(coarse[i], coarse[j], self._shape(i, j), y - p, p * (1 - p))[1], i, j))
        self.pairs = [(i, j, np.zeros(self._shape(i, j))) for g, i, j in sorted(gains)[:PAIRS] if g < 0]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in self.pairs:
                p = 1 / (1 + np.exp(-f))
                step, _ = self._quarter(coarse[i], coarse[j], t.shape, y - p, p * (1 - p))
                t += step
                f += step[coarse[i], coarse[j]]

    def _shape(self, i: int, j: int) -> tuple[int, int]:
        return len(self.coarse[i]) + 1, len(self.coarse[j]) + 1

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Steps of a tree of up to three leaves over bins: the best cut, then the better cut of a side."""
        edges = [0, len(g)]
        for _ in range(2):
            best = (1e-9, None)
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a < 2:
                    continue
                cg, ch, cn = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
                gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
                gain[(cn[:-1] < LEAF) | (cn[-1] - cn[:-1] < LEAF)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], a + k + 1)
            if best[1] is None:
                break
            edges = sorted([*edges, best[1]])
        out = np.zeros(len(g))
        if len(edges) > 2:
            for a, b in zip(edges, edges[1:], strict=False):
                out[a:b] = RATE * g[a:b].sum() / (h[a:b].sum() + 1)
        return out

    @staticmethod
    def _quarter(a: np.ndarray, b: np.ndarray, shape: tuple[int, int], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """Steps of the best tree with one cut of either feature, and its gain."""
        flat = a * shape[1] + b
        cg, ch, cn = (np.bincount(flat, w, shape[0] * shape[1]).reshape(shape).cumsum(0).cumsum(1) for w in (g, h, np.ones(len(g))))
        out = np.zeros(shape)
        if min(shape) < 2:
            return out, 0.0

        def parts(c: np.ndarray) -> list[np.ndarray]:
            tl = c[:-1, :-1]
            tr, bl = c[:-1, -1:] - tl, c[-1:, :-1] - tl
            return [tl, tr, bl, c[-1, -1] - tl - tr - bl]

        gs, hs, ns = parts(cg), parts(ch), parts(cn)
        gain = sum(x**2 / (y + 1) for x, y in zip(gs, hs, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
        gain = np.where(np.minimum.reduce(ns) >= LEAF, gain, 0)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[i, j] <= 1e-9:
            return out, 0.0
        v = [RATE * x[i, j] / (y[i, j] + 1) for x, y in zip(gs, hs, strict=True)]
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
        return out, float(gain[i, j])

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for t, b in zip(self.tables, self._bins(x, self.cuts), strict=True):
            f += t[b]
        coarse = self._bins(x, self.coarse)
        for i, j, t in self.pairs:
            f += t[coarse[i], coarse[j]]
        return np.round(1 / (1 + np.exp(-f)), 9)


def held_out(id_col) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 5. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Learns from the labelled rows that aren't held out, max_rows of them at most (those with the least md5 of the id).

    Null labels and null ids are left out; an id with several labels takes the least, one with several texts the least
    features. Without labelled rows every score is 0.5; with one class alone it is near that class.
    """
    spark = docs.sparkSession
    some = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("i")))
    some = some.groupBy("i").agg(F.min("y").alias("y")).orderBy(F.md5(F.col("i").cast("string").cast("binary")), "i").limit(max_rows)
    # At most max_rows ids and labels, by construction.
    picked = spark.createDataFrame(some.collect(), some.schema)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(picked), "i").select("i", "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["i", "y", "x"])

    found = texts.mapInArrow(run, f"i {dict(docs.dtypes)[id_col]}, y int, x array<double>").groupBy("i").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect()
    found.sort(key=lambda r: str(r["i"]))
    return AdditiveModel(np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["y"] > 0 for r in found], float))


def score_quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score of every row; null texts score as empty ones. Rows stay one to one, repeated rows included."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(features(b.column(1).to_pylist())), pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, score double")


def keep_quality(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns, whatever their names.

    Null texts are judged as empty ones; repeated rows share their fate; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(features(b.column(at).to_pylist())) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
