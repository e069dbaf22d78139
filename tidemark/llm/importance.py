"""Importance resampling towards a target: documents are drawn by the likelihood ratio of hashed n-grams, by the Gumbel top-k rule."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact_rank, table, tune, written
from .crcs import BLANK, Words, joined, parts
from .sharding import _BYTES, _STEP

BUCKETS, LENGTH, SEED, SHARE, LEAST = 10_000, 3, 42, 5, 20
BLOCK, VOCABULARY, EDGES = 1 << 18, 400_000, 1024
#: A-Z to a-z; digits, letters and bytes from 128 stay; all other bytes part words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Grams:
    """Buckets of all runs of one to three words of texts, by CRCs that are composed from the words' own."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.vocabulary, self.buckets = Words(), buckets

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(row of each feature, its bucket, row of the words) for some 2^18 words at a time. Words after a cut know the two before it."""
        ids, rows, new, held = [], [], [], 0
        for row, text in enumerate(texts):
            tail = np.empty(0, np.int64)
            for words in parts(text.encode("utf-8", "surrogatepass").translate(_WORDS)) if text else ():
                found = np.concatenate([tail, self.vocabulary.numbers(words)])
                ids.append(found)
                rows.append(np.full(len(found), row))
                new.append(np.arange(len(found)) >= len(tail))
                tail, held = found[1 - LENGTH :], held + len(found)
                if held >= BLOCK:
                    yield self._features(ids, rows, new)
                    ids, rows, new, held = [], [], [], 0
                    if len(self.vocabulary) > VOCABULARY:
                        words = [self.vocabulary.words[k] for k in tail]
                        self.vocabulary = Words()
                        tail = self.vocabulary.numbers(words)
        if held:
            yield self._features(ids, rows, new)

    def _features(self, ids: list[np.ndarray], rows: list[np.ndarray], new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, row, fresh = np.concatenate(ids), np.concatenate(rows), np.concatenate(new)
        word, size = self.vocabulary.crcs()[w], self.vocabulary.sizes()[w]
        crc, out = word, [(row[fresh], word[fresh])]
        for k in range(1, LENGTH):
            # A run of k + 1 words that ends at a word: the run of k words before it, a blank, and the word.
            crc = joined(joined(crc[:-1], BLANK, np.ones(len(crc) - 1, np.int64)), word[k:], size[k:])
            whole = (row[k:] == row[: len(row) - k]) & fresh[k:]
            out.append((row[k:][whole], crc[whole]))
            if len(crc) < 2:
                break
        return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out]) % np.uint32(self.buckets), row[fresh]


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket and n of all features of all texts. A task sends its sums of `buckets` counts once, whatever it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for _, bucket, _ in grams.blocks(b.column(0).to_pylist()):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return df.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in docs: `buckets` numbers, whatever the tables' sizes."""
    count = lambda d, name: bucket_counts(d, text_col, buckets).withColumnRenamed("n", name)
    found = {k: (s or 0, t or 0) for k, s, t in count(docs, "s").join(count(target, "t"), "bucket", "full").collect()}
    all_s, all_t = (float(sum(x[k] for x in found.values()) + buckets) for k in (0, 1))
    ratios = ((t + 1) * all_s / ((s + 1) * all_t) for s, t in (map(float, found.get(k, (0, 0))) for k in range(buckets)))
    return [math.floor(1000 * math.log(x)) for x in ratios]


def weigh(docs: DataFrame, gains: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_features and weight (sum of the features' gains) of every row; null and empty texts have none."""
    values = np.array(gains, np.float64)  # sums of whole numbers below 2^53 are exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(len(values))
        for b in batches:
            n, words, found, weight = b.num_rows, *(np.zeros(b.num_rows) for _ in range(3))
            for row, bucket, word_row in grams.blocks(b.column(1).to_pylist()):
                words += np.bincount(word_row, minlength=n)
                found += np.bincount(row, minlength=n)
                weight += np.bincount(row, values[bucket], n)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(np.int64)) for x in (words, found, weight))], [id_col, "n_words", "n_features", "weight"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_features long, weight long")


def noise(ident: Column, seed: int = SEED) -> Column:
    """floor(1000 g), g a Gumbel draw that seed and id decide. A null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))) * -1000)


def _place(value: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are above the value: ten steps of a search by halves, not a comparison with each."""
    up, steps = F.array(*[F.lit(e) for e in edges]), [1 << k for k in reversed(range(len(edges).bit_length()))]
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when((a + s <= len(edges)) & (F.try_element_at(up, a + s) <= value), a + s).otherwise(a))
    return F.lit(len(edges)) - at


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's n_features, weight, score, and its rank if it is drawn (else null).

    Of the documents with at least `least` words, floor(share * n / 100) with the highest scores are drawn; ties go to the
    smaller id, null ids first; rows alike in both are interchangeable. Nothing is sorted as a whole: scores fall into at
    most 1,024 ranges of about equal size, whose bounds are estimated and whose counts are exact, and rows are numbered
    within their range. Null and empty texts have no words, weigh 0 and are never drawn; an empty target or table of
    documents gives smoothed gains. Other columns aren't read. The driver holds the buckets' gains and the bounds.
    """
    d = weigh(docs, bucket_gains(docs, target, text_col), id_col, text_col)
    d = written(d.withColumn("score", F.col("weight") + noise(F.col(id_col), seed)), "weights")
    able = d.filter(F.col("n_words") >= least)
    edges = sorted(set(able.agg(F.percentile_approx("score", [k / EDGES for k in range(1, EDGES)], 20 * EDGES)).first()[0] or []))
    able = able.withColumn("__range", _place(F.col("score"), edges) if edges else F.lit(0))
    able = exact_rank(able, [], "__range", [F.col("score").desc(), F.col(id_col).asc_nulls_first()], "rank", "__n")
    able = able.withColumn("rank", F.when(F.col("rank") <= F.floor(F.col("__n") * share / 100), F.col("rank").cast("long")))
    rest = d.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    cols = [id_col, "n_features", "weight", "score", "rank"]
    return able.select(*cols).unionByName(rest.select(*cols))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards `benchmark`; five of a hundred are drawn."""
    tune(spark)
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda a, x: {_STEP}))"
# rank has nulls, which pandas holds as doubles.
ORACLE = f"""
WITH t AS (SELECT 0 AS kind, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT kind, rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM t),
p AS (SELECT kind, rid, len(ws) AS n_words, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT kind, rid, array_to_string(ws[i:i + k], ' ') AS f FROM p, (VALUES (0), (1), (2)) v(k) WHERE i + k <= n_words),
c AS (SELECT f, {_CRC} % {BUCKETS} AS bucket FROM (SELECT f, hex(encode(f)) AS b FROM (SELECT DISTINCT f FROM g))),
h AS (SELECT kind, rid, bucket FROM g JOIN c USING (f)),
n AS (SELECT k.bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM range({BUCKETS}) k(bucket) LEFT JOIN h ON h.bucket = k.bucket GROUP BY k.bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM n),
d AS (SELECT rid, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM h JOIN gains USING (bucket) WHERE kind = 0 GROUP BY rid),
e AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS g FROM w LEFT JOIN d USING (rid) WHERE kind = 0),
r AS (SELECT *, weight + g AS score, count(*) FILTER (n_words >= {LEAST}) OVER () AS able, row_number() OVER (PARTITION BY n_words >= {LEAST} ORDER BY weight + g DESC, doc_id NULLS FIRST) AS k FROM e)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= {LEAST} AND k <= {SHARE} * able // 100 THEN k END::DOUBLE AS rank FROM r
"""
