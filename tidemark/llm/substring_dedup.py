"""Substring dedup: runs of words that occur elsewhere are cut out of documents.

Against a bounded reference, `reference_matches` works by suffix automata of reference shards, broadcast one after the
other, with matching statistics of the streamed documents. Where the reference is the corpus itself (`repeated_words`),
every shard would have to be streamed past every document, which grows with the square of the corpus; there a window's
least run of five words is its anchor, only anchors that occur twice are looked at, and windows are compared by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, table, tune, written
from .decontaminate import Automata
from .near_duplicates import _HASHES, VOCABULARY

WINDOW, GRAM = 35, 5
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text, unchanged, as UTF-8. Null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS.get("b", ())) < n:
        n = 1 << (n - 1).bit_length()
        for name, base in (("b", BASE), ("i", INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["b"], _POWERS["i"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Windows:
    """Hashes of a document's windows and their anchors: the leftmost least run of five words in each."""

    def __init__(self, words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> None:
        self.words, self.window, self.count = words, window, max(0, len(words) - window + 1)
        if not self.count:
            return
        if len(_HASHES) > VOCABULARY:
            _HASHES.clear()
        h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
        b, self.inverse = _powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(h * b[: len(words)], out=self.sums[1:])
        n = len(words) - gram + 1
        value = _mixed(self.spans(np.arange(n), gram))
        place, width, want = np.arange(n), 1, window - gram + 1
        while width < want:  # least of twice as many at a time, the left one on ties
            d = min(width, want - width)
            left = value[:-d] <= value[d:]
            value, place, width = np.where(left, value[:-d], value[d:]), np.where(left, place[:-d], place[d:]), width + d
        cuts = np.flatnonzero(np.diff(place)) + 1
        self.starts = np.concatenate([[0], cuts])
        self.lengths = np.diff(np.concatenate([self.starts, [self.count]]))
        self.anchors = value[self.starts]

    def spans(self, at: np.ndarray, n) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.inverse[at]

    def contents(self) -> np.ndarray:
        """Hash of all words that the windows of each anchor cover."""
        return _mixed(self.spans(self.starts, self.lengths + self.window - 1) ^ self.lengths.astype(np.uint64))

    def digests(self, at: np.ndarray) -> np.ndarray:
        """128 bits of the words of each window that starts at `at`, as two columns: xxh3 of the words with one blank between."""
        text = memoryview(b" ".join(self.words))
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)
        starts = np.concatenate([[0], ends])[at].tolist()
        stops = (ends[at + self.window - 1] - 1).tolist()
        return np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[a:e]) for a, e in zip(starts, stops, strict=True)]), np.int64).reshape(-1, 2)


def _batch(names: list[str], cols: list[list[np.ndarray]], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


KEY = ("k1", "k2")  # 128 bits of a row's id and text
HEAVY = 20_000  # at most so many keys can have more than one row in HEAVY


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(k1, k2, s, n, a, p): each run of n windows from s on that share one anchor, the anchor, and the hash of what they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for k1, k2, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                w = Windows(words_of(text), window)
                if w.count:
                    n = len(w.starts)
                    for c, x in zip(cols, (np.full(n, k1, np.int64), np.full(n, k2, np.int64), w.starts, w.lengths, _signed(w.anchors), _signed(w.contents())), strict=True):
                        c.append(x)
            yield _batch([*KEY, "s", "n", "a", "p"], cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])

    return docs.select(*KEY, "text").mapInArrow(run, "k1 long, k2 long, s int, n int, a long, p long")


def _window_rows(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """(k1, k2, s, w1, w2): each window of the runs (KEY, r: array of struct(s, n)) and its digest, once a row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for k1, k2, text, r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                w = Windows(words_of(text), window)
                at = np.unique(np.concatenate([np.arange(x["s"], x["s"] + x["n"]) for x in r]))
                at = at[at < w.count]
                if len(at):
                    digest = w.digests(at)
                    for c, x in zip(cols, (np.full(len(at), k1, np.int64), np.full(len(at), k2, np.int64), at, digest[:, 0], digest[:, 1]), strict=True):
                        c.append(x)
            yield _batch([*KEY, "s", "w1", "w2"], cols, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])

    return docs.join(runs, list(KEY)).select(*KEY, "text", "r").mapInArrow(run, "k1 long, k2 long, s int, w1 long, w2 long")


def heavy_join(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """left with right's columns by keys that are unique in right, whose column `count` says how many rows of left they have.

    Keys with more than one row in HEAVY are at most HEAVY, so they are broadcast whatever the size of left, and their
    rows stay where they are; only the others are shuffled, and no task gets more than its share of them.
    """
    bound = max(1000, total // HEAVY)
    heavy, light = F.broadcast(right.filter(F.col(count) > bound).drop(count)), right.filter(F.col(count) <= bound).drop(count)
    return left.join(heavy, on).unionByName(left.join(heavy.select(*on), on, "left_anti").join(light, on))


def repeated_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_removed, kept_sha256, kept (the words left, joined by a blank).

    A word goes if a window of `window` consecutive words covers it whose words also start anywhere else, in this
    document or another, repeated rows included. Texts shorter than a window, null and empty ones lose nothing.

    Windows with equal words have the same anchor, so an anchor that occurs once in the corpus clears all its windows.
    If all occurrences of an anchor cover the same words, all their windows are repeated; the others' windows are
    counted by a 128-bit digest. Counts are summed before the shuffle, and anchors and windows of a large share of all
    rows are broadcast to these instead of shuffled to one task, so a passage in any share of the documents gathers
    nowhere. Rows are told apart by 128 bits of id and text. Empty tables give none.
    """
    spark, key = docs.sparkSession, list(KEY)
    d = docs.select(F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit("second"), text_col, id_col).alias("k2"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = written(_anchor_rows(d, window), "anchors")
    twice = rows.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.min("p").alias("p0"), F.max("p").alias("p1")).filter("c > 1")
    twice = written(twice.select("a", "c", (F.col("p0") == F.col("p1")).alias("same")), "anchors-again")
    found = written(heavy_join(rows, twice, ["a"], "c", rows.count()).select(*key, "s", "n", "same"), "repeated-anchors")
    forget(spark, rows, twice)
    runs = found.filter("not same").groupBy(*key).agg(F.collect_list(F.struct("s", "n")).alias("r"))
    windows = written(_window_rows(d, runs, window), "windows")
    again = written(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "windows-again")
    hits = heavy_join(windows, again, ["w1", "w2"], "c", windows.count()).select(*key, "s", F.lit(1).alias("n"))
    spans = written(hits.unionByName(found.filter("same").select(*key, "s", "n")).groupBy(*key).agg(F.collect_set(F.struct("s", "n")).alias("r")), "repeated-windows")
    forget(spark, found, windows, again)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = words_of(text)
                kept, n = w, len(w)
                if r:
                    edge = np.zeros(n + 1, np.int32)
                    for x in r:
                        edge[min(x["s"], n)] += 1
                        edge[min(x["s"] + x["n"] + window - 1, n)] -= 1
                    gone = np.cumsum(edge[:n]) > 0
                    kept = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                left = b" ".join(kept)
                for c, x in zip(out, (n, n - len(kept), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "surrogatepass")), strict=True):
                    c.append(x)
            cols = [b.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    full = d.join(spans, key, "left").select("id", "text", "r").mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return full.withColumnRenamed("id", id_col)


def reference_matches(docs: DataFrame, reference: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", ref_text: str = "text", shard_words: int = 1_000_000) -> DataFrame:
    """id_col, shard and spans (word runs [s, e)) of docs that a reference table has, by suffix automata of its shards.

    The reference is cut by hash into shards of about shard_words words, whose automata tasks build; each is broadcast
    and all documents stream past it, so that a position's matching length of at least `window` words marks a span. One
    row a row of docs and shard, repeated rows included. Use it where the reference is bounded. Nulls on either side have
    no words, repeated reference rows count once, and an empty reference gives empty spans. Of several shards each pass
    is written before the next one's automaton is loaded.
    """
    r = reference.select(F.lit(None).cast("string").alias("i"), F.col(ref_text).alias("t"))
    # Only whole windows count: items shorter than one can't match.
    automata = Automata(r, window, "i", "t", split=lambda t: w if len(w := words_of(t)) >= window else [], max_words=shard_words)
    kind, out = dict(docs.dtypes)[id_col], None
    for k in range(automata.count):
        shared = automata.shard(k)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                spans = [[{"s": s, "e": e} for s, e in shared.automaton.scan(words_of(t))[0]] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k] * b.num_rows, pa.int32()), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], [id_col, "shard", "spans"])

        one = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, shard int, spans array<struct<s:int,e:int>>")
        if automata.count > 1:
            one = written(one, "matches")
            shared.broadcast.destroy()
        out = one if out is None else out.unionByName(one)
    forget(docs.sparkSession, automata.files)
    return out


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and the digest of what stays of every document."""
    tune(spark)
    return repeated_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


_WORD = r"[^\x20\x09-\x0D]+"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
g AS (SELECT rid, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
h AS (SELECT rid, i, sha256(array_to_string(g, ' ')) AS k FROM g),
r AS (SELECT rid, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
hit AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS p FROM r),
word AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n FROM word ANTI JOIN hit USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
