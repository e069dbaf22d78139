"""Spelling variants: words one code point apart, by groups of words that agree but for one place, without pairs.

A word is near another if a code point is replaced, inserted or deleted. Words that agree but for one replaced place share
one group (position, prefix, suffix); a word and another with one code point less share the shorter word. Each group is
one key; its size and its two most frequent words tell every member how many words it is near and which is the most
frequent, so that groups are never multiplied into pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, table, tune, written
from .crcs import Words, parts, shifted
from .sharding import _BYTES, _STEP

EVERY, LEAST_LENGTH, LEAST_COUNT, RATIO = 31, 7, 2, 10
VOCABULARY, ROWS = 300_000, 1 << 16
#: Latin-1: A-Z to a-z; a-z and code points from 0xC0 stay; all others part words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: A polynomial's modulus and base; 127 bits, so that texts of equal value are equal texts.
PRIME, BASE = (1 << 127) - 1, 0x5D8F3A91C2E4B7061F9C83D5A7E2B419
OWN, GONE, WILD = 0, 1, 2


class _Counted(Words):
    """Words as Latin-1, with the CRC of their UTF-8 and their size there."""

    def __init__(self) -> None:
        super().__init__()
        self.size: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.words)
        utf8 = word.decode("latin-1").encode()
        self.words.append(word)
        self.crc.append(zlib.crc32(utf8))
        self.size.append(len(utf8))
        return k


def word_counts(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: maximal runs of Latin letters, A-Z lower-cased, of at least least_length code points.

    Where crc32("<id>:<run>") is a multiple of `every`, the run's code point at the remainder by its length is left out
    first. That CRC is composed of the id's and the run's own. Tasks add up before the shuffle. A null id counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, cut = _Counted(), np.zeros(0, np.int64), Counter()
        for b in batches:
            ids, rows = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    own = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for part in parts(t.encode("latin-1", "replace").translate(_LETTERS)):
                        ids.append(words.numbers([w for w in part if len(w) >= least_length]))
                        rows.append(np.full(len(ids[-1]), own, np.uint32))
            if not ids:
                continue
            w, own = np.concatenate(ids), np.concatenate(rows)
            h = shifted(own, np.array(words.size, np.int64)[w]) ^ words.crcs()[w]
            hit = h % np.uint32(every) == 0
            seen = np.pad(seen, (0, len(words) - len(seen))) + np.bincount(w[~hit], minlength=len(words))
            length = np.fromiter(map(len, words.words), np.int64, len(words))[w[hit]]
            for k, p, size in zip(w[hit].tolist(), (h[hit] % length).tolist(), length.tolist(), strict=True):
                if size > least_length:
                    cut[words.words[k][:p] + words.words[k][p + 1 :]] += 1
            if len(words) + len(cut) > VOCABULARY:
                yield from _counts(words, seen, cut)
                words, seen, cut = _Counted(), np.zeros(0, np.int64), Counter()
        yield from _counts(words, seen, cut)

    return docs.select(id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(words: Words, seen: np.ndarray, cut: Counter) -> Iterator[pa.RecordBatch]:
    found = [(words.words[k].decode("latin-1"), int(seen[k])) for k in np.flatnonzero(seen)] + [(w.decode("latin-1"), n) for w, n in cut.items()]
    for a in range(0, len(found), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found[a : a + ROWS]], pa.string()), pa.array([n for _, n in found[a : a + ROWS]], pa.int64())], ["word", "n"])


def _keys(word: str, powers: list[int]) -> Iterator[tuple[int, int]]:
    """(kind, key): the word itself, the word without a code point (once for each such text), the word with a wildcard.

    A text's key is its polynomial, with a leading one, and code points one up; a wildcard is 0. Each key comes from the whole's by one product, so
    a word takes time and rows in proportion to its length.
    """
    points = [ord(c) + 1 for c in word]
    while len(powers) < len(points):
        powers.append(powers[-1] * BASE % PRIME)
    heads = list(accumulate(points, lambda h, c: (h * BASE + c) % PRIME, initial=1))
    whole, last = heads[-1], len(points) - 1
    yield OWN, whole
    for p, c in enumerate(points):
        yield WILD, (whole - c * powers[last - p]) % PRIME
        if p == last or points[p + 1] != c:
            yield GONE, (whole - (heads[p + 1] - heads[p]) * powers[last - p]) % PRIME


def group_keys(vocabulary: DataFrame) -> DataFrame:
    """kind, key, n and rid of every group of every word of vocabulary (rid, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, rows = [1], []
        for b in batches:
            for rid, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for kind, key in _keys(word, powers):
                    rows.append((kind, key.to_bytes(16, "big"), n, rid))
                    if len(rows) >= ROWS:
                        yield _key_rows(rows)
                        rows = []
        if rows:
            yield _key_rows(rows)

    return vocabulary.select("rid", "word", "n").mapInArrow(run, "kind byte, key binary, n long, rid long")


def _key_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int8(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "key", "n", "rid"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """rid, n, n_near and best (n and rid of the most frequent near word, the least rid of equals) of words with near words.

    A group holds its own word first, then the others by n and rid. A group of wildcards has at most as many members as
    there are letters; that of a shorter word at most as many as it has insertions. Members read size and first two only.
    """
    by_key = Window.partitionBy("key")
    order, whole = by_key.orderBy("kind", F.col("n").desc(), "rid"), (Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("kind", "n", "rid")
    g = group_keys(vocabulary).select("*", F.row_number().over(order).alias("k"), F.count(F.lit(1)).over(by_key).alias("size"))
    g = g.select("*", F.first(row).over(order.rowsBetween(*whole)).alias("first"), F.nth_value(row, 2).over(order.rowsBetween(*whole)).alias("second"))
    # Without its shorter word a group of deletions links nobody: its members are two code points apart, or one replaced.
    g = g.filter((F.col("size") > 1) & ((F.col("kind") == WILD) | (F.col("first.kind") == OWN)))
    near = F.when((F.col("kind") == GONE), F.lit(1)).otherwise(F.col("size") - 1)
    best = F.when(F.col("k") == 1, F.col("second")).otherwise(F.col("first"))
    g = g.select("rid", "n", near.alias("near"), F.struct(best["n"].alias("n"), (-best["rid"]).alias("rid")).alias("best"))
    g = g.groupBy("rid", "n").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    return g.select("rid", "n", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.rid")).alias("best_rid"))


def spelling_variants(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of least_length code points or more that occurs least_count times.

    form is the near word with the largest n (ties: the least in the order of code points) if that is at least `ratio` times
    the word's n; root is where forms lead in the end. Each form is `ratio` times as frequent as its word, so chains are
    short (19 words at most), and halving them takes five rounds. Words get numbers in their order, so that rows carry numbers,
    not texts, and a word of any length costs rows in proportion to it. Null and empty texts have no words; repeated rows count each; an
    empty table, or one without such words, gives an empty one. Other columns aren't read. A ratio below 2 is refused:
    words of equal n would be each other's form.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least")
    spark = docs.sparkSession
    v = word_counts(docs, every, least_length, id_col, text_col).filter(F.col("n") >= least_count)
    v = written(v.orderBy("word").select(F.monotonically_increasing_id().alias("rid"), "word", "n"), "variant-words")
    near = written(near_words(v), "variant-near")
    forms = near.filter(F.col("best_n") >= F.col("n") * ratio).select("rid", F.col("best_rid").alias("form_rid"), F.col("best_n").alias("form_n"))
    roots = written(forms.select("rid", F.col("form_rid").alias("root_rid")), "variant-roots")
    while True:
        further = roots.select(F.col("rid").alias("root_rid"), F.col("root_rid").alias("next"))
        step = written(roots.join(further, "root_rid", "left").select("rid", F.coalesce("next", "root_rid").alias("root_rid"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        forget(spark, roots)
        folder, roots = step.folder, step.select("rid", "root_rid")
        roots.folder = folder
        if step.filter("moved").isEmpty():
            break
    text = lambda k: v.select(F.col("rid").alias(f"{k}_rid"), F.col("word").alias(k))
    led = forms.join(roots, "rid").join(text("form"), "form_rid").join(text("root"), "root_rid").select("rid", "form", "root", "form_n")
    out = v.join(near.select("rid", "n_near"), "rid", "left").join(led, "rid", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among all words of `documents`."""
    tune(spark)
    return spelling_variants(table(spark, sf_dir, "documents"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda a, x: {_STEP}))"
# form_n has nulls, which pandas holds as doubles.
ORACLE = f"""
WITH RECURSIVE r AS (SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'))")} AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS b FROM r WHERE length(w) >= {LEAST_LENGTH} GROUP BY doc_id, w),
h AS (SELECT w, k, {_CRC} AS h FROM d),
m AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM m WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
x AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM p),
y AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM p),
pairs AS (SELECT s.word, s.n, t.word AS other, t.n AS m FROM y s JOIN y t ON s.i = t.i AND s.a = t.a AND s.z = t.z AND s.word <> t.word
  UNION ALL SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON v.word = x.short UNION ALL SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON v.word = x.short),
q AS (SELECT word, n, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word, n),
f AS (SELECT q.word, q.n_near, CASE WHEN q.m >= {RATIO} * q.n THEN q.m END AS form_n, CASE WHEN q.m >= {RATIO} * q.n THEN (SELECT min(p.other) FROM pairs p WHERE p.word = q.word AND p.m = q.m) END AS form FROM q),
c(word, root) AS (SELECT word, word FROM v UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
t AS (SELECT c.word, c.root FROM c LEFT JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT v.word, f.form, t.root, v.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n::DOUBLE AS form_n FROM v LEFT JOIN f USING (word) JOIN t ON t.word = v.word
"""
