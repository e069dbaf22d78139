"""Benchmark decontamination: a generalised suffix automaton of the test items, and matching lengths of streamed words."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, map_texts, table, tune, written

WINDOW, COVERAGE = 13, 20  # words of a window; contaminated if at least one word in COVERAGE is hit
#: Words of benchmark text that one automaton holds (some 600 bytes each in a worker); a larger benchmark is split over several.
MAX_WORDS = 250_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # as words_of finds them, before lower-casing
# Bytes that end a word; all others, with A-Z lower-cased, belong to words.
BREAKS = bytes(0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8. Null has none."""
    return text.encode("utf-8", "surrogatepass").lower().translate(BREAKS).split() if text else []


class ItemAutomaton:
    """Suffix automaton over the words of many items; a state stands for a class of word runs of equal occurrences."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        for _, ids in texts:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: For each state the one on its chain that holds the runs of `window` words, or -1.
        self.at_window = [-1] * len(self.next)
        for s in by_length:
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[self.link[s]] < window else self.at_window[self.link[s]]
        self.items: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for item, ids in texts:
            s = 0
            for n, c in enumerate(ids, 1):
                s = self.next[s][c]
                if n >= window:
                    self.items.setdefault(self.at_window[s], set()).add(item)
            if len(ids) < window:
                self.short.setdefault(s, {}).setdefault(len(ids), set()).add(item)
        #: Nearest proper ancestor that ends a short item.
        self.up = [-1] * len(self.next)
        for s in by_length:
            p = self.link[s]
            self.up[s] = p if p in self.short else self.up[p] if p > 0 else -1
        self.ends = [s in self.short or self.up[s] >= 0 for s in range(len(self.next))]

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        else:
            self.link[new] = 0
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _state(self, length: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged runs [start, end) of hit words, and the items with an occurring window."""
        nxt, link, length, window, ends = self.next, self.link, self.length, self.window, self.ends
        root = nxt[0]
        spans: list[tuple[int, int]] = []
        items: set = set()
        seen: set[int] = set()
        s = n = 0
        for i, c in enumerate(map(self.vocabulary.get, words), 1):
            t = nxt[s].get(c)
            if t is None:
                if c is None:
                    s = n = 0
                    continue
                while t is None and s:
                    s = link[s]
                    t = nxt[s].get(c)
                n = length[s]
                if t is None:
                    t = root.get(c, 0)
                    n = 0 if t else -1
            s = t
            n += 1
            if n >= window:
                a = i - window
                w = self.at_window[s]
                if w not in seen:
                    seen.add(w)
                    items |= self.items.get(w, ())
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i))
            if ends[s]:
                q = s
                while q >= 0:
                    for m, which in self.short.get(q, {}).items():
                        if m <= n:
                            items |= which
                            a = i - m
                            while spans and spans[-1][1] >= a:
                                a = min(a, spans.pop()[0])
                            spans.append((a, i))
                    q = self.up[q]
        return spans, items


class Automata:
    """The automata of a benchmark's shards. Tasks build them and write them to the shared folder; the driver holds the
    packed bytes of one shard at a time, and workers unpack what they need, whatever the benchmark's size. Shards are counted
    by words, some MAX_WORDS each; an item of more than that is cut into pieces that share window - 1 words, so no window is
    lost and no shard follows one item's length."""

    PIECE = 16 << 20

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text", split=words_of, max_words: int | None = None) -> None:
        b = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t <> ''").distinct()
        most = max(max_words or MAX_WORDS, window)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Items of more than `most` words in pieces; each window starts in exactly one of them."""
            for x in batches:
                found = [(i, w[a : a + most]) for i, t in zip(*(c.to_pylist() for c in x.columns), strict=True) for w in [split(t)] for a in range(0, max(1, len(w) - window + 1), most - window + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.string()), pa.array([b" ".join(w).decode("utf-8", "surrogatepass") for _, w in found], pa.string()), pa.array([len(w) for _, w in found], pa.int64())], ["i", "t", "n"])

        b = written(b.mapInArrow(cut, "i string, t string, n long"), "benchmark-pieces")
        self.count = max(1, -(-(b.agg(F.sum("n")).first()[0] or 0) // most))
        piece = self.PIECE

        def build(key: tuple, rows: pa.Table) -> pa.Table:
            data = pickle.dumps(ItemAutomaton(zip(rows.column("i").to_pylist(), map(split, rows.column("t").to_pylist()), strict=True), window), 5)
            parts = [data[k : k + piece] for k in range(0, len(data), piece)]
            return pa.table({"shard": pa.array([key[0].as_py()] * len(parts), pa.int32()), "at": pa.array(range(len(parts)), pa.int32()), "data": pa.array(parts, pa.binary())})

        parts = b.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(self.count)).cast("int")).groupBy("shard").applyInArrow(build, "shard int, at int, data binary")
        self.files, self.window = written(parts, "automata"), window
        forget(b.sparkSession, b)

    def shard(self, k: int) -> "Shared":
        rows = self.files.filter(F.col("shard") == k).orderBy("at").collect()
        data = b"".join(r["data"] for r in rows) or pickle.dumps(ItemAutomaton((), self.window), 5)
        return Shared(self.files.sparkSession.sparkContext.broadcast(data))


_UNPACKED: dict[str, ItemAutomaton] = {}


class Shared:
    """A broadcast automaton; a worker unpacks it once and keeps the one it used last."""

    def __init__(self, broadcast) -> None:
        self.broadcast, self.key = broadcast, uuid.uuid4().hex

    @property
    def automaton(self) -> ItemAutomaton:
        if self.key not in _UNPACKED:
            _UNPACKED.clear()
            _UNPACKED[self.key] = pickle.loads(self.broadcast.value)
        return _UNPACKED[self.key]


def text_key(text_col: str) -> F.Column:
    """Digest of a text, null as empty: rows of one text have the same hits."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


MERGED = "array<struct<s:int,e:int>>"


def merged(spans: F.Column) -> F.Column:
    """Runs [s, e) in any order as sorted runs without overlap."""
    last = lambda a: F.element_at(a, -1)
    grow = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["s"].alias("s"), F.greatest(last(a)["e"], x["e"]).alias("e"))))
    add = lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["e"] >= x["s"]), grow(a, x)).otherwise(F.concat(a, F.array(x)))
    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), F.array().cast(MERGED), add)).otherwise(spans)


def text_hits(docs: DataFrame, automata: Automata, text_col: str = "text") -> DataFrame:
    """(h, spans, items) of each text with a hit: shards stream past the documents one after the other, each pass is
    written, and its automaton is released before the next one's."""
    passes = []
    for k in range(automata.count):
        shared = automata.shard(k)

        def scan(keys: list, texts: list, shared=shared) -> dict:
            a, out = shared.automaton, {"h": [], "spans": [], "items": []}
            for h, t in zip(keys, texts, strict=True):
                spans, items = a.scan(words_of(t))
                if spans:
                    out["h"].append(h)
                    out["spans"].append([{"s": s, "e": e} for s, e in spans])
                    out["items"].append(sorted(i for i in items if i is not None))
            return _typed(out)

        keyed = docs.select(text_key(text_col).alias("__h"), F.col(text_col))
        passes.append(written(map_texts(keyed, scan, f"h string, spans {MERGED}, items array<string>", "__h", text_col).dropDuplicates(["h"]), "hits"))
        shared.broadcast.destroy()
    every = reduce(DataFrame.unionByName, passes).groupBy("h").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = written(every.withColumn("spans", merged(F.col("spans"))), "text-hits")
    forget(docs.sparkSession, automata.files, *passes)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_words, spans (runs of hit words, [s, e)), items (sorted ids as strings).

    A window is `window` consecutive words of an item, or a whole shorter item; a word inside any occurrence of a
    window is hit. Null and empty texts have no words and no hits; null, empty and repeated items add nothing;
    items with a null id count by their words and are not listed. Only the two named columns of docs are read.
    A benchmark of more than MAX_WORDS words is cut into shards, which stream past the documents one after the other;
    their hits meet by the text's digest.
    """
    kind = dict(docs.dtypes)[id_col]
    automata = Automata(benchmark, window, item_col, item_text)
    if automata.count > 1:
        d = docs.select(F.col(id_col), text_key(text_col).alias("h"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
        d = d.join(text_hits(docs, automata, text_col), "h", "left")
        return d.select(id_col, "n_words", F.coalesce("spans", F.array().cast(MERGED)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    shared = automata.shard(0)

    def scan(ids: list, texts: list) -> dict:
        a, out = shared.automaton, {id_col: ids, "n_words": [], "spans": [], "items": []}
        for x in texts:
            w = words_of(x)
            spans, items = a.scan(w)
            out["n_words"].append(len(w))
            out["spans"].append([{"s": s, "e": e} for s, e in spans])
            out["items"].append(sorted(i for i in items if i is not None))
        return _typed(out, id_col, kind)

    forget(docs.sparkSession, automata.files)
    return map_texts(docs, scan, f"{id_col} {kind}, n_words long, spans {MERGED}, items array<string>", id_col, text_col)


def _typed(columns: dict, id_col: str = "", kind: str = "") -> dict:
    spans = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    types = {"h": pa.string(), "n_words": pa.int64(), "spans": spans, "items": pa.list_(pa.string()), id_col: {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)}
    return {k: pa.array(v, types.get(k)) for k, v in columns.items()}


def hit_words(spans) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])


def is_contaminated(n_hit, n_words, coverage: int = COVERAGE) -> F.Column:
    return (n_hit > 0) & (n_hit * coverage >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, mode: str = "drop", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without contaminated rows (`drop`), or with the hit words cut out of contaminated texts (`cut`).

    Contaminated: some word is hit and at least one word in `coverage` is. All other rows stay as they are, with
    every column; null and empty texts are kept. Each row is judged by itself, so repeated rows and ids share a
    fate only through their texts. An empty benchmark keeps all; empty docs give an empty table.
    In `cut`, what remains of a text are its bytes outside the hit words, the breaks beside them included.
    """
    automata = Automata(benchmark, window, item_col, item_text)
    many, at, spark = automata.count > 1, docs.columns.index(text_col), docs.sparkSession
    if many:
        hits = text_hits(docs, automata, text_col).select(F.col("h").alias("__h"), F.col("spans").alias("__spans"))
        rows = docs.select("*", text_key(text_col).alias("__h")).join(hits, "__h", "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__spans")
    else:
        rows, shared = docs, automata.shard(0)
        forget(spark, automata.files)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [[(x["s"], x["e"]) for x in r or ()] for r in b.column(b.num_columns - 1).to_pylist()] if many else [shared.automaton.scan(words_of(t))[0] for t in texts]
            n_hit = [sum(e - s for s, e in r) for r in found]
            bad = [n > 0 and n * coverage >= len(words_of(t)) for t, n in zip(texts, n_hit, strict=True)]
            b = b.select(range(len(docs_schema)))
            if mode == "drop":
                yield b.filter(pa.array([not x for x in bad], pa.bool_()))
            else:
                left = [cut(t, {k for s, e in r for k in range(s, e)}) if x else t for t, r, x in zip(texts, found, bad, strict=True)]
                yield b.set_column(at, b.schema.field(at), pa.array(left, b.schema.field(at).type))

    docs_schema = docs.columns
    return rows.mapInArrow(run, docs.schema)


def cut(text: str, hit: set[int]) -> str:
    raw, mask, out, k, i = text.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass").lower().translate(BREAKS), [], 0, 0
    while i < len(raw):
        j = i
        while j < len(raw) and (mask[j] == 0x20) == (mask[i] == 0x20):
            j += 1
        if mask[i] == 0x20 or k not in hit:
            out.append(raw[i:j])
        k += mask[i] != 0x20
        i = j
    return b"".join(out).decode("utf-8", "surrogatepass")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and contaminating items of every document."""
    tune(spark)
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("spans"))
    return c.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated(n_hit, F.col("n_words")).alias("contaminated"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all({_LOWER}, '{_WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, m, list_slice(w, i, i + m - 1) AS g FROM
  (SELECT item_id, w, least(len(w), {WINDOW}) AS m, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
grams AS (SELECT rid, i, m, list_slice(w, i, i + m - 1) AS g FROM pos, (SELECT DISTINCT m FROM win) WHERE i + m - 1 <= len(w)),
hits AS (SELECT rid, i, m, item_id FROM grams JOIN win USING (m, g)),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM hits)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN its USING (rid)
"""
