"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide, and groups are connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import forget, table, tune, written

WORDS, SIMILARITY = 5, 0.8
RECALL, HASHES = 0.999, 128
#: Texts of a candidate group that one task compares with as many others, and hashes of these: larger groups are dealt out by pairs of blocks.
BLOCK, HASHES_A_BLOCK = 200, 500_000
COLUMNS = 4096  # shingles that are counted at once
VOCABULARY = 250_000  # words whose hashes a worker remembers


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows a band (the fewest false candidates) at which a pair of this similarity is found with the recall asked for."""
    for rows in range(hashes, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no bands reach this recall")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the runs of `words` words, repeats included; a shorter text is one run; null and blank texts have none.

    Words are what white space separates, in lower case.
    """
    if not text:
        return np.zeros(0, np.uint64)
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > VOCABULARY:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, map(str.encode, w)), np.uint64, len(w))
    n = max(1, len(w) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(w))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n] * np.uint64(2 * k + 1)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def __call__(self, s: np.ndarray) -> list[int]:
        """Band keys; none for a text without shingles."""
        if not len(s):
            return []
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 8192):
            np.minimum(low, (x[None, i : i + 8192] * self.a[:, None] + self.b[:, None]).min(axis=1), out=low)
        m = low.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
        for c in m.T:
            key = (key ^ c) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
        return key.view(np.int64).tolist()


HOT, SALTS = 1000, 32  # rows of a key from which a lookup splits it, and into how many parts


def salt(*cols: str) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def salted(d: DataFrame) -> DataFrame:
    """Each row of d once for every salt."""
    return d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the least vertex of its component.

    Rounds of least neighbour's label and of the label's label; labels are written to the shared folder each round,
    so that the plan stays short and lost executors cost one round's tasks. Rounds grow with the log of the diameter.
    A vertex of many edges and a label of many vertices are looked up in parts: edges of one with over a thousand are
    dealt by salt and its label is copied to all salts; labels that change, few after the first round, are as well.
    """
    spark = edges.sparkSession
    e = edges.filter("a <> b").select("a", "b")
    both = written(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    hubs = written(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("b"), f"{name}-hubs")
    dealt = both.withColumn("salt", salt("a")).join(salted(hubs.withColumn("hub", F.lit(True))), ["b", "salt"], "left")
    dealt = written(dealt.select("a", "b", F.when(F.col("hub"), F.col("salt")).otherwise(0).alias("salt")), f"{name}-dealt")
    # Neighbours of the least label: every vertex has one edge at least.
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")), f"{name}-0")
    forget(spark, both)
    step = 0
    while True:
        step += 1
        sent = labels.select(F.col("v").alias("b"), "root").join(hubs.withColumn("hub", F.lit(True)), "b", "left")
        sent = sent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hub"), SALTS - 1).otherwise(0)))).drop("hub")
        near = dealt.join(sent, ["b", "salt"]).groupBy("a").agg(F.min("root").alias("m"))
        new = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.filter("v <> root").select(F.col("v").alias("root"), F.col("root").alias("top"))
        up = new.select("root").distinct().join(up, "root")
        new = new.withColumn("salt", salt("v")).join(salted(up), ["root", "salt"], "left").select("v", "old", F.least("root", "top").alias("root"))
        before, new = labels, written(new, f"{name}-{step}")
        forget(spark, before)
        labels = new.select("v", "root")
        labels.folder = new.folder
        if new.filter("old <> root").limit(1).count() == 0:
            forget(spark, hubs, dealt)
            return labels


def _signed(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """id, key, digest of the text and band keys of every row. Nothing else of a row is kept."""
    kind = dict(docs.dtypes)[id_col]
    bands, rows = choose_bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = MinHash(bands, rows)
        for b in batches:
            texts = b.column(1).to_pylist()
            nodes = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            sets = [shingles(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes), pa.array([sign(s) for s in sets], pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int64())], ["id", "node", "bands", "size"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, node string, bands array<bigint>, size long")


def _hashed(d: DataFrame, words: int) -> DataFrame:
    """d with `sets`, the distinct hashes of its text's runs, in the place of `text`."""
    at = d.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([np.unique(shingles(t, words)).tobytes() for t in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([sets if k == at else b.column(k) for k in range(b.num_columns)], ["sets" if k == at else n for k, n in enumerate(b.schema.names)])

    return d.mapInArrow(run, StructType([StructField("sets", BinaryType()) if k == at else f for k, f in enumerate(d.schema)]))


def compare(nodes: list, sets: list[np.ndarray], side: list[int], left: int, right: int, similarity: float, bands: np.ndarray, band: int | None = None) -> tuple[list, list[int], list]:
    """Of the sets of two blocks (or of one, if left is right): nodes with links, how many, and the least node of their
    local component. Only pairs with a common band (a row of bands a set) are linked; with `band`, only those whose first common one it is."""
    size = np.array([len(s) for s in sets], np.int64)
    side_ = np.array(side)
    a, b = np.flatnonzero(side_ == left), np.flatnonzero(side_ == right)
    links = np.zeros(len(nodes), np.int64)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if len(a) and len(b):
        owner = np.repeat(np.arange(len(sets)), size)
        values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(df > 1) - 1
        some = df[inverse] > 1
        owner, column = owner[some], column[inverse[some]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = int(column[-1]) + 1 if len(column) else 0
        common = np.zeros((len(a), len(b)), np.float32)
        at_a, at_b = np.full(len(sets), -1), np.full(len(sets), -1)
        at_a[a], at_b[b] = np.arange(len(a)), np.arange(len(b))
        for c in range(0, width, COLUMNS):
            i, j = np.searchsorted(column, [c, c + COLUMNS])
            o, k = owner[i:j], column[i:j] - c
            one = np.zeros((len(a), COLUMNS), np.float32)
            m = at_a[o] >= 0
            one[at_a[o[m]], k[m]] = 1
            if left == right:
                two = one
            else:
                two = np.zeros((len(b), COLUMNS), np.float32)
                m = at_b[o] >= 0
                two[at_b[o[m]], k[m]] = 1
            common += one @ two.T
        union = size[a][:, None] + size[b][None, :] - common
        hit = (common > 0) & (common >= similarity * union - 1e-6)
        if left == right:
            np.fill_diagonal(hit, False)
        i, j = np.nonzero(hit)
        same = bands[a[i]] == bands[b[j]]
        hit[i, j] = same.any(axis=1) & ((band is None) | (bands[a[i], same.argmax(axis=1)] == band))
        if left == right:
            links[a] += hit.sum(1)
        else:
            links[a] += hit.sum(1)
            links[b] += hit.sum(0)
        for i, j in zip(*np.nonzero(hit), strict=True):
            p, q = find(int(a[i])), find(int(b[j]))
            if p != q:
                root[p] = q
    least: dict[int, str] = {}
    for i, n in enumerate(nodes):
        r = find(i)
        least[r] = min(least.get(r, n), n)
    some = np.flatnonzero(links).tolist()
    return [nodes[i] for i in some], [int(links[i]) for i in some], [least[find(i)] for i in some]


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, class_id, class_size, n_links, group_id and node.

    Equal texts (null counts as empty) are a class: node is the md5 of the text, class_id the least id, class_size its
    rows. Two classes are linked if the Jaccard similarity of their sets of runs of five words is at least 0.8;
    n_links counts a class's links, and group_id is the least id of its connected component (class_id without links).
    Texts without words have no links. An id that repeats with other texts is in several classes; ids of null don't
    take part in the least ids. Only the two named columns are read. An empty table gives an empty table.

    Bands are chosen for a recall of 0.999 a pair at the threshold. One rule holds for all pairs: those that share a band
    are verified on full sets, no others. Texts that share a band meet as edges to the least text of the bucket, never as
    pairs. Where they are verified is a matter of cost alone: members of a connected group of candidates share most of
    their buckets as a rule, so they are compared group by group; but where its buckets hold fewer pairs than the group,
    as in a long chain, they are compared within buckets, and a pair counts in its first common one. Either way a pair
    without a common band isn't linked. Sets of hashes are taken once and travel, in blocks of 200 sets or 500,000 hashes
    (or one set), to pairs of blocks. Only counts of links and edges of a spanning forest come out. Thus buckets and groups of any
    size are done whole, spread over tasks, without emitting pairs, and a group costs no more than its buckets.
    """
    signed, info = _grouped(docs, words, similarity, id_col, text_col)
    return signed.select(F.col("id").alias(id_col), "node").join(info, "node").select(id_col, "class_id", "class_size", "n_links", "group_id", "node", "head")


def _grouped(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every row, and one row a class: node, class_id, class_size, n_links, group_id, head. Both are written."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    d = docs.select(F.col(id_col), F.col(text_col))
    signed = written(_signed(d, id_col, text_col, words, similarity), "signatures")
    key = lambda i, node: F.coalesce(i.cast("string"), F.concat(F.lit("~"), node))
    nodes = written(signed.groupBy("node").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(key(F.col("id"), F.col("node"))).alias("key"), F.first("bands").alias("bands"), F.first("size").alias("size")), "classes")
    members = nodes.select(F.explode("bands").alias("band"), "node", "size")
    blocks = lambda k, size: F.ceil(F.greatest(F.col(k) / BLOCK, F.col(size) / HASHES_A_BLOCK)).cast("int")
    buckets = written(members.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("k"), F.sum("size").alias("all")).filter("k > 1"), "buckets")
    shared = written(members.join(buckets, "band").select("node", "band", "a", blocks("k", "all").alias("n")), "memberships")
    reps = shared.groupBy("node").agg(F.array_sort(F.collect_set("a")).alias("reps"))
    # A text is in as many buckets as there are bands; the least texts of these meet at the least of all.
    edges = reps.select(F.element_at("reps", 1).alias("a"), F.explode(F.concat("reps", F.array("node"))).alias("b")).distinct()
    candidates = components(edges, "candidates")
    # Groups of more than one block are compared where it costs less: group by group, or within their buckets.
    pairs = buckets.join(candidates, F.col("a") == F.col("v")).groupBy("root").agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("pairs"))
    sized = candidates.join(nodes.select(F.col("node").alias("v"), "size"), "v")
    big = sized.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("all")).withColumn("n", blocks("m", "all")).filter("n > 1").join(pairs, "root")
    big = big.select("root", "n", (F.col("pairs") < F.col("m").cast("double") * F.col("m")).alias("sparse"))
    placed = candidates.withColumn("salt", salt("v")).join(salted(big), ["root", "salt"], "left")
    placed = written(placed.select("root", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("sparse", F.lit(False)).alias("sparse"), F.col("v").alias("node")), "placed")
    side = lambda: F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("side")
    whole = placed.filter("not sparse").select("node", F.col("root").alias("g"), F.lit(None).cast("long").alias("band"), "n", side())
    inside = shared.join(placed.filter("sparse").select("node"), "node")
    inside = inside.select("node", F.col("band").cast("string").alias("g"), "band", "n", side())
    tasks = whole.unionByName(inside).select("node", "g", "band", "side", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    tasks = tasks.groupBy("node").agg(F.collect_list(F.struct("g", "band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")).alias("tasks"))
    tasks = tasks.join(nodes.select("node", "key", "class_id", "bands"), "node")
    texts = d.select(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("at"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("key", key(F.col("id"), F.col("at")))
    found = _hashed(texts.join(tasks, "key").filter("at = node").select("node", "class_id", "text", "bands", "tasks"), words)
    dealt = found.select("node", "class_id", "sets", "bands", F.explode("tasks").alias("x"))
    dealt = dealt.select("x.g", "x.band", "x.i", "x.j", "x.side", vertex("class_id", "node").alias("vertex"), "sets", "bands")
    names, vertex_type = ("none", "id", "node"), f"struct<none:boolean,id:{kind},node:string>"

    def run(key_: tuple, rows: pa.Table) -> pa.Table:
        _, band, left, right = (x.as_py() for x in key_)
        seen: dict[tuple, tuple] = {}
        for v, at, held, own in zip(*(rows.column(c).to_pylist() for c in ("vertex", "side", "sets", "bands")), strict=True):
            # A missing id sorts behind all others, as in the table.
            seen[tuple(v[n] if v[n] is not None or n != "id" else "" for n in names)] = (v, np.frombuffer(held, np.uint64), at, own)
        order = sorted(seen, key=lambda k: (k[0], k[1] if not k[0] else 0, k[2]))
        got = [seen[k] for k in order]
        found = compare(list(range(len(got))), [r[1] for r in got], [r[2] for r in got], left, right, similarity, np.array([r[3] for r in got], np.int64), band)
        kinds = pa.struct([("none", pa.bool_()), ("id", rows.schema.field("vertex").type.field("id").type), ("node", pa.string())])
        return pa.table({"a": pa.array([got[i][0] for i in found[0]], kinds), "links": pa.array(found[1], pa.int64()), "b": pa.array([got[i][0] for i in found[2]], kinds)})

    verified = written(dealt.groupBy("g", "band", "i", "j").applyInArrow(run, f"a {vertex_type}, links long, b {vertex_type}"), "verified")
    links = verified.groupBy(F.col("a.node").alias("node")).agg(F.sum("links").alias("n_links"))
    # Vertices sort by their least id, so that a component's root is the group's head itself.
    groups = components(verified.select("a", "b"), "groups")
    of = groups.select(F.col("v.node").alias("node"), F.col("root.id").alias("group_id"), F.col("root.node").alias("head"))
    info = nodes.drop("bands", "key", "size").join(links, "node", "left").join(of, "node", "left")
    info = info.select("node", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("head", "node").alias("head"))
    # Written, so that the last join stands alone and a class with very many copies may be split.
    info = written(info, "class-info")
    forget(spark, nodes, buckets, shared, candidates, placed, verified, groups)
    return signed, info


def vertex(class_id: str, node: str) -> F.Column:
    """A class as a vertex: ordered by its least id, one without ids last."""
    return F.struct(F.col(class_id).isNull().alias("none"), F.col(class_id).alias("id"), F.col(node).alias("node"))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near_duplicates: the one with its least id; all columns stay as they are.

    Among rows of one id and text any one stays. A group without any id keeps one row all the same. Null, empty and blank
    texts have no near copies, so each such text keeps one row for all its equals; an empty table stays empty, and
    columns of any name pass through.
    """
    # Heads come from the classes, one row each: the rows of a class with very many copies meet nowhere.
    signed, info = _grouped(docs, words, similarity, id_col, text_col)
    forget(docs.sparkSession, signed)
    heads = info.filter("node = head").select(F.col("node").alias("__node"), F.col("class_id").alias("__id"))
    d = docs.withColumn("__at", F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    d = d.join(heads, (F.col("__at") == F.col("__node")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    return d.dropDuplicates(["__at", id_col]).select(docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of links and group of every document."""
    tune(spark)
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links", "group_id")
