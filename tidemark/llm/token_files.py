"""Token-ID files: byte-level BPE ids in range-coded blocks (static rANS), with checkpoints and checksums."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, gathered, scratch, table, tune

END_ID = 0
LANES, BLOCK = 2048, 1 << 18  # lanes of a block, and tokens after which it ends with the document
PRECISION = 18  # bits of the frequency table, more for vocabularies that need them
LOW = np.uint64(1 << 31)
CACHE_WORDS, CACHE_BYTES, CACHE_CHARS = 1_500_000, 64 << 20, 48  # words that a worker remembers, their bytes, and the longest
BATCH = 12 << 20  # bytes of text that are encoded at once, so that words repeat within

_TOKENIZERS: dict[str, "WordEncoder"] = {}


class Pool:
    """Words that were encoded already, and their ids: compact arrays, of which the half used last survives a full pool."""

    def __init__(self, dtype: str) -> None:
        self.words = pa.array([], pa.binary())
        self.off, self.len, self.used, self.ids, self.clock = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, dtype), 0

    def places(self, words: pa.Array, learn) -> np.ndarray:
        """Place of each of these distinct words; learn(words) gives the new ones with their ids and lengths."""
        self.clock += 1
        if len(self.words) > CACHE_WORDS or len(self.ids) + self.words.nbytes > CACHE_BYTES:
            short = np.flatnonzero(pc.binary_length(self.words).to_numpy() <= CACHE_CHARS)
            kept = np.sort(short[np.argsort(self.used[short], kind="stable")[len(short) // 2 :]])
            self.ids = take_runs(self.ids, self.off[kept], self.len[kept])
            self.words, self.len, self.used = self.words.take(pa.array(kept)), self.len[kept], self.used[kept]
            self.off = np.cumsum(self.len, dtype=np.int64) - self.len
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new, ids, lengths = learn(words.filter(at.is_null()))
            self.words = pa.concat_arrays([self.words, new])
            self.off = np.concatenate([self.off, len(self.ids) + np.cumsum(lengths) - lengths])
            self.len = np.concatenate([self.len, lengths.astype(np.int32)])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])
            self.ids = np.concatenate([self.ids, ids])
            at = pc.if_else(at.is_valid(), at, pc.add(pc.index_in(words, value_set=new), len(self.words) - len(new)))
        place = at.to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[place] = self.clock
        return place


def take_runs(values: np.ndarray, off: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[off : off + length] of every run, one after the other."""
    total = int(lengths.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((off - (np.cumsum(lengths) - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at]


class WordEncoder:
    """Ids of texts by the tokenizers library, which sees each distinct word once.

    A byte-level pre-tokenizer starts a new token at every blank that has no white space before it, so a text can be
    cut there and its words encoded apart. Texts in which a blank stands between white space or at the end, and texts
    with the string of a special token, are encoded whole. So are all texts of a tokenizer that works otherwise: with a
    normaliser, another pre-tokenizer, or pieces that know where a word begins or ends.
    """

    #: What the cut at blanks is right for.
    BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    PLAIN = ("dropout", "continuing_subword_prefix", "end_of_word_suffix")

    ODD = re.compile(r"\s (?:\s|\Z)|\A (?:\s|\Z)| \Z")
    #: Letters of any version of Unicode, then signs; then perhaps a line feed and the same again.
    LETTERS, SIGNS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-/:-@\[-`{-~]*"
    PARTS = rf"^(?P<a>{LETTERS})(?:(?P<b>{SIGNS})|(?P<b2>{SIGNS}\n)(?P<c>{LETTERS})(?P<d>{SIGNS}))$"
    TOGETHER = 1000  # words that the library sees as one text

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        before, model = told.get("pre_tokenizer") or {}, told["model"]
        self.cuts = not told.get("normalizer") and all(before.get(k) == v for k, v in self.BYTE_LEVEL.items()) and model["type"] == "BPE" and not any(model.get(k) for k in self.PLAIN)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.bytes = 2 if size <= 1 << 16 else 4
        self.dtype = f"<u{self.bytes}"
        #: Bytes of each id: a byte-level piece has one character a byte.
        self.length = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.later, self.bare = Pool(self.dtype), Pool(self.dtype)  # words with a blank before them, and without

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], self.dtype), np.array(list(map(len, got)), np.int64)

    def _later(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words in an order of their own, their ids with a blank before each, and the lengths of these.

        Words with white space at an edge go alone, as next to another blank they'd be cut otherwise; of the others many
        make one text, and are told apart by the bytes of their ids.
        """
        plain = words.cast(pa.string())
        edgy = pc.or_(pc.equal(plain, ""), pc.not_equal(pc.utf8_trim_whitespace(plain), plain))
        alone, words = words.filter(edgy), words.filter(pc.invert(edgy))
        ids, lengths = map(lambda x: [x], self._encoded([" " + t for t in alone.cast(pa.string()).to_pylist()]))
        texts, size = words.cast(pa.string()).to_pylist(), pc.binary_length(words).to_numpy().astype(np.int64) + 1
        cuts = range(0, len(texts), self.TOGETHER)
        for k, e in zip(cuts, self.tokenizer.encode_batch_fast([" " + " ".join(texts[k : k + self.TOGETHER]) for k in cuts], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.length[got]), np.cumsum(size[k : k + self.TOGETHER])) + 1
            ids.append(got.astype(self.dtype))
            lengths.append(np.diff(ends, prepend=0))
        return pa.concat_arrays([alone, words]), np.concatenate(ids), np.concatenate(lengths)

    def _bare(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        return words, *self._encoded(words.cast(pa.string()).to_pylist())

    def _words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words behind a blank, one after the other, and their lengths. Letters that signs follow, and perhaps a
        line feed and such a word once more, are tokens of their own, and fewer than the words that they make."""
        cut = pc.extract_regex(distinct.cast(pa.string()), self.PARTS)
        some = cut.is_valid()
        part = lambda k: pc.if_else(some, pc.struct_field(cut, k), "").cast(pa.binary())
        parts = [pc.if_else(some, part("a"), distinct), pc.binary_join_element_wise(part("b"), part("b2"), b""), part("c"), part("d")]
        ids, off, lengths = [], [], []
        at = 0
        for pool, learn, p in ((self.later, self._later, parts[0]), *((self.bare, self._bare, p) for p in parts[1:])):
            coded = pc.dictionary_encode(p)
            place = pool.places(coded.dictionary, learn)[coded.indices.to_numpy()]
            off.append(pool.off[place] + at)
            lengths.append(pool.len[place])
            ids.append(pool.ids)
            at += len(pool.ids)
        lengths = np.stack(lengths, axis=1)
        return take_runs(np.concatenate(ids), np.stack(off, axis=1).ravel(), lengths.ravel()), lengths.sum(axis=1, dtype=np.int64)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the id `end` behind it, and their lengths. Null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            ids, lengths = self._encoded(texts.to_pylist())
            return np.insert(ids, np.cumsum(lengths), end), lengths + 1
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= np.asarray(pc.match_substring(texts, s).to_numpy(zero_copy_only=False), bool)
        words = pc.split_pattern(texts.cast(pa.binary()), b" ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(words.flatten())
        distinct, index, bounds = coded.dictionary, coded.indices.to_numpy(), bounds - bounds[0]
        plain = distinct.cast(pa.string())
        empty = pc.equal(plain, "").to_numpy(zero_copy_only=False)
        starts_blank = empty | pc.not_equal(pc.utf8_ltrim_whitespace(plain), plain).to_numpy(zero_copy_only=False)
        if starts_blank.any():
            for k in np.unique(np.searchsorted(bounds, np.flatnonzero(starts_blank[index]), side="right") - 1).tolist():
                whole[k] |= self.ODD.search(texts[k].as_py()) is not None
        # A text's first word has no blank before it; a text that can't be cut is one long first word.
        heads = plain.take(pa.array(index[bounds[:-1]])).to_pylist()
        for k in np.flatnonzero(whole).tolist():
            heads[k] = texts[k].as_py()
        each = list(dict.fromkeys(heads))
        ids, lengths = self._encoded(each)
        number = dict(zip(each, range(len(each)), strict=True))
        later, later_size = self._words(distinct)
        size = np.concatenate([later_size, lengths, [1]])
        ids = np.concatenate([later, ids, np.array([end], self.dtype)])
        off = np.cumsum(size) - size
        run = np.empty(len(index) + len(texts), np.int64)  # each text's words, then the end
        last = bounds[1:] + np.arange(len(texts))
        inner = np.ones(len(run), bool)
        inner[last] = False
        run[inner] = index
        run[last] = len(off) - 1
        run[bounds[:-1] + np.arange(len(texts))] = len(distinct) + np.fromiter(map(number.__getitem__, heads), np.int64, len(heads))
        if whole.any():  # only their first "word" and the end stay
            keep = np.ones(len(run), bool)
            for k in np.flatnonzero(whole).tolist():
                keep[bounds[k] + k + 1 : bounds[k + 1] + k] = False
            counts = np.add.reduceat(keep, bounds[:-1] + np.arange(len(texts)))
            run = run[keep]
        else:
            counts = np.diff(bounds) + 1
        sizes = size[run]
        return take_runs(ids, off[run], sizes), np.add.reduceat(sizes, np.cumsum(counts) - counts) if len(texts) else np.zeros(0, np.int64)


class RangeTable:
    """Frequencies scaled to a power of two; ids that occur have one part at least, others none."""

    def __init__(self, counts: dict[int, int], size: int) -> None:
        n = np.zeros(size, np.float64)
        for i, c in counts.items():
            n[i] = c
        self._set(self._scaled(n))

    @classmethod
    def of(cls, freq: np.ndarray) -> RangeTable:
        """The table of frequencies that are scaled already, as files hold them."""
        t = cls.__new__(cls)
        t._set(freq.astype(np.int64))
        return t

    @staticmethod
    def _scaled(n: np.ndarray) -> np.ndarray:
        seen = np.flatnonzero(n)
        total = 1 << max(PRECISION, int(len(seen)).bit_length() + 2)
        freq = np.zeros(len(n), np.int64)
        if len(seen):
            freq[seen] = np.maximum(1, np.floor(n[seen] * (total / n[seen].sum()))).astype(np.int64)
            spare = total - int(freq.sum())
            order = seen[np.lexsort((seen, -n[seen]))]
            if spare >= 0:
                freq[order[0]] += spare
            for i in order if spare < 0 else ():  # give back what the least parts took, from the most frequent on
                take = min(-spare, int(freq[i]) - 1)
                freq[i] -= take
                spare += take
                if not spare:
                    break
        return freq

    def _set(self, freq: np.ndarray) -> None:
        self.bits = max(0, int(freq.sum()).bit_length() - 1)
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.lookup = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = 0) -> bytes:
        """One block: count, lanes, rows between checkpoints, then for each checkpoint its place among the words, for each
        the state of every lane, and last the words that the lanes share. every: ids after which a checkpoint stands
        (BLOCK if 0), so that a block with a long document can be entered in its middle, and decoded in parts."""
        n, shift, low32 = len(ids), np.uint64(32), np.uint64(0xFFFFFFFF)
        k = max(1, min(lanes, n))
        step = max(1, (every or BLOCK) // k)
        f, c, bits, room = self.freq[ids], self.cum[ids], np.uint64(self.bits), np.uint64(63 - self.bits)
        x, out, written, places, states = np.full(k, LOW, np.uint64), [], 0, [], []
        for row in range(-(-n // k) - 1, -1, -1):
            at = row * k
            fs, cs = f[at : at + k], c[at : at + k]
            xs = x[: len(fs)]
            full = xs >= (fs << room)
            if full.any():
                out.append((xs[full] & low32).astype("<u4"))
                written += len(out[-1])
                xs = np.where(full, xs >> shift, xs)
            q = xs // fs
            x[: len(fs)] = (q << bits) + (xs - q * fs) + cs
            if row % step == 0:
                places.append(written)
                states.append(x.astype("<u8").tobytes())
        words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
        head = struct.pack("<III", n, k, step) + (written - np.array(places[::-1], np.int64)).astype("<u8").tobytes()
        return head + b"".join(states[::-1]) + words.tobytes()

    def decode(self, block: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids[start:stop] of a block, from the checkpoint before start to the one after stop, whose state is compared."""
        n, k, step = struct.unpack_from("<III", block)
        rows = -(-n // k)
        marks = -(-rows // step)
        places = np.frombuffer(block, "<u8", marks, 12).astype(np.int64)
        states = np.frombuffer(block, "<u8", marks * k, 12 + 8 * marks).reshape(marks, k)
        words = np.frombuffer(block, "<u4", offset=12 + 8 * marks * (k + 1)).astype(np.uint64)
        stop = n if stop is None else min(stop, n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // (k * step), -(-stop // (k * step))
        x, at, end = states[first].astype(np.uint64), int(places[first]), min(n, last * step * k)
        out, bits, mask, shift = np.empty(end - first * step * k, np.uint32), np.uint64(self.bits), np.uint64((1 << self.bits) - 1), np.uint64(32)
        for i in range(0, len(out), k):
            xs = x[: min(k, len(out) - i)]
            slot = xs & mask
            ids = self.lookup[slot]
            xs = self.freq[ids] * (xs >> bits) + slot - self.cum[ids]
            low = np.flatnonzero(xs < LOW)
            if len(low):
                if at + len(low) > len(words):
                    raise ValueError("the block has too few words")
                xs[low] = (xs[low] << shift) | words[at : at + len(low)]
                at += len(low)
            x[: len(xs)] = xs
            out[i : i + len(xs)] = ids
        want = (int(places[last]), states[last]) if last < marks else (len(words), np.full(k, LOW, np.uint64))
        if at != want[0] or (x != want[1]).any():
            raise ValueError("the block doesn't end in the state of its next checkpoint")
        return out[start - first * step * k : stop - first * step * k]


def _binary(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of ids as a binary column."""
    offsets = np.concatenate([[0], np.cumsum(lengths * ids.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def _flat(column: pa.Array, dtype: str) -> np.ndarray:
    """The ids of a binary column's rows one after the other, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    return np.frombuffer(data, dtype, (int(ends[-1]) - int(ends[0])) // np.dtype(dtype).itemsize, int(ends[0])) if data else np.zeros(0, dtype)


def _encoded(docs: DataFrame, path: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, tie and the ids of every row, the end id included, in the narrowest width; and for each task one row with
    its counts of all ids, so that no second pass over the ids is needed. tie is a checksum of the ids."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        e = WordEncoder.of(path)
        total, of = np.zeros(size, np.int64), None
        for b in gathered(batches, BATCH):
            flat, lengths = e.encode(b.column(1), END_ID)
            total += np.bincount(flat, minlength=size)
            ids, of, n = _binary(flat, lengths), b.column(0).type, len(lengths)
            ties = pa.array([zlib.crc32(x) for x in ids.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), ties, ids, pa.nulls(n, pa.binary())], ["id", "n", "tie", "ids", "counts"])
        if of is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, of), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["id", "n", "tie", "ids", "counts"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, tie long, ids binary, counts binary")


def _counts(encoded: DataFrame) -> dict[int, int]:
    """How often each id occurs in all rows, from the tasks' counts: at most as many rows as ids reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                n = np.frombuffer(x, "<i8")
                total = n if total is None else total + n
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["t", "n"])

    rows = encoded.select("counts").filter("counts is not null").mapInArrow(run, "t int, n long")
    return {r["t"]: r["n"] for r in rows.groupBy("t").agg(F.sum("n").alias("n")).collect()}


def write_token_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", work: str | None = None) -> None:
    """Writes the ids of all texts, each ended by id 0, in ascending order of id_col (nulls first; ties by a checksum of
    their ids, equal rows in any order). Ids may be of any type that Spark sorts; other columns aren't read.

    `path`/blocks are Parquet files with one row a block: its part and number, the part's tokens before it, its
    documents with their lengths, a checksum of the ids, a checksum of the data, and the range-coded data. A block ends
    with the first document that fills 2^18 tokens; a checkpoint stands in it after every 2^18 tokens. `path`/table
    holds the frequencies of all rows, which every block shares, so that the files need nothing else to be read. Null
    and empty texts have the end id only; an empty table gives no blocks and an empty table of frequencies. Repeated
    rows are written as often as they come, and rows of one id may be spread over parts. Files go through Spark's
    committer: a lost task leaves none behind.
    """
    spark = docs.sparkSession
    probe = WordEncoder.of(tokenizer)
    dtype, size, kind = probe.dtype, max(probe.tokenizer.get_vocab_size(), END_ID + 1), dict(docs.dtypes)[id_col]
    raw = work or scratch(spark, "token-ids")
    encoded = _encoded(docs, tokenizer, size, id_col, text_col)
    encoded.write.option("compression", "zstd").parquet(raw)
    encoded = spark.read.schema(encoded.schema).parquet(raw)
    ranges = RangeTable(_counts(encoded), size)
    table_ = [(i, int(ranges.freq[i])) for i in np.flatnonzero(ranges.freq).tolist()]
    spark.createDataFrame(pd.DataFrame(table_, columns=["id", "freq"]).astype("int64"), "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(ranges)
    schema = block_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, t = TaskContext.get().partitionId(), shared.value
        block = first = 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, lens, flat = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            data = t.encode(flat)
            ends = pa.array([0, len(ids)], pa.int32())
            cols = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, pa.array(lens, pa.int32()))]
            cols += [pa.array([zlib.crc32(flat.astype("<u4").tobytes())], pa.int64()), pa.array([zlib.crc32(data)], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

        have = 0
        for b in batches:
            lens, flat, at = b.column(1).to_numpy(), _flat(b.column(2), dtype), 0
            ends = np.cumsum(lens)
            while at < len(lens):  # up to the document that fills the block
                base = int(ends[at - 1]) if at else 0
                stop = min(int(np.searchsorted(ends, base + BLOCK - have)) + 1, len(lens))
                # Copied, so that what is held doesn't keep whole batches.
                held.append((b.column(0).slice(at, stop - at), lens[at:stop], flat[base : int(ends[stop - 1])].copy()))
                have, at = have + int(ends[stop - 1]) - base, stop
                if have >= BLOCK:
                    yield flush()
                    block, first, have, held = block + 1, first + have, 0, []
        if held:
            yield flush()

    # The last key parts the rows of one id and text, which a range alone would leave in one task.
    ids = encoded.filter("counts is null").select("id", "n", "ids", "tie", F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("row")]
    ids.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "n", "ids").mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    shared.destroy()
    forget(spark, raw)


def block_schema(kind: str) -> str:
    return f"part int, block int, first long, doc_ids array<{kind}>, doc_tokens array<int>, ids_crc32 long, data_crc32 long, data binary"


def read_table(spark: SparkSession, path: str) -> RangeTable:
    """The shared frequencies of the files under `path`; as many rows as the vocabulary has ids."""
    rows = spark.read.schema("id long, freq long").parquet(f"{path}/table").collect()
    freq = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    return RangeTable.of(freq)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row a document of the files under `path`: id_col, start (tokens of all documents before it), n_tokens,
    ids_crc32, and ids if asked for. Blocks are decoded apart, in parallel; both checksums are tested, and a damaged
    block fails the read. Files of an empty table give no rows; null and repeated ids come out as they went in.
    """
    kind = spark.read.parquet(f"{path}/blocks").schema["doc_ids"].dataType.elementType.simpleString()
    blocks = spark.read.schema(block_schema(kind)).parquet(f"{path}/blocks")
    shared = spark.sparkContext.broadcast(read_table(spark, path))
    # One row a part, of which there are as many as write tasks: some bytes each, so they are summed and broadcast.
    parts = blocks.select("part", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(parts), "part").select((F.col("base") + F.col("first")).alias("start"), "doc_ids", "doc_tokens", "ids_crc32", "data_crc32", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            for r in range(b.num_rows):
                start, ids_crc, data_crc, data = (b.column(k)[r].as_py() for k in (0, 3, 4, 5))
                if zlib.crc32(data) != data_crc:
                    raise ValueError("the data's checksum is wrong")
                ids = t.decode(data).astype("<u4")
                if zlib.crc32(ids.tobytes()) != ids_crc:
                    raise ValueError("the ids' checksum is wrong")
                doc_ids, lens = b.column(1)[r].values, b.column(2)[r].values.to_numpy().astype(np.int64)
                ends = np.cumsum(lens)
                each = [ids[a:e] for a, e in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
                cols = [doc_ids, pa.array(ends - lens + start, pa.int64()), pa.array(lens, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)

    return placed.mapInArrow(run, f"{id_col} {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the files of the 50k byte-level vocabulary."""
    import public_tokenizers

    tune(spark)
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path)
