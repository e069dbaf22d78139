"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass of Viterbi."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, tune

MARK = "▁"  # fixed value of the format: stands for a blank
UNIGRAM, BPE = 1, 2  # fixed values of the format: kinds of models
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # fixed values of the format: kinds of pieces
UNKNOWN_PENALTY = 10.0  # fixed value of the format: how far an unknown character is below the least score
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 200_000, 48, 1_000_000

_MODELS: dict[str, "PieceModel"] = {}


class _Words(dict):
    """Ids of words that were seen, of two generations; others are encoded on their first use."""

    def __init__(self, model: "PieceModel", older: dict[str, bytes]) -> None:
        self.model, self.older = model, older

    def __missing__(self, w: str) -> bytes:
        out = self.older.get(w)
        if out is None:
            ids = self.model.ids(MARK + w)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(w) <= CACHE_CHARS:
            self[w] = out
        return out


class PieceModel:
    """Encodes and decodes with the pieces of a model file; ids equal those of the sentencepiece library.

    The automaton reads a word once; at each position its output links give every piece that ends there, the longest
    first, and each relaxes the best path to that position. Unigram models add scores. In a BPE model a piece may
    follow another only if merging the two strings' characters by score gives these two pieces; of the pieces that end
    at a position exactly one continues a path so, and a path that has it is the merge order's own result.
    """

    def __init__(self, path: str, kind: int | None = None) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or any(p.type == USER for p in m.pieces):
            raise NotImplementedError("models with a character map, squeezed blanks or user-defined pieces")
        self.kind, self.prefix, self.fallback = kind or m.trainer_spec.model_type, n.add_dummy_prefix, m.trainer_spec.byte_fallback
        if self.kind not in (UNIGRAM, BPE):
            raise NotImplementedError(f"models of kind {self.kind}")
        self.score = [p.score for p in m.pieces]
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.piece = [p.piece for p in m.pieces]
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        low = min((self.score[i] for i in self.id.values()), default=0.0)
        self.unknown_score = low - UNKNOWN_PENALTY
        self.surface = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else b" \xe2\x81\x87 " if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode() for p in m.pieces]
        self.single = {p for p in self.id if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.kind == UNIGRAM or self.merged(p) == [i]:
                self.automaton.add_word(p, (len(p), i, self.score[i]))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}  # by the left piece's number times the vocabulary's size plus the right one's
        self.words = _Words(self, {})
        #: No piece has a mark after another character, so words can be encoded apart.
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)

    @classmethod
    def of(cls, path: str, kind: int | None = None) -> PieceModel:
        key = f"{path}:{kind}"
        if key not in _MODELS:
            _MODELS[key] = cls(path, kind)
        return _MODELS[key]

    def merged(self, s: str) -> list[int]:
        """Pieces of s by merging neighbours, the highest score first, then the leftmost."""
        sym, nxt, prv = list(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < len(s) and (p := self.id.get(sym[i] + sym[j])) is not None:
                heapq.heappush(heap, (-self.score[p], i, j, sym[i] + sym[j]))

        for i in range(len(s) - 1):
            push(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not sym[i] or not sym[j] or nxt[i] != j or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j], nxt[i] = both, "", nxt[j]
            if nxt[i] < len(s):
                prv[nxt[i]] = i
            if prv[i] >= 0:
                push(prv[i])
            push(i)
        return [self.id.get(x, -1) for x in sym if x]

    def _pair(self, a: int, b: int) -> bool:
        key = a * len(self.piece) + b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged(self.piece[a] + self.piece[b]) == [a, b]
        return ok

    def path(self, s: str) -> list[int]:
        """Pieces of a word; -1 for a character that no piece has."""
        if self.kind == BPE:
            if self.single.issuperset(s):
                return self._merge_path(s)
            out, at = [], 0
            for i, c in enumerate(s):  # nothing merges with a character that has no piece
                if c not in self.single:
                    out += [*self._merge_path(s[at:i]), -1]
                    at = i + 1
            return out + self._merge_path(s[at:])
        n = len(s)
        last, start, best = [-2] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
        last[0], at = -1, 0

        def unknowns(to: int) -> None:
            """Relaxes the positions after characters without a piece, up to `to`."""
            nonlocal at
            for i in range(at, to):
                if s[i] not in self.single and last[i] != -2 and (last[i + 1] == -2 or best[i] + self.unknown_score > best[i + 1]):
                    last[i + 1], start[i + 1], best[i + 1] = -1, i, best[i] + self.unknown_score
            at = max(at, to)

        for end, (size, piece, score) in self.automaton.iter(s):
            unknowns(end)
            a, end = end + 1 - size, end + 1
            if last[a] != -2 and (last[end] == -2 or best[a] + score > best[end]):
                last[end], start[end], best[end] = piece, a, best[a] + score
        unknowns(n)
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def _merge_path(self, s: str) -> list[int]:
        """Pieces of a BPE string all of whose characters are pieces: the first piece that fits its left neighbour stays."""
        if s.startswith(MARK * 2):
            return self.merged(s)  # runs of marks have one score in common, so that places decide their order
        last, start, pairs, n = [-1] * (len(s) + 1), [0] * (len(s) + 1), self.pairs, len(self.piece)
        for end, (size, piece, _) in self.automaton.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            a = end - size
            if a:
                ok = pairs.get(last[a] * n + piece)
                if not (self._pair(last[a], piece) if ok is None else ok):
                    continue
            last[end], start[end] = piece, a
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at = start[at]
        out.reverse()
        return out

    def ids(self, s: str) -> list[int]:
        """Ids of a string whose blanks are marks; unknown characters become bytes, or one unknown id a run."""
        out, at, path = [], 0, self.path(s)
        if -1 not in path:
            return path
        for p in path:
            if p >= 0:
                out.append(p)
                at += len(self.piece[p])
                continue
            if self.fallback:
                out += [self.byte[b] for b in s[at].encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at += 1
        return out

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not text:
            return b""
        if len(self.words) > CACHE_WORDS:  # what the last generation used again lives on, the rest goes
            self.words.older = {}
            self.words = _Words(self, self.words)
        if self.prefix and self.apart and MARK not in text and "  " not in text and text[0] != " ":
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        s = (MARK if self.prefix else "") + text.replace(" ", MARK)
        parts = re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", s) if self.apart else [s]
        flat = [i for x in parts for i in self.ids(x)]
        if not self.fallback:  # a run of unknown characters may cross words only without marks between them
            flat = [i for k, i in enumerate(flat) if not (i == self.unknown and k and flat[k - 1] == i)]
        return np.array(flat, "<u4").tobytes()

    def decode(self, packed: bytes) -> str:
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw[:1] == " " else raw


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", kind: int | None = None) -> DataFrame:
    """id_col and ids (binary, little-endian unsigned 32-bit) of every text; null and empty texts have no ids.

    Rows stay one to one: repeated rows, null ids and ties need no rule. `kind` reads a model's pieces as of another kind.
    """
    typ = dict(docs.dtypes)[id_col]

    def run(ids: list, texts: list) -> dict:
        m = PieceModel.of(model, kind)
        return {id_col: _arr(ids, typ), "ids": _arr([m.packed(t) for t in texts], "binary")}

    return map_texts(docs, run, f"{id_col} {typ}, ids binary", id_col, text_col)


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text of every row of ids; null ids give the empty text."""
    typ = dict(encoded.dtypes)[id_col]

    def run(ids: list, packed: list) -> dict:
        m = PieceModel.of(model)
        return {id_col: _arr(ids, typ), "text": _arr([m.decode(p or b"") for p in packed], "string")}

    return map_texts(encoded, run, f"{id_col} {typ}, text string", id_col, ids_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: n_tokens, ids_crc32, decoded_sha256 of the text decoded from its ids, and whether it equals the input."""
    typ = dict(docs.dtypes)[id_col]

    def run(ids: list, texts: list) -> dict:
        m = PieceModel.of(model)
        packed = [m.packed(t) for t in texts]
        back = [m.decode(p) for p in packed]
        return {
            id_col: _arr(ids, typ), "n_tokens": _arr([len(p) // 4 for p in packed], "bigint"), "ids_crc32": _arr([zlib.crc32(p) for p in packed], "bigint"),
            "decoded_sha256": _arr([hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back], "string"), "round_trip": [b == (t or "") for b, t in zip(back, texts, strict=True)],
        }

    return map_texts(docs, run, f"{id_col} {typ}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean", id_col, text_col)


def _arr(values: list, kind: str):
    import pyarrow as pa

    return pa.array(values, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}.get(kind))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the 32k piece model and decoded again."""
    tune(spark)
    return round_trip(table(spark, sf_dir, "documents"), model_path())
