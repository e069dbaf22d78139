"""Media columns: bytes as 8-bit grey PNG, chunk checksums, numpy unfiltering and low-frequency cosine hashes."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

UNIT, WIDTH, FILL = 576, 24, 255  # payloads are multiples of UNIT = 24 x 24 samples; rows have WIDTH
SIDE, LOW = 32, 8  # the hash: SIDE x SIDE means, LOW x LOW lowest frequencies
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format


class BadImage(ValueError):
    """The bytes aren't a PNG of the kind read here, or are damaged."""


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([FILL]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """8-bit grey PNG of whole rows; each image takes the filter (none, left, up) with the least absolute sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    cost = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in (rows, left, up)]
    kind = cost.index(min(cost))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, (rows, left, up)[kind]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered one-byte rows; runs of rows with filter none, left or up are undone together."""
    kinds, body = lines[:, 0], lines[:, 1:]
    out = np.empty_like(body)
    i, n, prior = 0, len(lines), np.zeros(body.shape[1], np.uint8)
    while i < n:
        kind, j = kinds[i], i + 1
        if kind <= 2:
            while j < n and kinds[j] == kind:
                j += 1
            run = body[i:j]
            if kind == 0:
                out[i:j] = run
            elif kind == 1:
                out[i:j] = np.cumsum(run, axis=1, dtype=np.uint8)
            else:
                out[i:j] = np.cumsum(np.vstack([prior, run]), axis=0, dtype=np.uint8)[1:]
        elif kind <= 4:
            a = c = 0
            row = out[i]
            for x, (v, b) in enumerate(zip(body[i].tolist(), prior.tolist(), strict=True)):
                if kind == 3:
                    p = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if pa <= pb and pa <= pc else b if pb <= pc else c
                a, c = (v + p) & 255, b
                row[x] = a
        else:
            raise BadImage(f"filter {kind}")
        i, prior = j, out[j - 1]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Rows of an 8-bit grey PNG; every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise BadImage("signature")
    at, parts, head = 8, [], None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise BadImage("checksum")
        at += 12 + n
        if kind == b"IHDR":
            if n != 13:
                raise BadImage("header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
    else:
        raise BadImage("no end")
    if not head or head[2:] != (8, 0, 0, 0, 0):
        raise BadImage("kind of image")
    width, height = head[:2]
    if not width or not height:
        raise BadImage("no samples")
    # One byte more than fits is enough to see that there is too much.
    lines = np.frombuffer(zlib.decompressobj().decompress(b"".join(parts), height * (width + 1) + 1), np.uint8)
    if lines.size != height * (width + 1):
        raise BadImage("size")
    return unfilter(lines.reshape(height, width + 1))


def _cosines(n: int, low: int) -> np.ndarray:
    return np.array([[math.cos(math.pi * k * (2 * i + 1) / (2 * n)) for i in range(n)] for k in range(low)])


_BASIS = _cosines(SIDE, LOW)


def _edges(n: int) -> np.ndarray:
    return np.minimum(np.arange(SIDE) * n // SIDE, n - 1)


def cosine_hash(rows: np.ndarray) -> str:
    """64 bits in hex: means of a SIDE x SIDE grid, its LOW x LOW lowest cosine terms, each against their median.

    Sides under SIDE samples repeat samples. Sums are of integers and terms are rounded, so equal images have equal hashes.
    """
    h, w = rows.shape
    a, b = _edges(h), _edges(w)
    grid = np.add.reduceat(np.add.reduceat(rows.astype(np.int64), a, axis=0), b, axis=1).astype(float)
    grid /= np.outer(np.maximum(np.diff(np.append(a, h)), 1), np.maximum(np.diff(np.append(b, w)), 1))
    terms = np.round(_BASIS @ grid @ _BASIS.T, 6).ravel()
    bits = terms > np.median(terms[1:])
    return np.packbits(bits).tobytes().hex()


def texts_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and media: the text's UTF-8 bytes, filled with 255 to a positive multiple of 576, as PNG.

    Null texts count as empty; equal texts give equal media. Rows stay one to one, repeated rows and null ids included;
    ids may be of any type. Other columns aren't read, and an empty table gives an empty one.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array([encode_png(payload_of(t)) for t in texts], pa.binary())], [id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, n_bytes long, media binary")


FEATURES = (("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()), ("error", "string", pa.string()))


def image_features(m: bytes | None) -> tuple:
    """FEATURES of one stored image; a damaged one, one without samples and null have nulls and an error."""
    if m is None:
        return (None,) * 6 + ("null",)
    stored = (len(m), hashlib.sha256(m).hexdigest())
    try:
        rows = decode_png(m)
    except (BadImage, zlib.error, struct.error) as e:
        return (None, None, None, *stored, None, str(e))
    p = rows.tobytes()
    return (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), *stored, cosine_hash(rows), None)


def media_features(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Reads media back: the columns `keep`, of any types, and FEATURES: payload length, digests, cosine hash and error.

    Rows stay one to one; a damaged or null image, and one of no samples, has nulls and its error.
    """
    kinds = dict(media.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{n} {k}" for n, k, _ in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [image_features(m) for m in b.column(b.num_columns - 1).to_pylist()]
            found = [pa.array([r[k] for r in rows], t) for k, (_, _, t) in enumerate(FEATURES)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keep))] + found, [*keep, *(n for n, _, _ in FEATURES)])

    return media.select(*[F.col(f"`{c}`") for c in keep], F.col(media_col)).mapInArrow(run, schema)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as PNG, read back: the image and its features are made in one pass over the texts."""
    tune(spark)
    return media_features(texts_to_media(table(spark, sf_dir, "documents")), keep=("doc_id", "n_bytes")).drop("error")
