"""CRC-32 of words that are put together, from the words' own: a shift by a length is a linear map over GF(2)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

NEAR, PART = 64, 1 << 20


def _applied(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map `table` (one row of 256 images a byte of the register) of every register in x."""
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps of 0 to NEAR - 1 zero bytes, and of NEAR * 2^k of them."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    near = [one]
    one = one >> np.uint32(8) ^ step[one & 255]
    for _ in range(NEAR):
        near.append(_applied(one, near[-1]))
    far = [near.pop()]
    for _ in range(40):
        far.append(_applied(far[-1], far[-1]))
    return np.stack(near), far


_CLOSE, _FAR = _tables()
BLANK = np.uint32(zlib.crc32(b" "))


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What each CRC adds to that of a text with n more bytes: the matrix of n, or the product of those of its binary digits."""
    near, far = n & (NEAR - 1), n // NEAR
    out = _CLOSE[near, 0, crc & 255] ^ _CLOSE[near, 1, crc >> 8 & 255] ^ _CLOSE[near, 2, crc >> 16 & 255] ^ _CLOSE[near, 3, crc >> 24]
    k = 0
    while far.any():
        rows = np.flatnonzero(far & 1)
        out[rows] = _applied(_FAR[k], out[rows])
        far, k = far >> 1, k + 1
    return out


def joined(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC of texts whose first parts have CRC a, and whose second parts CRC b and n bytes."""
    return shifted(a, n) ^ b


class Words(dict):
    """Numbers of words, in the order in which they come. The CRC of a word is taken once, when it gets its number."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.crc: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.words)
        self.words.append(word)
        self.crc.append(zlib.crc32(word))
        return k

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def crcs(self) -> np.ndarray:
        return np.array(self.crc, np.uint32)

    def sizes(self) -> np.ndarray:
        return np.fromiter(map(len, self.words), np.int64, len(self.words))


def parts(raw: bytes, size: int = PART) -> Iterator[list[bytes]]:
    """The words between blanks, of about `size` bytes at a time, so that a very long text is never a list as a whole."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end
