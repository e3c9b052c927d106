"""Sets of hashed word shingles of texts, worked out on whole blocks of bytes at once."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_U = np.uint64
# Odd multipliers of a 64-bit finaliser.
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def scatter(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = x ^ (x >> _U(33))
    x = x * _M1
    x = x ^ (x >> _U(33))
    x = x * _M2
    return x ^ (x >> _U(33))


def _powers(base: int, n: int) -> np.ndarray:
    found = np.ones(n, _U)
    if n > 1:
        found[1:] = _U(base)
        np.multiply.accumulate(found, out=found)
    return found


class WordHasher:
    """Hashes of the words of texts, letters A to Z in lower case.

    A word is a run of bytes other than space and the controls 9 to 13.
    """

    def __init__(self) -> None:
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.separator = np.zeros(256, bool)
        self.separator[[32, *range(9, 14)]] = True
        self.values = scatter(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))
        self.up = _powers(_BASE, BLOCK_BYTES + 2)
        self.down = _powers(_INVERSE, BLOCK_BYTES + 2)

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first bytes of the words, and the words' hashes."""
        if len(data) + 2 > len(self.up):
            self.up, self.down = _powers(_BASE, len(data) + 2), _powers(_INVERSE, len(data) + 2)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~self.separator[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(self.values[self.lower[data]] * self.up[: len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(_U)
        return starts, scatter(hashes)


    def of_text(self, text: np.ndarray) -> np.ndarray:
        """Hashes of the words of one text of any length, a block of whole words at a time."""
        found, begin = [], 0
        while begin < len(text):
            end = min(len(text), begin + BLOCK_BYTES)
            if end < len(text):
                spaces = np.flatnonzero(self.separator[text[begin:end]])
                if len(spaces):
                    end = begin + int(spaces[-1]) + 1
                else:  # a word longer than a block
                    later = np.flatnonzero(self.separator[text[end:]])
                    end = end + int(later[0]) if len(later) else len(text)
            found.append(self.words(text[begin:end])[1])
            begin = end
        return np.concatenate(found) if found else np.zeros(0, _U)


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(hashes) - width + 1)
    grams = np.zeros(n, _U)
    for k in range(width):
        grams = grams * _U(0x9FB21C651E98DF25) + hashes[k : k + n]
    return scatter(grams)


def _whole(hashes: np.ndarray) -> np.ndarray:
    """The only shingle of a text with fewer words than a shingle has."""
    whole = _U(len(hashes))
    for h in hashes:
        whole = whole * _U(0xD6E8FEB86659FD93) + h
    return scatter(np.array([whole], _U))


def shingle_sets(hasher: WordHasher, texts: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer words make one shingle."""
    found: list[np.ndarray] = []
    block: list[np.ndarray] = []
    size = 0

    def add() -> None:
        space = np.array([32], np.uint8)
        data = np.concatenate([part for text in block for part in (text, space)])
        bounds = np.cumsum([0, *(len(text) + 1 for text in block)])
        starts, hashes = hasher.words(data)
        first = np.searchsorted(starts, bounds)
        grams = _grams(hashes, width)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                found.append(np.unique(grams[a : b - width + 1]))
            else:
                found.append(_whole(hashes[a:b]) if b > a else np.zeros(0, _U))

    with np.errstate(over="ignore"):
        for text in texts:
            if block and size + len(text) > BLOCK_BYTES:
                add()
                block, size = [], 0
            if len(text) > BLOCK_BYTES:
                hashes = hasher.of_text(text)
                one = _grams(hashes, width) if len(hashes) >= width else _whole(hashes)
                found.append(np.unique(one) if len(hashes) else np.zeros(0, _U))
                continue
            block.append(text)
            size += len(text) + 1
        if block:
            add()
    return found


def text_arrays(column: pa.Array) -> list[np.ndarray]:
    """The bytes of the texts of a column; NULL has none."""
    empty = np.zeros(0, np.uint8)
    return [np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else empty for v in column]


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit key of a set as a signed number."""
    with np.errstate(over="ignore"):
        total = tokens.sum(dtype=_U) * _M1 + scatter(tokens).sum(dtype=_U)
        return int(scatter(np.array([total + _U(len(tokens))], _U))[0].astype(np.int64))


def in_sets(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch with the shingle sets of its column `text`."""
    hasher = WordHasher()
    for batch in batches:
        yield batch, shingle_sets(hasher, text_arrays(batch.column("text")), width)
