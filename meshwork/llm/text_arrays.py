"""Words and word shingles of whole Arrow batches as numpy arrays.

A batch's texts lie in one byte buffer; each function works on a slice of whole texts of that buffer, so memory
follows ``SLICE_BYTES`` (or one text where a single text is longer), not the batch. A word is a maximal run of bytes
outside ``\\x20\\x09-\\x0D``. Hashes are 64-bit: the sum of a random value per byte times a power of an odd constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


with np.errstate(over="ignore"):
    _RAW = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    #: Factors of the words of a shingle, by place.
    PLACE = mix(np.arange(1000, 1064, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_STEP = 0x9E3779B97F4A7C55
_UNSTEP = pow(_STEP, -1, 1 << 64)


def byte_values(lower: bool, spaces: bool) -> np.ndarray:
    values = _RAW.copy()
    if lower:
        values[65:91] = values[97:123]
    if not spaces:
        values[SPACE] = 0
    return values


WORD_EXACT, WORD_LOWER, LINE_BYTES = byte_values(False, False), byte_values(True, False), byte_values(False, True)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the step and of its inverse; those of a slice are kept."""
    if n > len(_powers[0]):
        made = []
        for step in (_STEP, _UNSTEP):
            steps = np.full(n, step, U64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U64))
        if n > 4 * SLICE_BYTES:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of at most ``limit`` bytes, or one longer text. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the text (by place in the slice) of each word."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to the next; bytes of value 0 don't count."""
    if not len(starts):
        return np.empty(0, U64)
    up, down = powers(len(data))
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(values[data] * up, starts) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the text it is in."""
    starts, _, text = word_bounds(data, offsets)
    return run_hashes(data, starts, values), text


def shingle_hashes(words: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, with the text of each, in order; a text with fewer words (but some) gives
    its whole sequence as one."""
    count = np.bincount(text, minlength=n_texts)
    with np.errstate(over="ignore"):
        if len(words) >= size:
            total = words[: len(words) - size + 1] * PLACE[0]
            for k in range(1, size):
                total += words[k : len(words) - size + 1 + k] * PLACE[k]
            whole = text[: len(words) - size + 1] == text[size - 1 :]
            found, of = mix(total[whole]), text[: len(words) - size + 1][whole]
        else:
            found, of = np.empty(0, U64), np.empty(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            begin = np.concatenate([[0], np.cumsum(count)])[short]
            extra = np.zeros(len(short), U64)
            for k in range(size - 1):
                has = count[short] > k
                extra[has] += words[begin[has] + k] * PLACE[k]
            found = np.concatenate([found, mix(extra + count[short].astype(U64) * PLACE[size])])
            of = np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            found, of = found[order], of[order]
    return found, of


def shingle_sets(texts: pa.Array, size: int, values: np.ndarray = WORD_LOWER) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, in row order."""
    for _, data, offsets in slices(texts):
        n = len(offsets) - 1
        found, of = shingle_hashes(*word_hashes(data, offsets, values), n, size)
        ends = np.searchsorted(of, np.arange(n), "right")
        begin = 0
        for end in ends:
            yield np.unique(found[begin:end])
            begin = end
