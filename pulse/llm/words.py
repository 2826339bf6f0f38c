"""What several operators share: cutting batches, splitting words, hashing words and windows of words.

Hashes are 64-bit and do not depend on the process, so that tasks on different executors agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

#: Bytes of text that a task works on at a time; a longer text is a piece of its own.
PIECE_BYTES = 8 << 20


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a piece have at most ``limit`` bytes, or it is one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    # Idle workers of a long session give back what Arrow holds for reuse.
    pa.default_memory_pool().release_unused()


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts in UTF-8; a missing text is empty."""
    return pc.fill_null(batch.column(column), "").cast(pa.binary()).to_pylist()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's texts; a missing text is empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def split(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text: for bytes, white space is exactly these."""
    return text.split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers by the splitmix rule."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 0x10001)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(z) | np.uint64(1)


def mixed(z: np.ndarray) -> np.ndarray:
    """The bits of every value spread over all 64 places."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes; none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    spread = words ^ (words >> np.uint64(29))
    total = np.zeros(n, np.uint64)
    for k, factor in enumerate(odd_numbers(size, seed)):
        total += spread[k : k + n] * factor
    return mixed(total)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``size`` words that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, n), -1)
    return np.cumsum(step[:n]) > 0


def runs(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Each run of rows with one value of a whole-number column, as one table; the rows come ordered by it."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), batch.num_rows]
        if waiting and waiting[-1].column(column)[0].as_py() != values[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        for start, stop in zip(cuts, cuts[1:]):
            if start:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(start, stop - start))
    if waiting:
        yield pa.Table.from_batches(waiting)
