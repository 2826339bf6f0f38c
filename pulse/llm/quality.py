"""Quality rules (9): counts over words and lines, and bands of compression ratios.

A text is compressed with zstandard as a whole and in chunks of a fixed size; the last chunk of a longer text ends where
the text ends, and counts by the bytes that no other chunk has. A ratio (compressed bytes
by bytes) below its band says that the text repeats itself, one above it that it is no language but noise
or encoded data. Short texts compress worse, so the limits depend on the length.

Defined cases: a missing text is empty: no words, all counts 0, base_failed. Very long texts are read
whole. Repeated rows are judged alone, so ties do not occur. An empty table gives no rows. Other columns
of the table are passed by, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from pulse.llm.words import covered, pieces, raw, split, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"


@dataclass(frozen=True)
class Bands:
    """Limits of the compression ratio: from so many bytes on, (lowest, highest) of a good text."""

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.35, 2.0),
        (512, 0.30, 0.85),
        (1024, 0.30, 0.75),
        (4096, 0.25, 0.70),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.20, 0.70)
    #: Share of a longer text's bytes whose chunks may lie outside their band.
    chunks_outside: float = 0.25
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        return next((low, high) for start, low, high in reversed(self.whole) if size >= start)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, verdict string, whole_ratio double, chunks_low long, chunks_high long, n_chunks long"
)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words in runs of ``size`` words that the text has twice or more, the first one included."""
    hashes = window_hashes(word_hashes(words), size)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    return int(covered(np.flatnonzero(np.isin(hashes, twice)), size, len(words)).sum())


def compression(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[str, float, int, int, int]:
    """(verdict, ratio of the whole, chunks below, chunks above their band, chunks)."""
    if not text:
        return "empty", 0.0, 0, 0, 0
    whole, (low, high) = len(packer.compress(text)) / len(text), bands.limits(len(text))
    size = bands.chunk_bytes
    starts, rest = [*range(0, len(text) - size + 1, size)], len(text) % size
    own = [size] * len(starts)
    if starts and rest:
        starts, own = [*starts, len(text) - size], [*own, rest]
    ratios = [len(packer.compress(text[k : k + size])) / size for k in starts]
    low_at, high_at = [r < bands.chunk[0] for r in ratios], [r > bands.chunk[1] for r in ratios]
    below, above, allowed = sum(low_at), sum(high_at), bands.chunks_outside * sum(own)
    if whole < low or sum(n for n, out in zip(own, low_at) if out) > allowed:
        verdict = "repetitive"
    elif whole > high or sum(n for n, out in zip(own, high_at) if out) > allowed:
        verdict = "incompressible"
    else:
        verdict = "good"
    return verdict, whole, below, above, len(ratios)


def judged(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: the base counts, the base rule, the compression verdict and ``kept``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        for piece in pieces(batches):
            points = pc.utf8_length(pc.fill_null(piece.column("text"), "")).to_pylist()
            rows = []
            for doc_id, text, length in zip(piece.column("doc_id").to_pylist(), raw(piece), points):
                words = split(text)
                n, repeated = len(words), repeated_words(words)
                failed = n < 50 or 100 * repeated > 50 * n
                verdict, *figures = compression(text, bands, packer)
                spaces = len(text) - len(text.translate(None, SPACES))
                symbols = len(text) - len(text.translate(None, SYMBOLS))
                rows.append(
                    (doc_id, n, length - spaces, symbols, duplicate_lines(text), repeated, failed)
                    + (not failed and verdict == "good", verdict, *figures)
                )
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
TYPES = [_ARROW[part.split()[1]] for part in SCHEMA.split(", ")]


def filtered(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that the rules keep, with all their columns, in one pass over the table."""
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        for batch in batches:
            verdicts = []
            column = pc.fill_null(batch.column(place), "")
            for text in column.cast(pa.binary()).to_pylist():
                words = split(text)
                good = len(words) >= 50 and 100 * repeated_words(words) <= 50 * len(words)
                verdicts.append(good and compression(text, bands, packer)[0] == "good")
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
