"""Token ids in binary files (1): each document compressed alone with one shared dictionary.

A zstandard dictionary is trained on the serialised ids of a bounded sample of documents and written once beside the
files. A file holds documents in ascending doc_id order:

    header   4 bytes "TOK1", 1 byte width of an id, 3 bytes zero, 32 bytes SHA-256 of the dictionary
    frames   one zstandard frame a document, without the dictionary's id and its own size
    index    an entry a document: doc_id (8 bytes, signed), offset of its frame (8), ids before it in the file (8)
    footer   8 bytes offset of the index, 8 bytes number of documents, 8 bytes number of ids, 4 bytes "TOKX"

All numbers are little-endian. A short document is read by a binary search of the index and one range read; its
frame opens with the dictionary of that hash only. The table of files, with first and last doc_id and
the number of ids, is what gives each file its place among the ids of all documents.

Defined cases: a missing text is empty; its document holds the end id alone. Very long texts are encoded whole.
Rows with one doc_id are kept each, in the order of their ids' hash. Rows without doc_id come first and keep a null in
the result (the index holds the smallest long for them). An empty table has no files. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulse.llm.shared import bounded_sample, file_system, kept, partitions, write_whole
from pulse.llm.words import pieces, texts
from pulse.session import shared_dir


@dataclass(frozen=True)
class Settings:
    end_id: int | None = 2
    #: Documents that the dictionary is trained on, at most so many of at most so many bytes, and its size.
    sample: int = 2000
    sample_bytes: int = 1 << 16
    dictionary_bytes: int = 64 << 10
    level: int = 3
    #: Words whose ids a worker keeps.
    cached_words: int = 300_000


MAGIC, END = b"TOK1", b"TOKX"
NO_ID = -(1 << 63)
_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("before", "<i8")])
#: Latin letters with ASCII punctuation after them, but for the apostrophe, which begins contractions.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*)([!-&(-/:-@\[-`{-~]*)")
_PROBES = ("Word", "ÀÉ", "ends,", "x.", "***", "mixed&&&", "Thing!?", "ÿ)", "antidisestablishment")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level models write each byte: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Parts(dict):
    """Ids of parts of words, by the tokenizer's model alone."""

    def __init__(self, model, kind: str):
        self._model, self._kind, self._letters = model, kind, byte_letters()

    def __missing__(self, part: str) -> bytes:
        text = part if part.isascii() else "".join(map(self._letters.__getitem__, part.encode()))
        ids = self[part] = array(self._kind, [t.id for t in self._model.tokenize(text)]).tobytes() if part else b""
        return ids


class Encoder:
    """Ids of whole texts through the tokenizers library, for a tokenizer that drops white space.

    Such a tokenizer treats what stands between two spaces alone, so the ids of a text are those of its words. Words seen
    before are not encoded again. A word of letters and punctuation after them is two parts to a tokenizer that
    lowers case and parts the two; where some probes show that, the parts go to the library's model at once.
    """

    def __init__(self, definition: str, width: str, settings: Settings):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer, self._width, self._limit = Tokenizer.from_str(definition), width, settings.cached_words
        self._known: dict[str, bytes] = {}
        self._parts = _Parts(self._tokenizer.model, {"<u2": "H", "<u4": "I"}[width])
        self._by_parts = sys.byteorder == "little" and all(self._plain(w) == self._alone(w) for w in _PROBES)

    def encode(self, batch: list[str]) -> list[bytes]:
        """The texts' ids, serialised."""
        # A space and a line break are white space by any rule: no token goes across them.
        words = [text.replace("\n", " ").split(" ") for text in batch]
        seen = set().union(*words)
        if len(self._known) + len(seen) > self._limit:
            self._known = {w: self._known[w] for w in seen if w in self._known}
        if len(self._parts) > self._limit:
            self._parts.clear()
        known = self._known
        for word in seen:
            if word not in known:
                known[word] = self._plain(word) if self._by_parts else self._alone(word)
        found = [b"".join(map(known.__getitem__, some)) for some in words]
        if len(known) > self._limit:
            self._known = {}
        return found

    def _plain(self, word: str) -> bytes:
        parts = _PLAIN.fullmatch(word.lower())
        return self._parts[parts[1]] + self._parts[parts[2]] if parts else self._alone(word)

    def _alone(self, word: str) -> bytes:
        return np.array(self._tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids, self._width).tobytes()


def id_width(largest: int) -> str:
    """Type of the ids: the narrowest that holds them all."""
    return "<u2" if largest < 1 << 16 else "<u4"


def _encoding(spark: SparkSession, definition: str, width: str, settings: Settings):
    """A function from batches of doc_id and text to batches of doc_id and serialised ids."""
    shared = spark.sparkContext.broadcast(definition)
    end = b"" if settings.end_id is None else np.array([settings.end_id], width).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for piece in pieces(batches, limit=4 << 20):
            encoder = encoder or Encoder(shared.value, width, settings)
            ids = [x + end for x in encoder.encode(texts(piece))]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return encode


def trained_dictionary(docs: DataFrame, definition: str, width: str, settings: Settings) -> bytes:
    """A dictionary for the serialised ids, from a bounded sample; empty if the sample is too small for one."""
    sample = bounded_sample(docs.select("doc_id", "text"), settings.sample, "token-sample", "text", settings.sample_bytes)
    ids = sample.mapInArrow(_encoding(docs.sparkSession, definition, width, settings), "doc_id long, ids binary")
    samples = [bytes(r["ids"]) for r in ids.select("ids").toLocalIterator()]
    try:
        return zstandard.train_dictionary(settings.dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _packer(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=known, write_dict_id=False, write_content_size=True)


def _opener(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


FILES = "shard int, path string, n_docs long, n_ids long, first_id long, last_id long, bytes long"


def write(docs: DataFrame, folder: str, definition: str, largest_id: int, settings: Settings = Settings()) -> DataFrame:
    """Writes the documents' files into a folder that all machines reach, and returns the table of files."""
    spark, width = docs.sparkSession, id_width(largest_id)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spread = partitions(spark)
    dictionary = trained_dictionary(docs, definition, width, settings)
    write_whole(f"{folder}/dictionary", [dictionary])
    digest = hashlib.sha256(dictionary).digest()

    # Files are ranges of doc_id with about as many documents each; their bounds come from the ids alone.
    shares = [k / spread for k in range(1, spread)]
    bounds = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 10_000)).first()[0] if spread > 1 else []
    bounds = sorted(set(bounds or []))

    encode = _encoding(spark, definition, width, settings)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, edges = _packer(dictionary, settings.level), np.array(bounds, np.int64)
        size = np.dtype(width).itemsize
        for batch in encode(batches):
            ids = batch.column("ids").to_pylist()
            doc = batch.column("doc_id").fill_null(NO_ID)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.searchsorted(edges, doc.to_numpy(zero_copy_only=False), "right"), pa.int32()),
                    doc,
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([len(x) // size for x in ids], pa.int64()),
                    pa.array([packer.compress(x) for x in ids], pa.binary()),
                ],
                names=["shard", "doc_id", "tie", "n", "frame"],
            )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            path, entries, state = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.tok", [], [0, 0]

            def parts(rows=rows, entries=entries, state=state):
                yield MAGIC + bytes([np.dtype(width).itemsize, 0, 0, 0]) + digest
                at = 40
                for doc, n, frame in rows:
                    entries.append((doc, at, state[0]))
                    at, state[0] = at + len(frame), state[0] + n
                    yield frame
                yield np.array(entries, _ENTRY).tobytes() + struct.pack("<qqq", at, len(entries), state[0]) + END

            written = write_whole(path, parts())
            values = (shard, path, len(entries), state[0], entries[0][0], entries[-1][0], written)
            yield pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in FILES.split(", ")], values))], schema=_FILES)

    packed = docs.mapInArrow(pack, "shard int, doc_id long, tie long, n long, frame binary")
    ordered = packed.repartitionById(spread, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie")
    # Each task's files have names of their own; the table lists those of the tasks that counted.
    return kept(ordered.mapInArrow(store, FILES), "token-files")


_FILES = pa.schema(
    [("shard", pa.int32()), ("path", pa.string())] + [(x, pa.int64()) for x in ("n_docs", "n_ids", "first_id", "last_id", "bytes")]
)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    """(shard, its rows) one after the other; the rows are never together in memory."""
    rows = (
        row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n", "frame")))
    )
    ahead = next(rows, None)
    while ahead is not None:
        shard = ahead[0]

        def own():
            nonlocal ahead
            while ahead is not None and ahead[0] == shard:  # noqa: B023
                yield ahead[1:]
                ahead = next(rows, None)

        yield shard, own()


class Reader:
    """One file, read by ranges: header and index at once, frames when asked for."""

    def __init__(self, path: str, dictionary: bytes):
        system, place = file_system(path)
        self._file = system.open_input_file(place)
        size = self._file.size()
        head = self._file.read_at(40, 0)
        start, count, self.n_ids = struct.unpack("<qqq", self._file.read_at(28, size - 28)[:24])
        if head[:4] != MAGIC or head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} does not belong to this dictionary")
        self._width = {2: "<u2", 4: "<u4"}[head[4]]
        self.index = np.frombuffer(self._file.read_at(count * _ENTRY.itemsize, start), _ENTRY)
        self._ends = np.append(self.index["offset"][1:], start)
        self._opener = _opener(dictionary)

    def documents(self, ahead: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, ids before it in the file, ids) of all documents, read some MB at a time."""
        first = 0
        while first < len(self.index):
            low = int(self.index["offset"][first])
            last = max(first + 1, int(np.searchsorted(self._ends, low + ahead, "right")))
            data = memoryview(self._file.read_at(int(self._ends[last - 1]) - low, low))
            for k in range(first, last):
                frame = data[int(self.index["offset"][k]) - low : int(self._ends[k]) - low]
                yield int(self.index["doc_id"][k]), int(self.index["before"][k]), self._ids(frame)
            first = last

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents of that doc_id, by binary search and one range read each."""
        low, high = (int(np.searchsorted(self.index["doc_id"], doc_id, side)) for side in ("left", "right"))
        offsets = [(int(self.index["offset"][k]), int(self._ends[k])) for k in range(low, high)]
        return [self._ids(self._file.read_at(end - start, start)) for start, end in offsets]

    def _ids(self, frame) -> np.ndarray:
        return np.frombuffer(self._opener.decompress(frame), self._width)


def _dictionary(folder: str) -> bytes:
    system, place = file_system(folder)
    with system.open_input_file(f"{place}/dictionary") as file:
        return file.read()


def read(files: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (32-bit integers) of all documents, out of the files."""
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("start", before).select("path", "start")  # one row a file

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                dictionary = _dictionary(folder) if dictionary is None else dictionary
                rows, size = [], 0
                for doc_id, earlier, ids in Reader(path, dictionary).documents():
                    data = ids.astype("<u4").tobytes()
                    rows.append((None if doc_id == NO_ID else doc_id, start + earlier, len(ids), zlib.crc32(data), data if with_ids else None))
                    size += len(data)
                    if size > 8 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    spread = placed.repartition(partitions(files.sparkSession), "path")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def lookup(files: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the wanted documents: each opens only the files whose range holds it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, path, reader = None, None, None
        for batch in batches:
            rows = []
            for place, doc_id in zip(batch.column("path").to_pylist(), batch.column("doc_id").to_pylist()):
                dictionary = _dictionary(folder) if dictionary is None else dictionary
                if place != path:
                    path, reader = place, Reader(place, dictionary)
                rows += [(doc_id, ids.astype("<u4").tobytes()) for ids in reader.get(doc_id)]
            ids, data = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "ids"])

    ranges = files.select("path", "first_id", "last_id")
    asked = wanted.select(F.col("doc_id").cast("long")).distinct()
    pairs = asked.join(ranges, F.col("doc_id").between(F.col("first_id"), F.col("last_id")))
    return pairs.select("path", "doc_id").sortWithinPartitions("path").mapInArrow(find, "doc_id long, ids binary")


def stored(spark: SparkSession, docs: DataFrame, definition: str, largest_id: int, settings: Settings = Settings()) -> tuple[DataFrame, str]:
    """The table of files and the folder of a store in a new place of the cluster's shared folder."""
    folder = shared_dir(spark, "tokens")
    return write(docs, folder, definition, largest_id, settings), folder
