"""Byte-level BPE (7): encoding with a local rank file through tiktoken, and decoding raw bytes.

tiktoken fails on very long runs that its split pattern has to try again and again, and its merges of one
very long piece take long. So a long text is cut first, where the pattern must cut anyway: before a
space that stands alone between two characters that are no white space. Runs of white space that are longer still
are split by the pattern's own rule: all but the last character of a run, if another character follows,
make one piece.

Defined cases: a missing text is empty, with no ids. Very long texts, also of a single character, are
encoded whole. Repeated rows are encoded each. An empty table gives no rows. Other columns are passed by.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from pulse.llm.words import pieces, texts

#: Characters of a text that are given to the library at once.
LONG = 20_000
_CUT = regex.compile(r"(?<=\P{White_Space})(?= \P{White_Space})")
#: White space from which a run is cut out as a piece of its own.
BLANK = 1000
_BLANK = regex.compile(rf"\p{{White_Space}}{{{BLANK},}}")


class Codec:
    """The library's encoder for a rank file; encodes and decodes texts of any length."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self._encoding.encode_ordinary(text)
        ids: list[int] = []
        for part in self.parts(text):
            # A long blank run is one match of the pattern, which would exhaust the library's stack.
            blank = len(part) >= BLANK and _BLANK.fullmatch(part)
            ids += self._encoding._encode_single_piece(part) if blank else self._encoding.encode_ordinary(part)
        return ids

    @staticmethod
    def parts(text: str) -> Iterator[str]:
        """The text in parts of about LONG characters; a cut never goes through a match of the pattern."""
        start = 0
        for blank in [*_BLANK.finditer(text), None]:
            # The run's last character belongs to what follows it, unless the text ends there.
            end = len(text) if blank is None else blank.start()
            while end - start > LONG:
                cut = _CUT.search(text, start + LONG, end)
                if cut is None or cut.start() >= end:
                    break
                yield text[start : cut.start()]
                start = cut.start()
            if blank is None:
                if start < end:
                    yield text[start:end]
            else:
                if start < end:
                    yield text[start:end]
                last = blank.end() if blank.end() == len(text) else blank.end() - 1
                yield text[blank.start() : last]
                start = last

    def decode(self, ids: list[int]) -> bytes:
        return self._encoding.decode_bytes(ids)


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    """The encoder, made once in a worker and kept for its later tasks."""
    return Codec(ranks, pattern)


def shared_bytes(spark: SparkSession, path: str) -> bytes:
    """A small local file's bytes, read once in the driver; they travel with the tasks."""
    with open(path, "rb") as file:
        return file.read()


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def encoded(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, number of ids, hashes of the ids and of the decoded bytes, and the ids as 32-bit integers."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(shared_bytes(spark, ranks_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for piece in pieces(batches):
            counts, of_ids, of_text, packed = [], [], [], []
            for text in texts(piece):
                ids = own.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids)).hexdigest())
                packed.append(np.array(ids, "<u4").tobytes() if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(of_ids, pa.string()),
                    pa.array(of_text, pa.string()),
                    pa.array(packed, pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(encode, SCHEMA)


def decoded(encoded_docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and text of documents from their ids; bytes that are no UTF-8 become replacement characters."""
    spark = encoded_docs.sparkSession
    ranks = spark.sparkContext.broadcast(shared_bytes(spark, ranks_path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for batch in batches:
            text = [
                own.decode(np.frombuffer(x or b"", "<u4").tolist()).decode("utf-8", "replace")
                for x in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
