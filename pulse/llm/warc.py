"""Web archives (3): WARC files with a two-level capture index.

Pages become WARC records, each a gzip member of its own. Of pages with equal payloads of some size the one with the
largest page_id is kept as a response, the others as revisits of it without a payload. Payloads that more than a
``hot_share`` of all pages have are fewer than 1 / hot_share, so their table is broadcast: their revisits lose the payload before
anything is compressed, and are dealt over all tasks. The other pages meet their response by digest.

The index has two levels. Captures, ordered by the URL with its host reversed, lie in compressed blocks of some
thousand lines; a sparse directory has the first key, place and length of each block. A URL is found by a binary
search of the directory, one range read of a block, a binary search in it, and one range read of the archive.
The directory holds at most about ``most_blocks`` entries with keys cut to ``key_bytes``, whatever the size of the
archive: blocks grow instead. So it can be sent to all tasks.

Defined cases: missing html is an empty payload; a page without a URL has the empty key. Long payloads are written
whole. Rows that repeat the largest page_id of their payload are all responses; if no row of a payload has a
page_id, all are responses. An empty table makes an archive without files. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.shared import file_system, kept, partitions
from pulse.llm.words import pieces, raw, runs


@dataclass(frozen=True)
class Settings:
    #: Payloads below so many bytes are never revisits.
    revisit_bytes: int = 1000
    #: A payload that a larger share of all pages has is hot.
    hot_share: float = 0.001
    #: An archive file is closed when it has so many bytes.
    file_bytes: int = 256 << 20
    block_lines: int = 3000
    most_blocks: int = 100_000
    key_bytes: int = 256
    #: Bytes that a reader fetches at once from an archive.
    ahead: int = 4 << 20
    gzip_level: int = 3
    date: str = "1970-01-01T00:00:00Z"


_PLAIN = "/:?#[]@!$&'()*+,;=%-._~"


def reversed_host(url: str | None) -> str:
    """Index key of a URL: the host's labels from the last to the first, the port, then the rest; no scheme.

    Whatever is no plain URL character is percent-encoded, so keys are ASCII without white space.
    """
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, _, port = host.partition(":")
    return quote(",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (tail or "/"), safe=_PLAIN)


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record(kind: str, page_id: int | None, url: str | None, headers: dict[str, str], block: bytes, settings: Settings) -> bytes:
    """One WARC record as a gzip member."""
    lines = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{page_id if page_id is not None else uuid.uuid4()}>",
        "WARC-Date": settings.date,
        **({"WARC-Target-URI": quote(url, safe=_PLAIN)} if url else {}),
        **headers,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    return _gzip(head.encode() + block + b"\r\n\r\n", settings.gzip_level)


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def _payload_headers(digest: str, size: int) -> dict[str, str]:
    return {"WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "X-Payload-Length": str(size)}


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


CAPTURES = "key string, page_id long, path string, offset long, length long"
_PACKED = ["page_id", "url", "digest", "size", "known", "member", "meet"]
_CAPTURE_NAMES = [part.split()[0] for part in CAPTURES.split(", ")]


def write(pages: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Writes the archive's files and returns its captures: key, page_id, path, offset and length of each record."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest, size = F.sha1(F.col("html").cast("binary")), F.octet_length("html")
    large = pages.select("page_id", digest.alias("digest"), size.alias("size")).where(F.col("size") >= settings.revisit_bytes)
    equal = kept(large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1"), "equal")
    is_hot = F.col("n") > settings.hot_share * pages.count()
    hot, rest = equal.where(is_hot).drop("n"), equal.where(~is_hot).drop("n")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            rows = []
            columns = (piece.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "response"))
            for page_id, url, sha, size, response, payload in zip(*columns, raw(piece, "html")):
                known = response is not None and response != page_id
                member = None if known else _record("response", page_id, url, _payload_headers(sha, size), _http(payload), settings)
                # A random number deals what is settled already over all tasks.
                rows.append((page_id, url, sha, size, response, member, sha if response is None else uuid.uuid4().hex))
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=_PACKED)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "response", "member"))
            for page_id, url, sha, size, response, member in zip(*columns):
                if size >= settings.revisit_bytes and response is not None and response != page_id:
                    headers = _payload_headers(sha, size) | {
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        "WARC-Refers-To": f"<urn:page:{response}>",
                    }
                    member = _record("revisit", page_id, url, headers, b"", settings)
                if out is None or at >= settings.file_bytes:
                    if out is not None:
                        out.close()
                    # A task that runs again writes files of its own; only the captures of one of them count.
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{place}/{name}", compression=None)
                out.write(member)
                rows.append((reversed_host(url), page_id, name, at, len(member)))
                at += len(member)
            if rows:
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=_CAPTURE_NAMES)
        if out is not None:
            out.close()

    # The payload of a page whose response is another one is read no further than its digest.
    other = F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id"))
    told = pages.withColumns({"digest": digest, "size": size.cast("long")}).join(F.broadcast(hot), "digest", "left")
    told = told.select("page_id", "url", "digest", "size", "response", F.when(~other, F.col("html")).alias("html"))
    packed = told.mapInArrow(pack, "page_id long, url string, digest string, size long, known long, member binary, meet string")
    met = packed.join(rest.withColumnRenamed("digest", "meet"), "meet", "left")
    records = met.withColumn("response", F.coalesce("known", "response"))
    return kept(records.mapInArrow(store, CAPTURES), "captures")


DIRECTORY = "first string, last string, path string, offset long, length long"


def index(captures: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Writes the blocks of captures, ordered by key, and returns their directory."""
    lines = max(settings.block_lines, -(-captures.count() // settings.most_blocks))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        packer, out, at, waiting, rows = zstandard.ZstdCompressor(), None, 0, [], []
        name = f"{uuid.uuid4().hex}.cdx"

        def block(part: list[tuple]) -> None:
            nonlocal at, out
            out = out or system.open_output_stream(f"{place}/{name}", compression=None)
            data = packer.compress("".join(f"{k}\t{p}\t{o}\t{n}\n" for k, p, o, n in part).encode())
            out.write(data)
            size = settings.key_bytes
            rows.append((part[0][0][:size], part[-1][0][:size], name, at, len(data)))
            at += len(data)

        for batch in batches:
            waiting += zip(*(batch.column(c).to_pylist() for c in ("key", "path", "offset", "length")))
            while len(waiting) >= lines:
                block(waiting[:lines])
                waiting = waiting[lines:]
        if waiting:
            block(waiting)
        if out is not None:
            out.close()
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            names = [part.split()[0] for part in DIRECTORY.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    # page_id spreads the captures of one URL.
    ordered = captures.repartitionByRange(partitions(captures.sparkSession), "key", "page_id", "path", "offset")
    return kept(ordered.sortWithinPartitions("key", "page_id", "path", "offset").mapInArrow(store, DIRECTORY), "directory")


def lookup(keys: DataFrame, directory: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """key, path, offset and length of all captures of the keys (column ``key``), found over the two levels.

    Every block is read once, with all keys that it may hold; a key with captures in many blocks is looked up in each.
    """
    spark = keys.sparkSession
    entries = sorted(map(tuple, directory.collect()))  # at most about most_blocks, see Settings
    sent = spark.sparkContext.broadcast(entries)
    size = settings.key_bytes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [e[0] for e in sent.value]
        for batch in batches:
            found = []
            for key in batch.column("key").to_pylist():
                low, high = max(0, bisect_left(firsts, key[:size]) - 1), bisect_right(firsts, key[:size])
                found += [(block, key) for block in range(low, high) if sent.value[block][1] >= key[:size]]
            blocks, held = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(held, pa.string())], names=["block", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        opener = zstandard.ZstdDecompressor()
        for rows in runs(batches, "block"):
            _, _, name, offset, length = sent.value[rows.column("block")[0].as_py()]
            with system.open_input_file(f"{root}/{name}") as file:
                lines = [x.split("\t") for x in opener.decompress(file.read_at(length, offset)).decode().split("\n")[:-1]]
            inside, found = [x[0] for x in lines], []
            for key in rows.column("key").to_pylist():
                found += lines[bisect_left(inside, key) : bisect_right(inside, key)]
            if found:
                keys, paths, offsets, lengths = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(paths), pa.array(map(int, offsets), pa.int64()), pa.array(map(int, lengths), pa.int64())],
                    names=["key", "path", "offset", "length"],
                )

    spread = partitions(spark)
    asked = keys.select("key").distinct().mapInArrow(place, "block long, key string")
    dealt = asked.repartition(spread, "block").sortWithinPartitions("block")
    return dealt.mapInArrow(search, "key string, path string, offset long, length long")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def fetch(captures: DataFrame, folder: str, with_payload: bool = True, settings: Settings = Settings()) -> DataFrame:
    """The captures' records, read from the archives by ranges; neighbours in a file are read together.

    Size and digest of a response are taken from its payload, those of a revisit from its headers.
    """

    def page(urn: str | None) -> int | None:
        tail = (urn or "").rpartition(":")[2].rstrip(">")
        return int(tail) if tail.lstrip("-").isdigit() else None

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        file, opened, data, low = None, None, b"", 0
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if path != opened:
                    file, opened, data, low = system.open_input_file(f"{root}/{path}"), path, b"", 0
                if offset < low or offset + length > low + len(data):
                    data, low = file.read_at(max(length, settings.ahead), offset), offset
                headers, payload = parsed(data[offset - low : offset - low + length])
                kind = headers["WARC-Type"]
                if kind == "response":
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                else:
                    size = int(headers["X-Payload-Length"])
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                of = page(headers["WARC-Record-ID"])
                rows.append((of, headers.get("WARC-Target-URI"), size, digest, kind, page(headers.get("WARC-Refers-To")), payload if with_payload else None))
            if rows:
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                names = [part.split()[0] for part in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    part = F.floor(F.col("offset") / settings.ahead)
    dealt = captures.repartition(partitions(captures.sparkSession), F.col("path"), part).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(load, RECORDS)


def archived(pages: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """The pages written to an archive in ``folder``, and every record read back by the key of its URL."""
    captures = write(pages, folder, settings)
    directory = index(captures, folder, settings)
    return fetch(lookup(captures.select("key"), directory, folder, settings), folder, False, settings).drop("payload")
