"""WARC archives, compressed record by record with Zstandard and a dictionary in the leading skippable frame."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

VERSION = b"WARC/1.1"
#: Magic numbers of the format: the skippable frame that holds the dictionary, an ordinary frame.
DICTIONARY_FRAME, ORDINARY_FRAME = 0x184D2A5D, 0xFD2FB528
#: Payload bytes from which equal payloads are stored once.
REVISIT_FROM = 100
#: An archive is closed when its records exceed so many bytes before compression.
ARCHIVE_BYTES = 8 << 20
#: The dictionary of an archive: its size, and how many of the first records and their bytes it is trained on.
DICTIONARY_BYTES, TRAIN_RECORDS, TRAIN_BYTES = 16 << 10, 200, 1 << 20
#: Equal payloads meet their group's row in so many parts, so that one large group is not one task.
PARTS = 16
LEVEL, DATE = 3, "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SLICE = 1 << 16


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: a response with an HTTP head and the payload, or a revisit with the head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if key is None else key}>"),
        ("WARC-Date", date), ("WARC-Target-URI", quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{n}: {v}\r\n" for n, v in lines).encode("ascii") + b"\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary in a skippable frame, then one frame per record.

    The dictionary is trained on a bounded number of the archive's own records; with too few of them the archive
    has neither dictionary nor leading frame.
    """
    sample, size = [], 0
    for r in records[:TRAIN_RECORDS]:
        sample.append(r[:TRAIN_BYTES // 8])
        size += len(sample[-1])
        if size > TRAIN_BYTES:
            break
    out, dictionary = [], None
    if len(sample) >= 8:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8)
        except zstandard.ZstdError:  # the library finds nothing in common
            dictionary = None
    if dictionary is not None:
        raw = dictionary.as_bytes()
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    out += [compressor.compress(r) for r in records]
    return b"".join(out)


def frames(archive: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """The content of each frame of an archive, or what is wrong with it; reading ends at a broken frame."""
    at, dictionary = 0, None
    view = memoryview(archive)
    while len(archive) - at >= 8:
        magic, size = struct.unpack_from("<II", archive, at)
        if magic & 0xFFFFFFF0 != 0x184D2A50:
            break
        if magic == DICTIONARY_FRAME and at == 0:
            raw = bytes(view[8:8 + size])
            if len(raw) != size:
                yield None, "dictionary frame cut off"
                return
            if raw[:4] == struct.pack("<I", ORDINARY_FRAME):  # the dictionary may itself be compressed
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            dictionary = zstandard.ZstdCompressionDict(raw)
        at += 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(archive):
        one, parts = reader.decompressobj(), []
        try:
            while not one.eof and at < len(archive):
                piece = view[at:at + SLICE]
                parts.append(one.decompress(piece))
                at += len(piece) - len(one.unused_data)
        except zstandard.ZstdError as wrong:
            yield None, f"frame not readable: {wrong}"
            return
        if not one.eof:
            yield None, "frame cut off"
            return
        yield b"".join(parts), None


def parse(record: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Headers (lower-case names), HTTP body and the first fault of a record."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.1", b"WARC/1.0"):
        return {}, b"", "no WARC head"
    pairs = [line.partition(b":") for line in lines[1:]]
    headers = {n.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for n, _, v in pairs}
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            return headers, b"", f"no {name}"
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return headers, b"", "wrong length"
    http, found, body = rest[:-4].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        return headers, b"", "no HTTP head"
    if headers["warc-type"] == "response":
        said = [v for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if n.strip().lower() == b"content-length"]
        if said and int(said[0]) != len(body):
            return headers, body, "wrong payload length"
        digest = headers.get("warc-payload-digest", "")
        if digest and digest != "sha256:" + hashlib.sha256(body).hexdigest():
            return headers, body, "wrong digest"
    elif headers["warc-type"] == "revisit" and "warc-refers-to" not in headers:
        return headers, body, "revisit without target"
    return headers, body, None


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                  least: int = REVISIT_FROM) -> DataFrame:
    """Rows (key, url, payload, digest, refers_to): of equal payloads of ``least`` bytes or more the one with the
    smallest key is stored, the others refer to it. Digests are grouped with counts and minima, combined before
    the shuffle; only groups of two or more go back to the pages, in ``PARTS`` copies, by the join that the optimizer
    chooses from their bytes. A NULL key is never referred to unless all of its group are NULL, which are then all
    stored. Keys that are not integers are an error: records name pages by number."""
    if not isinstance(pages.schema[key].dataType, T.IntegralType):
        raise ValueError(f"page keys must be integers: {key}")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = stored(rows.filter(F.octet_length("payload") >= least).groupBy("digest")
                   .agg(F.count("*").alias("n"), F.min("key").alias("first")).filter("n > 1").drop("n"), "equal_payloads")
    copies = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    joined = rows.withColumn("part", F.pmod(F.xxhash64("key", "url"), F.lit(PARTS)).cast("int")).join(copies, ["digest", "part"], "left")
    return joined.select("key", "url", "payload", "digest",
                         F.when(~F.col("first").eqNullSafe(F.col("key")), F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Records (key, url, payload, digest, refers_to) to archives (path, content), closed at a bounded size.

    The content of a row is a complete ``.warc.zst`` file. They are kept as rows because Spark's own writers are
    what reaches every file system; ``read_archives`` takes the same rows or those of the ``binaryFile`` source.
    """
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            content = pack(held)
            name = hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["path", "content"])

        for batch in batches:
            for key, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record_bytes(key, url, payload or b"", digest, refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return rows.select("key", "url", "payload", "digest", "refers_to").mapInArrow(write, "path string, content binary")


RECORD = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("key", T.LongType()), T.StructField("record_type", T.StringType()),
    T.StructField("uri", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("fault", T.StringType())])


def _number(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame) -> DataFrame:
    """Archives (path, content) to one row per record, see RECORD; ``fault`` says what is wrong with a record.

    The dictionary comes from the leading skippable frame; every frame is decoded by itself, so one record is in
    memory at a time; heads, lengths and digests are validated. Records that cannot be read become rows with a
    fault and NULL elsewhere; an empty archive has no records.
    """
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for record, fault in frames(content.as_py() or b""):
                    if record is None:
                        rows.append((path, None, None, None, None, None, None, fault))
                        continue
                    headers, body, fault = parse(record)
                    kind = headers.get("warc-type")
                    rows.append((path, _number(headers.get("warc-record-id", "")), kind, headers.get("warc-target-uri"),
                                 headers.get("warc-payload-digest", "").rpartition(":")[2] or None,
                                 _number(headers.get("warc-refers-to", "")), body if kind != "revisit" else None, fault))
                    size += len(record)
                    if size > ARCHIVE_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return archives.select("path", "content").mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], RECORD.names)


def archive_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page as a record and read all archives back: the rows of ``read_archives``.

    NULL html is an empty payload, a NULL url ``about:blank``. Pages that repeat a key and payload are all stored.
    """
    return read_archives(stored(write_archives(with_revisits(pages, key, url, html)), "archives"))


def resolved(records: DataFrame) -> DataFrame:
    """(key, payload_bytes, digest, record_type, refers_to) of readable records; a revisit takes the payload's
    size from the response it refers to, NULL if that is missing."""
    narrow = stored(records.filter(F.col("fault").isNull()).select(
        "key", "record_type", "digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes")), "records")
    responses = narrow.filter("record_type = 'response'")
    sizes = (responses.groupBy(F.col("key").alias("_k"), F.col("digest").alias("_d")).agg(F.max("payload_bytes").alias("payload_bytes")))
    revisits = narrow.filter("record_type = 'revisit'").drop("payload_bytes")
    found = revisits.join(sizes, (revisits["refers_to"] == sizes["_k"]) & (revisits["digest"] == sizes["_d"]), "left")
    columns = ["key", "payload_bytes", "digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(found.select(*columns))
