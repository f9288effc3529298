"""WARC archives: segmented writing, reading and segment reassembly.

``write_archives`` stores one record per row as gzip-compressed WARC/1.1 files.
A record is a row of text whose lines end in CRLF CRLF, which is how WARC ends
its records, so Spark's text writer makes the files: through any store, with
its commit protocol. A block longer than ``segment_bytes`` becomes a first
record and continuation records; a file holds at most ``records_per_file`` of
them, so its size is bounded whatever the payloads.

``read_records`` reads such files, and any .gz or plain .warc archive of one or
more gzip members (one task per file), by Content-Length. Spark hands a file over
whole, as stored (up to 2 GB); a task unpacks it piece by piece and holds one
record at a time. ``reassemble`` groups the segments by origin identifier, orders
them by segment number, and verifies that the numbers are complete and the total
length is right. ``payloads`` decodes the HTTP message, chunked framing included,
and verifies the payload digest. ``whole_payloads`` does all this in one reading
of the archives: only segments are stored with their blocks.

Of records whose payloads are equal and have ``min_revisit`` bytes or more, that
with the least id is the response; the others are revisits of it, without a
payload of their own.

Defined results: a null payload is empty; a null URL leaves out the target
header; a null id is written as ``~`` and read as null, and such a record is a
response only if no record with an id has the same payload. Rows that share the
least id of a payload are all responses. Copies of a row are records of their
own. Extra columns are ignored. An empty table gives an empty archive and an
empty result. A broken record is returned with ``problem`` set, not dropped; a head
of over 16 MB or a block of over 1 GB makes a record broken.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, stage

VERSION = "WARC/1.1"
END = "\r\n\r\n"
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 2_000
MIN_REVISIT = 100
PIECE = 64 * 1024
MAX_HEAD, MAX_BLOCK = 1 << 24, 1 << 30
URN = "urn:x-row:"


def mark_revisits(rows: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Adds ``refers_to`` (null for responses) to rows of id, digest, bytes.

    Ids and digests alone are aggregated, with map-side combine; the join back
    is on the digest, where Spark splits hot keys.
    """
    long = rows.filter(F.col("bytes") >= min_revisit)
    first = long.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    first = stage(first.select(F.col("digest").alias("known"), "first"), "warc-first")
    joined = rows.join(first, (F.col("digest") == F.col("known")) & (F.col("bytes") >= min_revisit), "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.withColumn("refers_to", refers).drop("known", "first")


def header(fields: list[tuple[str, str]]) -> bytes:
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in fields)]).encode() + b"\r\n\r\n"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is wrong."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        part = body[at : at + size]
        if len(part) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of wrong length")
        out.append(part)
        at += size + 2


HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def records(name: str, copy: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str, segment: int, chunk: int) -> Iterator[bytes]:
    """The WARC records of one row, without the CRLF CRLF at their ends."""
    origin = f"<{URN}{name}#{copy}>"
    shared = [("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:  # no control characters in a header
        shared.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)))
    if refers_to is not None:
        block = HTTP_HEAD
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", origin), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    else:
        block = HTTP_HEAD + chunked(payload, chunk)
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", origin)]
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    if len(parts) == 1:
        yield header([*fields, *shared, ("Content-Length", str(len(block)))]) + block
        return
    yield header([*fields, *shared, ("WARC-Segment-Number", "1"), ("Content-Length", str(len(parts[0])))]) + parts[0]
    for k, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{origin[:-1]}/{k}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield header([*fields, ("Content-Length", str(len(part)))]) + part


def write_archives(
    rows: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2000-01-01T00:00:00Z",
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
    min_revisit: int = MIN_REVISIT,
) -> None:
    """Write one record per row under ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    given = rows.select(
        F.col(id_col).cast("string").alias("name"),
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        payload.cast("binary").alias("payload"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).alias("bytes"),
    )
    marked = mark_revisits(given, min_revisit).select(
        "name", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", F.col("refers_to").cast("string").alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):
                name, url, body, digest, refers = (c[i].as_py() for c in batch.columns)
                n += 1
                for record in records("~" if name is None else name, f"{task}-{n}", url, body or b"", digest, refers, date, segment_bytes, chunk_bytes):
                    out.append(record)
                    held += len(record)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (
        map_arrow(marked, run, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


RECORD = "record_id string, type string, target string, refers_to string, digest string, segment int, origin string, total bigint, problem string, block binary"


#: The head of a record up to its identifier, which every record has.
_next = re.compile(rb"(?<=\n)WARC/[0-9][^\r\n]*+\r\n(?:(?!WARC-Record-ID:)[^\r\n]++\r\n)*+WARC-Record-ID:", re.I)


def unpacked(content: bytes, problems: list[str]) -> Iterator[bytes]:
    """The bytes of an archive, plain or of any number of gzip members, in
    pieces; what was wrong with them is added to ``problems``. After a broken
    member the next one is read."""
    view, end = memoryview(content), len(content)
    if not content.startswith(b"\x1f\x8b"):
        for at in range(0, end, PIECE):
            yield bytes(view[at : at + PIECE])
        return
    at = 0
    while 0 <= at < end:
        member, pos, problem, tail = zlib.decompressobj(31), at, None, b""
        while not member.eof and not problem:
            if not tail:  # in pieces, for unused_data is a copy
                tail = view[pos : pos + PIECE]
                pos += len(tail)
            given = len(tail)
            try:
                out = member.decompress(tail, 16 * PIECE)
            except zlib.error as e:
                problem = f"broken gzip member: {e}"
                break
            tail = member.unconsumed_tail
            if out:
                yield out
            elif not given:
                problem = "gzip member is cut short"
        if problem:
            if not content[at:].strip(b"\0"):
                break  # padding
            problems.append(problem)
            at = content.find(b"\x1f\x8b\x08", at + 1)
        else:
            at = pos - len(member.unused_data)


def parse(pieces: Iterable[bytes]) -> Iterator[dict]:
    """The records of one (unpacked) archive, in order. After a broken one it
    goes on at the next head of a record. Holds one record and a piece."""
    pieces, held = iter(pieces), bytearray()

    def grow() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    def have(n: int) -> bool:
        while len(held) < n:
            if not grow():
                return False
        return True

    def seek(at: int) -> bool:
        """Drop all before the next head from ``at`` on."""
        while True:
            found = _next.search(held, at)
            if found:
                del held[: found.start()]
                return True
            last = held.rfind(b"\nWARC/", at)  # may still become one
            if last < 0 or len(held) - last > MAX_HEAD:
                last = max(at, len(held) - len(b"\nWARC"))
            del held[: max(0, last)]
            at = 0
            if not grow():
                return False

    while have(1):
        stop, searched = -1, 0
        if have(5) and held.startswith(b"WARC/"):
            while (stop := held.find(b"\r\n\r\n", searched)) < 0 and len(held) < MAX_HEAD:
                searched = max(0, len(held) - 3)
                if not grow():
                    break
        lines = held[:stop].decode("utf-8", "replace").split("\r\n") if stop >= 0 else []
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = _number(fields.get("content-length"), 18)
        if length is None:
            yield {"problem": "no record where one should start"}
            if not seek(1):
                return
            continue
        begin, problem = stop + 4, None
        end = begin + length
        if length > MAX_BLOCK:
            block, problem = b"", "record is too long"
        else:
            have(end + 4)
            block = bytes(held[begin:end])
            if len(block) != length or held[end : end + 4] != b"\r\n\r\n":
                problem = "record of wrong length"
        record_id = fields.get("warc-record-id")
        yield {
            "record_id": record_id,
            "type": fields.get("warc-type"),
            "target": fields.get("warc-target-uri"),
            "refers_to": fields.get("warc-refers-to"),
            "digest": fields.get("warc-payload-digest"),
            "segment": _number(fields.get("warc-segment-number"), 9),
            "origin": fields.get("warc-segment-origin-id") or record_id,
            "total": _number(fields.get("warc-segment-total-length"), 18),
            "problem": problem,
            "block": block,
        }
        if problem is None:
            del held[: end + 4]
        elif not seek(begin):
            return


def _number(text: str | None, digits: int) -> int | None:
    return int(text) if text and len(text) <= digits and re.fullmatch("[0-9]+", text) else None


_schema = pa.schema(
    [(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))]
)


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").option("recursiveFileLookup", "true").load(path).select("content")


def in_batches(schema: pa.Schema, of_archive):
    """A task over archives that gathers the rows (dictionaries) which
    ``of_archive`` makes of one archive's records into batches of some MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, held, problems = [], 0, []
                records = parse(unpacked(content.as_py(), problems))
                for r in of_archive(chain(records, ({"problem": p} for p in problems))):
                    out.append(r)
                    held += len(r.get("block") or b"") + len(r.get("payload") or b"")
                    if held > 8_000_000 or len(out) >= 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def read_records(spark: SparkSession, path: str, segments: bool | None = None) -> DataFrame:
    """The records of all archives under ``path``: only those in segments, only
    whole ones, or (None) both."""

    def wanted(records: Iterator[dict]) -> Iterator[dict]:
        return (r for r in records if segments is None or segments == (r.get("segment") is not None))

    return map_arrow(archives(spark, path), in_batches(_schema, wanted), RECORD)


def reassemble(parts: DataFrame) -> DataFrame:
    """One record per origin of the segments ``parts``, with the joined block.

    A group is the segments of one record, whatever the archive's size.
    """
    columns = [c for c in parts.columns if c not in ("segment", "origin", "total")]
    grouped = parts.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "total", *columns))).alias("s"))
    s = F.col("s")
    numbers = F.transform(s, lambda x: x["segment"])
    length = F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x["block"]))
    total = F.element_at(s, -1)["total"]
    problem = (
        F.when(F.exists(s, lambda x: x["problem"].isNotNull()), "a segment is broken")
        .when(numbers != F.sequence(F.lit(1), F.size(s)), "segments are missing or repeated")
        .when(total.isNull() | (total != length), "total length is wrong")
    )
    # Binary pieces join as hexadecimal text, in one pass over the block.
    block = F.unhex(F.array_join(F.transform(s, lambda x: F.hex(x["block"])), ""))
    head = s[0]
    return grouped.select(*[head[c].alias(c) for c in columns if c not in ("problem", "block")], problem.alias("problem"), block.alias("block"))


def decoded(r: dict, content: bool) -> dict:
    """A whole record with its payload decoded and its digest verified."""
    claimed = (r.get("digest") or "").removeprefix("sha256:")
    block, payload, problem = r.get("block") or b"", None, r.get("problem")
    if r.get("type") == "response" and not problem:
        head, _, body = block.partition(b"\r\n\r\n")
        try:
            payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        except ValueError as e:
            problem = f"chunked framing: {e}"
        else:
            if claimed and hashlib.sha256(payload).hexdigest() != claimed:
                problem = "payload digest is wrong"
    size = None if payload is None else len(payload)
    return {**{k: r.get(k) for k in ("record_id", "type", "target", "refers_to")}, "bytes": size, "digest": claimed, "problem": problem, **({"payload": payload} if content else {})}


def _payload_columns(content: bool) -> dict[str, tuple[str, pa.DataType]]:
    texts = {n: ("string", pa.string()) for n in ("record_id", "type", "target", "refers_to")}
    rest = {"bytes": ("bigint", pa.int64()), "digest": ("string", pa.string()), "problem": ("string", pa.string())}
    return {**texts, **rest, **({"payload": ("binary", pa.binary())} if content else {})}


def _ddl(columns: dict[str, tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {t}" for n, (t, _) in columns.items())


def payloads(whole: DataFrame, content: bool = True) -> DataFrame:
    """(record_id, type, target, refers_to, bytes, digest, problem[, payload]):
    the decoded payload of each record. A revisit has no payload of its own;
    its digest is that of its header."""
    columns = _payload_columns(content)
    schema = pa.schema([(n, t) for n, (_, t) in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["record_id", "type", "target", "refers_to", "digest", "problem", "block"])
            yield pa.RecordBatch.from_pylist([decoded(r, content) for r in rows.to_pylist()], schema)

    return map_arrow(whole, run, _ddl(columns))


def whole_payloads(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """``payloads`` of all records under ``path``, segments reassembled, in one
    reading of the archives: its task decodes whole records at once, and stores
    segments with their blocks; only these are shuffled."""
    columns = {**_payload_columns(content), "segment": ("int", pa.int32()), "origin": ("string", pa.string()), "total": ("bigint", pa.int64()), "block": ("binary", pa.binary())}
    schema = pa.schema([(n, t) for n, (_, t) in columns.items()])

    def rows(records: Iterator[dict]) -> Iterator[dict]:
        return (decoded(r, content) if r.get("segment") is None else r for r in records)

    read = stage(map_arrow(archives(spark, path), in_batches(schema, rows), _ddl(columns)), "warc-records")
    parts = read.filter("segment IS NOT NULL").select(*[x.split()[0] for x in RECORD.split(", ")])
    whole = read.filter("segment IS NULL").select(*_payload_columns(content))
    return whole.unionByName(payloads(reassemble(parts), content))


def row_name(urn: Column) -> Column:
    """The id that ``write_archives`` put into a record identifier."""
    name = F.regexp_extract(urn, "<" + re.escape(URN) + r"([^#>]*)", 1)
    return F.when(~name.isin("~", ""), name)


def read_pages(spark: SparkSession, path: str, id_type: str = "bigint", content: bool = False) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to, problem)
    of every record; revisits take the length from the response they name."""
    rows = whole_payloads(spark, path, content).select(
        row_name(F.col("record_id")).cast(id_type).alias("page_id"),
        F.col("type").alias("record_type"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        row_name(F.col("refers_to")).cast(id_type).alias("refers_to"),
        "problem",
        *(["payload"] if content else []),
    )
    rows = stage(rows, "warc-pages")
    named = rows.filter("record_type = 'response'").groupBy(F.col("page_id").alias("first"), F.col("payload_digest").alias("same")).agg(F.max("payload_bytes").alias("first_bytes"))
    joined = rows.join(named, (rows["refers_to"] == named["first"]) & (rows["payload_digest"] == named["same"]), "left")
    lost = (F.col("record_type") == "revisit") & F.col("first").isNull()
    return joined.withColumns(
        {"payload_bytes": F.coalesce("payload_bytes", "first_bytes"), "problem": F.when(lost, "no response to revisit").otherwise(F.col("problem"))}
    ).drop("first", "same", "first_bytes")
