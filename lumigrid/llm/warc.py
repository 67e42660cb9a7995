"""WARC archives: a writer that replaces repeated payloads by revisit records, and a reader that salvages damaged files.

Every record is a gzip member of its own. The reader takes records one after another; where a check fails it looks for
the next gzip member or version line that starts a valid record, takes up reading there, and logs the bytes between as
a gap. Archives go to the shared folder by pyarrow's file systems; a table lists the files of the attempts that
succeeded, so files of lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumigrid.llm.shared import file_system, qualified
from lumigrid.session import Scratch, materialize, new_folder, table

#: Bytes after which a writer begins the next archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes that the reader takes from a file at once.
READ_BYTES = 1 << 20
#: Bytes of a gzip member that are unpacked at once, so that damage is found near its place.
PIECE_BYTES = 1 << 14
#: Digests of repeated payloads up to which they are broadcast; more are joined, each payload in so many parts.
REPEATED, SALTS = 1_000_000, 64
#: A header longer than this is damage.
HEADER_BYTES = 1 << 16
VERSION = b"WARC/1.1\r\n"
#: The largest record that is read; a payload is a string of Spark, which has less than 2 GB.
MOST_BYTES = (1 << 31) + (1 << 17)
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|" + _LINE.pattern)
_DATE = "2020-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, refers_url: str | None = None) -> bytes:
    """One record; a revisit keeps the HTTP header, leaves out the payload and names the address that has it."""
    line = lambda text: re.sub(r"[\r\n]+", " ", text) if text else None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": _DATE,
        "WARC-Target-URI": line(url),
        "WARC-Refers-To-Target-URI": line(refers_url) if revisit else None,
        "WARC-Refers-To-Date": _DATE if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": "sha1:" + sha1_base32(payload),
        "WARC-Block-Digest": "sha1:" + sha1_base32(block),
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "X-Payload-Length": len(payload),
        "X-Page-ID": page_id,
        "X-Refers-To-Page-ID": refers_to,
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _write(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, records, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"  # unique for each attempt
                    out, size, records = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                size += out.write(packer.compress(record(row["page_id"], row["url"], row["html"], row["refers_to"], row["revisit"], row.get("refers_url"))) + packer.flush())
                records += 1
                if size >= archive_bytes:
                    out.close()
                    out = done.append((f"{folder}/{name}", size, records))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, records))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "records"), x)) for x in done], schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return write


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the archives: path (a URI), bytes, records.

    Of the records with one payload of at least min_bytes bytes that with the smallest page_id is a response and the
    others revisit it; smaller ones are responses. A null html is an empty payload. A row with a null page_id revisits
    the smallest page_id, and is a response where there is none. Repeated rows of the smallest page_id are responses.
    No pages give no archives. Further columns are not read.
    """
    scratch = Scratch(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("html")).withColumn("digest", F.sha1("html"))
    keys = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "url", "digest")
    several = keys.groupBy("digest").agg(F.min("page_id").alias("owner"), F.min_by("url", "page_id").alias("refers_url"), F.count("*").alias("n"))
    owners = scratch.table(several.where("n > 1 and owner is not null").drop("n"), "owners")
    if owners.limit(REPEATED + 1).count() <= REPEATED:
        marked = rows.join(F.broadcast(owners), "digest", "left")  # no payload moves
    else:
        salted = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id")) & (F.octet_length("html") >= min_bytes)
    marked = marked.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("owner")))
    written = marked.select("page_id", "url", "html", "refers_to", "revisit", "refers_url").mapInArrow(_write(qualified(pages.sparkSession, folder).rstrip("/"), archive_bytes), "path string, bytes long, records long")
    out = materialize(written, "archives")
    scratch.clear()
    return out


class _Bytes:
    """A window over a stream of bytes that remembers offsets. What lies before keep, an offset, may be given up."""

    def __init__(self, stream):
        self.stream, self.data, self.at, self.base, self.keep, self.ended = stream, bytearray(), 0, 0, 0, False

    @property
    def offset(self) -> int:
        return self.base + self.at

    def go(self, offset: int) -> None:
        self.at, self.keep = offset - self.base, offset

    def more(self) -> bool:
        """Read on. Bytes are given up when they are most of the window, so each is moved a bounded number of times."""
        if self.ended:
            return False
        got = self.stream.read(READ_BYTES)
        self.ended = not got
        if 2 * (cut := self.keep - self.base) > len(self.data):
            del self.data[:cut]
            self.base, self.at = self.base + cut, self.at - cut
        self.data += got
        return bool(got)

    def need(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True


class Damage(Exception):
    """A record that fails a check. lost: the offset from which on nothing was read; resume: where to look for the next start."""

    def __init__(self, reason: str, lost: int | None = None, resume: int | None = None):
        super().__init__(reason)
        self.lost, self.resume = lost, resume


class Broken(Damage):
    """A gzip member that cannot be unpacked any further."""


class _Inflated:
    """The unpacked bytes of the gzip member at a window's place, as a stream.

    A piece that fails is unpacked once more byte by byte, so what came before the damage is given. sure: the offset up
    to which the member has surely been needed for what was given so far; no later member begins before it.
    """

    def __init__(self, window: _Bytes):
        self.window, self.unpack, self.step, self.sure = window, zlib.decompressobj(31), PIECE_BYTES, window.offset

    def read(self, _: int) -> bytes:
        window = self.window
        while not self.unpack.eof:
            if window.at >= len(window.data) and not window.more():
                raise Broken("cut off")
            piece, saved = bytes(window.data[window.at : window.at + self.step]), self.unpack.copy()
            try:
                got = self.unpack.decompress(piece)
            except zlib.error as e:
                if self.step == 1:
                    raise Broken(f"gzip: {e}") from e
                self.unpack, self.step = saved, 1
                continue
            self.sure = window.offset + (self.step == 1)
            window.at += len(piece) - len(self.unpack.unused_data)
            if got:
                return got
        return b""


def _head(text: bytes) -> dict[str, str]:
    lines = text.split(b"\r\n")
    if lines[0] + b"\r\n" not in (VERSION, b"WARC/1.0\r\n"):
        raise Damage("no version line")
    pairs = [line.partition(b":") for line in lines[1:] if line]
    if any(not sep for _, sep, _ in pairs):
        raise Damage("bad header line")
    return {k.strip().decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header and payload of one record, checked against its length and digests."""
    end = raw.find(b"\r\n\r\n", 0, HEADER_BYTES)
    if end < 0:
        raise Damage("no end of header")
    head = _head(raw[:end])
    if not head.get("content-length", "").isdigit():
        raise Damage("no length")
    n = int(head["content-length"])
    block = raw[end + 4 : end + 4 + n]
    if len(block) < n or raw[end + 4 + n : end + 8 + n] != b"\r\n\r\n" or len(raw) != end + 8 + n:
        raise Damage("wrong length")
    if head.get("warc-block-digest", "sha1:" + sha1_base32(block)) != "sha1:" + sha1_base32(block):
        raise Damage("wrong block digest")
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    if head.get("warc-type") == "response" and head.get("warc-payload-digest", "") not in ("", "sha1:" + sha1_base32(payload)):
        raise Damage("wrong payload digest")
    return head, payload


def _plain(window: _Bytes, most: int) -> bytes:
    """The uncompressed record at the window's place; the window stands after it."""
    while (end := window.data.find(b"\r\n\r\n", window.at, window.at + HEADER_BYTES)) < 0:
        if len(window.data) - window.at >= HEADER_BYTES or not window.more():
            raise Damage("no end of header")
    length = _head(window.data[window.at : end]).get("content-length", "")
    if not length.isdigit() or int(length) > most:
        raise Damage("no length")
    n = end - window.at + 8 + int(length)
    if not window.need(n):
        raise Damage("cut off")
    raw = window.data[window.at : window.at + n]
    window.at += n
    return raw


def _one(window: _Bytes, most: int) -> Iterator[tuple]:
    """The uncompressed record at the window's place."""
    start = window.offset
    head, payload = parse_record(_plain(window, most))
    yield ("record", start, window.offset, head, payload)


def _member(window: _Bytes, most: int) -> Iterator[tuple]:
    """Records and gaps of the gzip member at the window's place, each record as soon as it is unpacked and checked.

    Offsets are those of the member; the end of a record that others follow is what had been read of the member by then.
    Records that carry no digest wait for the member's own checksum. Where the member breaks off, Damage says from where.
    """
    start, unpacked = window.offset, _Inflated(window)
    inner = _Bytes(unpacked)
    done = start  # what was surely read when the last record was complete
    ready, waiting, gaps, bad, held, why = None, [], [], None, 0, "no record"
    try:
        while inner.need(1):
            inner.keep, at = inner.offset, inner.offset
            try:
                if not (inner.need(10) and _LINE.match(inner.data, inner.at)):
                    raise Damage("no record")
                head, payload = parse_record(_plain(inner, most))
            except Broken:
                raise
            except Damage as e:
                if bad is None:
                    bad, why = at, str(e)
                inner.go(at + 1)
                while not (ahead := _LINE.search(inner.data, inner.at)):
                    inner.go(inner.base + max(inner.at, len(inner.data) - 9))
                    if not inner.more():
                        inner.go(inner.base + len(inner.data))
                        break
                if ahead:
                    inner.go(inner.base + ahead.start())
                continue
            if bad is not None:
                gaps.append((bad, at, why))
                bad = None
            if ready:
                yield ready
            done = window.keep = unpacked.sure
            ready = ("record", start, done, head, payload)
            if not {"warc-block-digest", "warc-payload-digest"} & head.keys():
                held += len(payload)
                if held > most:
                    raise Broken("more records without digest than can wait for the checksum")
                waiting.append(ready)
                ready = None
    except Broken as e:
        if ready:
            yield ready
        lost = done if ready or done > start and not waiting else start
        for a, b, reason in gaps:
            yield ("gap", start, lost, f"{reason} in bytes {a} to {b} of the member", None)
        raise Damage(str(e), lost, max(lost, start + 1)) from e
    end = window.offset
    found = [*waiting, *([ready] if ready else [])]
    if not found and done == start:
        raise Damage(why, start, end)
    for _, _, _, head, payload in found:
        yield ("record", start, end, head, payload)
    if bad is not None:
        gaps.append((bad, inner.offset, why))
    for a, b, reason in gaps:
        yield ("gap", start, end, f"{reason} in bytes {a} to {b} of the member", None)


def salvage(stream, most: int = MOST_BYTES, starts: re.Pattern[bytes] = _START) -> Iterator[tuple]:
    """("record", offset, end, header, payload) and ("gap", offset, end, reason, None), in the order of the file.

    After damage the search for the next start goes on one byte behind the start that failed, so no valid record is
    passed over. A gzip member of several records gives each as it is complete, and where it breaks off the gap begins
    after the last of them. most: bytes of the largest record. An empty stream yields nothing. The window holds a
    record and what is read ahead, however large the file or a member is.
    """
    window, bad, reason = _Bytes(stream), None, ""
    while window.need(1):
        start = window.offset
        window.keep, lost, resume, why = start, start, start + 1, "no record"
        window.need(10)
        if found := starts.match(window.data, window.at):
            try:
                for x in (_member if found[0][:1] == b"\x1f" else _one)(window, most):
                    if bad is not None:
                        yield ("gap", bad, start, reason, None)
                        bad = None
                    yield x
                continue
            except Damage as e:
                why = str(e)
                if e.lost is not None:
                    lost, resume = e.lost, e.resume
        if bad is None:
            bad, reason = lost, why
        window.go(resume)
        while not (ahead := starts.search(window.data, window.at)):
            window.go(window.base + max(window.at, len(window.data) - 9))
            if not window.more():
                window.go(window.base + len(window.data))
                break
        if ahead:
            window.go(window.base + ahead.start())
    if bad is not None:
        yield ("gap", bad, window.offset, reason, None)


_READ = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read(with_payload: bool):
    def number(head: dict[str, str], key: str) -> int | None:
        return int(head[key]) if re.fullmatch(r"-?\d+", head.get(key, "")) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = file_system(uri)
                out, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for kind, start, end, head, payload in salvage(stream):
                        row = {"path": uri, "offset": start, "end": end, "kind": kind}
                        if kind == "gap":
                            row["reason"] = head
                        else:
                            revisit = head.get("warc-type") == "revisit"
                            row |= {
                                "page_id": number(head, "x-page-id"),
                                "url": head.get("warc-target-uri"),
                                "record_type": head.get("warc-type"),
                                "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else sha1_base32(payload),
                                "payload_bytes": number(head, "x-payload-length") if revisit else len(payload),
                                "refers_to": number(head, "x-refers-to-page-id"),
                                "payload": payload if with_payload and not revisit else None,
                            }
                            size += len(payload) * with_payload
                        out.append(row)
                        if len(out) >= 2000 or size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=_READ)
                            out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=_READ)

    return read


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps (kind) of the files in column path: offsets in the file, header fields, payload of responses.

    path: URIs with a scheme. Rows with a null path name no file and give none; a repeated path is read as often. No
    rows give no rows. Further columns are not read.
    """
    schema = "path string, offset long, end long, kind string, reason string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    spread = archives.select("path").where("path is not null").repartition(max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(_read(with_payload), schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives and read them back; one row per record. Fails if the reader met a gap."""
    folder = new_folder(spark, "warc")
    back = read_archives(write_archives(table(spark, sf_dir, "pages"), folder), with_payload=False)
    sound = F.when(F.col("kind") == "gap", F.raise_error(F.concat(F.lit("gap in "), F.col("path")))).otherwise(F.col("record_type"))
    return back.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")
