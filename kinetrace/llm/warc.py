"""WARC archives: a writer of one gzip member a record, and a reader that salvages damaged files.

The reader checks each member or record: it must decompress, have a version line, a header with a length, the
closing blank lines and the digest it names. Where a check fails it searches on for the next gzip member or
version line that passes, goes on from there, and logs the bytes between as a quarantined gap. The same holds
within a member of several records; of one that is cut off or broken, the content up to there counts.

Files are read and members inflated piece by piece, so a task holds a record and not an archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, bounded_batches, id_or_last, join_groups, new_path, stored, tables, text_of

#: A file ends after the record with which it has this many bytes.
FILE_BYTES = 256 << 20
#: Read from a file at once; and what a member may inflate to before it is inflated a second time, piece by piece.
BLOCK, HELD = 1 << 20, 16 << 20
_DATE = "1970-01-01T00:00:00Z"
_SCHEMA = "file string, offset bigint, length bigint, status string, reason string, record_type string, record_id string, target_uri string, page_id bigint, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def digest(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _one_line(s: str | None) -> str:
    return " ".join((s or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response holds the payload, a revisit only names it by digest, length and the response's id."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_one_line(url)}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Bad(ValueError):
    """A failed check; its text is the reason that the gap gets."""


class _Bytes:
    """Bytes that are in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def get(self, start: int, stop: int) -> bytes:
        return self.data[start:stop]

    def forget(self, start: int) -> None:
        """Nothing before ``start`` will be asked for again."""


class _File(_Bytes):
    """An open file that is read in blocks."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.held, self.at = file, file.size(), b"", 0

    def get(self, start: int, stop: int) -> bytes:
        stop = min(stop, self.size)
        if not self.at <= start <= stop <= self.at + len(self.held):
            self.at, self.held = start, self.file.read_at(max(stop - start, min(BLOCK, self.size - start)), start)
        return self.held[start - self.at : stop - self.at]


class _Member(_Bytes):
    """What a gzip member inflates to, made again as it is asked for; ``size`` is known from a first pass."""

    def __init__(self, source: _Bytes, at: int, size: int):
        self.pieces, self.size, self.held, self.at = _inflated(source, at), size, bytearray(), 0

    def get(self, start: int, stop: int) -> bytes:
        while self.at + len(self.held) < min(stop, self.size):
            self.held += next(self.pieces)[0]
        return bytes(self.held[start - self.at : stop - self.at])

    def forget(self, start: int) -> None:
        if start - self.at > BLOCK:
            del self.held[: start - self.at]
            self.at = start


def _find(source: _Bytes, pattern: re.Pattern, at: int, step: int = 1 << 12) -> re.Match | None:
    """The first match from ``at`` on, with its place; patterns have at most 8 bytes."""
    while at < source.size:
        part = source.get(at, at + step + 7)
        for m in pattern.finditer(part):
            if m.start() < step:
                return at + m.start(), m[0]
        at, step = at + step, min(4 * step, BLOCK)
    return None


_LINE = re.compile(rb"\r\n")


def _parse(source: _Bytes, at: int) -> tuple[dict, bytes, int]:
    """(header, block, end) of the record at ``at``."""
    if source.get(at, at + 7) not in (b"WARC/1.", b"WARC/0."):
        raise Bad("no version line")
    head, found = {}, _find(source, _LINE, at)
    while found and source.get(found[0], found[0] + 4) != b"\r\n\r\n":  # a header may be of any length; the first bad line ends the search
        start, found = found[0] + 2, _find(source, _LINE, found[0] + 2)
        if not found:
            break
        line = source.get(start, found[0]).decode("utf-8", "replace")
        name, colon, value = line.partition(":")
        if not colon or "\r" in line or "WARC/" in name:
            raise Bad("header line cut off or without colon")
        head[name.strip().lower()] = value.strip()
    if not found:
        raise Bad("header without end")
    end = found[0]
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError):
        raise Bad("no content length") from None
    stop = end + 4 + length
    if length < 0 or stop + 4 > source.size or source.get(stop, stop + 4) != b"\r\n\r\n":
        raise Bad("record does not end where its length says")
    block = source.get(end + 4, stop)
    named = head.get("warc-block-digest", "")
    if named.lower().startswith("sha1:") and named[5:].upper() != digest(block):
        raise Bad("block digest differs")
    return head, block, stop + 4


def _payload(head: dict, block: bytes) -> bytes | None:
    """A response's payload, checked; None for records without one here."""
    if head.get("warc-type") not in ("response", "resource"):
        return None
    data = block
    if head.get("content-type", "").startswith("application/http"):
        _, blank, data = block.partition(b"\r\n\r\n")
        if not blank:
            raise Bad("HTTP header without end")
    named = head.get("warc-payload-digest", "")
    if named.lower().startswith("sha1:") and named[5:].upper() != digest(data):
        raise Bad("payload digest differs")
    return data


_VERSION = re.compile(rb"WARC/[01]\.")
_START = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.")


def _inflated(source: _Bytes, at: int) -> Iterator[tuple[bytes, int, str | None]]:
    """Pieces of the member at ``at``: (bytes, end, reason), the last with its end and, if it is cut off or broken, why."""
    d, i, step = zlib.decompressobj(31), at, 1 << 16
    while not d.eof:
        if i >= source.size:
            yield b"", i, "member cut off"
            return
        before = d.copy()
        try:
            piece = d.decompress(source.get(i, i + step))
        except zlib.error:  # the failing step gave nothing: its input once more, byte by byte
            out = []
            try:
                while i < source.size:
                    out.append(before.decompress(source.get(i, i + 1)))
                    i += 1
            except zlib.error:
                pass
            yield b"".join(out), i, "member does not decompress"
            return
        i += step
        yield piece, min(i, source.size) - len(d.unused_data), None


def _inside(source: _Bytes, broken: str | None) -> Iterator[tuple[dict | None, bytes | None, str | None]]:
    """(header, payload, reason) of each record and gap of a member's content.

    Where it does not decompress to the end, records without a block digest count as damaged, and the others
    have the reason too, for nothing covers their headers; the last gap is then the member's end.
    """
    i, gap, why = 0, None, None
    while i < source.size:
        source.forget(i)
        try:
            head, block, end = _parse(source, i)
            payload = _payload(head, block)
            if broken == "member does not decompress" and not head.get("warc-block-digest", "").lower().startswith("sha1:"):
                raise Bad("no digest in a broken member")
        except Bad as e:
            if gap is None:
                gap, why = i, str(e)
            found = _find(source, _VERSION, i + 1)
            i = found[0] if found else source.size
            continue
        if gap is not None:
            yield None, None, f"{why}, bytes {gap} to {i} of the member"
            gap = None
        yield head, payload, broken
        i = end
    if broken:
        yield None, None, f"{broken}, after byte {source.size if gap is None else gap} of its content"
    elif gap is not None:
        yield None, None, f"{why}, bytes {gap} to {source.size} of the member"


def _member(source: _Bytes, at: int):
    """(records and gaps, end, reason) of the member at ``at``; Bad if it has no record that is whole."""
    held, size, end, broken = [], 0, at, None
    for piece, end, broken in _inflated(source, at):
        size += len(piece)
        if size <= HELD:
            held.append(piece)
    found = _inside(_Bytes(b"".join(held)) if size <= HELD else _Member(source, at, size), broken)
    first = []
    for x in found:
        first.append(x)
        if x[0] is not None:
            break
    else:
        if first:
            raise Bad(broken or first[0][2])
    return chain(first, found), end, broken


def salvage(data: bytes | _Bytes) -> Iterator[tuple[int, int, dict | None, bytes | None, str | None]]:
    """(offset, length, header, payload, reason) of each record, and of each gap with a header of None.

    What lies in a member of several has the member's place. A record has a reason if its member is broken.
    """
    source = _Bytes(data) if isinstance(data, bytes) else data
    at, gap, why, seen = 0, None, "", 0
    while at < source.size:
        try:
            if source.get(at, at + 2) == b"\x1f\x8b":
                found, end, broken = _member(source, at)
                if broken:
                    # a next member may start in what was taken for this one's; version lines there are its own
                    seen = max(seen, end)
                    end = _next(source, at + 1, seen)
            else:
                head, block, end = _parse(source, at)
                found = [(head, _payload(head, block), None)]
        except Bad as e:
            if gap is None:
                gap, why = at, str(e)
            at = _next(source, at + 1, seen)
            continue
        if gap is not None:
            yield gap, at - gap, None, None, why
            gap = None
        for head, payload, reason in found:
            yield at, end - at, head, payload, reason
        at = end
    if gap is not None:
        yield gap, source.size - gap, None, None, why


def _next(source: _Bytes, at: int, seen: int) -> int:
    """The next place from ``at`` where a member may start, or a record from ``seen`` on."""
    while found := _find(source, _START, at):
        if found[0] >= seen or found[1] == b"\x1f\x8b\x08":
            return found[0]
        at = found[0] + 1
    return source.size


def _store(uri: str):
    """(file system, path) that pyarrow has for a URI or a local path."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file" or not _:
        return fs.LocalFileSystem(), "/" + (rest if _ else uri).lstrip("/")
    return fs.FileSystem.from_uri("s3:" + rest if scheme in ("s3a", "s3n") else uri)


#: Schemes that pyarrow opens; files of others are read whole by Spark.
_OPENED = ("file", "hdfs", "s3", "s3a", "s3n", "gs")


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """Write rows (page_id, url, payload, refers_to, revisit) as archives under ``path``; a stored table of the files.

    ``path`` is a URI of a new folder that pyarrow can write from every executor. A task writes under names of
    its own attempt in ``_attempts``, which no reader looks into; only the files of attempts that Spark counts
    are then moved to their names, so tasks that die or run twice leave nothing that is read.
    """

    def run(batches):
        from pyspark import TaskContext

        store, root = _store(path)
        store.create_dir(f"{root}/_attempts", recursive=True)
        task = TaskContext.get()
        out, files, held, count = None, 0, 0, 0

        def closed():
            nonlocal out, files, held, count
            out.close()
            name = f"part-{task.partitionId():06d}-{files:05d}.warc.gz"
            row = pa.RecordBatch.from_arrays([pa.array([temp]), pa.array([name]), pa.array([held], pa.int64()), pa.array([count], pa.int64())], ["temp", "file", "bytes", "records"])
            out, files, held, count = None, files + 1, 0, 0
            return row

        for b in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit"))):
                if out is None:
                    temp = f"_attempts/{task.partitionId()}-{task.taskAttemptId()}-{files}"
                    out = store.open_output_stream(f"{root}/{temp}", compression=None)
                data = member(record(page_id, url, (payload or "").encode() if not isinstance(payload, bytes) else payload, refers_to, revisit))
                out.write(data)
                held += len(data)
                count += 1
                if held >= FILE_BYTES:
                    yield closed()
        if out is not None:
            yield closed()

    def publish(batches):
        store, root = _store(path)
        for b in batches:
            for temp, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    store.move(f"{root}/{temp}", f"{root}/{name}")
                except OSError:  # a task that ran before has moved it
                    if not store.get_file_info(f"{root}/{name}").is_file:
                        raise
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{n}" for n in b.column(1).to_pylist()], pa.string()), *b.columns[2:]], ["file", "bytes", "records"])

    written = stored(records.mapInArrow(run, "temp string, file string, bytes bigint, records bigint"), "warc-attempts")
    return stored(written.mapInArrow(publish, "file string, bytes bigint, records bigint"), "warc-files")


def _rows(with_payload: bool, opened):
    """Rows of archives; ``opened`` gives (file, source) pairs of a batch."""
    names = [f.split(" ")[0] for f in _SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    number = lambda head, name: int(head[name]) if head.get(name, "").lstrip("-").isdigit() else None

    def run(batches):
        for b in batches:
            for file, source in opened(b):
                rows, held = [], 0
                for at, length, head, payload, reason in salvage(source):
                    if head is None:
                        rows.append((file, at, length, "gap", reason, *[None] * 8))
                    else:
                        named = head.get("warc-payload-digest", "")[5:].upper() or None
                        size, sum_ = (number(head, "x-payload-length"), named) if payload is None else (len(payload), digest(payload))
                        rows.append((file, at, length, "record", reason, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-target-uri"), number(head, "x-page-id"), number(head, "x-refers-to-page-id"), size, sum_, payload if with_payload else None))
                    held += len(payload or b"") * with_payload + len((head or {}).get("warc-target-uri", ""))
                    if len(rows) >= 2000 or held >= 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _opened(batch):
    for file in batch.column(0).to_pylist():
        store, place = _store(file)
        with store.open_input_file(place) as f:
            yield file, _File(f)


def _whole(batch):
    for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield file, _Bytes(content.as_py() or b"")


def read_files(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """``read_warc`` of exactly the archives in the column ``file``, each by one task, a block at a time."""
    each = files.select("file").repartition(min(max(1, files.count()), 10_000))
    return each.mapInArrow(_rows(with_payload, _opened), _SCHEMA)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives under ``path`` (any path Spark reads), ``status`` telling them apart.

    A gap has its file, offset, length and reason; a record also its header's fields and payload, and a reason
    only if it was salvaged from a member that is cut off or broken. A revisit's
    length and digest are those of the payload it stands for. Files without a byte, and paths without a file,
    give no rows. In stores that pyarrow does not know a task holds whole files, of 2 GB at most.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    first = files.select("path").first()
    if first is None or first.path.partition(":")[0] in _OPENED:
        return read_files(files.select(F.col("path").alias("file")), with_payload)
    return files.select("path", "content").mapInArrow(_rows(with_payload, _whole), _SCHEMA)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record a page to ``path``; the table of files.

    Null payloads count as empty. Of equal payloads (by SHA-1) the one with the smallest id is a response, all
    others are revisits of it; rows repeated with that id are all responses; a null id counts as the largest.
    Other columns are not read. An empty table writes no file.
    """
    p = pages.select(id_or_last(id_col).alias("id"), F.col(url_col).alias("url"), text_of(payload_col).alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha1("payload")))
    bounded_batches(pages.sparkSession)
    narrow = stored(p.select("id", "sha"), "payloads")
    groups = narrow.groupBy("sha").agg(F.min("id").alias("owner"), F.count("*").alias("size")).where(F.col("size") > 1)
    again = join_groups(narrow, stored(groups, "payload-groups"), ["sha"], "size", narrow.count())
    again = again.where(F.col("id") > F.col("owner")).select("id", "sha", "owner").distinct()
    p = p.join(again, ["id", "sha"], "left")
    page_id = F.when(F.col("id") < F.lit(NULL_ID), F.col("id"))
    return write_warc(p.select(page_id.alias("page_id"), "url", "payload", F.col("owner").alias("refers_to"), F.col("owner").isNotNull().alias("revisit")), path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read those archives back: a row a page. A gap in them is an error."""
    spark = pages.sparkSession
    with tables(spark) as keep:
        path = new_path(spark, "warc")
        files = archive(pages, path)
        keep(path, files)
    back = read_files(files, with_payload=False)
    gap = F.raise_error(F.concat(F.lit("gap in an archive just written: "), "file", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "reason"))
    return back.where(F.when(F.col("status") == "record", True).otherwise(gap.cast("boolean"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
