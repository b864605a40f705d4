"""WARC archives written in parallel, and a reader that salvages what damaged archives still hold.

``write`` gives every page a record of WARC 1.1 in a gzip member of its own. Tasks write the pages of their own splits;
nothing wide is shuffled. Payloads of at least ``least`` bytes that occur again become ``revisit`` records of the
profile identical-payload-digest: they hold the HTTP header, with the payload's length, but no payload. Of equal payloads
the row of smallest ``page_id`` is kept whole (NULL last, then by file and place of the row). Files are named by attempt
and listed by a manifest that Spark commits, so a repeated or lost attempt leaves no record twice.

``read`` takes ``.warc.gz`` with a member a record or with several records a member, and plain ``.warc``. A file is
read by one task, in pieces: archives are rolled at a bounded size. Checks, in order: member header, deflate stream,
checksum and length of the member, version line, header fields, length of the block, end of the record, digests of
block and payload. After a failed check the reader searches on from the byte after the place that failed, not after the
place where it noticed: for the next member that inflates to a version line, or the next version line at the start of a
line with fields that hold. What it passes over is logged as a gap with its first and last byte and the first failed
check; gaps that touch are one. Records of a damaged member that their own digest confirms are kept. A record stored
inside a damaged record (an archive of archives) may come up as a record of its own.

A NULL html is an empty payload, a NULL url has no target field, control characters and spaces of a url are
percent-encoded, a NULL ``page_id`` is written as such and read as NULL. Repeated rows are records of their own; empty
tables give no archive and no rows; a very long text is one record, held by its task. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import keys_side
from .rows import with_row
from .scratch import folder, stage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, n_records long, n_bytes long"
RECORDS = ("file string, offset long, record_type string, record_id string, uri string, refers_to string, payload_bytes long, "
           "payload_digest string, payload binary, gap_end long, failed string")
#: Bytes read at a time, and most bytes of a member that are kept inflated instead of being inflated twice.
PIECE, KEPT = 1 << 20, 8 << 20
#: Most bytes of a record's header.
HEADER = 1 << 20
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/[01]\.\d+\r?\n")
_NEXT_VERSION = re.compile(rb"(?<=\n)WARC/[01]\.\d+\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# ------------------------------------------------------------------ writing


def record(kind: str, record_id: str, block: bytes, fields: list[tuple[str, str]], date: str) -> bytes:
    """One record, uncompressed."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *fields,
             ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without name or time."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _page_record(row, date: str) -> bytes:
    payload = row["payload"]
    fields = [("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http; msgtype=response")]
    if row["url"] is not None:
        fields.insert(0, ("WARC-Target-URI", quote(row["url"], safe="".join(map(chr, range(0x21, 0x7F))))))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if row["first"] is None:
        return record("response", row["id"], http + payload, fields, date)
    fields += [("WARC-Refers-To", f"<{row['first']}>"), ("WARC-Profile", PROFILE)]
    return record("revisit", row["id"], http, fields, date)


def write(pages: DataFrame, path: str, *, least: int = 100, roll_bytes: int = 1 << 30, level: int = 6,
          date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of ``page_id``, ``url`` and ``html`` below ``path``; the manifest, one row a file."""
    spark = pages.sparkSession
    t = with_row(pages.select("page_id", "url", "html"), "row")
    payload = F.coalesce("html", F.lit(""))
    name = F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("row").cast("string"))
    t = t.select("page_id", "url", payload.cast("binary").alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"),
                 name.alias("id"), "row")
    # the first row of each payload that occurs again: one row a digest, so counts meet before the shuffle
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "id")
    again = (t.where(F.octet_length("payload") >= least).groupBy(F.unhex("digest").alias("key"))
             .agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("key", F.col("f.row").alias("first_row"), F.col("f.id").alias("first")))
    again = stage(again, "payloads")
    t = t.withColumn("key", F.unhex("digest")).join(keys_side(again), "key", "left")
    t = t.select("url", "payload", "digest", "id", F.when(F.col("row") != F.col("first_row"), F.col("first")).alias("first"))

    def save(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, root = _store(path)
        out, name, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if out is None:
                        store.create_dir(root, recursive=True)
                        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out, n = store.open_output_stream(f"{root}/{name}", compression=None), 0
                        info = member(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", [
                            ("Content-Type", "application/warc-fields"), ("WARC-Filename", name)], date), level)
                        size = out.write(info)
                    size += out.write(member(_page_record(row, date), level))
                    n += 1
                    if size >= roll_bytes:
                        out.close()
                        done.append((name, n, size))
                        out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "n_records", "n_bytes"), d)) for d in done],
                                             pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    t.mapInArrow(save, FILES).write.parquet(f"{path}/manifest")
    return spark.read.schema(FILES).parquet(f"{path}/manifest")


# ------------------------------------------------------------------ reading


class Failed(Exception):
    """A check that did not hold."""


class Plain:
    """A file's bytes with a window that moves on; ``at`` is the offset of the next byte, ``buf[pos]``."""

    def __init__(self, file) -> None:
        self.file, self.buf, self.pos, self.at = file, b"", 0, 0

    def need(self, n: int) -> int:
        """Have the next ``n`` bytes in the window, fewer only at the end; how many it has."""
        have = len(self.buf) - self.pos
        if have < n:
            parts = [self.buf[self.pos:]]
            while have < n and (more := self.more()):
                parts.append(more)
                have += len(more)
            self.buf, self.pos = b"".join(parts), 0
        return have

    def more(self) -> bytes:
        return self.file.read(PIECE)

    def skip(self, n: int) -> None:
        n = min(n, self.need(n))
        self.pos, self.at = self.pos + n, self.at + n

    def ends(self, n: int) -> bool:
        """Whether a record may end ``n`` bytes on: looked up before so much is read."""
        if len(self.buf) - self.pos >= n + 2:
            return True
        back = self.file.tell()
        self.file.seek(self.at + n)
        found = self.file.read(2)
        self.file.seek(back)
        return found in (b"\r\n", b"\n\n")


class Inflated(Plain):
    """What the member at ``start`` inflates to, as far as it inflates."""

    def __init__(self, file, start: int) -> None:
        super().__init__(file)
        file.seek(start)
        self.z, self.end, self.error = zlib.decompressobj(31), start, None

    def more(self) -> bytes:
        while self.error is None and not self.z.eof:
            raw = self.z.unconsumed_tail or self.file.read(PIECE)
            if not raw:
                self.error = "member is cut off"
                break
            try:
                out = self.z.decompress(raw, PIECE)
            except zlib.error as e:
                text = str(e)
                self.error = ("member checksum" if "data check" in text else "member length" if "length check" in text
                              else "member header" if "header" in text else "deflate stream")
                break
            self.end += len(raw) - len(self.z.unused_data if self.z.eof else self.z.unconsumed_tail)
            if out:
                return out
        return b""

    def ends(self, n: int) -> bool:
        return True


def _matches(digest: str, data: bytes) -> bool | None:
    """Whether ``label:value`` is the digest of ``data``, in hex, base 32 or base 64; None if the label is unknown."""
    label, _, value = digest.partition(":")
    try:
        raw = hashlib.new(label.strip().lower().replace("-", ""), data).digest()
    except ValueError:
        return None
    value = value.strip()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=") or (
        value.rstrip("=") == base64.b64encode(raw).decode().rstrip("="))


def _fields(head: bytes) -> dict[str, str]:
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif line:
            name, colon, value = line.partition(":")
            if not colon:
                raise Failed("header field")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _header(source: Plain) -> tuple[dict[str, str], int, int]:
    """Fields of the record that begins here, the header's length and the block's."""
    source.need(64)
    if not VERSION.match(source.buf, source.pos):
        raise Failed("version line")
    size = 8192
    while True:
        have = source.need(size)
        if end := _HEAD_END.search(source.buf, source.pos, source.pos + HEADER):
            break
        if have < size or size > HEADER:
            raise Failed("header is cut off")
        size *= 2
    fields = _fields(source.buf[source.pos:end.start()])
    length = fields.get("content-length", "")
    if "warc-type" not in fields or not (length.isascii() and length.isdigit() and len(length) < 19):
        raise Failed("header field")
    return fields, end.end() - source.pos, int(length)


def parse(source: Plain) -> dict:
    """The record at the source's place, checked; the source moves behind it. ``sure`` if a digest confirms it."""
    fields, head, length = _header(source)
    if not source.ends(head + length):
        raise Failed("end of record")
    if source.need(head + length + 4) < head + length:
        raise Failed("record is cut off")
    block = source.buf[source.pos + head:source.pos + head + length]
    tail = source.buf[source.pos + head + length:source.pos + head + length + 4]
    width = 4 if tail == b"\r\n\r\n" else 2 if tail[:2] == b"\n\n" else 0
    if not width:
        raise Failed("end of record")
    sure = False
    if digest := fields.get("warc-block-digest"):
        if (ok := _matches(digest, block)) is False:
            raise Failed("block digest")
        sure = bool(ok)
    kind, payload, size, http = fields["warc-type"].lower(), block, length, b""
    if "application/http" in fields.get("content-type", "") and (cut := _HEAD_END.search(block)):
        http, payload = block[:cut.end()], block[cut.end():]
        size = len(payload)
    digest = fields.get("warc-payload-digest", "")
    if kind == "revisit":
        bare = digest.partition(":")[2].strip().lower() or None
        if m := re.search(rb"(?im)^content-length:[ \t]*(\d+)", http):
            size = int(m[1])
    else:
        bare = hashlib.sha256(payload).hexdigest()
        if digest and digest.lower() != f"sha256:{bare}":
            if (ok := _matches(digest, payload)) is False:
                raise Failed("payload digest")
            sure |= bool(ok)
    source.skip(head + length + width)
    return {"record_type": kind, "record_id": fields.get("warc-record-id", "").strip("<>"), "uri": fields.get("warc-target-uri"),
            "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "payload_bytes": size,
            "payload_digest": bare, "payload": payload, "sure": sure}


def _salvaged(source: Plain) -> Iterator[tuple[str, int, dict | str]]:
    """Records of a source of plain bytes and the places where a check failed, each with its offset."""
    while source.need(1):
        at = source.at
        try:
            yield "record", at, parse(source)
            continue
        except Failed as e:
            failed = str(e)
        yield "failed", at, failed
        while True:  # to the next version line whose fields hold
            have = source.need(PIECE)
            if m := _NEXT_VERSION.search(source.buf, source.pos + 1):
                source.skip(m.start() - source.pos)
                try:
                    _header(source)
                    break
                except Failed:
                    continue
            if have < PIECE:
                source.skip(have)
                break
            source.skip(have - 65)  # a version line may begin here and end in the next piece


def _next_member(file, at: int) -> int | None:
    """The next place from ``at`` on where a member inflates to a version line; None if there is none."""
    buf = b""
    file.seek(at)
    while True:
        more = file.read(PIECE)
        buf += more
        place = 0
        while (place := buf.find(MEMBER, place)) >= 0:
            inside = Inflated(file, at + place)
            inside.need(64)
            if VERSION.match(inside.buf):
                return at + place
            place += 1
        if not more:
            return None
        at += max(0, len(buf) - 2)
        buf = buf[-2:]
        file.seek(at + len(buf))


def _members(file) -> Iterator[tuple[str, int, dict | str]]:
    """Records of a file of gzip members, by the member's offset, and failed places."""
    at = 0
    while True:
        file.seek(at)
        if not file.read(1):
            return
        # first the member as a whole: a small one stays inflated
        inside, parts, kept = Inflated(file, at), [], 0
        while piece := inside.more():
            kept += len(piece)
            parts = [*parts, piece] if kept <= KEPT else []
        error, end = inside.error or (None if kept else "empty member"), inside.end
        source = Plain(io.BytesIO(b"".join(parts))) if kept <= KEPT else Inflated(file, at)
        for kind, _, x in _salvaged(source):
            if kind == "failed":
                error = error or x
            elif inside.error is None or x["sure"]:
                yield "record", at, x
        if error is None:
            at = end
            continue
        yield "failed", at, error
        if inside.error is None:  # the member is sound, its text is not
            at = end
        elif (found := _next_member(file, at + 1)) is None:
            return
        else:
            at = found


def records(file, size: int, members: bool) -> Iterator[dict]:
    """Records and gaps of one archive, in order of their offsets; ``file`` can be read and sought."""
    found = _members(file) if members else _salvaged(Plain(file))
    gap = None
    for kind, at, x in found:
        if kind == "failed":
            gap = gap or (at, x)
            continue
        # records salvaged from inside a damaged member share its offset and leave the gap open
        if gap and at > gap[0]:
            yield {"offset": gap[0], "gap_end": at, "failed": gap[1]}
            gap = None
        yield {"offset": at, **x}
    if gap:
        yield {"offset": gap[0], "gap_end": size, "failed": gap[1]}


def read(spark: SparkSession, path: str, files: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives below ``path``: rows with ``failed`` are gaps ``[offset, gap_end)``.

    ``files`` has the names to read in ``file`` (a manifest); without it every ``*.warc`` and ``*.warc.gz`` is read.
    """
    if files is None:
        files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
                 .select(F.regexp_extract("path", r"[^/]+\z", 0).alias("file")))
    names = ["offset", "record_type", "record_id", "uri", "refers_to", "payload_bytes", "payload_digest", "payload", "gap_end", "failed"]

    def load(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary(), "gap_end": pa.int64()}
        schema = pa.schema([("file", pa.string()), *((n, kinds.get(n, pa.string())) for n in names)])
        store, root = _store(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_file(f"{root}/{name}") as f:
                    out, held = [], 0
                    for r in records(f, f.size(), name.endswith(".gz")):
                        if not payloads:
                            r["payload"] = None
                        held += 500 + len(r.get("payload") or b"")
                        out.append({"file": name, **{n: r.get(n) for n in names}})
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema)

    n = max(1, files.count())
    return files.select("file").repartition(n, "file").mapInArrow(load, RECORDS)


def page_of(record_id) -> F.Column:
    """The ``page_id`` in a record id of ``write``; NULL if the page had none."""
    found = F.regexp_extract(record_id, r"\Aurn:page:(-?\d*):", 1)
    return F.when(found != "", found.cast("long"))


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """The pages' records as read back from their archives."""
    path = path or folder(pages.sparkSession, "warc")
    found = read(pages.sparkSession, path, write(pages, path, **options), payloads=False)
    return found.where(F.col("record_type").isin("response", "revisit")).select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"),
        "file", "offset")
