"""WARC archives in Zstandard: writer and reader.

An archive begins with a skippable frame that holds the compression dictionary; then comes one frame for each record. The
reader loads the dictionary from that frame, decodes frame by frame in pieces (so neither an archive nor a frame's
compressed form is ever held whole) and checks each record: version line, mandatory headers, Content-Length against the
bytes there, the closing line breaks, the payload's length and digest. What fails a check is returned with ``error`` and
never left out; ``strict`` raises instead.

Of equal payloads of at least ``LEAST`` bytes the record with the smallest identifier is the response, others revisit it:
they carry the payload's digest and HTTP headers, which tell its length, but not the payload. Only identifiers and digests
are shuffled to find these; the table of repeated payloads is written first, so Spark knows its size before it chooses the
join, and a payload that many rows share has one row on that side.

Archives are written by tasks under the shared folder with names of their own; the table of archives holds those of the
attempt that Spark committed, so what a lost or repeated task wrote is never read. Tasks reach that folder by
``pyarrow.fs``, so its scheme must be one that pyarrow knows (file, hdfs, s3, gs, abfs).

Defined cases: a null payload is empty; a null identifier is never a response's beside one that isn't null, and reads as
null again; rows that repeat a response's identifier are responses too; a null URL reads as null; an empty table gives no
archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, staged, staged_folder, trimmed

LEAST, DATE, ARCHIVE_BYTES, LEVEL, PIECE = 100, "2000-01-01T00:00:00Z", 1 << 27, 3, 1 << 16
#: The dictionary is trained on so many records at most, those of smallest hash that are no longer than this.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 15, 1 << 16
#: Fixed values of the format: magic numbers of the dictionary's frame, of any skippable frame, and of a Zstandard frame.
DICTIONARY_MAGIC, SKIPPABLE_MAGIC, FRAME_MAGIC = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528
VERSION, PROFILE = b"WARC/1.1\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
_URN = "urn:page:"
READ = "archive string, at long, record_type string, id string, target_uri string, date string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"


class Damaged(ValueError):
    """An archive or record that breaks the format."""


def record(kind: str, ident: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """A response or revisit record as bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _named(ident)), ("WARC-Date", date), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _named(refers_to))]
    return _framed(fields, block)


def _named(ident: str | None) -> str:
    return f"<{_URN}{'' if ident is None else '=' + quote(ident, safe='')}>"


def _framed(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; raises ``Damaged``."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(VERSION) or not gap:
        raise Damaged("no WARC version line or end of headers")
    fields = {}
    for line in head[len(VERSION) :].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged(f"malformed header {line[:40]!r}")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if missing := [m for m in MANDATORY if m.lower() not in fields]:
        raise Damaged(f"without {', '.join(missing)}")
    if not fields["content-length"].isdecimal():
        raise Damaged("Content-Length is no number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Damaged(f"Content-Length is {length}, the block has {len(rest) - 4}")
    return fields, rest[:length]


def _checked(fields: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Length, digest and, of a response, the payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    length = next((v for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length"), b"").strip()
    kind, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if not gap or not length.isdigit() or kind != "sha256":
        raise Damaged("no HTTP headers, length or digest of the payload")
    if fields["warc-type"] == "revisit":
        if payload or not fields.get("warc-refers-to"):
            raise Damaged("a revisit with a payload, or of nothing")
        return int(length), digest.lower(), None
    if int(length) != len(payload) or hashlib.sha256(payload).hexdigest() != digest.lower():
        raise Damaged("the payload's length or digest differs")
    return len(payload), digest.lower(), payload


class Archive:
    """Frames of an open archive, in order."""

    def __init__(self, file):
        self.file, self.held, self.at = file, b"", 0
        magic, size = self._head()
        if magic != DICTIONARY_MAGIC:
            raise Damaged("no dictionary in a leading skippable frame")
        raw = self._take(size)
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))

    def _more(self) -> bool:
        piece = self.file.read(PIECE)
        self.held += piece
        return bool(piece)

    def _take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self._more():
                raise Damaged("the archive ends within a frame")
        taken, self.held = self.held[:size], self.held[size:]
        self.at += size
        return taken

    def _head(self) -> tuple[int, int]:
        return struct.unpack("<II", self._take(8))

    def __iter__(self):
        """Offset and bytes of each frame's content."""
        while self.held or self._more():
            while len(self.held) < 4 and self._more():
                pass
            magic = int.from_bytes(self.held[:4], "little")
            if magic in SKIPPABLE_MAGIC:
                self._take(self._head()[1])
                continue
            if magic != FRAME_MAGIC:
                raise Damaged("neither a frame nor a skippable frame")
            start, frame, pieces = self.at, self.reader.decompressobj(), []
            while not frame.eof:
                if not self.held and not self._more():
                    raise Damaged("the archive ends within a frame")
                self.at += len(self.held)
                try:
                    pieces.append(frame.decompress(self.held))
                except zstandard.ZstdError as why:
                    raise Damaged(f"a frame can't be decoded: {why}") from why
                self.held = frame.unused_data
                self.at -= len(self.held)
            yield start, b"".join(pieces)


def records(file, strict: bool = False):
    """Rows of ``READ`` without the archive's name, of an open archive; after a broken frame nothing more can be found."""
    at = 0
    try:
        for at, raw in Archive(file):
            fields = {}
            try:
                fields, block = parsed(raw)
                kind = fields["warc-type"]
                size, digest, payload = _checked(fields, block) if kind in ("response", "revisit") else (None, None, None)
                error = None
            except Damaged as why:
                if strict:
                    raise
                size, digest, payload, error = None, None, None, str(why)
            uri = fields.get("warc-target-uri")
            yield at, fields.get("warc-type"), _ident(fields.get("warc-record-id")), uri, fields.get("warc-date"), size, digest, _ident(fields.get("warc-refers-to")), payload, error
    except Damaged as why:
        if strict:
            raise
        yield (at, *[None] * 8, str(why))


def _ident(urn: str | None) -> str | None:
    name = (urn or "").strip("<>")
    return unquote(name.removeprefix(_URN + "=")) if name.startswith(_URN + "=") else None


def _filesystem(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def dictionary(df: DataFrame, id_col: str, payload_col: str, sample: int = SAMPLE, longest: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for the records: trained on a bounded sample of whole payloads, or headers alone where there are too few."""
    rows = df.select(F.col(f"`{payload_col}`").alias("t"), F.xxhash64(f"`{payload_col}`", f"`{id_col}`").alias("h")).filter(F.octet_length("t").between(1, longest))
    # About so many rows in all pass the hash's remainder, so that each partition sends few and the driver holds a bounded number.
    every = max(1, rows.count() // sample)
    picked = rows.filter(F.pmod("h", F.lit(every)) == 0).orderBy("h", "t").limit(sample).collect()
    samples = [record("response", "0", "http://example.com/", r.t.encode(), hashlib.sha256(r.t.encode()).hexdigest(), None) for r in picked]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return record("response", "0", "http://example.com/", b"", "", None)


def decided(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """_id, _url, _payload, _digest, _refers (of a revisit: whose payload it repeats) and _revisit of each row."""
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), payload.alias("_payload"), F.sha2(payload.cast("binary"), 256).alias("_digest"))
    long = rows.filter(F.octet_length("_payload") >= least)
    repeated = staged(long.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 and _first is not null").select("_digest", "_first"), "repeated-payloads")
    out = rows.join(repeated, "_digest", "left")
    revisit = F.coalesce(~F.col("_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))
    return out.select("_id", "_url", "_payload", "_digest", F.when(revisit, F.col("_first")).alias("_refers"), revisit.alias("_revisit"))


def write(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL, folder: str | None = None) -> DataFrame:
    """Write a record for each row; return the table of archives: archive (its URI), records, bytes.

    A task begins a new archive when one has ``archive_bytes``. Without a ``folder`` one is made under the shared one.
    """
    spark = df.sparkSession
    folder = folder or staged_folder(spark, "warc")
    words = dictionary(df, id_col, payload_col)
    rows = decided(df, id_col, url_col, payload_col, least).select(F.col("_id").cast("string"), "_url", F.col("_payload").cast("binary"), "_digest", F.col("_refers").cast("string"), "_revisit")

    def run(batches):
        compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True).compress
        info = compress(_framed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        name, out, count, size = None, None, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pylist([{"archive": name, "records": count, "bytes": size}], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        try:
            for batch in batches:
                for ident, url, payload, digest, refers, again in zip(*batch.columns, strict=True):
                    if out is None:
                        name, count, size = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
                        store, path = _filesystem(name)
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(path)
                        size += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words + info)
                    made = record("revisit" if again.as_py() else "response", ident.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py(), date)
                    size += out.write(compress(made))
                    count += 1
                    if size >= archive_bytes:
                        yield closed()
                        out = None
            if out is not None:
                yield closed()
                out = None
        finally:
            if out is not None:
                out.close()

    return staged(rows.mapInArrow(trimmed(run), "archive string, records long, bytes long"), "archives")


def read(archives: DataFrame, strict: bool = False, payloads: bool = True) -> DataFrame:
    """Rows of ``READ``, one for each record of the archives that column ``archive`` names; an archive is read by one task, in pieces."""
    kinds = [(name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in READ.split(","))]

    def sent(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], [n for n, _ in kinds])

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = _filesystem(name)
                rows, held = [], 0
                with store.open_input_stream(path) as file:
                    for row in records(file, strict):
                        if not payloads:
                            row = (*row[:8], None, row[9])
                        rows.append((name, *row))
                        held += len(row[8] or b"") + 200
                        if held > 1 << 22:
                            yield sent(rows)
                            rows, held = [], 0
                yield sent(rows)

    return archives.select("archive").repartition(spread(archives), "archive").mapInArrow(trimmed(run), READ)


def pages(archives: DataFrame, id_type: str = "bigint", strict: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each response and revisit."""
    found = read(archives, strict, payloads=False).filter(F.col("record_type").isin("response", "revisit"))
    return found.select(F.col("id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the rows, then read them back."""
    return pages(write(df, id_col, url_col, payload_col), df.schema[id_col].dataType.simpleString())


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """The table of archives of a folder that others wrote: every ``*.warc.zst`` in it."""
    store, path = _filesystem(folder)
    names = [f.path for f in store.get_file_info(pyarrow.fs.FileSelector(path, recursive=True)) if f.path.endswith(".warc.zst")]
    scheme = folder.partition("://")[0] + "://" if "://" in folder else "file://"
    return spark.createDataFrame([(scheme + n,) for n in names], "archive string")
