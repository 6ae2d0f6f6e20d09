"""WARC archives: a writer with revisit records and a splittable reader.

The writer gives every record a gzip member of its own. The reader's tasks each scan a
byte range for gzip magic, accept a candidate only if a WARC header, of any length, can be
decoded from it, and own the records that start inside their range, reading past its end to finish the
last one. Archives lie in the folder that driver and executors share and are read and
written through Arrow's file systems, by URI.

A record's payload follows its HTTP header. Of records with equal payloads of at least
``least_bytes`` bytes the one with the largest id holds the payload, the others revisit it.

Defined results: a null payload is an empty one; payloads below ``least_bytes`` are never
revisits; repeated rows are records each, all of them responses where their id is the
largest; rows with a null id take part in no revisits. An empty table makes an
archive without records. A damaged or truncated record is an error, and so is a round
trip that reads another number of records than it wrote.
"""

from __future__ import annotations

import base64
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import file_system
from .common import Work

MAGIC, FIRST = b"\x1f\x8b\x08", b"WARC/"
#: A range that one task scans, and how much it reads at a time.
SPLIT_BYTES, READ_BYTES = 16 << 20, 1 << 20
#: Compressed bytes given to the decoder at a time.
FEED_BYTES = 1 << 14
#: Copies of a revisited response that its revisits are dealt to.
LOTS = 64
FIXED_DATE = "2024-01-01T00:00:00Z"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, which is the cluster's default one where it has none."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def record_id(page_id: int) -> str:
    return f"<urn:x-page:{page_id}>"


def clean(value: str | None) -> str:
    return "".join(" " if c in "\r\n" else c for c in value or "")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record's bytes, without compression; a revisit holds the HTTP header alone."""
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {FIXED_DATE}", f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{sha}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    body = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, **options) -> list[str]:
    """Writes one archive a task into ``folder``; the paths of those that were finished."""
    return [path for path, _ in written_archives(pages, folder, **options)]


def written_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, level: int = 4) -> list[tuple[str, int]]:
    """Writes one archive a task; (path, records) of those that were finished.

    A task writes under a name of its own attempt, so a lost or repeated task leaves files
    that nobody lists. The list has an entry for each task that wrote something.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull())
    # Only digests that occur again need an owner; counts are combined before the shuffle.
    owner = large.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d2"), "owner")
    owned = rows.join(owner, (F.col("digest") == F.col("d2")) & (F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull(), "left").drop("d2")

    def write(batches):
        name = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        system, path = file_system(name)
        n, out = 0, None
        for batch in batches:
            for page_id, url, body, digest, own in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                data = record(page_id, url, body, digest, own if own is not None and own != page_id else None)
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(gz.compress(data) + gz.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "n"])

    done = owned.select("page_id", "url", "payload", "digest", "owner").mapInArrow(write, "path string, n long")
    return [(r.path, r.n) for r in done.collect()]  # one row a task


class Ahead:
    """A window on a file from ``start`` on that grows as far as it is looked at."""

    def __init__(self, source, start: int):
        self.source, self.at, self.data, self.pos = source, start, b"", 0
        source.seek(start)

    def more(self) -> bool:
        got = self.source.read(READ_BYTES)
        self.data, self.pos = self.data[self.pos :] + got, 0
        return bool(got)

    def skip(self, n: int) -> None:
        self.pos, self.at = self.pos + n, self.at + n

    def piece(self, offset: int) -> bytes:
        """Bytes from an offset to the window's start on; none at the file's end."""
        if self.pos + offset >= len(self.data) and not self.more():
            return b""
        return self.data[self.pos + offset : self.pos + offset + FEED_BYTES]


class BrokenRecord(ValueError):
    """A member that begins like a record and cannot be read to its end."""


def member(ahead: Ahead):
    """The member at the window's start: (its content, its compressed length), or None if
    none that begins with a WARC header starts there. What begins like a record must be
    one: its header may have any length, but it must end, and so must the member."""
    if not begins_record(ahead):
        return None
    gz, out, fed = zlib.decompressobj(31), [], 0
    try:
        while not gz.eof and (piece := ahead.piece(fed)):
            out.append(gz.decompress(piece))
            fed += len(piece)
    except zlib.error as error:
        raise BrokenRecord(f"damaged record at byte {ahead.at}: {error}") from error
    content = b"".join(out)
    if not gz.eof or b"\r\n\r\n" not in content:
        raise BrokenRecord(f"truncated record at byte {ahead.at}")
    return content, fed - len(gz.unused_data)


def begins_record(ahead: Ahead) -> bool:
    """Whether the first bytes decoded from the window's start are those of a record."""
    gz, out, fed = zlib.decompressobj(31), b"", 0
    try:
        while len(out) < len(FIRST) and not gz.eof and (piece := ahead.piece(fed)):
            out += gz.decompress(piece, len(FIRST) - len(out))
            fed += len(piece)
    except zlib.error:
        return False
    return out == FIRST


def records_of(uri: str, start: int, end: int, broken: str = "raise"):
    """(offset, content) of the records that start in the byte range; a broken one is an
    error, or with ``broken`` "skip" left out."""
    system, path = file_system(uri)
    with system.open_input_file(path) as source:
        ahead = Ahead(source, start)
        while ahead.at < end:
            k = ahead.data.find(MAGIC, ahead.pos)
            if k < 0:
                ahead.skip(max(0, len(ahead.data) - ahead.pos - len(MAGIC) + 1))
                if not ahead.more():
                    return
                continue
            ahead.skip(k - ahead.pos)
            if ahead.at >= end:
                return
            try:
                found = member(ahead)
            except BrokenRecord:
                if broken != "skip":
                    raise
                found = None
            if found is None:
                ahead.skip(1)
                continue
            yield ahead.at, found[0]
            ahead.skip(found[1])


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields, in lower case, and its block."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    length = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else len(rest)
    return fields, rest[:length]


READ = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])


def read_archives(spark: SparkSession, paths: list[str], *, split_bytes: int = SPLIT_BYTES, broken: str = "raise") -> DataFrame:
    """All records of the archives: record_id, record_type, url, refers_to, payload, path, offset.

    A record that is damaged or cut off fails the read; ``broken`` "skip" goes on behind it."""

    def sizes(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([file_system(n)[0].get_file_info(file_system(n)[1]).size for n in names], pa.int64())], names=["path", "size"])

    def scan(batches):
        rows, held = [], 0
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                for offset, content in records_of(path, start, start + split_bytes, broken):
                    fields, block = parsed(content)
                    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                    rows.append((fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), payload, path, offset))
                    held += len(payload)
                    if held > 4 << 20 or len(rows) >= 2048:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), READ.types)], schema=READ)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), READ.types)], schema=READ)

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    splits = files.mapInArrow(sizes, "path string, size long").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(split_bytes).cast("long"))).alias("start"))
    n = max(1, min(len(paths) * 4, 4 * spark.sparkContext.defaultParallelism))
    return splits.repartition(n).mapInArrow(scan, "record_id string, record_type string, url string, refers_to string, payload binary, path string, offset long")


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes the pages as archives, reads those back, and gives what the archives hold:
    page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload is that of the response that it refers to, found by a join.
    """
    spark = pages.sparkSession
    work = Work(spark, "warc")
    folder = qualified(spark, work.path("archives"))
    archives = written_archives(pages, folder, id_col=id_col, url_col=url_col, payload_col=payload_col, least_bytes=least_bytes)
    number = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit("^<urn:x-page:(-?[0-9]+)>$")), F.lit(1)).cast("long")
    read = read_archives(spark, [path for path, _ in archives], split_bytes=split_bytes)
    facts = read.select(number(F.col("record_id")).alias("page_id"), "url", "record_type", number(F.col("refers_to")).alias("refers_to"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    facts = work.keep(facts, "facts")
    if (found := facts.count()) != (wrote := sum(n for _, n in archives)):
        raise BrokenRecord(f"{found} records read of {wrote} written")
    # Only responses large enough to be revisited can be meant; one for each id.
    revisited = facts.where("refers_to is not null").select(F.col("refers_to").alias("page_id")).distinct()
    owners = facts.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes)).join(revisited, "page_id", "left_semi")
    # A payload that a third of all pages repeat is one key: its revisits are dealt to LOTS copies of it.
    owners = owners.groupBy(F.col("page_id").alias("owner")).agg(F.max("payload_bytes").alias("own_bytes"), F.max("payload_digest").alias("own_digest")).withColumn("own_lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))))
    lots = facts.withColumn("lot", F.pmod(F.xxhash64("page_id", "url"), F.lit(LOTS)).cast("int"))
    out = lots.join(owners, (F.col("refers_to") == F.col("owner")) & (F.col("lot") == F.col("own_lot")), "left")
    revisit = F.col("record_type") == "revisit"
    return out.select("page_id", "url", F.when(revisit, F.col("own_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(revisit, F.col("own_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
