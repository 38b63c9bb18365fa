"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id and written by one task per range. The bounds of the ranges are
counted, not sampled: they depend on the ids alone. A task rolls to a new file once the compressed size
passes a limit. Headers and digests are made anew from the payload, with nothing that depends on time,
host or attempt, so the same rows and number of ranges give the same bytes. A file is written under a
temporary name and renamed when complete; the manifest, written last and committed by Spark's own
protocol, lists the files that count, with size and digest. Where a rename isn't atomic (object stores),
a file that is cut off is one that no manifest lists, or that differs from its size there.

Of records with equal payloads the one with the smallest page id is the response. Who revisits
whom is settled on (digest, page id) alone; the answers are sorted in among the pages as small
directive rows, so the pages themselves are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._common import join_by_share, shared_path, ship

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 16_000_000
#: Equal payloads under this size are stored again rather than revisited.
MIN_REVISIT_BYTES = 0
LEVEL = 4
#: Compressed bytes read at a time.
STEP = 16_384
#: Buckets of ids that are counted in one pass over them.
BUCKETS = 65_536
DATE = "2000-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

MANIFEST = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("n_records", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("sha1", T.StringType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_value(text: str) -> str:
    """One line of a header: line breaks and other controls would end it, so they are percent-coded.

    That can't be told from percent signs that were there before, so such a record has its URL in base 64 beside it.
    """
    return "".join(c if c == "%" or c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds no payload, but its full digest and length."""
    kind, digest, target = "revisit" if revisit else "response", base32_sha1(payload), header_value(url or "")
    plain = target == (url or "") == target.strip()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(NAMESPACE, f"{page_id}\n{url}\n{digest}\n{kind}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        *([] if plain else [f"X-Target-Base64: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}"]),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", *([f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else [])]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


class ShardWriter:
    """Writes the files of one range; each goes from a temporary name to its own when it is full."""

    def __init__(self, directory: str, part: int, attempt: str, roll_bytes: int):
        self.fs, self.path = fs.FileSystem.from_uri(directory)
        self.fs.create_dir(self.path)
        self.part, self.attempt, self.roll = part, attempt, roll_bytes
        self.number = 0
        self.out = None

    def add(self, member: bytes) -> dict | None:
        if self.out is None:
            self.name = f"shard-{self.part:06d}-{self.number:06d}.warc.gz"
            self.temporary = posixpath.join(self.path, f".{self.name}.{self.attempt}.tmp")
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha1()
        self.out.write(member)
        self.size += len(member)
        self.records += 1
        self.sha.update(member)
        return self.close() if self.size >= self.roll else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.temporary, posixpath.join(self.path, self.name))  # another attempt's file has the same bytes
        self.out = None
        self.number += 1
        return {"file": self.name, "n_records": self.records, "n_bytes": self.size, "sha1": self.sha.hexdigest()}


def uri(spark: SparkSession, path: str) -> str:
    """``path`` as a URI with a scheme."""
    if "://" in path:
        return path
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    text = system.makeQualified(hadoop).toUri().toString()
    return text.replace("file:/", "file:///", 1) if text.startswith("file:/") and not text.startswith("file://") else text


def below(bounds: list[int], value: F.Column) -> F.Column:
    """How many of the sorted ``bounds`` are not above ``value``, in steps that halve."""
    if not bounds:
        return F.lit(0)
    held = F.lit(bounds)
    steps = F.lit([1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(F.coalesce(F.try_element_at(held, n + k) <= value, F.lit(False)), n + k).otherwise(n))


def range_bounds(ids: DataFrame, ranges: int, buckets: int = BUCKETS) -> list[int]:
    """First id of each range but the first, for ranges of about equal numbers of the ids (column ``id``; nulls aside).

    Exact counts of equal-width buckets; a bucket with over an eighth of a range's rows is counted again in
    finer ones, down to one id. So the bounds don't depend on partitions, order or chance. The driver holds at
    most about ``buckets`` counts per pass, and some six passes see all ids of 64 bits.
    """
    wide = ids.filter("id is not null").select(F.col("id").cast("decimal(20,0)").alias("id"))
    low, high, total = wide.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if not total or ranges < 2:
        return []
    limit = max(1, total // (8 * ranges))
    open_, done = [(int(low), int(high))], []
    while open_:
        open_.sort()
        fan = max(16, buckets // len(open_))
        starts = [a for a, _ in open_]
        widths = [(b - a) // fan + 1 for a, b in open_]
        at = below(starts, F.col("id").cast("long"))
        pick = lambda values: F.element_at(F.lit(values).cast("array<decimal(20,0)>"), F.col("at"))
        inside = wide.withColumn("at", at).filter("at > 0").filter(F.col("id") <= pick([b for _, b in open_]))
        place = inside.select("at", "id", F.floor((F.col("id") - pick(starts)) / pick(widths)).alias("bucket"))
        counts = place.groupBy("at", "bucket").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        open_ = []
        for r in counts:
            if r["n"] > limit and r["a"] < r["b"]:
                open_.append((int(r["a"]), int(r["b"])))
            else:
                done.append((int(r["a"]), r["n"]))
    bounds, before, current = [], 0, 0
    for first, n in sorted(done):
        if (number := before * ranges // total) > current:
            bounds.append(first)
            current = number
        before += n
    return bounds


def prepared(pages: DataFrame, page_id: str, url: str, html: str, min_revisit_bytes: int) -> DataFrame:
    """Pages and directives in one frame: a directive (kind 0) says that its page revisits ``refers_to``."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    known = rows.filter(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "url", F.unhex(F.sha1("payload")).alias("digest"))
    # the response is the smallest (page id, url); of repeated rows of that page the writer takes one
    first = known.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = join_by_share(known, first, "digest", "n", rows.count()).filter(F.col("page_id").isNotNull() | F.col("first_id").isNotNull()).select("page_id", "digest", F.col("first_id").alias("refers_to")).distinct()
    blank = lambda kind, name: F.lit(None).cast(kind).alias(name)
    directives = again.select("page_id", blank("string", "url"), blank("binary", "payload"), F.lit(0).alias("kind"), "refers_to", "digest")
    return rows.select("page_id", "url", "payload", F.lit(1).alias("kind"), blank("long", "refers_to"), blank("binary", "digest")).unionAll(directives)


def write(
    pages: DataFrame,
    directory: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    ranges: int | None = None,
    roll_bytes: int = ROLL_BYTES,
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """Write ``pages`` as WARC files under ``directory``; returns the manifest (file, n_records, n_bytes, sha1).

    A null html is an empty payload; empty payloads are equal like others. Null page ids sort first,
    count as the largest for the choice of the response, and their records carry no id; a null url
    gives no target. Of repeated rows of one page with one payload, one is the response and the others
    revisit it. An empty table gives an empty manifest. Page ids must be whole numbers of 64 bits. Rows of one
    page id stay in one range. Memory per task: one page and one Arrow batch.
    """
    spark = pages.sparkSession
    ship(spark)
    target = uri(spark, directory)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(pages.select(F.col(f"`{page_id}`").cast("long").alias("id")), ranges)
    placed = prepared(pages, page_id, url, html, min_revisit_bytes).withColumn("part", F.coalesce(below(bounds, F.col("page_id")), F.lit(0)))
    ordered = placed.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "page_id", "kind", "digest", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer: ShardWriter | None = None
        done: list[dict | None] = []
        current: object = context  # no page id yet
        known: dict[bytes, int | None] = {}
        written: set[bytes] = set()
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None or row["part"] != writer.part:
                    done.append(writer and writer.close())
                    writer = ShardWriter(target, row["part"], f"{context.stageId()}-{context.taskAttemptId()}", roll_bytes)
                if row["page_id"] != current or current is context:
                    current, known, written = row["page_id"], {}, set()
                if row["kind"] == 0:
                    known[row["digest"]] = row["refers_to"]
                    continue
                payload = row["payload"]
                digest = hashlib.sha1(payload).digest()
                revisit = digest in known and (known[digest] != row["page_id"] or digest in written)
                written.add(digest)
                done.append(writer.add(record(row["page_id"], row["url"], payload, known.get(digest), revisit)))
        done.append(writer and writer.close())
        files = [d for d in done if d]
        if files:
            yield pa.RecordBatch.from_pylist(files, pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha1", pa.string())]))

    manifest = f"{target}/manifest"
    ordered.mapInArrow(run, MANIFEST).write.json(manifest)
    return spark.read.schema(MANIFEST).json(manifest)


def parse(archive: bytes) -> Iterator[dict]:
    """Records of a file of gzip members, digests checked."""
    at, view = 0, memoryview(archive)
    while at < len(view):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:  # in steps, since what is left over is copied
            step = view[at : at + STEP]
            if not step:
                raise ValueError("the last record is cut off")
            parts.append(unpacker.decompress(step))
            at += len(step)
        at -= len(unpacker.unused_data)
        whole = b"".join(parts)
        head, _, rest = whole.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        block = rest[: int(fields["Content-Length"])]
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        payload = block.partition(b"\r\n\r\n")[2]
        if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or fields["WARC-Type"] == "response" and base32_sha1(payload) != digest:
            raise ValueError(f"wrong digest in {fields['WARC-Record-ID']}")
        number = lambda key: int(fields[key]) if key in fields else None
        yield {
            "page_id": number("X-Page-ID"),
            "url": base64.b64decode(fields["X-Target-Base64"]).decode("utf-8", "surrogatepass") if "X-Target-Base64" in fields else fields.get("WARC-Target-URI"),
            "payload_bytes": number("X-Payload-Length"),
            "payload_digest": digest,
            "record_type": fields["WARC-Type"],
            "refers_to": number("X-Refers-To-Page-ID"),
            "payload": payload if fields["WARC-Type"] == "response" else None,
        }


def read(spark: SparkSession, directory: str, payloads: bool = True) -> DataFrame:
    """Records of the files that the manifest under ``directory`` lists; a file whose size differs from it is an error.

    Each file is one row of at most about the roll size plus one record.
    """
    ship(spark)
    manifest = spark.read.schema(MANIFEST).json(f"{uri(spark, directory)}/manifest")
    listed = manifest.select(F.col("file").alias("listed"), F.col("n_bytes"))
    found = spark.read.format("binaryFile").load(f"{uri(spark, directory)}/shard-*.warc.gz")
    files = found.join(listed, F.element_at(F.split("path", "/"), -1) == F.col("listed")).select("n_bytes", "content")
    fields = [f for f in RECORD if payloads or f.name != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                archive = content.as_py()
                if len(archive) != size:
                    raise ValueError(f"{len(archive)} bytes where the manifest has {size}")
                rows, held = [], 0
                for row in parse(archive):
                    if not payloads:
                        del row["payload"]
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if held > 8_000_000 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(f.name, types.get(f.name, pa.string())) for f in fields])
    return files.mapInArrow(run, T.StructType(fields))


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    directory = shared_path(spark, "warc")
    if not write(pages, directory).head(1):
        return spark.createDataFrame([], T.StructType([f for f in RECORD if f.name not in ("payload", "url")]))
    return read(spark, directory, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
