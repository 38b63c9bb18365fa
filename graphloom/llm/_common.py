"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own; a cluster has no folder to guess, so that is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"/tmp/checkpoints/graphloom-{sc.applicationId}"
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/graphloom-{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that each application has written and not deleted.
_written: dict[str, set[str]] = {}


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, so a lost executor costs a reread.

    Its shuffle files go with the end of the write, as nothing reads them any more.
    """
    path, conf = shared_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*stored: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that no later plan reads."""
    for df in stored:
        path = getattr(df, "stored_at", None)
        if path is not None:
            delete_path(df.sparkSession, path)
            _written[df.sparkSession.sparkContext.applicationId].discard(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Deletes at its end the tables that were written inside it, but for those that it was told to keep."""
    written = _written.setdefault(spark.sparkContext.applicationId, set())
    before, kept = set(written), set()
    yield lambda df: kept.add(df.stored_at)
    for path in written - before - kept:
        delete_path(spark, path)
        written.discard(path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application's operators have written: once their results are stored elsewhere."""
    for path in _written.pop(spark.sparkContext.applicationId, set()):
        delete_path(spark, path)


def join_by_share(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join with ``right``, one row per key with the number ``rows`` of rows that ``left`` has of it, ``total`` in all.

    Keys with more than 1 / ``share`` of all rows would each fall to one task. There are fewer than ``share`` of
    them, so their side is broadcast; the rows of all other keys are shuffled. ``right`` stands in the plan twice:
    an aggregate shares its exchange.
    """
    heavy, light = right.filter(F.col(rows) * share > total), right.filter(F.col(rows) * share <= total)
    common = left.join(F.broadcast(heavy), key)
    if getattr(right, "stored_at", None) and not light.head(1):
        return common  # nothing to shuffle, so no second look at the rows
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return common.unionByName(rest)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their workers can import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted((root / "graphloom").rglob("*.py")):
            archive.write(path, path.relative_to(root))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Bytes of text that a function gets at a time.
SLICE_BYTES = 4_000_000


def trim_memory() -> None:
    """Give freed memory back to the system: a worker waits for its next task with what it holds, beside the others'."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; nothing is lost
        pass


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= limit):
            size += sizes[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def doc_text(column: str) -> F.Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_results(
    df: DataFrame,
    text: str,
    fn: Callable[[list[str]], list[pa.Array]],
    fields: list[T.StructField],
    carry: list[str] | None = None,
    finish: Callable[[], None] | None = None,
) -> DataFrame:
    """Rows of ``df`` as struct ``row`` next to the result columns that ``fn`` makes of the texts of a batch.

    ``carry`` names the columns that ``row`` keeps, all by default; others don't travel back.

    ``finish`` runs at the end of a partition.

    Keeping the input in one struct means that its column names can clash with nothing.
    """
    ship(df.sparkSession)
    carry = df.columns if carry is None else carry
    row = F.struct(*[F.col(f"`{c}`") for c in carry])
    schema = T.StructType([T.StructField("row", df.select(row).schema[0].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                columns = fn(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["row", *(f.name for f in fields)])
        if finish is not None:
            finish()
        trim_memory()

    packed = df.select(row.alias("row"), doc_text(text).alias("text"))
    return packed.mapInArrow(run, schema)
