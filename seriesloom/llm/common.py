"""Helpers of the operators: the shared folder, staged tables, word counts and Arrow plumbing.

Words are runs of ``[^\\x20\\x09-\\x0D]+`` throughout; ``bytes.split()`` cuts UTF-8 at the same places.
"""

from __future__ import annotations

import atexit
import ctypes
import threading
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACES = "\t\n\x0b\x0c\r"
_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_MADE: list[tuple[SparkSession, str]] = []
_OPEN = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is missing (one machine, tests) the application gets a folder below /tmp/checkpoints.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, f"file:///tmp/checkpoints/{uuid.uuid4().hex}")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A fresh folder below the shared one; it is removed when the driver's Python ends, or with the ``scratch`` around it
    (``outer``: with the one around that)."""
    if not _MADE:
        atexit.register(_remove_made)
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, folder))
    scopes = getattr(_OPEN, "scopes", [])
    if len(scopes) > outer:
        scopes[-1 - outer].append((spark, folder))
    return folder


@contextmanager
def scratch(keep: bool = False):
    """Folders made inside are removed at the end; with ``keep`` they are only listed, for ``remove`` to take later."""
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    made: list[tuple[SparkSession, str]] = []
    _OPEN.scopes.append(made)
    try:
        yield made
    finally:
        _OPEN.scopes.remove(made)
        if not keep:
            remove(made)


def remove(made: list[tuple[SparkSession, str]]) -> None:
    for spark, folder in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gone = {folder for _, folder in made}
    _MADE[:] = [x for x in _MADE if x[1] not in gone]
    made.clear()


def _remove_made() -> None:
    try:
        remove(list(_MADE))
    except Exception:  # the JVM has gone already; the cluster's own clean-up has to do it
        return


def staged(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: later uses neither repeat nor lose it."""
    folder = new_folder(df.sparkSession, name, outer)
    df.write.option("compression", "zstd").parquet(folder)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that have ended; else they stay until the driver's heap happens to fill."""
    for _ in range(2):  # what the first collection ends still holds some of them
        spark._jvm.System.gc()
        time.sleep(0.05)


def ship_code(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="code-")) / "seriesloom_modules.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted((root / "seriesloom").rglob("*.py")):
            out.write(file, str(file.relative_to(root)))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(application)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of a text, JVM-side; null counts 0."""
    flat = F.translate(F.coalesce(text, F.lit("")), _SPACES, " " * len(_SPACES))
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def tidy(run):
    """``run`` for mapInArrow, after which a worker hands memory it no longer uses back to the system.

    Workers wait for further tasks, of other stages too; what their allocators keep would count against the executor.
    """
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    return tidied


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch`` of up to ``most`` bytes of ``column``; a larger row comes alone."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def id_text(doc_id: Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
