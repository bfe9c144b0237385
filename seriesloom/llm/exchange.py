"""Corpus in chunks, and questions of chunks to the whole corpus.

``pack`` writes texts as chunks of up to CHUNK bytes to a table in the shared folder, bucketed by chunk, so that
joining something to the chunks never moves texts. A chunk asks about keys (64-bit hashes): it sends one compressed
entry list for each range of the key space, whatever the number of its documents that hold a key. ``answer`` brings the
lists of a range together and sends each chunk its answers. A key of a third of all rows hence costs one entry for
each chunk, and the ranges are even, as the keys are hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import new_folder, pieces, shuffle_partitions, text_bytes, tidy

CHUNK = 2 << 20


def pack(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """chunk, body (UTF-8 of its texts, joined), sizes (bytes of each text), rest (all other columns, as Arrow)."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, "text", chunk_bytes):
                texts = text_bytes(part.column(part.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([b"".join(texts)], type=pa.binary()), pa.array([list(map(len, texts))], type=pa.list_(pa.int64())),
                     pa.array([to_ipc(part.select(others))], type=pa.binary())], names=["chunk", "body", "sizes", "rest"])
                number += 1

    name = f"chunks_{uuid.uuid4().hex}"
    (docs.mapInArrow(tidy(run), "chunk long, body binary, sizes array<long>, rest binary").write.format("parquet")
     .option("compression", "zstd").option("path", new_folder(spark, "chunks"))
     .bucketBy(shuffle_partitions(spark), "chunk").saveAsTable(name))
    return spark.table(name)


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def pack_columns(*columns: tuple[np.ndarray, int]) -> bytes:
    """Arrays of equal length, each with the number of low bytes to keep, as compressed byte planes."""
    n = len(columns[0][0])
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].T).tobytes() for c, width in columns]
    return zstandard.compress(n.to_bytes(8, "little") + b"".join(planes), 1)


def unpack_columns(data: bytes, *widths: int) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for width in widths:
        cells = np.zeros((n, 8), dtype=np.uint8)
        cells[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T
        out.append(cells.reshape(-1).view("<u8"))
        at += n * width
    return out


def ranges(sorted_keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Range number, from, to, of sorted uint64 keys dealt to n even ranges of the key space; empty ranges left out."""
    number = ((sorted_keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, dtype=np.int64)
    return list(zip(number[starts].astype(int).tolist(), starts.tolist(), [*starts[1:].tolist(), len(number)]))


def n_ranges(df: DataFrame) -> int:
    return 4 * shuffle_partitions(df.sparkSession)


ENTRIES = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("entries", T.BinaryType())])


def entry_batch(chunk: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), type=pa.int64()), pa.array([b for b, _ in rows], type=pa.int32()),
                                       pa.array([e for _, e in rows], type=pa.binary())], names=["chunk", "bucket", "entries"])


def answer(entries: DataFrame, reduce: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """chunk, answers (bucket and answer of each of its lists, by bucket). ``reduce`` gets the lists of one range."""
    def run(table: pa.Table) -> pa.Table:
        got = reduce([x.as_py() for x in table.column("entries")])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "answer": pa.array(got, type=pa.binary())})

    replies = entries.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, answer binary")
    return replies.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


def joined_lists(lists: list[bytes], *widths: int) -> tuple[list[np.ndarray], list[int]]:
    """The columns of all lists, one after the other, and the length of each list."""
    opened = [unpack_columns(x, *widths) for x in lists]
    return [np.concatenate([o[k] for o in opened]) for k in range(len(widths))], [len(o[0]) for o in opened]


def per_list(values: np.ndarray, lengths: list[int], width: int = 1) -> list[bytes]:
    out, at = [], 0
    for n in lengths:
        out.append(pack_columns((values[at:at + n], width)))
        at += n
    return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
