"""Documents packed into blocks: one row holds as many whole texts as a task takes at once.

A block is cut from a task's own rows, without a shuffle, and written to the
shared folder, so its number and its rows are the same whenever it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusionlens.llm import chunks
from fusionlens.llm.sizing import staged

BLOCK_BYTES = 4 << 20   # of text; a longer text is a block of its own


def blocked(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """``block`` and ``data``, the block's rows (``doc_id``, ``text``, and ``row`` if ``carry``) as an Arrow stream."""
    source = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
                         *([F.struct(*[docs[c].alias(c) for c in carry]).alias("row")] if carry else []))
    most = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(
                    compression=pa.Codec("zstd", compression_level=3))) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"])

        for batch in batches:
            for part in chunks.slices(batch, "text"):
                held.append(part)
                size += chunks.text_bytes(part.column(1))[1][-1]
                if size >= most:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    return staged(source.mapInArrow(run, "block long, data binary"), "blocks")


def rows_of(data: bytes) -> pa.RecordBatch:
    """A block's rows, in the order they were packed in."""
    with pa.ipc.open_stream(data) as stream:
        table = stream.read_all().combine_chunks()
    return table.to_batches()[0]


def each(function, fields: str, table: DataFrame) -> DataFrame:
    """``function(block, rows)``, a table of ``fields``, for every block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from function(batch.column(0)[i].as_py(), rows_of(batch.column(1)[i].as_py())).to_batches()

    return table.select("block", "data").mapInArrow(run, fields)


def packed(*arrays: np.ndarray) -> list[bytes]:
    """Arrays as compressed bytes."""
    raw, codec = [np.ascontiguousarray(a).tobytes() for a in arrays], pa.Codec("zstd", compression_level=3)
    return [codec.compress(r, asbytes=True) + len(r).to_bytes(8, "little") for r in raw]


def unpacked(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[-8:], "little")
    return np.frombuffer(pa.decompress(data[:-8], decompressed_size=size, codec="zstd", asbytes=True), kind)
