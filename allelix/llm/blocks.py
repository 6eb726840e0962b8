"""Blocks of documents that are read several times, and exchanges between blocks and shards.

A block is a bounded number of whole rows in compressed Arrow form, one row of a table in the shared
folder. In an exchange every block sends each shard at most one message, in which a key occurs once
however often the block holds it, and every shard answers each message: hot keys are combined before
the shuffle and no group grows with the number of rows that share a key.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from allelix.session import shared_dir, ship_package

BLOCK_BYTES = 6 << 20

Message = tuple[int, bytes]


def release() -> None:
    """Gives freed memory back to the machine, which long-lived workers would hold on to."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def packed_rows(batches: list[pa.RecordBatch]) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for b in batches:
            writer.write_batch(b)
    return out.getvalue().to_pybytes()


def rows_of(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def as_blocks(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, pack: Callable[[list[pa.RecordBatch]], bytes] = packed_rows) -> DataFrame:
    """A stored table (block, n_bytes, payload) of all rows of ``docs``; a longer text is a block of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([pack(held)], pa.binary())], names=["block", "n_bytes", "payload"])

        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text)).fill_null("")).to_pylist()
            start = 0
            for i, n in enumerate(lengths):
                if size and size + n > block_bytes:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield block()
                    held, size, start = [], 0, i
                size += n
            if start < len(lengths):
                held.append(batch.slice(start))
        if held:
            yield block()

    ship_package(docs.sparkSession)
    path = f"{shared_dir(docs.sparkSession)}/blocks-{uuid.uuid4().hex}"
    schema = "block long, n_bytes long, payload binary"
    docs.mapInArrow(run, schema).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shard_count(blocks: DataFrame, bytes_each: int) -> int:
    """So many shards that each stands for about ``bytes_each`` of text."""
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_each))


_MESSAGES = "shard long, block long, kind int, message binary"
_NAMES = ["shard", "block", "kind", "message"]


def messages(rows: Iterable[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Messages as Arrow batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > 8 << 20:
            yield _message_batch(held)
            held, size = [], 0
    if held:
        yield _message_batch(held)


def _message_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def send(blocks: DataFrame, make: Callable[..., Iterable[tuple[int, int, bytes]]], unpack: Callable = rows_of) -> DataFrame:
    """``make(block, rows)`` gives (shard, kind, message) of each block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0), batch.column(1), strict=True):
                block = block.as_py()
                yield from messages((shard, block, kind, m) for shard, kind, m in make(block, unpack(payload.as_buffer())))
                release()

    return blocks.select("block", "payload").mapInArrow(run, _MESSAGES)


def answer(sent: DataFrame, make: Callable[[int, int, list[bytes]], list[bytes]]) -> DataFrame:
    """``make(kind, shard, messages)`` gives the answers of a shard to the messages of a kind, in order."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        release()
        answers = pa.array(make(group["kind"][0].as_py(), group["shard"][0].as_py(), group["message"].to_pylist()), pa.binary())
        release()
        return pa.table({"shard": group["shard"], "block": group["block"], "kind": group["kind"], "message": answers})

    return sent.groupBy("kind", "shard").applyInArrow(run, _MESSAGES)


def receive(blocks: DataFrame, answers: DataFrame, make: Callable[..., Iterable[pa.Table]], schema: str | StructType, unpack: Callable = rows_of) -> DataFrame:
    """``make(block, rows, {(kind, shard): answer})`` gives result tables of each block."""
    names = [f.name for f in schema] if isinstance(schema, StructType) else None

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        got = {(k, s): m for k, s, m in zip(right["kind"].to_pylist(), right["shard"].to_pylist(), right["message"].to_pylist(), strict=True)}
        out = list(make(left["block"][0].as_py(), unpack(left["payload"][0].as_buffer()), got))
        del got
        release()
        return pa.concat_tables(out) if not names else pa.concat_tables(t.rename_columns(names) for t in out)

    left = blocks.select("block", "payload").groupBy("block")
    return left.cogroup(answers.groupBy("block")).applyInArrow(run, schema)
