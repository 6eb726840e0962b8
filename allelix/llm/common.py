"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Characters of text handled together by the Python operators; one longer text is a chunk of its own.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with about ``limit`` characters of text; null texts become empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pa.compute.utf8_length(column).fill_null(0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start), column.slice(start, i - start).fill_null("").to_pylist()
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start), column.slice(start).fill_null("").to_pylist()


class BoundedCache(dict):
    """A dict of about ``limit`` keys; results never depend on its content.

    When it is full, only the keys that the current work needs are kept.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def missing(self, wanted: set) -> list:
        """The wanted keys that are not held, after making room for them."""
        new = [k for k in wanted if k not in self]
        if len(self) + len(new) > self.limit:
            kept = {k: self[k] for k in wanted if k in self}
            self.clear()
            self.update(kept)
        return new
