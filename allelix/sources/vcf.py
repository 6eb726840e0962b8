"""Variant text files as a Spark data source, and records as text lines.

``spark.dataSource.register(VcfDataSource); spark.read.format("vcf").load(path)`` reads plain or
gzipped files, a partition for each file (or, uncompressed, for each ``split`` bytes), with one row
for each record. Lines are handed on as Arrow batches.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "samples"]
SCHEMA = "chrom string, pos int, id string, ref string, alt string, qual double, filter string, info string, format string, samples array<string>"
SPLIT_BYTES = 64 << 20


@dataclass
class Span(InputPartition):
    path: str
    start: int
    stop: int | None  # None: the whole of a compressed file

    def __init__(self, path: str, start: int, stop: int | None):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def parse_line(line: str) -> tuple | None:
    """The fields of a record, None for a header or blank line; a dot is a missing QUAL."""
    if not line or line[0] == "#":
        return None
    parts = line.split("\t")
    if len(parts) < 8:
        raise ValueError(f"a record has {len(parts)} fields: {line[:80]!r}")
    return parts[0], int(parts[1]), parts[2], parts[3], parts[4], None if parts[5] == "." else float(parts[5]), parts[6], parts[7], parts[8] if len(parts) > 8 else None, parts[9:]


class VcfReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Span]:
        store, base = _store(self.path)
        info = store.get_file_info(base)
        files = [info] if info.type == pyarrow.fs.FileType.File else [f for f in store.get_file_info(pyarrow.fs.FileSelector(base)) if f.type == pyarrow.fs.FileType.File and f.base_name.endswith((".vcf", ".vcf.gz"))]
        spans: list[Span] = []
        for f in files:
            with store.open_input_stream(f.path, compression=None) as stream:
                packed = stream.read(2) == b"\x1f\x8b"
            spans += [Span(f.path, 0, None)] if packed else [Span(f.path, a, min(a + self.split, f.size)) for a in range(0, max(1, f.size), self.split)]
        return spans

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        rows: list[tuple] = []
        for line in self._lines(store, span):
            if row := parse_line(line):
                rows.append(row)
            if len(rows) >= 10_000:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _lines(self, store, span: Span) -> Iterator[str]:
        if span.stop is None:
            with store.open_input_stream(span.path, compression=None) as raw, gzip.open(raw, "rt", encoding="utf-8") as text:
                yield from (x.rstrip("\r\n") for x in text)
            return
        with store.open_input_file(span.path) as raw:
            data = io.BufferedReader(raw, 1 << 20)
            # a line belongs to the span that holds its first byte
            data.seek(max(0, span.start - 1))
            if span.start:
                data.readline()
            while data.tell() < span.stop and (line := data.readline()):
                yield line.decode().rstrip("\r\n")

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=FIELDS)


class VcfDataSource(DataSource):
    """Options: path (file or folder), split (bytes of an uncompressed file in one partition)."""

    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VcfReader:
        return VcfReader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)))


def info_map(info: Column) -> Column:
    """``key=value`` pairs as a map; a flag has a null value, a dot is an empty map."""
    return F.when(info == ".", F.str_to_map(F.lit(""), F.lit(";"), F.lit("="))).otherwise(F.str_to_map(info, F.lit(";"), F.lit("=")))


def shown_number(x: Column) -> Column:
    """A number as a 32-bit float with six significant digits, without trailing zeros; a dot for none.

    From a million on, and below 0.0001, the form with an exponent of two digits or more is used. The value is
    rounded from its 17 digits, ties to an even sixth one, and the point is moved inside the digits.
    """
    value = x.cast("float").cast("double")
    half = 5 * 10**10

    def rounded(form: Column) -> Column:
        every = F.translate(F.substring_index(form, "e", 1), ".", "")
        head, rest = F.substr(every, F.lit(1), F.lit(6)).cast("long"), F.substr(every, F.lit(7)).cast("long")
        up = (rest > half) | ((rest == half) & (head % 2 == 1))
        return F.struct((head + F.when(up, 1).otherwise(0)).alias("head"), F.substring_index(form, "e", -1).cast("int").alias("exponent"))

    def carried(r: Column) -> Column:
        over = r["head"] == 10**6
        return F.struct(F.when(over, "1").otherwise(F.regexp_replace(r["head"].cast("string"), "0+$", "")).alias("digits"), (r["exponent"] + F.when(over, 1).otherwise(0)).alias("exponent"))

    def text(r: Column) -> Column:
        digits, exponent = r["digits"], r["exponent"]
        n, size = F.length(digits), F.abs(exponent).cast("string")
        whole = F.when(n > exponent + 1, F.concat(F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2))).otherwise(F.rpad(digits, exponent + 1, F.lit("0")))
        plain = F.when(exponent >= 0, whole).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-exponent - 1, F.lit(0))), digits))
        fraction = F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
        far = F.concat(F.substr(digits, F.lit(1), F.lit(1)), fraction, F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(size, F.greatest(F.length(size), F.lit(2)), F.lit("0")))
        return F.when((exponent < -4) | (exponent >= 6), far).otherwise(plain)

    # each step is worked out once: as the one element of an array
    shown = F.array(F.format_string("%.16e", F.abs(value)))
    for step in (rounded, carried, text):
        shown = F.transform(shown, step)
    finite = F.concat(F.when(value < 0, "-").otherwise(""), F.get(shown, F.lit(0)))
    return F.when(x.isNull() | F.isnan(value), ".").when(value == 0, "0").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).otherwise(finite)


def info_text(fields: dict[str, Column]) -> Column:
    """The INFO column: ``key=value`` of the fields that are not null, a flag's key where it is true, a dot for none."""
    shown = [F.when(c, F.lit(k)) if c_is_flag else F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, (c, c_is_flag) in {k: v if isinstance(v, tuple) else (v, False) for k, v in fields.items()}.items()]
    text = F.concat_ws(";", *shown)
    return F.when(text == "", ".").otherwise(text)


def lines(records: DataFrame, info: dict[str, Column] | None = None) -> Column:
    """Record lines; every column is there, a dot where it is null; samples follow if there is a column ``calls``."""
    dotted = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    info = {"DP": F.col("info_dp")} if info is None else info
    fixed = [F.col("chrom"), F.col("pos").cast("string"), *(dotted(F.col(c)) for c in ("id", "ref", "alt")), shown_number(F.col("qual")), dotted(F.col("filter")), info_text(info)]
    if "calls" in records.columns:
        shown = F.array_join(F.transform("calls", lambda c: F.concat_ws(":", dotted(c["gt"]), dotted(c["dp"]))), "\t")
        fixed += [F.lit("GT:DP"), shown]
    return F.concat_ws("\t", *fixed)


def write_vcf(records: DataFrame, path: str, contigs: list[str], samples: list[str]) -> None:
    """A folder of text parts, each a whole file with its own header, sorted by contig and position."""
    header = ["##fileformat=VCFv4.2", *(f"##contig=<ID={c}>" for c in contigs), '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">']
    header.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, contigs)), F.col("chrom")), F.lit(0))
    rows = records.withColumn("_rank", rank).repartitionByRange("_rank", "pos").sortWithinPartitions("_rank", "pos", F.upper("ref"), F.upper("alt"))

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(header, batch.schema.types[0])], schema=batch.schema)
                first = False
            yield batch

    rows.select(lines(rows).alias("value")).mapInArrow(with_header, "value string").write.text(path)
