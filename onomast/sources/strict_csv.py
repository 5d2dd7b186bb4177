"""A CSV file as text, row for row: nothing is inferred, dropped, padded with nulls or renamed.

Columns are named ``c0..cn`` inside Spark, so that repeated headers survive; the header is kept beside. ``__row`` is the place of a
row in the file. One file has one reader: a record can span lines, so a file isn't splittable; for large trusted input read Parquet.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import LongType, StringType, StructField, StructType

MAX_FIELD = 1 << 30


def writing_codec(encoding: str) -> str:
    """utf-8-sig adds a mark when it writes, which the input may not have had."""
    return "utf-8" if encoding.lower().replace("_", "-") == "utf-8-sig" else encoding


def line_ending(path: str | Path) -> str:
    with open(path, "rb") as f:
        return "\r\n" if f.readline().endswith(b"\r\n") else "\n"


def decode(path: str | Path, encoding: str) -> str:
    raw = Path(path).read_bytes()
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError as e:
        raise ValueError(f"{path} is not {encoding}: byte {e.object[e.start]:#04x} at offset {e.start}. Name its encoding; it is not guessed.") from e


def records(path: str | Path, encoding: str) -> Iterator[list[str]]:
    """The header, then every record padded to its width, read as it goes. A blank line is a row of empty values."""
    csv.field_size_limit(MAX_FIELD)
    header: list[str] | None = None
    with open(path, encoding=encoding, newline="") as f:
        reader = csv.reader(f, strict=True)
        try:
            for row in reader:
                if header is None:
                    if not row:
                        raise ValueError(f"{path} has no header")
                    header = row
                elif len(row) > len(header):
                    raise ValueError(f"{path}: the row at line {reader.line_num} has {len(row)} values, the header {len(header)}")
                if any("\0" in v for v in row):
                    raise ValueError(f"{path}: line {reader.line_num} holds a NUL character")
                yield row + [""] * (len(header) - len(row))
        except csv.Error as e:
            raise ValueError(f"{path} cannot be read as CSV near line {reader.line_num}: {e}") from e
        except UnicodeDecodeError:
            decode(path, encoding)  # says where in the file
            raise
    if header is None:
        raise ValueError(f"{path} is empty")


class _Reader(DataSourceReader):
    def __init__(self, path: str, encoding: str) -> None:
        self.path, self.encoding = path, encoding

    def read(self, partition) -> Iterator[tuple]:
        rows = records(self.path, self.encoding)
        next(rows)
        for i, row in enumerate(rows):
            yield (i, *row)


class StrictCsv(DataSource):
    """``spark.read.format("strict_csv").option("encoding", ...).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "strict_csv"

    def schema(self) -> StructType:
        header = next(records(self.options["path"], self.options.get("encoding", "utf-8-sig")))
        return StructType([StructField("__row", LongType(), False), *(StructField(f"c{i}", StringType(), False) for i in range(len(header)))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("encoding", "utf-8-sig"))


@dataclass
class Table:
    frame: DataFrame
    header: list[str]
    column: str
    path: Path
    encoding: str
    ending: str

    @property
    def internal(self) -> str:
        """Spark's name of the sample column."""
        return f"c{self.header.index(self.column)}"


def read_table(spark: SparkSession, path: str | Path, column: str, encoding: str = "utf-8-sig") -> Table:
    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(f"no file {path}")
    rows = records(path, encoding)
    header = next(rows)
    if header.count(column) > 1:
        raise ValueError(f"{path} has {header.count(column)} columns named {column!r}")
    if column not in header:
        if len(header) == 1 and "\t" in header[0]:
            raise ValueError(f"{path} seems to be separated by tabs; only commas are read")
        raise ValueError(f"{path} has no column {column!r}. Its columns: {', '.join(header)}")
    for _ in rows:  # refuse a row that can't be read before anything is done
        pass
    spark.dataSource.register(StrictCsv)
    frame = spark.read.format("strict_csv").option("encoding", encoding).load(str(path.resolve()))
    return Table(frame, header, column, path, encoding, line_ending(path))


def write_table(frame: DataFrame, header: list[str], columns: list[str], path: str | Path, encoding: str, ending: str) -> None:
    """One CSV file in row order, streamed to the driver a partition at a time."""
    with open(path, "w", encoding=writing_codec(encoding), newline="") as f:
        out = csv.writer(f, lineterminator=ending)
        out.writerow(header)
        for row in frame.orderBy("__row").select(*columns).toLocalIterator():
            if len(row) == 1 and row[0] == "":
                f.write('""' + ending)
            else:
                out.writerow(row)


def same_file(a: str | Path, b: str | Path) -> bool:
    try:
        return os.path.samefile(a, b)
    except OSError:
        return Path(a).resolve() == Path(b).resolve()


def read_names(arguments: list[str], path: str | None = None) -> list[str]:
    """Names given one by one and in a file, one a line; stripped, blanks dropped."""
    lines = decode(path, "utf-8-sig").splitlines() if path else []
    return [n.strip() for n in [*arguments, *lines] if n.strip()]
