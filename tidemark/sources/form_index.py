"""A data source of quarterly filing indexes: spark.read.format("form_index").load(folder), or read_index.

A folder holds one text file a quarter, named <year>-QTR<n>.idx: a heading, a line of dashes, and lines of fixed width with
form, company, cik, day and path. A file is a partition. The options first_year and last_year drop files before they are
opened, `forms` drops lines as they are read. Lines that don't parse aren't lost: the option errors=true gives them instead,
as (file, line, text), from the same files.

These are options, not filters that Spark pushes: in Spark 4.1 a Python source keeps the filters pushed by one query for the
next query of the same frame, which then lacks rows. Other filters are Spark's, on the rows that come out.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "form string, company string, cik long, filed date, path string, year int, quarter int"
ERRORS = "file string, line int, text string"
NAME = re.compile(r"(\d{4})-QTR([1-4])\.idx$")
#: Of the index files, fixed values: columns are parted by two blanks and more, the path has none.
LINE = re.compile(r"(\S+(?: \S+)*)\s{2,}(.+?)\s{2,}(\d+)\s+(\d{4}-\d{2}-\d{2}|\d{8})\s+(\S+)\s*")


class Quarter(InputPartition):
    def __init__(self, file: str, year: int, quarter: int) -> None:
        self.file, self.year, self.quarter = file, year, quarter


class IndexReader(DataSourceReader):
    def __init__(self, folder: str, errors: bool, forms: set[str] | None, years: tuple[int, int]) -> None:
        self.folder, self.errors, self.forms, self.years = folder, errors, forms, years

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.folder)
        found = [(f.path, m) for f in system.get_file_info(fs.FileSelector(top)) if (m := NAME.search(f.path))]
        quarters = [Quarter(path, int(m[1]), int(m[2])) for path, m in sorted(found, key=lambda x: x[0])]
        # Spark wants one partition at least; without a file it has no rows.
        return [q for q in quarters if self.years[0] <= q.year <= self.years[1]] or [Quarter("", 0, 0)]

    def read(self, partition: Quarter) -> Iterator[tuple]:
        if not partition.file:
            return
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder)
        begun = False
        with system.open_input_stream(partition.file) as raw:
            for number, line in enumerate(_lines(raw), 1):
                if not begun:
                    begun = line.startswith("-----")
                    continue
                if not line.strip():
                    continue
                if self.forms is not None and line.split("  ", 1)[0].strip() not in self.forms:
                    continue
                row = _parsed(line)
                if self.errors:
                    if row is None:
                        yield partition.file.rsplit("/", 1)[-1], number, line
                elif row is not None:
                    yield (*row, partition.year, partition.quarter)


def _lines(raw) -> Iterator[str]:  # noqa: ANN001
    """Lines of a stream by blocks of a megabyte; a file is never held whole."""
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        for x in whole:
            yield x.decode("latin-1").rstrip("\r")
    if rest:
        yield rest.decode("latin-1").rstrip("\r")


def _parsed(line: str) -> tuple | None:
    m = LINE.fullmatch(line)
    try:
        return (m[1], m[2], int(m[3]), dt.date.fromisoformat(m[4]), m[5]) if m else None
    except ValueError:
        return None


class FormIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "form_index"

    def schema(self) -> str:
        return ERRORS if self._errors() else SCHEMA

    def _errors(self) -> bool:
        return self.options.get("errors", "false").lower() == "true"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        o = self.options
        forms = {x.strip() for x in o["forms"].split(",")} if o.get("forms") else None
        return IndexReader(o["path"], self._errors(), forms, (int(o.get("first_year", 0)), int(o.get("last_year", 9999))))


def read_index(spark: SparkSession, folder: str, forms: tuple[str, ...] = (), first_year: int = 0, last_year: int = 9999, errors: bool = False) -> DataFrame:
    """The rows of the index files of a folder, or with errors the lines that don't parse; no forms are all forms."""
    spark.dataSource.register(FormIndex)
    return spark.read.format(FormIndex.name()).option("forms", ",".join(forms)).option("first_year", first_year).option("last_year", last_year).option("errors", str(errors).lower()).load(folder)
