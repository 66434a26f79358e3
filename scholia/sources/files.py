"""Data sources of Spark for article files and stored search responses, in batch and as streams.

    register(spark)
    spark.read.format("scholia_articles").load(folder).where("pmid = '7'")
    spark.readStream.format("scholia_articles").load(folder)

A file is a partition. Conditions on ids, dates and languages are taken by the
source, which passes over a record before the rest of it is read into fields; they
leave the plan's filters and are not evaluated again. A stream reads the files in the
order of their times and names, each once; its offset is the last one that was
read, so that a restarted stream goes on behind it. Files come into a folder whole
(by a rename), as with Spark's own file streams.

records.read_xml_records() splits large files between tasks; this source is for
folders of many files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)

from scholia.operators.articles import FIELDS, Record

#: Columns on which conditions are taken by the source.
TAKEN = frozenset(["pmid", "publication_date", "lang", "total"])
_RECORD = re.compile(r"<PubmedArticle\b.*?</PubmedArticle\s*>", re.S)


@dataclass
class File(InputPartition):
    path: str


def listed(path: str) -> list[tuple[int, str]]:
    """Time and path of the files below a folder, or of one file, in this order."""
    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = store.get_file_info(place)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(place, recursive=True))
    prefix = path[: path.index(place)] if "://" in path and place in path else ""
    return sorted((f.mtime_ns or 0, prefix + f.path) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def text_of(path: str) -> str:
    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_stream(place) as file:
        return file.read().decode("utf-8", "replace")


def condition_of(found: Filter) -> Callable[[str | int | None], bool] | None:
    """A condition on one column as a test of its value; None for those that the source does not take."""
    compared = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}
    if len(found.attribute) != 1 or found.attribute[0] not in TAKEN:
        return None
    if isinstance(found, In):
        values = set(found.value)
        return lambda x: x in values
    if isinstance(found, IsNotNull):
        return lambda x: x is not None
    test = compared.get(type(found))
    return None if test is None else lambda x, v=found.value: x is not None and test(x, v)


def articles_in(text: str, path: str, tests: dict[str, list]) -> Iterator[tuple]:
    """file, article_index and fields of the well-formed records of a file that pass; others keep their numbers."""
    for number, match in enumerate(_RECORD.finditer(text), 1):
        try:
            record = Record(match.group())
        except ElementTree.ParseError:
            continue
        early = {"pmid": record.pmid, "publication_date": record.date, "lang": record.language}
        if all(test(early[name]()) for name, own in tests.items() for test in own):
            yield (path, number, *record.fields())


def hits_in(text: str, path: str, tests: dict[str, list]) -> Iterator[tuple]:
    """file, total and id of every hit of a stored search response."""
    found = json.loads(text)["esearchresult"]
    total = int(found["count"])
    for pmid in found["idlist"]:
        if all(test({"total": total, "pmid": pmid}.get(name)) for name, own in tests.items() for test in own):
            yield (path, total, pmid)


class _Files(DataSourceReader):
    def __init__(self, path: str, rows: Callable):
        self.path, self.rows, self.tests = path, rows, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 (Spark's name)
        for found in filters:
            test = condition_of(found)
            if test is None:
                yield found
            else:
                self.tests.setdefault(found.attribute[0], []).append(found)

    def partitions(self) -> list[File]:
        return [File(path) for _, path in listed(self.path)] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        tests = {name: [condition_of(f) for f in own] for name, own in self.tests.items()}
        if partition.path:
            yield from self.rows(text_of(partition.path), partition.path, tests)


class _FileStream(DataSourceStreamReader):
    def __init__(self, path: str, rows: Callable):
        self.path, self.rows = path, rows

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = listed(self.path)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[File]:
        first, last = (start["time"], start["path"]), (end["time"], end["path"])
        return [File(path) for time, path in listed(self.path) if first < (time, path) <= last]

    def read(self, partition: File) -> Iterator[tuple]:
        yield from self.rows(text_of(partition.path), partition.path, {})


class _Source(DataSource):
    columns, rows = "", None

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options["path"], type(self).rows)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _FileStream(self.options["path"], type(self).rows)


class ArticleFiles(_Source):
    """Articles of XML files."""

    columns, rows = f"file string, article_index int, {FIELDS}", staticmethod(articles_in)

    @classmethod
    def name(cls) -> str:
        return "scholia_articles"


class SearchResponses(_Source):
    """Hits of stored search responses, a JSON object in each file."""

    columns, rows = "file string, total long, pmid string", staticmethod(hits_in)

    @classmethod
    def name(cls) -> str:
        return "scholia_hits"


def register(spark: SparkSession) -> None:
    """Make both sources known to a session, with conditions that they take."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ArticleFiles, SearchResponses):
        spark.dataSource.register(source)
