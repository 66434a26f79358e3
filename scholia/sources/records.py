"""Reading and writing: article XML, chunk stores, article tables, web pages, folders."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.session import stored

RECORD = "PubmedArticle"
CHUNK_SCHEMA = (
    "content STRING, metadata STRUCT<topic_id: STRING, pubmed_id: STRING, title: STRING, authors: STRING, journal: STRING, publication_date: STRING,"
    " doi: STRING, mesh_terms: ARRAY<STRING>, keywords: ARRAY<STRING>, publication_types: ARRAY<STRING>, url: STRING, chunk_type: STRING,"
    " chunk_index: BIGINT, chunk_id: STRING>"
)


class NotFound(LookupError):
    """A topic's store that is not there."""


#: Most file blocks whose offsets are sent to every task; beyond it, a shuffle join.
BROADCAST_BLOCKS = 1_000_000


def read_xml_records(spark: SparkSession, path: str, tag: str = RECORD) -> DataFrame:
    """xml and article_index (from 1, by file) of every record; large files are split between tasks.

    The closing tag is the record separator of Spark's text reader. Numbers come
    from the records' places within a block of a file and the counts of the
    blocks before it, so that no record leaves the task that reads it.
    """
    text = spark.read.option("lineSep", f"</{tag}>").text(path)
    cut = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.regexp_extract("value", rf"(?s)<{tag}\b.*", 0).alias("open"),
    ).where("open <> ''")
    counts = stored(cut.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("low")))
    # A file's blocks, a row for each 128 MB or so.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    small = counts.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    placed = cut.join(F.broadcast(offsets) if small else offsets, ["file", "block"])
    return placed.select("file", F.concat("open", F.lit(f"</{tag}>")).alias("xml"), (F.col("offset") + F.col("at") - F.col("low") + 1).alias("article_index"))


def read_search_response(spark: SparkSession, path: str) -> DataFrame:
    """total (of all hits) and id of every hit of stored search responses."""
    read = spark.read.schema("esearchresult STRUCT<count: STRING, idlist: ARRAY<STRING>>").option("multiLine", True).json(path)
    return read.select(F.col("esearchresult.count").cast("long").alias("total"), F.explode("esearchresult.idlist").alias("pmid"))


def fetch_by_ids(articles: DataFrame, ids: DataFrame, key: str = "pmid") -> DataFrame:
    """The articles of a list of ids; Spark picks the join by the list's size."""
    return articles.join(ids.select(key).distinct(), key, "left_semi")


def write_articles(articles: DataFrame, path: str) -> None:
    """Append to the article table, a folder for each topic."""
    articles.write.mode("append").partitionBy("topic_id").parquet(path)


def write_chunk_store(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, a folder for each topic."""
    chunks.withColumn("topic", F.col("metadata.topic_id")).write.mode("append").partitionBy("topic").json(path)


def topic_folder(spark: SparkSession, base: str, column: str, topic_id: str) -> str:
    """The folder below base that Spark's writers give a topic; an id can name no other place, whatever is in it."""
    if not topic_id or not topic_id.strip():
        raise ValueError("a topic has an id")
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(topic_id)
    return f"{base}/{column}={escaped}"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of all topics and generations, with both."""
    return spark.read.schema(f"{CHUNK_SCHEMA}, topic STRING, generation STRING").json(path)


def read_chunk_store(spark: SparkSession, path: str, topic_id: str | None = None, multiline: bool = False) -> DataFrame:
    """Chunks of a store, of one topic from its folder alone; multiline reads files that are one JSON array each, without folders."""
    read = spark.read.schema(CHUNK_SCHEMA if multiline else f"{CHUNK_SCHEMA}, topic STRING").option("multiLine", multiline).json(path)
    if topic_id is not None:
        read = read.where((F.col("metadata.topic_id") if multiline else F.col("topic")) == topic_id)
        if read.isEmpty():
            raise NotFound(topic_id)
    return read.drop("topic")


def write_index(vectors: DataFrame, path: str) -> None:
    """Append vectors to the index, a folder for each topic, so that a search reads its topic alone."""
    vectors.write.mode("append").partitionBy("topic_id").parquet(path)


def read_index(spark: SparkSession, path: str, topic_id: str, generation: str | None = None) -> DataFrame:
    """The vectors of a topic, of one generation where the index has them; NotFound if it has none."""
    try:
        found = spark.read.parquet(path).where(F.col("topic_id") == topic_id)
    except AnalysisException as error:
        raise NotFound(topic_id) from error
    if generation is not None:
        found = found.where(F.col("generation") == generation).drop("generation")
    if found.isEmpty():
        raise NotFound(topic_id)
    return found


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """topics (first folders below path) and bytes below it, from file listings alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    # The first of a file's partition folders, or the folder it is in.
    below = F.regexp_extract("path", r"/([^/=]+=[^/]+)(?:/[^/=]+=[^/]+)*/[^/]+$|/([^/]+)/[^/]+$", 0)
    below = F.coalesce(F.nullif(F.regexp_extract(below, r"^/([^/=]+=[^/]+)/", 1), F.lit("")), F.regexp_extract(below, r"/([^/]+)/[^/]+$", 1))
    return files.agg(F.count_distinct(below).alias("topics"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


# Elements whose end, or start, ends an open paragraph, and elements without an end.
_CLOSING = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li td".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Items(HTMLParser):
    """First title, paragraphs' own texts and first link of every item element of a page."""

    def __init__(self, item: tuple[str, str | None], title: str, paragraph: str):
        super().__init__(convert_charrefs=True)
        self.item, self.title, self.paragraph = item, title, paragraph
        self.items: list[dict] = []
        # How deep in an item, in which text element, and how deep in that.
        self.depth, self.inside, self.nested = 0, None, 0

    def handle_starttag(self, tag, attributes):
        attributes = dict(attributes)
        name, wanted = self.item
        if self.depth and tag == name:
            self.depth += 1
        if not self.depth and tag == name and (wanted is None or wanted in (attributes.get("class") or "").split()):
            self.depth = 1
            self.items.append({"title": None, "content": [], "href": None})
        if not self.depth:
            return
        if tag == "a" and self.items[-1]["href"] is None:
            self.items[-1]["href"] = attributes.get("href")
        if tag in _CLOSING:
            self.inside = None
        if tag in (self.title, self.paragraph):
            self.inside, self.nested = tag, 0
        elif self.inside and tag not in _VOID:
            self.nested += 1

    def handle_endtag(self, tag):
        if self.depth and tag == self.item[0]:
            self.depth -= 1
        if tag == self.inside or tag in _CLOSING:
            self.inside = None
        elif self.inside:
            self.nested = max(0, self.nested - 1)

    def handle_data(self, data):
        if not self.depth or self.inside is None or self.nested:
            return
        now = self.items[-1]
        if self.inside == self.paragraph:
            now["content"].append(data)
        elif now["title"] is None:
            now["title"] = data


def crawl_items(pages: DataFrame, id_col: str = "page_id", item: tuple[str, str | None] = ("div", "article"), title: str = "h2", paragraph: str = "p") -> DataFrame:
    """id, title, content, url of the items of pages; items without a title or content go."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parser = _Items(item, title, paragraph)
                parser.feed(html or "")
                parser.close()
                rows += [(page, x["title"], x["content"], urljoin(url or "", x["href"]) if x["href"] else None) for x in parser.items if x["title"] and x["content"]]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = [batch.schema.field(0).type, pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [id_col, "title", "content", "url"])

    return pages.select(id_col, "url", "html").mapInArrow(run, f"{id_col} {kind}, title string, content array<string>, url string")
