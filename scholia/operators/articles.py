"""Articles from XML records, their quality filter, and their chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scholia.functions.batches import parts

# What stands in an article for a missing field.
UNKNOWN_ID, NO_TITLE, NO_ABSTRACT = "unknown", "No Title", "No Abstract"
UNKNOWN_AUTHORS, UNKNOWN_JOURNAL, UNKNOWN_DATE = "Unknown Authors", "Unknown Journal", "Unknown Date"
ARTICLE_URL = "https://pubmed.ncbi.nlm.nih.gov/"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Languages and record states of the XML with the names that searches use.
LANGUAGE_CODES = {
    "eng": "en", "spa": "es", "fre": "fr", "ger": "de", "ita": "it", "jpn": "ja", "por": "pt", "rus": "ru", "chi": "zh", "dut": "nl", "pol": "pl",
    "swe": "sv", "dan": "da", "nor": "no", "fin": "fi", "cze": "cs", "hun": "hu", "kor": "ko", "tur": "tr", "ara": "ar", "heb": "he",
}
RECORD_STATES = {"MEDLINE": "medline", "PubMed-not-MEDLINE": "pubmed not medline", "In-Process": "in process", "In-Data-Review": "in process", "Publisher": "publisher"}
#: Size and overlap of chunks in characters, separators in order, and the length from which an abstract is split.
CHUNK_SIZE, CHUNK_OVERLAP, SEPARATORS, SPLIT_FROM = 400, 50, ("\n\n", "\n", ".", " "), 800


#: What is read of a record, in this order.
FIELDS = (
    "pmid string, title string, abstract string, authors string, journal string, publication_date string, doi string,"
    " mesh_terms array<string>, keywords array<string>, publication_types array<string>, lang string, subsets array<string>"
)


def _text(element: ElementTree.Element, name: str) -> str:
    """What stands before any child in the first element of that name; empty without one."""
    found = next(element.iter(name), None)
    return "" if found is None else found.text or ""


class Record:
    """The fields of one XML record, as an XML parser reads it: entities, CDATA sections, comments and attributes included.

    The text of an element is what stands before its first child; the first
    element of a name counts, and an empty one is as good as none.
    """

    def __init__(self, xml: str):
        self.root = ElementTree.fromstring(xml)

    def pmid(self) -> str:
        return _text(self.root, "PMID") or UNKNOWN_ID

    def all(self, name: str) -> list[str]:
        return [e.text for e in self.root.iter(name) if e.text]

    def abstract(self) -> str:
        parts = [(e.get("Label"), e.text) for e in self.root.iter("AbstractText") if e.text and e.text.strip()]
        return " ".join(f"{label}: {text}" if label else text for label, text in parts).strip() or NO_ABSTRACT

    def authors(self) -> str:
        return "; ".join(filter(None, map(self._author, self.root.iter("Author")))) or UNKNOWN_AUTHORS

    @staticmethod
    def _author(element: ElementTree.Element) -> str:
        """A group's name; else last and given name or initials; empty without a last name."""
        if next(element.iter("CollectiveName"), None) is not None:
            return _text(element, "CollectiveName").strip()
        last, *given = (_text(element, name).strip() for name in ("LastName", "ForeName", "Initials"))
        given = next(filter(None, given), "")
        return f"{last}, {given}" if last and given else last

    def journal(self) -> str:
        named = next(self.root.iter("Journal"), None)
        return (named is not None and _text(named, "Title")) or _text(self.root, "MedlineTA") or UNKNOWN_JOURNAL

    def date(self) -> str:
        """year, year-month or year-month-day of the first of three dates that has parts."""
        dates = (next(self.root.iter(kind), None) for kind in ("PubDate", "ArticleDate", "DateCompleted"))
        found = next((d for d in dates if d is not None and len(d)), None)
        year, month, day = ("" if found is None else _text(found, part) for part in ("Year", "Month", "Day"))
        if not re.fullmatch("[0-9]+", month) and month[:3] in MONTHS:
            month = str(MONTHS.index(month[:3]) + 1)
        if not year:
            return UNKNOWN_DATE
        known = [year, *([month.zfill(2), *([day.zfill(2)] if day else [])] if month else [])]
        return "-".join(known)

    def doi(self) -> str | None:
        return next((e.text for e in self.root.iter("ArticleId") if e.get("IdType") == "doi"), None) or None

    def language(self) -> str | None:
        """The search's code of the first language, its own code where there is none; null without one."""
        code = _text(self.root, "Language").lower()
        return LANGUAGE_CODES.get(code, code) or None

    def subsets(self) -> list[str]:
        """Which subsets of the catalogue a record is in: its state, and full texts that its identifiers speak of."""
        citation = next(self.root.iter("MedlineCitation"), None)
        ids = {e.get("IdType") for e in self.root.iter("ArticleId")}
        found = [RECORD_STATES.get(citation.get("Status")) if citation is not None else None]
        found += ["pmc", "full text", "free full text"] if "pmc" in ids else []
        found += (["full text"] if "doi" in ids else []) + (["nihms"] if "mid" in ids else [])
        return list(dict.fromkeys(filter(None, found)))

    def fields(self) -> tuple:
        one = lambda name: _text(self.root, name)
        return (
            self.pmid(), one("ArticleTitle") or NO_TITLE, self.abstract(), self.authors(), self.journal(), self.date(), self.doi(),
            self.all("DescriptorName"), self.all("Keyword"), self.all("PublicationType"), self.language(), self.subsets(),
        )


def extract_articles(records: DataFrame, xml_col: str = "xml", index_col: str = "article_index") -> DataFrame:
    """The eleven fields of every well-formed record, its language and subsets; others go, and keep their number.

    A record is parsed once, in the task that reads it.
    """
    schema = T.StructType.fromDDL(f"article_index int, {FIELDS}")
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, xml in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows.append((number, *Record(xml.as_py()).fields()))
                except ElementTree.ParseError:
                    continue
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema.fieldNames())

    return records.where(F.col(xml_col).isNotNull()).select(F.col(index_col).cast("int"), F.col(xml_col).cast("string")).mapInArrow(run, schema)


def with_date_bounds(articles: DataFrame) -> DataFrame:
    """date_from and date_to: the days that a full or partial publication date may mean."""
    text = F.col("publication_date")
    full, month, year = F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyy-MM"), F.try_to_date(text, "yyyy")
    return articles.withColumn("date_from", F.coalesce(full, month, year)).withColumn("date_to", F.coalesce(full, F.last_day(month), F.date_sub(F.add_months(year, 12), 1)))


def is_valid(pmid: Column, title: Column, abstract: Column) -> Column:
    """Quality: an id, a title of ten characters, and an abstract of fifty or a title of fifty."""

    def long(text: Column, n: int) -> Column:
        # Of n characters or more without the white space at its ends; stripping a whole text costs more than reading it.
        return text.rlike(rf"(?Us)\S.{{{n - 2},}}\S")

    thin = abstract.isNull() | (abstract == NO_ABSTRACT) | ~long(abstract, 50)
    named = pmid.isNotNull() & ~pmid.isin("", UNKNOWN_ID)
    titled = title.isNotNull() & (title != NO_TITLE) & long(title, 10)
    return F.coalesce(named & titled & ~(thin & (F.length(title) < 50)), F.lit(False))


def article_url(pmid: Column) -> Column:
    return F.concat(F.lit(ARTICLE_URL), pmid, F.lit("/"))


def stored_articles(articles: DataFrame) -> DataFrame:
    """The six columns that are kept of an article."""
    return articles.select("topic_id", F.col("pmid").alias("pubmed_id"), "title", "abstract", "authors", article_url(F.col("pmid")).alias("url"))


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """A text in pieces of at most `size` characters, cut at the first separator that it has.

    A separator stays in front of what follows it; longer pieces are cut at the
    next separators; a piece begins with up to `overlap` characters of the one before.
    """
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    head, *tail = text.split(mark)
    out: list[str] = []
    short: list[str] = []
    for piece in [p for p in (head, *(mark + t for t in tail)) if p]:
        if len(piece) < size:
            short.append(piece)
            continue
        out += _merged(short, size, overlap)
        short = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return out + _merged(short, size, overlap)


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces put together up to `size`, with the overlap carried on."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            if text := "".join(held).strip():
                out.append(text)
            while total > overlap or (total and total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if text := "".join(held).strip():
        out.append(text)
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def split_column(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.string())
    made = [pa.array([split_text(t) if t else [] for t in few.to_pylist()], kind) for few in parts(texts)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def chunks(articles: DataFrame) -> DataFrame:
    """content and metadata of every chunk: the article itself, then pieces of a long abstract.

    articles has topic_id and the eleven fields.
    """
    pieces = F.when(F.length("abstract") > SPLIT_FROM, split_column(F.when(F.length("abstract") > SPLIT_FROM, F.col("abstract"))))
    split = articles.withColumn("_pieces", F.coalesce(pieces, F.array().cast("array<string>")))
    main = F.concat(F.lit("[PMID: "), F.col("pmid"), F.lit("]\nTitle: "), F.col("title"), F.lit("\nAuthors: "), F.col("authors"), F.lit("\n\nAbstract: "), F.col("abstract"))
    none = F.lit(None)
    whole = F.struct(main.alias("content"), F.lit("title_abstract").alias("chunk_type"), none.cast("long").alias("chunk_index"), none.cast("string").alias("chunk_id"))

    def part(text: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        return F.struct(
            F.concat(F.lit("Abstract Chunk "), number, F.lit(": "), text).alias("content"), F.lit("abstract_split").alias("chunk_type"),
            i.cast("long").alias("chunk_index"), F.concat(F.col("pmid"), F.lit("_abs_"), i.cast("string")).alias("chunk_id"),
        )

    spread = split.withColumn("_chunk", F.explode(F.concat(F.array(whole), F.transform("_pieces", part))))
    fields = ["title", "authors", "journal", "publication_date", "doi", "mesh_terms", "keywords", "publication_types"]
    metadata = F.struct(
        "topic_id", F.col("pmid").alias("pubmed_id"), *fields, article_url(F.col("pmid")).alias("url"),
        F.col("_chunk.chunk_type").alias("chunk_type"), F.col("_chunk.chunk_index").alias("chunk_index"), F.col("_chunk.chunk_id").alias("chunk_id"),
    )
    return spread.select(F.col("_chunk.content").alias("content"), metadata.alias("metadata"))


def articles_of_documents(documents: DataFrame) -> DataFrame:
    """The documents table as articles: the first line is the title, the source the journal and topic."""
    empty = F.array().cast("array<string>")
    return documents.select(
        F.col("source").alias("topic_id"), F.col("doc_id").cast("int").alias("article_index"), F.col("doc_id").cast("string").alias("pmid"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), F.lit(UNKNOWN_AUTHORS).alias("authors"), F.col("source").alias("journal"),
        F.lit(UNKNOWN_DATE).alias("publication_date"), F.lit(None).cast("string").alias("doi"), empty.alias("mesh_terms"), empty.alias("keywords"), empty.alias("publication_types"), "lang", "doc_id",
    )
