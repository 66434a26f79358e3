"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A text's words are its runs of ASCII digits, letters and non-ASCII characters
after lower-casing A-Z. A benchmark item gives one pattern per window of 13
consecutive words; an item of fewer words is one pattern, an item of none gives
nothing. Patterns of one length share a Wu-Manber table: the last two words
under the cursor look up how far it may jump, and where the jump is zero the
bucket of that suffix is compared word by word.

Each task scans whole texts. A benchmark of up to `block_bytes` of text is sent to
the tasks with its tables. A larger one never leaves the executors: its windows
are a table, and the shift tables of all pattern lengths are hashed into one of
at most MOST_SLOTS bytes, where blocks that meet keep the smaller jump. That is
all the tasks get; where the jump is zero they give out the words under the
cursor, and Spark's equality join of these with the windows is the bucket and
the comparison. Texts are read once whatever the benchmark's size.

Defined results: null or empty text has no words, no hits and is clean; null
benchmark text gives no pattern; items with a null id mark words as hit but are
not counted; repeated rows are judged one by one; an empty benchmark hits
nothing, an empty table gives no rows; texts and items of any length are taken
whole; columns beyond the id and the text, whatever their names, are passed
through by decontaminate() and not looked at elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.batches import thrifty
from scholia.session import stored

WINDOW = 13
#: Benchmark text that is sent to tasks; a task's tables take about a hundred times as much memory.
BLOCK_BYTES = 2 << 20
#: Sizes of the hashed shift table: some eight bytes to a word of the benchmark, within bounds.
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 26
#: Slots of the table that one task gathers, and rows handed on at a time.
PAGE, ROWS = 1 << 16, 20_000
#: A document is contaminated if hit words * RATIO >= words.
RATIO = 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(
    b if b >= 0x80 or b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words_of(data: bytes | None) -> list[bytes]:
    """Words of UTF-8 text; splitting bytes equals splitting characters here."""
    return data.translate(_FOLD).split() if data else []


class WuManber:
    """Multi-pattern search for word sequences of one common length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]]):
        self.length = length = len(next(iter(patterns)))
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[list[bytes], set[int]]]] = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.bucket.setdefault(pattern[length - self.block :], []).append((list(pattern), owners))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """(start, end, owners) of every occurrence, by start."""
        shift, bucket, length, jump, total = self.shift.get, self.bucket, self.length, self.jump, len(words)
        at = length - 1
        pairs = self.block == 2
        while at < total:
            key = (words[at - 1], words[at]) if pairs else (words[at],)
            step = shift(key, jump)
            if step:
                at += step
                continue
            start = at - length + 1
            for pattern, owners in bucket[key]:
                if pattern[0] == words[start] and words[start : at + 1] == pattern:
                    yield start, at + 1, owners
            at += 1


class Matcher:
    """Wu-Manber tables for every pattern length of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        found: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for start in range(len(words) - size + 1 if size else 0):
                owners = found.setdefault(size, {}).setdefault(tuple(words[start : start + size]), set())
                if item is not None:
                    owners.add(item)
        self.tables = [WuManber(patterns) for _, patterns in sorted(found.items())]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words, merged and in order, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for table in self.tables:
            for start, end, owners in table.find(words):
                spans.append((start, end))
                items |= owners
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def contaminated(n_words: int, spans: list[tuple[int, int]]) -> bool:
    hit = sum(end - start for start, end in spans)
    return hit > 0 and RATIO * hit >= n_words


def _items(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return bench.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.encode(F.col(f"`{text_col}`").cast("string"), "utf-8").alias("text")).where(F.length("text") > 0)


def _sent(items: DataFrame, block_bytes: int) -> list[tuple] | None:
    """The items, if they are few enough to be sent to every task."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return [tuple(row) for row in items.collect()] if total <= block_bytes else None


def _binary(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    return (x.as_py() for x in batch.column(name).cast(pa.binary()))


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>"


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _scan(source: DataFrame, items: list[tuple], window: int) -> DataFrame:
    """id, tk, n_words, spans, item_ids of documents (id, tk, text) against items that every task gets."""
    sent = source.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, window)
        for batch in batches:
            counts, spans, items = [], [], []
            for text in _binary(batch, "text"):
                words = words_of(text)
                got, owners = matcher.scan(words)
                counts.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in got])
                items.append(sorted(owners))
            columns = [batch.column("id"), batch.column("tk"), pa.array(counts, pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "tk", "n_words", "spans", "item_ids"])

    return source.mapInArrow(thrifty(run), T.StructType([source.schema["id"], *T.StructType.fromDDL(f"tk long, {_FOUND}").fields]))


def block_hash(words: list[bytes], end: int, length: int) -> int:
    """Hash of the block of words that ends there, for patterns of that length."""
    return xxhash.xxh3_64_intdigest(b" ".join(words[max(0, end - min(2, length)) : end]), length)


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """n, words, item: every window of the items (item, text), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), _binary(batch, "text"), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                count = len(words) - size + 1 if size else 0
                for at in range(0, count, ROWS):
                    found = [b" ".join(words[k : k + size]) for k in range(at, min(count, at + ROWS))]
                    yield pa.RecordBatch.from_arrays([pa.array([size] * len(found), pa.int32()), pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], ["n", "words", "item"])

    return items.mapInArrow(thrifty(run), "n int, words binary, item string").distinct()


def shift_table(items: DataFrame, window: int) -> tuple[np.ndarray, list[int]]:
    """The hashed shift table of all windows (255: no block there), and the lengths of patterns."""
    words = items.agg(F.sum(F.length("text"))).first()[0] // 6
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (8 * words).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in _binary(batch, "text"):
                words = words_of(text)
                size = min(window, len(words))
                # Of all windows that a block ends in, the one that ends last jumps least.
                ends = range(min(2, size), len(words) + 1) if size else range(0)
                for at in range(0, len(ends), ROWS):
                    some = ends[at : at + ROWS]
                    columns = [pa.array([size] * len(some), pa.int32()), pa.array([block_hash(words, e, size) % slots for e in some], pa.int64()), pa.array([max(0, size - e) for e in some], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["n", "slot", "shift"])

    shifts = stored(items.mapInArrow(thrifty(run), "n int, slot long, shift int").groupBy("n", "slot").agg(F.min("shift").alias("shift")))

    def page(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full(min(PAGE, slots), 255, np.uint8)
        out[pdf["slot"].to_numpy() % PAGE] = pdf["shift"].to_numpy()
        return pd.DataFrame({"page": [key[0]], "data": [out.tobytes()]})

    table = np.full(slots, 255, np.uint8)
    merged = shifts.groupBy("slot").agg(F.min("shift").alias("shift")).withColumn("page", F.floor(F.col("slot") / PAGE))
    # At most MOST_SLOTS bytes in pages.
    for row in merged.groupBy("page").applyInPandas(page, "page long, data binary").toLocalIterator():
        table[row["page"] * PAGE : (row["page"] + 1) * PAGE] = np.frombuffer(row["data"], np.uint8)
    return table, sorted(r["n"] for r in shifts.select("n").distinct().collect())


def candidates(words: list[bytes], table: np.ndarray, length: int) -> Iterator[int]:
    """Places where a pattern of that length may start: the jump is zero at its last block."""
    at, jump, slots = length, length - min(2, length) + 1, len(table)
    while at <= len(words):
        step = int(table[block_hash(words, at, length) % slots])
        if step == 0:
            yield at - length
            step = 1
        at += min(step, jump)


def _routed(source: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """What _scan() gives, for items of any size: possible places are joined with the table of windows."""
    table, lengths = shift_table(items, window)
    sent = source.sparkSession.sparkContext.broadcast((table.tobytes(), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, sizes = sent.value
        shifts = np.frombuffer(data, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                counts, places = [], []
                for text in _binary(few, "text"):
                    words = words_of(text)
                    counts.append(len(words))
                    places.append([{"n": n, "start": k, "words": b" ".join(words[k : k + n])} for n in sizes for k in candidates(words, shifts, n)])
                yield pa.RecordBatch.from_arrays([few.column("id"), few.column("tk"), pa.array(counts, pa.int64()), pa.array(places, _PLACES)], ["id", "tk", "n_words", "places"])

    schema = T.StructType([source.schema["id"], *T.StructType.fromDDL("tk long, n_words long, places array<struct<n:int,start:int,words:binary>>").fields])
    scanned = stored(source.mapInArrow(thrifty(run), schema))
    tried = scanned.select("id", "tk", F.inline("places"))
    met = tried.join(windows_of(items, window), ["n", "words"])
    hits = met.groupBy(F.col("id").alias("id_"), F.col("tk").alias("tk_")).agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("item_ids")
    )
    joined = scanned.drop("places").join(hits, F.col("id").eqNullSafe(F.col("id_")) & (F.col("tk") == F.col("tk_")), "left").drop("id_", "tk_")

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": s, "end": e} for s, e in merge([(x["start"], x["end"]) for x in row or []])] for row in batch.column("spans").to_pylist()]
            items = [row or [] for row in batch.column("item_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "tk", "n_words")), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))], ["id", "tk", "n_words", "spans", "item_ids"])

    return joined.mapInArrow(thrifty(union), T.StructType([source.schema["id"], *T.StructType.fromDDL(f"tk long, {_FOUND}").fields]))


_PLACES = pa.list_(pa.struct([("n", pa.int32()), ("start", pa.int32()), ("words", pa.binary())]))


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, spans of hit words, item_ids that occur in it."""
    source, items = _source(docs, id_col, text_col), _items(bench, item_col, item_text_col)
    few = _sent(items, block_bytes)
    found = _routed(source, items, window) if few is None else _scan(source, few, window)
    return found.select(F.col("id").alias(id_col), "n_words", "spans", "item_ids")


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs without its contaminated rows; columns and other rows stay as they are.

    With a small benchmark a row is judged where it is read; with a larger one the
    judgement comes back to the documents in a join.
    """
    items = _items(bench, item_col, item_text_col)
    few = _sent(items, block_bytes)
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("id")
    )
    if few is not None:
        sent = docs.sparkSession.sparkContext.broadcast(few)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, window)
            for batch in batches:
                words = map(words_of, _binary(batch, "text"))
                yield batch.select(["row"]).filter(pa.array([not contaminated(len(w), matcher.scan(w)[0]) for w in words], pa.bool_()))

        kept = packed.select("row", "text").mapInArrow(thrifty(run), packed.select("row").schema)
    else:
        found = _routed(_source(docs, id_col, text_col), items, window)
        gone = found.where((_hit() > 0) & (F.lit(RATIO) * _hit() >= F.col("n_words"))).select(F.col("id").alias("id_"), F.col("tk").alias("tk_"))
        kept = packed.join(gone, F.col("id").eqNullSafe(F.col("id_")) & (F.xxhash64("text") == F.col("tk_")), "left_anti")
    return kept.select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)])


def _hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def digest(report: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The report of contamination() as counts and a hash of the item ids."""
    hit = _hit()
    names = F.array_sort("item_ids")
    return report.select(
        F.col(f"`{id_col}`"),
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((hit > 0) & (F.lit(RATIO) * hit >= F.col("n_words"))).alias("contaminated"),
    )


def brute_force(docs: list[tuple], bench: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The digest's rows by comparing every window at every place; for tests."""
    patterns = []
    for item, text in bench:
        words = words_of(text.encode() if text else None)
        size = min(window, len(words))
        patterns += [(item, words[i : i + size]) for i in range(len(words) - size + 1)] if size else []
    out = []
    for doc, text in docs:
        words = words_of(text.encode() if text else None)
        hit, items = set(), set()
        for item, pattern in patterns:
            for i in range(len(words) - len(pattern) + 1):
                if words[i : i + len(pattern)] == pattern:
                    hit |= set(range(i, i + len(pattern)))
                    items |= {item} - {None}
        joined = ",".join(sorted(map(str, items)))
        out.append((doc, len(words), len(hit), len(items), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and RATIO * len(hit) >= len(words)))
    return out


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS p
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM pat),
win AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
occ AS (SELECT win.doc_id, win.i, win.n, pat.item_id FROM win JOIN pat ON win.n = pat.n AND win.p = pat.p),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN its ON w.doc_id = its.doc_id
"""
