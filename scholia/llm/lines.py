"""Line dedup with a deletion-neighbourhood join.

A line's words are its runs of non-white-space bytes after lower-casing A-Z.
Lines are exact repeats if their words are equal, whatever their number; lines of
at least MIN_WORDS words are near repeats if they are one word apart (a word
replaced, added or left out), a similarity of 0.8 or more. Order is by document
id, then line number, then text hash. A line goes if its words came before, or
if an earlier line is one word apart.

Stages, all joins and sums on hashed keys:
1. the hash and place of every line with a word, and hashes of a long line's two ends, are stored once;
2. a filter that loses nothing: two lines one word apart share their first or
   their last words, so lines alone with both their ends have no near repeat;
3. the others emit their deletion neighbourhood, every variant with one word
   left out, as hashed keys with the place left out;
4. equal keys meet: variants with the same place left out are one replacement
   apart, a variant equal to a whole line is one addition apart. Each key keeps
   its earliest line, so that a large family of lines makes no pairs;
5. edit distance is verified on the words of the line and its earliest partner;
6. dropped line numbers go back to the documents.

Defined results: null text stays null, lines without a word stay, a text whose
lines all go becomes empty and its row stays; rows of one id and text are one
document and keep the same lines; a null id comes before all others; a line of
any length is one line, and texts of any length are read whole; an empty table
gives no rows; other columns, whatever their names, are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.batches import slices, thrifty
from scholia.session import stored

#: Words of a line from which it may have near repeats.
MIN_WORDS = 5
#: Rows handed on at a time by the stages that make several rows of one.
ROWS = 20_000
#: Most lines or ends that are sent to every task; beyond it, shuffle joins.
BROADCAST_LINES = 500_000

#: Odd multipliers and their inverses modulo 2**64, one pair for each half of a key.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def _end_size(n: int) -> int:
    """Words in each end of a line of n words: half at most, in steps, so that neighbours in length mostly agree."""
    step = 2 if n < 16 else 4
    return n // 2 // step * step


def ends(words: list[bytes]) -> list[int]:
    """Hashes of the ends, one of which a line one word away has too."""
    found = []
    for size in {_end_size(len(words)), _end_size(len(words) - 1)}:
        found.append(xxhash.xxh3_64_intdigest(b" ".join(words[:size]), 2 * size))
        found.append(xxhash.xxh3_64_intdigest(b" ".join(words[-size:]), 2 * size + 1))
    return [x - (1 << 64) if x >> 63 else x for x in found]


def neighbourhood(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys for the whole line (first) and for each variant with word i left out.

    Keys are sums of word hashes times powers of a base, so that leaving out a
    word takes one step whatever the length of the line.
    """
    keys = []
    for seed, (base, inverse) in enumerate(zip(_BASES, _INVERSES, strict=True)):
        hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)
        powers = np.cumprod(np.full(len(words), base, np.uint64), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])
        without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(inverse)
        keys.append(np.concatenate([sums[-1:], without]).view(np.int64))
    return keys[0], keys[1]


def one_apart(a: list, b: list) -> bool:
    """Whether the edit distance of two word lists is one at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    at = 0
    while at < len(short) and short[at] == long[at]:
        at += 1
    return short[at + (len(short) == len(long)) :] == long[at + 1 :]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """id, line, tk, h1, h2 (hash of the words), ends of every line with a word.

    Lines under MIN_WORDS have no ends and so never meet others one word apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, hashes, parts = [], [], [], []

            def flush(batch: pa.RecordBatch = batch):
                at = pa.array(rows, pa.int32())
                pair = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                columns = [batch.column(0).take(at), pa.array(numbers, pa.int32()), batch.column(1).take(at), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(parts, pa.list_(pa.int64()))]
                for kept in (rows, numbers, hashes, parts):
                    kept.clear()
                return pa.RecordBatch.from_arrays(columns, ["id", "line", "tk", "h1", "h2", "ends"])

            for row, text in enumerate(batch.column(2).cast(pa.binary())):
                for number, line in enumerate((text.as_py() or b"").lower().split(b"\n")):
                    words = line.split()
                    if not words:
                        continue
                    rows.append(row)
                    numbers.append(number)
                    hashes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    parts.append(ends(words) if len(words) >= MIN_WORDS else [])
                    if len(rows) >= ROWS:
                        yield flush()
            if rows:
                yield flush()

    fields = T.StructType.fromDDL("line int, tk long, h1 long, h2 long, ends array<long>").fields
    return docs.mapInArrow(thrifty(run), T.StructType([docs.schema["id"], *fields]))


def _words(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """lines (h1, h2, first) with their words, taken from the documents where they come first."""
    by_doc = lines.groupBy(F.col("first.id").alias("id_"), F.col("first.tk").alias("tk_")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "h1", "h2")).alias("wanted"))
    small = lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    joined = docs.join(F.broadcast(by_doc) if small else by_doc, F.col("id").eqNullSafe(F.col("id_")) & (F.col("tk") == F.col("tk_"))).select("id", "tk", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_py().encode().lower().split(b"\n")
                wanted = batch.column(3)[row].as_py()
                at = pa.array([row] * len(wanted), pa.int32())
                values = [pa.array([w[n] for w in wanted], t) for n, t in (("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()))]
                words = pa.array([b" ".join(text[w["line"]].split()) for w in wanted], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), values[0], batch.column(1).take(at), *values[1:], words], ["id", "line", "tk", "h1", "h2", "words"])

    fields = T.StructType.fromDDL("line int, tk long, h1 long, h2 long, words binary").fields
    # Repeated rows of a document bring its lines again.
    return joined.mapInArrow(thrifty(run), T.StructType([docs.schema["id"], *fields])).dropDuplicates(["h1", "h2"])


def _variants(lines: DataFrame, whole: bool) -> DataFrame:
    """k1, k2, pos, id, line, h1: the keys of lines with word pos left out, or of whole lines (pos -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, counts = [], []
            for row, words in enumerate(batch.column("words")):
                k1, k2 = neighbourhood(words.as_py().split(b" "))
                held.append((k1[:1], k2[:1]) if whole else (k1[1:], k2[1:]))
                counts.append(len(held[-1][0]))
                if sum(counts) >= ROWS or row == batch.num_rows - 1:
                    at = pa.array(np.repeat(np.arange(row + 1 - len(counts), row + 1), counts))
                    pos = np.full(len(counts), -1) if whole else np.concatenate([np.arange(n) for n in counts])
                    columns = [pa.array(np.concatenate([h[0] for h in held])), pa.array(np.concatenate([h[1] for h in held])), pa.array(pos.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, *(batch.column(n).take(at) for n in ("id", "line", "h1"))], ["k1", "k2", "pos", "id", "line", "h1"])
                    held, counts = [], []

    fields = T.StructType.fromDDL("k1 long, k2 long, pos int").fields
    return lines.select("id", "line", "h1", "words").mapInArrow(thrifty(run), T.StructType([*fields, lines.schema["id"], *T.StructType.fromDDL("line int, h1 long").fields]))


def near_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """h1, h2, first of the lines with an earlier line one word apart.

    lines: every occurrence with its ends; docs: id, tk, text.
    """
    parts = lines.select("h1", F.explode("ends").alias("end"))
    shared = parts.groupBy("end").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("end")
    shared = stored(shared)
    small = shared.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    spread = lines.select("h1", "h2", _place(), F.explode("ends").alias("end")).join(F.broadcast(shared) if small else shared, "end", "left_semi")
    left = spread.groupBy("h1", "h2").agg(F.min("first").alias("first"))
    left = stored(_words(stored(left), docs))

    keys = ["k1", "k2"]
    where = F.struct("id", "line", "h1")
    variants = _variants(left, False)
    # Variants that several lines share, and whole lines, with the earliest line of each.
    cells = variants.groupBy(*keys, "pos").agg(F.min(where).alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    wholes = _variants(left, True).select(*keys, "pos", where.alias("low"))
    known = cells.unionByName(wholes).withColumnRenamed("pos", "pos_")
    met = variants.select(*keys, "pos", where.alias("own")).join(known, keys).where("pos_ = pos or pos_ = -1")
    later = F.when(F.col("low") < F.col("own"), F.struct(F.col("own").alias("gone"), F.col("low").alias("with")))
    # Of a whole line and a variant the later line goes, of variants the one that is not the earliest.
    pairs = met.select(F.coalesce(later, F.when((F.col("pos_") == -1) & (F.col("own") < F.col("low")), F.struct(F.col("low").alias("gone"), F.col("own").alias("with")))).alias("pair"))
    pairs = pairs.where("pair is not null").groupBy(F.col("pair.gone").alias("gone")).agg(F.min("pair.with").alias("with"))

    side = lambda name: left.select(where.alias(name), F.col("words").alias(f"{name}_words"))
    both = pairs.join(left.select(where.alias("gone"), "h1", "h2", _place(), "words"), "gone").join(side("with"), "with").select("h1", "h2", "first", "words", "with_words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [one_apart(a.as_py().split(b" "), b.as_py().split(b" ")) for a, b in zip(batch.column(3), batch.column(4), strict=True)]
            yield batch.select(["h1", "h2", "first"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(thrifty(verify), both.select("h1", "h2", "first").schema)


def _place() -> F.Column:
    return F.struct("id", "line", "tk").alias("first")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tk (hash of the text), exact, near: numbers of the lines that go; documents that lose none are absent."""
    source = _documents(docs, id_col, text_col)
    lines = stored(_lines(source))
    near = stored(near_lines(lines, source))
    repeated = lines.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1")
    marks = repeated.select("h1", "h2", "first", F.lit(False).alias("near")).unionByName(near.select("h1", "h2", "first", F.lit(True).alias("near")))
    # Stored, so that both sides of the next join are dealt out for it alone and a frequent line's rows can be split.
    marks = stored(marks.groupBy("h1", "h2").agg(F.min("first").alias("earliest"), F.max("near").alias("near")))
    lost = lines.select("id", "line", "tk", "h1", "h2").join(marks, ["h1", "h2"]).select("id", "tk", "line", (_place() == F.col("earliest")).alias("is_first"), "near")
    lost = lost.where("near or not is_first")
    return lost.groupBy("id", "tk").agg(F.collect_set(F.when(~F.col("is_first"), F.col("line"))).alias("exact"), F.collect_set(F.when(F.col("is_first"), F.col("line"))).alias("near"))


def _without(text: str | None, *gone: list[int] | None) -> str | None:
    lost = {n for numbers in gone for n in numbers or ()}
    if not lost or text is None:
        return text
    return "\n".join([line for n, line in enumerate(text.split("\n")) if n not in lost])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """docs with the lines that stay; with report, also arrays `exact` and `near` of lines that go."""
    lost = dropped_lines(docs, id_col, text_col).select(F.col("id").alias("_id"), F.col("tk").alias("_tk"), "exact", "near")
    names = docs.columns
    at = names.index(text_col)
    packed = docs.select(F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("tk"))
    joined = packed.join(lost, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")), "left").select("row", "exact", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few in (few for batch in batches for few in slices(batch, batch.column("row").field(at).cast(pa.string()))):
            row = few.column("row")
            texts = [_without(t.as_py(), e.as_py(), n.as_py()) for t, e, n in zip(row.field(at), few.column("exact"), few.column("near"), strict=True)]
            columns = [pa.array(texts, pa.string()) if i == at else row.field(i) for i in range(len(names))]
            if report:
                columns += [few.column("exact"), few.column("near")]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    kinds = [docs.schema[n].dataType if n != text_col else T.StringType() for n in names]
    if report:
        kinds += [T.ArrayType(T.IntegerType())] * 2
    out = joined.mapInArrow(thrifty(run), T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)]))
    return out.toDF(*names, *(["exact", "near"] if report else []))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_exact, n_near: lines gone; n_chars, text_sha256 of what stays."""
    found = deduplicate(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col, report=True)
    gone = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return found.select(
        F.col(f"`{id_col}`"), gone("exact").alias("n_exact"), gone("near").alias("n_near"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256")
    )


def brute_force(docs: list[tuple]) -> dict:
    """Remaining text by id, comparing every pair of lines; for tests."""
    seen: list[list[bytes]] = []
    out = {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        if text is None:
            out[doc] = None
            continue
        kept = []
        for line in text.split("\n"):
            words = line.encode().lower().split()
            near = len(words) >= MIN_WORDS and any(len(other) >= MIN_WORDS and one_apart(words, other) for other in seen)
            if not words or not (near or words in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out[doc] = "\n".join(kept)
    return out


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line,
    regexp_extract_all(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
worded AS (SELECT doc_id, i, array_to_string(ws, ' ') AS k, ws FROM l WHERE len(ws) >= 1),
d AS (SELECT k, any_value(ws) AS ws, min(row(doc_id, i)) AS f FROM worded GROUP BY k),
long AS (SELECT * FROM d WHERE len(ws) >= 5),
v AS (SELECT k, f, len(ws) AS n, p, array_to_string(list_concat(ws[1:p - 1], ws[p + 1:]), ' ') AS x FROM (SELECT k, f, ws, unnest(range(1, len(ws) + 1)) AS p FROM long)),
sub AS (SELECT x, p, min(f) AS f FROM v GROUP BY x, p),
near AS (
  SELECT v.k FROM v JOIN sub ON v.x = sub.x AND v.p = sub.p WHERE sub.f < v.f
  UNION SELECT v.k FROM v JOIN long ON v.x = long.k WHERE long.f < v.f
  UNION SELECT long.k FROM v JOIN long ON v.x = long.k WHERE v.f < long.f),
mark AS (
  SELECT l.doc_id, l.i, l.line, w.k IS NOT NULL AND d.f <> row(l.doc_id, l.i) AS exact, w.k IS NOT NULL AND d.f = row(l.doc_id, l.i) AND near.k IS NOT NULL AS near
  FROM l LEFT JOIN worded w ON l.doc_id = w.doc_id AND l.i = w.i LEFT JOIN d ON w.k = d.k LEFT JOIN (SELECT DISTINCT k FROM near) near ON w.k = near.k),
t AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near) AS n_near, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT exact AND NOT near), '') AS text
  FROM mark GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_exact, 0) AS BIGINT) AS n_exact, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(length(coalesce(t.text, '')) AS BIGINT) AS n_chars, sha256(coalesce(t.text, '')) AS text_sha256
FROM documents LEFT JOIN t USING (doc_id)
"""
