"""Secret scan with corpus-wide ownership frequency.

Every text is read once, where it lies. The base patterns (assignments, access
keys, hex runs) give spans that always stay. Other runs of twelve or more
characters with a letter and a digit, outside the base spans, are candidates
beside them. Each value, a base one or a candidate, goes on as a hash, and Spark
counts for each hash the repositories and the owners it stands in, first each
owner once, then the owners of a hash, so that a value copied to a third of all
rows is a few partial sums for each task. A value of few owners is theirs alone
and looks live; one of many owners is a widely copied example. A candidate that
looks live becomes a span `live` if its shape is that of a key (twenty or more
characters, lower-case, upper-case and digit, twelve different ones), or if a base
pattern found the same value anywhere in the corpus: a key pasted without its name.

Texts are not shuffled; hashes are. Verdicts come back to spans by a join; hashes
with more than a 256th of all candidates, fewer than 256 of them, are broadcast.

The repository of a text is a column, its owner what stands before the first
slash in it (`owner/repository`), or the whole of it.

Defined results: null is the empty text, which has no span; texts of any length
are scanned whole; repeated rows have a row each and count as one of the same
owner; a text of no known repository belongs to an owner of its own, who is one
for all of them; an empty table gives no rows; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.session import stored

# The base patterns, and how long a match of each must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # as runs are whole, the same as those of any length that have 16 characters
LEAST = {"assign": 12, "access": 18}
KINDS = ["assign", "access", "hex", "live"]
#: What a text must have somewhere for a pattern to find anything in it.
MAY = [
    r"""(?i)(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[a-z0-9+/_.=-]{12}""",
    r"AKIA[A-Z0-9]{14}",
    r"[0-9a-f]{16}",
]
#: The same for other runs: twelve characters, and a digit beside what is none.
MAY_BESIDE = [r"[A-Za-z0-9+/_.=-]{12}", r"[0-9][A-Za-z+/_.=-]|[A-Za-z+/_.=-][0-9]"]
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: A key's shape, and the most owners of a value that is theirs alone.
SHAPE_LENGTH, SHAPE_DIFFERENT, MOST_OWNERS = 20, 12, 2
#: A hash with more than this share of all candidates is looked up by broadcast.
HOT_SHARE = 256

#: What the scan keeps of a span: kind's number (3 for a candidate), place, hash of the value, whether it has a key's shape.
_FIELDS = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("strong", pa.bool_())]
_FOUND = "array<struct<kind:int,start:int,end:int,value:long,strong:boolean>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """kind's number, start, end and value of every base match that is long enough, kind by kind."""
    out = [(0, *m.span(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    out += [(1, *m.span(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= LEAST["access"]]
    return out + [(2, *m.span(), m.group()) for m in HEX.finditer(text)]


def shaped(value: str) -> bool:
    """Whether a value has the shape of a key."""
    kinds = any(c.islower() for c in value) and any(c.isupper() for c in value) and any(c.isdigit() for c in value)
    return len(value) >= SHAPE_LENGTH and kinds and "/" not in value and "." not in value and len(set(value)) >= SHAPE_DIFFERENT


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Other runs with a letter and a digit that touch no base span, as kind 3; a closing full stop is not theirs."""
    starts, reach = [], []
    for start, end in sorted((a, b) for _, a, b, _ in base):
        starts.append(start)
        reach.append(max(end, reach[-1] if reach else 0))
    out = []
    for m in _RUN.finditer(text):
        value = m.group().rstrip(".")
        start, end = m.start(), m.start() + len(value)
        before = bisect_left(starts, end) - 1  # the last base span that starts before this one ends
        if len(value) >= LEAST["assign"] and _DIGIT.search(value) and _LETTER.search(value) and (before < 0 or reach[before] <= start):
            out.append((3, start, end, value))
    return out


def value_hash(value: str) -> int:
    """A signed 64-bit hash of a value; a closing full stop is not part of it."""
    return int(np.uint64(xxhash.xxh64_intdigest(value.rstrip("."))).astype(np.int64))


def owner_of(repo: Column) -> Column:
    """What stands before the first slash of a repository; one unknown owner for all that have none."""
    return F.substring_index(F.coalesce(repo, F.lit("")), "/", 1)


def _spans(texts: pa.Array) -> pa.Array:
    """Base spans and candidates of every text of a batch; only texts that may have any are looked at."""
    has = [pc.fill_null(pc.match_substring_regex(texts, p), False) for p in (*MAY, *MAY_BESIDE)]
    look = pc.or_(pc.or_(has[0], pc.or_(has[1], has[2])), pc.and_(has[3], has[4]))
    rows, counts = [], np.zeros(len(texts), np.int32)
    for n in np.flatnonzero(look.to_numpy(zero_copy_only=False)).tolist():
        text = texts[n].as_py()
        base = base_spans(text)
        own = base + candidates(text, base)
        counts[n] = len(own)
        rows += [(k, a, b, value_hash(v), shaped(v)) for k, a, b, v in own]
    columns = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
    flat = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [name for name, _ in _FIELDS])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """id, repo, owner, row (a number of its own) and found, all base spans and candidates of every text. Stored."""
    id_field = T.StructField("id", docs.schema[id_col].dataType)
    repo = F.coalesce(F.col(f"`{repo_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), repo.alias("repo"), owner_of(repo).alias("owner"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _spans(batch.column(3))], ["id", "repo", "owner", "found"])

    schema = T.StructType([id_field, *T.StructType.fromDDL(f"repo string, owner string, found {_FOUND}").fields])
    return stored(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repos (distinct ones), places, based (whether a base pattern found it) of every hash. Stored."""
    each = found.select("repo", "owner", F.explode("found").alias("s")).groupBy(F.col("s.value").alias("value"), "owner", "repo").agg(F.count("*").alias("places"), F.max(F.col("s.kind") < 3).alias("based"))
    owned = each.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("places").alias("places"), F.max("based").alias("based"))
    return stored(owned.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("places").alias("places"), F.max("based").alias("based")))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", most_owners: int = MOST_OWNERS) -> DataFrame:
    """id and spans (kind, start, end, owners, repos, live) of every text, by start and kind.

    Base spans all stay, whoever owns their values; `live` says whether `most_owners`
    have the value at most. Candidates are there as kind live if they are.
    """
    found = scan(docs, id_col, text_col, repo_col)
    owners = ownership(found)
    total = owners.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    spans = found.where(F.size("found") > 0).select("row", F.explode("found").alias("s")).select("row", "s.*")
    hot = owners.where(F.col("places") * HOT_SHARE > total)  # fewer than HOT_SHARE rows
    names = F.broadcast(hot.select("value"))
    told = spans.join(F.broadcast(hot), "value").unionByName(spans.join(names, "value", "left_anti").join(owners, "value"))
    live = F.col("owners") <= most_owners
    kept = told.where((F.col("kind") < 3) | (live & (F.col("strong") | F.col("based"))))
    span = F.struct("start", "kind", "end", "owners", "repos", live.alias("live"))
    by_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))  # the spans of one text
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform("spans", lambda s: F.struct(F.get(kinds, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["owners"].alias("owners"), s["repos"].alias("repos"), s["live"].alias("live")))
    joined = found.select(F.col("id").alias(id_col), "row").join(by_row, "row", "left")
    return joined.select(id_col, F.coalesce(named, F.array().cast("array<struct<kind:string,start:int,end:int,owners:bigint,repos:bigint,live:boolean>>")).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Base spans' numbers and hash, all spans as text, and how many hold values of few owners or widely copied ones."""
    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(test) -> Column:
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(kind: str) -> Column:
        return number(lambda s: s["kind"] == kind).alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "live")
    return found.select(
        id_col, *(of_kind(k) for k in KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        number(lambda s: s["live"]).alias("n_live"), number(lambda s: ~s["live"]).alias("n_example"),
    )


def brute_force(rows: list[tuple], most_owners: int = MOST_OWNERS) -> list[tuple]:
    """The digest's rows for (id, text, repository), character by character; for tests."""
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

    def stretch(text: str, at: int, allowed: str) -> int:
        while at < len(text) and text[at] in allowed:
            at += 1
        return at

    def assigned(text: str, at: int) -> tuple[int, int] | None:
        """Where the value and its match end, if an assignment starts here."""
        low = "".join(c.lower() if c in plain else c for c in text[at : at + 8])
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word):
                k = at + len(word)
                k += text[k : k + 1] in ("'", '"') and k < len(text)
                k = stretch(text, k, " ")
                if text[k : k + 1] in (":", "=") and k < len(text):
                    k = stretch(text, k + 1, " ")
                    k += text[k : k + 1] in ("'", '"') and k < len(text)
                    end = stretch(text, k, plain)
                    return (k, end) if end > k else None
        return None

    scanned = []
    for doc, text, repo in rows:
        text, spans, at = text or "", [], 0
        while at < len(text):
            got = assigned(text, at)
            if got and got[1] - got[0] >= 12:
                spans.append((at, 0, got[1], text[got[0] : got[1]]))
            at = got[1] if got else at + 1
        for kind, head, allowed, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), (2, "", "0123456789abcdef", 16)):
            at = 0
            while at < len(text):
                end = stretch(text, at + len(head), allowed) if text.startswith(head, at) else at
                if end > at + len(head):
                    if end - at >= least:
                        spans.append((at, kind, end, text[at:end]))
                    at = end
                else:
                    at += 1
        at, base = 0, list(spans)
        while at < len(text):
            end = stretch(text, at, plain)
            value = text[at:end].rstrip(".")
            if len(value) >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and all(b <= at or at + len(value) <= a for a, _, b, _ in base):
                spans.append((at, 3, at + len(value), value))
            at = max(end, at + 1)
        scanned.append((doc, repo or "", spans))
    owners: dict[str, set] = {}
    based = set()
    for _, repo, spans in scanned:
        for _, kind, _, value in spans:
            owners.setdefault(value.rstrip("."), set()).add(repo.split("/")[0])
            if kind < 3:
                based.add(value.rstrip("."))
    out = []
    for doc, _, spans in scanned:
        keep = []
        for start, kind, end, value in sorted(spans):
            value = value.rstrip(".")
            live = len(owners[value]) <= most_owners
            if kind < 3 or (live and (shaped(value) or value in based)):
                keep.append((f"{KINDS[kind]}:{start}:{end}", kind, live))
        base = ",".join(name for name, kind, _ in keep if kind < 3)
        counts = [sum(kind == k for _, kind, _ in keep) for k in range(3)]
        out.append((doc, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(name for name, _, _ in keep), sum(x for _, _, x in keep), sum(not x for _, _, x in keep)))
    return out


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS repo, coalesce(text, '') AS t FROM documents),
p(kind, pat) AS (VALUES
  (0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]{16,}'), (3, '[A-Za-z0-9+/_.=-]{12,}')),
f AS MATERIALIZED (
  SELECT r, 0 AS kind, regexp_extract_all(t, (SELECT pat FROM p WHERE kind = 0)) AS ms, string_split_regex(t, (SELECT pat FROM p WHERE kind = 0)) AS gaps FROM d
  UNION ALL SELECT r, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, 2, regexp_extract_all(t, '[0-9a-f]{16,}'), string_split_regex(t, '[0-9a-f]{16,}') FROM d
  UNION ALL SELECT r, 3, regexp_extract_all(t, '[A-Za-z0-9+/_.=-]{12,}'), string_split_regex(t, '[A-Za-z0-9+/_.=-]{12,}') FROM d),
u AS (
  SELECT r, kind, i, ms[i] AS x, coalesce(list_sum([length(g) FOR g IN gaps[1:i]]), 0) + coalesce(list_sum([length(g) FOR g IN ms[1:i - 1]]), 0) AS s
  FROM (SELECT r, kind, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM f)),
v AS MATERIALIZED (
  SELECT r, kind, CAST(s AS BIGINT) AS s, CAST(s AS BIGINT) + length(CASE WHEN kind = 3 THEN rtrim(x, '.') ELSE x END) AS e,
    CASE WHEN kind = 0 THEN regexp_extract(x, (SELECT pat FROM p WHERE kind = 0), 2) WHEN kind = 3 THEN rtrim(x, '.') ELSE x END AS whole FROM u),
base AS MATERIALIZED (SELECT * FROM v WHERE (kind = 0 AND length(whole) >= 12) OR (kind = 1 AND length(whole) >= 18) OR kind = 2),
beside AS (
  SELECT * FROM v WHERE kind = 3 AND length(whole) >= 12 AND regexp_matches(whole, '[0-9]') AND regexp_matches(whole, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = v.r AND base.s < v.e AND v.s < base.e)),
spans AS MATERIALIZED (SELECT *, rtrim(whole, '.') AS value FROM (SELECT * FROM base UNION ALL SELECT * FROM beside)),
owned AS MATERIALIZED (SELECT value, count(DISTINCT string_split(repo, '/')[1]) AS owners, max(kind < 3) AS based FROM spans JOIN d USING (r) GROUP BY value),
kept AS (
  SELECT r, kind, s, e, owners <= 2 AS live FROM spans JOIN owned USING (value)
  WHERE kind < 3 OR (owners <= 2 AND (based OR (length(value) >= 20 AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND NOT regexp_matches(value, '[/.]')
    AND len(list_distinct(string_split(value, ''))) >= 12)))),
g AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(name, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(name, ',' ORDER BY s, kind) AS spans,
    count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example
  FROM (SELECT *, (['assign', 'access', 'hex', 'live'])[kind + 1] || ':' || s || ':' || e AS name FROM kept) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (r)
"""
