"""Ranked lexical search by presence masks: the best documents of every item, exactly.

Texts are read once for each block of items: a task counts the terms of a text and
keeps the numbers of those that some item has. These counts, not the texts, are
stored. Spark sums documents, terms and document frequencies over all of them;
weights follow.

A second pass reads the counts by blocks of documents of like length. There, a
bitmap of documents for each term an item has makes a mask for each document: bit
i says whether it holds the item's i-th term. Documents of one mask are a group.
A group's maximum score takes the greatest gain that each of its terms has in the
block, so that documents of one mask need no look of their own once the maximum
is below what is held. Groups are evaluated from the highest maximum down until the
next one is lower than the item's k-th best score so far in the task, which
is safe. A task hands on k rows for each item; Spark ranks them.

Items are taken in blocks of VOCABULARY_BYTES of text at most, all of a block's
terms are sent to every task, and a larger set of items is more blocks, each
against all documents. What a task holds is a block's terms, k scores for each of
its items, and one Arrow batch.

Defined results: null and empty texts have no terms, and a document without terms
counts for nothing; items without terms, or whose terms no document has, have no
rows; repeated items are items of their own, with rows each; repeated documents
rank each; null ids rank last among equal scores; texts of any length are counted
whole; empty tables give no rows; other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.session import stored

TOP = 10
#: Bytes of the items' texts in a block: what is sent to every task at most.
VOCABULARY_BYTES = 4 << 20
#: Documents whose masks are made together, and those evaluated at a time.
DOCS, FEW = 4096, 64
#: Bits of a word of a mask.
WORD = 63
BEST = "number long, id long, score long"

# A term is a run of ASCII letters and digits and of all other characters past ASCII; A to Z are lower-cased.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | bytes | None) -> list[bytes]:
    """All terms of a text in order, in UTF-8."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_TERMS).split()


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def length_measure(n: int, documents: int, terms: int) -> int:
    """m of a document of n terms."""
    return 100 - 75 + (75 * n * documents) // terms


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n and, of the terms in the vocabulary, codes and tfs (32-bit integers) of every document with terms. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, bytes, bytes]] = []
            keep = []
            for at, text in enumerate(batch.column(1)):
                found = terms_of(text.as_buffer().to_pybytes() if text.is_valid else None)
                if found:
                    own = {vocabulary[t]: c for t, c in Counter(found).items() if t in vocabulary}
                    keep.append(at)
                    rows.append((len(found), np.fromiter(own, np.int32, len(own)).tobytes(), np.fromiter(own.values(), np.int32, len(own)).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = (pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "n", "codes", "tfs"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "id long, n long, codes binary, tfs binary"))


def frequencies(counts: DataFrame) -> dict[int, int]:
    """In how many documents each term of the vocabulary is; a number for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            codes, found = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), return_counts=True)
            total.update(dict(zip(codes.tolist(), found.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["code", "df"])

    rows = counts.select("codes").mapInArrow(run, "code int, df long").groupBy("code").agg(F.sum("df").alias("df"))
    return {r["code"]: r["df"] for r in rows.collect()}  # of the vocabulary


class _Best:
    """The k best documents of an item in a task: scores, ids, and whether an id is known."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """The score below which nothing gets in."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        good = scores >= self.least
        scores, ids, known = (np.concatenate([a, b[good]]) for a, b in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -scores))[: self.k]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


class Block:
    """Documents of like length with the postings of the vocabulary's terms in them, and what each is worth there at most."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, m: np.ndarray, owners: np.ndarray, codes: np.ndarray, tfs: np.ndarray):
        self.ids, self.known = ids, known
        order = np.lexsort((owners, codes))
        self.docs, self.gain = owners[order], gains(tfs[order], m[owners[order]])
        self.codes, first = np.unique(codes[order], return_index=True)
        self.bounds = np.append(first, len(order))
        self.most = np.maximum.reduceat(self.gain, first) if len(first) else self.gain

    def slots(self, codes: np.ndarray) -> np.ndarray:
        """Where these terms are among the block's, -1 for those that are not."""
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == codes, at, -1) if len(self.codes) else np.full(len(codes), -1)

    def search(self, codes: np.ndarray, weights: np.ndarray, best: _Best) -> int:
        """Add what the block has for an item (terms and their weights times repeats); how many documents were evaluated."""
        slots = self.slots(codes)
        here = np.flatnonzero((slots >= 0) & (weights > 0))
        if not len(here):
            return 0
        slots, weights = slots[here], weights[here]
        if int((weights * self.most[slots]).sum()) < best.least:
            return 0
        masks = np.zeros((-(-len(slots) // WORD), len(self.ids)), np.int64)
        most = np.zeros(len(self.ids), np.int64)
        for i, slot in enumerate(slots.tolist()):
            docs = self.docs[self.bounds[slot] : self.bounds[slot + 1]]
            masks[i // WORD, docs] |= 1 << i % WORD
            most[docs] += weights[i] * self.most[slot]
        # Documents by the maximum of their mask, and those of one mask together.
        able = np.flatnonzero(most >= best.least)
        able = able[np.lexsort((*masks[:, able], -most[able]))]
        changes = (masks[:, able[1:]] != masks[:, able[:-1]]).any(axis=0)
        ends = np.append(np.flatnonzero(changes) + 1, len(able))
        done = 0
        while done < len(able) and most[able[done]] >= best.least:
            # Whole groups: one, or as many as have FEW documents together.
            at = int(np.searchsorted(ends, done + FEW, side="right"))
            end = int(ends[at - 1]) if at and ends[at - 1] > done else int(ends[at])
            few = np.sort(able[done:end])
            scores = np.zeros(len(few), np.int64)
            for i, slot in enumerate(slots.tolist()):
                low, high = self.bounds[slot], self.bounds[slot + 1]
                at = low + np.searchsorted(self.docs[low:high], few)
                at[at == high] = low
                scores += np.where(self.docs[at] == few, weights[i] * self.gain[at], 0)
            best.add(scores, self.ids[few], self.known[few])
            done = end
        return done


def _blocks(batch: pa.RecordBatch, documents: int, terms: int, size: int) -> Iterator[Block]:
    """Blocks of up to `size` documents of a batch (id, n, codes, tfs), by length."""
    n = batch.column(1).to_numpy()
    order = np.argsort(n, kind="stable")
    m = np.array([length_measure(x, documents, terms) for x in n.tolist()], np.int64)
    known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    ids = batch.column(0).fill_null(0).to_numpy()
    for low in range(0, len(order), size):
        some = order[low : low + size]
        rows = pa.array(some)
        codes, tfs = (batch.column(c).take(rows).to_pylist() for c in (2, 3))
        owners = np.repeat(np.arange(len(some)), [len(c) // 4 for c in codes])
        yield Block(ids[some], known[some], m[some], owners, np.frombuffer(b"".join(codes), np.int32), np.frombuffer(b"".join(tfs), np.int32).astype(np.int64))


def _block_of_items(items: list[tuple[int, str | None]]) -> tuple[dict[bytes, int], list[tuple[int, np.ndarray, np.ndarray]]]:
    """Numbers of all terms of these items, and of each item its number, its terms and their repeats."""
    vocabulary: dict[bytes, int] = {}
    found = []
    for number, text in items:
        repeats = Counter(terms_of(text))
        if repeats:
            found.append((number, np.array([vocabulary.setdefault(t, len(vocabulary)) for t in repeats], np.int32), np.array(list(repeats.values()), np.int64)))
    return vocabulary, found


def _numbered(items: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """number, item, text, block of all items: neighbours with `size` bytes of text or little more are a block. Stored."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = stored(items.select(F.col(f"`{item_col}`").alias("item"), text.alias("text")).withColumn("number", F.monotonically_increasing_id()))
    part, length = F.shiftright("number", 33), F.octet_length(F.coalesce("text", F.lit("")))
    # Sums within a task of the scan, and before it: a row for each task.
    sums = rows.groupBy(part.alias("part")).agg(F.sum(length).alias("bytes"))
    offsets = sums.select("part", F.coalesce(F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    own = F.coalesce(F.sum(length).over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("part", part).withColumn("own", own).join(F.broadcast(offsets), "part")
    return stored(placed.select("number", "item", "text", F.floor((F.col("offset") + F.col("own")) / size).alias("block")))


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    vocabulary_bytes: int = VOCABULARY_BYTES, size: int = DOCS,
) -> DataFrame:
    """item, rank (from 1), id, score of the k best documents of every item."""
    numbered = _numbered(items, item_col, item_text_col, vocabulary_bytes)
    last = numbered.agg(F.max("block")).first()[0]
    rows = docs.sparkSession.createDataFrame([], BEST)
    for block in range(0 if last is None else last + 1):
        few = numbered.where(F.col("block") == block).select("number", "text").collect()  # vocabulary_bytes and one text at most
        rows = rows.unionByName(_search_block(docs, [tuple(r) for r in few], k, id_col, text_col, size))
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("number", "item"), "number").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_block(docs: DataFrame, items: list[tuple[int, str | None]], k: int, id_col: str, text_col: str, size: int) -> DataFrame:
    """number, id, score: of each task the k best documents of every item of a block."""
    vocabulary, asked = _block_of_items(items)
    counts = counted(docs, vocabulary, id_col, text_col)
    documents, terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = frequencies(counts)
    weights = np.array([weight(documents, df.get(c, 0)) for c in range(len(vocabulary))], np.int64)
    wanted = [(number, codes, repeats * weights[codes]) for number, codes, repeats in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {number: _Best(k) for number, _, _ in wanted}
        for batch in batches:
            for block in _blocks(batch, documents, terms, size):
                for number, codes, worth in wanted:
                    block.search(codes, worth, held[number])
        for number, best in held.items():
            ids = pa.array(best.ids, pa.int64(), mask=~best.known)
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), ids, pa.array(best.scores)], ["number", "id", "score"])

    return counts.mapInArrow(run, BEST)


def digest(found: DataFrame, item_col: str = "item_id", id_col: str = "doc_id") -> DataFrame:
    return found.select(item_col, "rank", id_col, "score")


def brute_force(docs: list[tuple], items: list[tuple], k: int = TOP) -> list[tuple]:
    """search()'s rows for (id, text), every document scored for every item; for tests."""
    import re

    def words(text: str | None) -> list[str]:
        found = re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in found]

    held = [(doc, own) for doc, text in docs if (own := words(text))]
    documents, terms = len(held), sum(len(own) for _, own in held)
    out = []
    for item, text in items:
        scored = []
        for doc, own in held:
            m = 25 + 75 * len(own) * documents // terms
            score = 0
            for term in words(text):
                tf, df = own.count(term), sum(term in other for _, other in held)
                score += math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
size AS (SELECT count(*) AS nd, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
q AS (SELECT i, item_id, t, count(*) AS q FROM (SELECT i, item_id, unnest(ws) AS t FROM b) GROUP BY i, item_id, t),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), size),
s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN tf USING (t), size GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
