"""Language identification by nearest clustered centroids of TF-IDF n-gram vectors.

A text is lower-cased and folded to words (runs of ASCII letters and non-ASCII
characters). Byte 2-grams and 3-grams of the words, with their bounds, are
counted in DIMS hashed places; square roots of counts times inverse document
frequency, scaled to length one, make the vector. Every language has up to
CLUSTERS centroids from spherical k-means over its training vectors; a text gets
the language of the centroid of the largest cosine.

Training uses at most SAMPLE different labelled texts of each language, those of
the smallest hashes: a documented bound, whatever the size of the table. A text
counts once however many documents have it, and in whatever order they come.

Rejection by distance: a text is rejected if its cosine is below REJECT times
the median cosine of that centroid's training members, scaled down by the
square root of its n-grams over SHORT for shorter texts, which fill fewer places.

Defined results: null texts and texts without a letter are `und` with score 0
and are rejected; without any labelled row every text is `und`; ties go to the
language first in alphabetical order; rows with a null id, text or language
teach nothing; repeated rows are predicted alike and teach once; a text of any
length counts whole; an empty table gives no rows and a model that knows no
language; other columns, whatever their names, are passed through by accepted()
and not looked at elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.batches import slices, thrifty
from scholia.session import cut

DIMS = 2048
CLUSTERS = 4
SAMPLE = 400
REJECT = 0.35
SHORT = 1000
UNKNOWN = "und"
#: Bytes counted at a time, and texts scored at a time.
CHUNK, ROWS = 1 << 20, 512

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b if b >= 0x80 or b in _LETTERS else 32 for b in range(256))


def counts_of(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a text; None if it has no letter."""
    if not text:
        return None
    words = text.lower().encode().translate(_FOLD).split()
    if not words or not (any(w[0] < 0x80 or w[-1] < 0x80 for w in words) or any(c.isalpha() for c in text)):
        return None
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    out = np.zeros(DIMS, np.int64)
    for at in range(0, len(data), CHUNK):
        part = data[max(0, at - 2) : at + CHUNK].astype(np.uint32)
        pairs = part[:-1] << 8 | part[1:]
        triples = pairs[:-1] << 8 | part[2:]
        fresh = 0 if at == 0 else 1
        for grams in (pairs[fresh:], triples | np.uint32(1 << 31)):
            out += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(21), minlength=DIMS)
    return out


def scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length from rows of counts."""
    rows = np.sqrt(counts, dtype=np.float32) * idf.astype(np.float32)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def cluster(rows: np.ndarray, k: int = CLUSTERS, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means started from rows far apart: centroids, and each row's cosine to its own."""
    picked = [rows[int(np.argmax(rows @ rows.sum(axis=0)))]]
    while len(picked) < min(k, len(rows)):
        near = np.max(rows @ np.array(picked).T, axis=1)
        if near.min() > 1 - 1e-6:
            break
        # The row at the lowest twentieth rather than the farthest, which may be an odd one.
        picked.append(rows[int(np.argsort(near, kind="stable")[len(rows) // 20])])
    centroids = np.array(picked)
    for _ in range(rounds):
        own = np.argmax(rows @ centroids.T, axis=1)
        fresh = np.array([rows[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        fresh /= np.maximum(np.linalg.norm(fresh, axis=1, keepdims=True), 1e-12)
        if np.allclose(fresh, centroids, atol=1e-6):
            break
        centroids = fresh
    cosines = rows @ centroids.T
    return centroids, cosines


class Model:
    """Centroids with their languages and usual cosines; plain arrays, bounded by the languages."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], usual: np.ndarray):
        self.idf, self.centroids, self.langs, self.usual = idf, centroids.astype(np.float32), langs, usual

    def parts(self) -> tuple:
        """What the model is made of, to be sent to tasks."""
        return self.idf, self.centroids, self.langs, self.usual

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (cosine) and whether it is rejected, of each text."""
        langs, scores, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        for at in range(0, len(texts), ROWS):
            found = [counts_of(x) for x in texts[at : at + ROWS]]
            have = [i for i, c in enumerate(found) if c is not None]
            names = [UNKNOWN] * len(found)
            if have and self.langs:
                counts = np.array([found[i] for i in have])
                cosines = scaled(counts, self.idf) @ self.centroids.T
                best = np.argmax(cosines, axis=1)
                top = np.clip(cosines[np.arange(len(have)), best], 0, 1).astype(np.float64)
                grams = counts.sum(axis=1)
                floor = REJECT * self.usual[best] * np.sqrt(np.minimum(1, grams / SHORT))
                for row, i in enumerate(have):
                    names[i] = self.langs[best[row]]
                    scores[at + i], rejected[at + i] = top[row], top[row] < floor[row]
            langs += names
        return langs, scores, rejected


def held_out(id_col: str) -> F.Column:
    """Documents kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Centroids from at most `sample` labelled texts of each language."""
    labelled = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
    labelled = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").withColumn("hash", F.xxhash64("text"))
    named = labelled.select("lang", "hash").distinct()
    # Hashes below a bound that some four times the sample pass, so that ranks are taken of few rows however large a language is.
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    bounds = [F.lit(x) for lang, n in sizes.items() if n > 8 * sample for x in (lang, int(-(2**63) + 2**64 * 4 * sample / n))]
    if bounds:
        named = named.where(F.coalesce(F.try_element_at(F.create_map(*bounds), F.col("lang")), F.lit(2**63 - 1)) > F.col("hash"))
    order = Window.partitionBy("lang").orderBy("hash")
    picked = named.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("lang", "hash")
    # At most `sample` hashes of each language; each text once, before it leaves its task.
    chosen = labelled.join(F.broadcast(picked), ["lang", "hash"], "left_semi").groupBy("lang", "hash").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, c) for i, x in enumerate(batch.column("text")) if (c := counts_of(x.as_py())) is not None]
            rows = pa.array([c.astype(np.float32).tobytes() for _, c in found], pa.binary())
            hashes, langs = (batch.column(name).take(pa.array([i for i, _ in found], pa.int32())) for name in ("hash", "lang"))
            yield pa.RecordBatch.from_arrays([hashes, langs, rows], ["hash", "lang", "counts"])

    rows = cut(chosen.mapInArrow(thrifty(vectors), "hash long, lang string, counts binary"))

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        pdf = pdf.sort_values("hash", kind="stable")
        return np.frombuffer(b"".join(pdf["counts"]), np.float32).reshape(-1, DIMS)

    def seen(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "n": [len(pdf)], "seen": [(matrix(pdf) > 0).sum(axis=0).astype(np.int64).tobytes()]})

    by_lang = rows.groupBy("lang").applyInPandas(seen, "lang string, n long, seen binary").collect()
    total = sum(r["n"] for r in by_lang)
    if not total:
        return Model(np.ones(DIMS), np.zeros((0, DIMS)), [], np.zeros(0))
    frequency = np.sum([np.frombuffer(r["seen"], np.int64) for r in by_lang], axis=0)
    idf = np.log((1 + total) / (1 + frequency)) + 1

    def centroids(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found, cosines = cluster(scaled(matrix(pdf), idf))
        own, top = np.argmax(cosines, axis=1), np.max(cosines, axis=1)
        usual = [float(np.median(top[own == c])) if (own == c).any() else float(np.median(top)) for c in range(len(found))]
        return pd.DataFrame({"lang": key[0], "k": range(len(found)), "usual": usual, "centroid": [c.astype(np.float32).tobytes() for c in found]})

    parts = rows.groupBy("lang").applyInPandas(centroids, "lang string, k int, usual double, centroid binary").collect()
    parts = sorted(parts, key=lambda r: (r["lang"], r["k"]))
    return Model(idf, np.array([np.frombuffer(r["centroid"], np.float32) for r in parts]), [r["lang"] for r in parts], np.array([r["usual"] for r in parts]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            for few in slices(batch, batch.column(1)):
                langs, scores, rejected = own.predict(few.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], [id_col, "lang_pred", "score", "rejected"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(thrifty(run), schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is rejected; columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            for few in slices(batch, batch.column("_text")):
                _, _, rejected = own.predict(few.column("_text").to_pylist())
                yield few.filter(pa.array(~rejected))

    return packed.mapInArrow(thrifty(run), packed.schema).select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(F.col(f"`{id_col}`"), held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")


def brute_force(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of texts, n-gram by n-gram and centroid by centroid; for tests."""
    out = []
    for text in texts:
        folded = (text or "").lower().encode().translate(_FOLD).split()
        if not any(c.isalpha() for c in text or ""):
            out.append((UNKNOWN, 0.0))
            continue
        data = b" " + b" ".join(folded) + b" "
        counts: dict[int, int] = {}
        for size, mark in ((2, 0), (3, 1 << 31)):
            for at in range(len(data) - size + 1):
                place = (int.from_bytes(data[at : at + size], "big") | mark) * 2654435761 % (1 << 32) >> 21
                counts[place] = counts.get(place, 0) + 1
        weights = {place: n**0.5 * float(model.idf[place]) for place, n in counts.items()}
        length = sum(w * w for w in weights.values()) ** 0.5
        scores = [sum(w * float(c[place]) for place, w in weights.items()) / length for c in model.centroids]
        best = max(range(len(scores)), key=lambda k: (scores[k], -k))
        out.append((model.langs[best], min(1.0, max(0.0, scores[best]))))
    return out
