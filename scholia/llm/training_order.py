"""Training-order materialisation: a keyed permutation of all sequences into fixed-stride shards.

Token ids are those of a tokenizer file, by op4's encoder in the task that reads a
text; or they come as arrays, or as little-endian binary of a stated width;
without any of these a text's ids are its bytes. The documents' ids, each followed
by an end mark (the first number past the vocabulary), are one stream, cut into
sequences of `length` tokens; the last one alone is padded, with end marks. A
document's place in the stream is the sum over the tasks and rows before it, in
the order in which documents are stored: one pass encodes, packs and numbers, the
packed ids are stored once with the number of their task and their place in it,
and only the tasks' sums, a row for each, are added up over the table.

Every sequence has an index from 0 without gaps; a keyed Feistel network over the
next power of four, walked until it falls below the number of sequences
(cycle-walking), maps the index to a slot. No sort of the order and no table of
it is needed, and the key alone gives the order again, in both directions.

Slots are written in shards of `records` records of equal stride: a record is
its number of tokens, then its ids, little-endian and of two bytes, or of four for
a vocabulary that needs them. Slot s is record s % records of shard s // records,
at byte (s % records) * stride of that shard's payload. Files hold ranges of
shards in order, and `lane` neighbouring shards have a number of their own, by
which a scan passes over files and row groups: a reader goes from lane to lane and
shard to shard from any slot on, without a sort of the table, and needs nothing
before that slot. The ids cross the network once.

Defined results: null and empty texts (or ids) add nothing; an id outside the
vocabulary, a null id and binary that ends inside an id are errors; repeated rows
are in the stream as often as in the table; a document of any length goes on over
as many sequences as it needs; an empty table gives no shard; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.batches import thrifty
from scholia.llm import bpe
from scholia.session import checkpoint_dir, stored

LENGTH, RECORDS, KEY = 2048, 1024, 2024
#: Shards of a lane: what a reader orders at a time.
LANE = 32
#: Ids of text bytes are the bytes. The end mark is the first number past the vocabulary.
BYTES = 256
ROUNDS = 4
#: Rows, and bytes of ids, handed on at a time.
ROWS, CHUNK = 512, 4 << 20


def _mix(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    """A keyed 64-bit hash of each number."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _feistel(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    """One pass through the network over 2 * bits bits."""
    mask, width = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> width, x & mask
    for turn in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        if back:
            left, right = right ^ (_mix(left, key, turn) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key, turn) & mask)
    return left << width | right


def permute(index: np.ndarray, total: int, key: int, back: bool = False) -> np.ndarray:
    """Slots of indexes below total, or with `back` indexes of slots."""
    bits = max(1, -(-(total - 1).bit_length() // 2))
    out = _feistel(np.asarray(index, np.uint64), bits, key, back)
    while (far := out >= np.uint64(total)).any():
        out[far] = _feistel(out[far], bits, key, back)
    return out.astype(np.int64)


def id_width(vocabulary: int) -> int:
    """Bytes of an id in a record: two if all ids and the end mark fit, else four."""
    return 2 if vocabulary < 1 << 16 else 4


def packed(ids: bytes | list | np.ndarray | None, width: int | None, vocabulary: int) -> bytes:
    """Ids in the width of a record; ValueError for what is no id."""
    if ids is None or not len(ids):
        return b""
    found = np.frombuffer(ids, f"<u{width}") if isinstance(ids, bytes) else np.asarray(ids)
    if found.dtype.kind not in "iu" or found.min() < 0 or found.max() >= vocabulary:
        raise ValueError(f"ids are not whole numbers from 0 to {vocabulary - 1}")
    return found.astype(f"<u{id_width(vocabulary)}").tobytes()


def _packed_column(column: pa.Array, width: int | None, vocabulary: int, codec: bpe.Codec | None) -> tuple[pa.Array, np.ndarray]:
    """Packed ids of every row of a column, and how many each has."""
    size = id_width(vocabulary)
    if codec is not None:
        ids, ends, _ = codec.encode_column(column)
        bounds = np.concatenate([[0], ends]) * size
        data = pa.py_buffer(ids.astype(f"<u{size}").tobytes())
        return pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), data]), np.diff(bounds) // size
    rows = [packed(x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) and x.is_valid else x.as_py(), width, vocabulary) for x in column]
    return pa.array(rows, pa.large_binary()), np.array([len(d) // size for d in rows], np.int64)


def streamed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int | None = None, vocabulary: int = BYTES, tokenizer: str | None = None) -> DataFrame:
    """id, task, first, n, data: packed ids of every document with any, its first place among its task's tokens, its tokens with the end mark. Stored.

    text_col has texts (encoded by the tokenizer file, or as bytes), arrays of ids, or binary ids of `width` bytes each.
    """
    kind = docs.schema[text_col].dataType
    column = F.col(f"`{text_col}`")
    if tokenizer is not None:
        bpe.read_spec(tokenizer)
        column = F.coalesce(column.cast("string"), F.lit(""))
    elif isinstance(kind, T.BinaryType):
        if width not in (1, 2, 4, 8):
            raise ValueError(f"binary ids of {width} bytes")
    elif not isinstance(kind, T.ArrayType):
        column, width = F.encode(column.cast("string"), "utf-8"), 1
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), column.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, codec = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            codec = codec or (bpe.Codec(tokenizer) if tokenizer is not None else None)
            for few in bpe.slices(batch, bpe.TOGETHER) if codec else (batch.slice(low, ROWS) for low in range(0, batch.num_rows, ROWS)):
                data, counts = _packed_column(few.column(1), width, vocabulary, codec)
                keep = np.flatnonzero(counts)
                counts = counts[keep] + 1
                firsts = at + np.concatenate([[0], np.cumsum(counts)])
                at = int(firsts[-1])
                some = pa.array(keep)
                found = [few.column(0).take(some), pa.array(np.full(len(keep), task, np.int32)), pa.array(firsts[:-1]), pa.array(counts), data.take(some).cast(pa.binary())]
                # Handed on a few at a time, as the reader on the other side holds a batch whole.
                whole = pa.RecordBatch.from_arrays(found, ["id", "task", "first", "n", "data"])
                yield from (whole.slice(low, ROWS) for low in range(0, whole.num_rows, ROWS))

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("task int, first long, n long, data binary").fields])
    path = f"{checkpoint_dir(docs.sparkSession)}/stream-{uuid.uuid4().hex}"
    rows.mapInArrow(thrifty(run), schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def offsets(stream: DataFrame) -> DataFrame:
    """task, offset, tokens: what lies before each task's tokens, and how many it has; a row for each task that had any."""
    sums = stream.groupBy("task").agg(F.sum("n").alias("tokens"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("task", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"), "tokens")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, records: int = RECORDS, key: int = KEY, lane: int = LANE, partitions: int | None = None, width: int | None = None, vocabulary: int = BYTES, tokenizer: str | None = None) -> DataFrame:
    """lane, shard, first_slot, n_records, n_tokens, stride, payload of every shard; text_col, width, vocabulary and tokenizer as for streamed()."""
    stream = streamed(docs, id_col, text_col, width, vocabulary, tokenizer)
    places = stored(offsets(stream))
    tokens = places.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    total, size = -(-tokens // length), id_width(vocabulary)
    count = max(1, -(-total // records))
    parts = max(1, min(count, partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    stride = 4 + size * length
    end = np.array([vocabulary], f"<u{size}").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, bytes]] = []
            held = 0
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = data.as_py() + end
                done = 0
                while done < len(whole):
                    index, at = divmod(first + done // size, length)
                    piece = whole[done : done + (length - at) * size]
                    rows.append((index, at, piece))
                    done += len(piece)
                    held += len(piece)
                    if held >= CHUNK or len(rows) >= ROWS:
                        yield _pieces(rows, total, key)
                        rows, held = [], 0
            if rows:
                yield _pieces(rows, total, key)

    # One row for each task of the scan.
    placed = stream.join(F.broadcast(places), "task").select((F.col("offset") + F.col("first")).alias("first"), "data")
    pieces = placed.mapInArrow(cut_up, "slot long, at int, tokens binary").withColumn("shard", F.floor(F.col("slot") / records).cast("int"))
    # Slots are 0..total-1 without gaps, so ranges of shards are known without a look at the data.
    ranged = pieces.repartitionById(parts, F.floor(F.col("shard").cast("long") * parts / count).cast("int")).sortWithinPartitions("slot", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, slots, held, filled = None, [], [], 0

        def close():
            """The record that is being filled, as part of the shard."""
            nonlocal held, filled
            data = b"".join(held)
            slots.append((len(data) // size).to_bytes(4, "little") + data + end * (length - len(data) // size))
            filled += len(data) // size
            held = []

        def flush():
            values = [shard // lane, shard, shard * records, len(slots), filled, stride, b"".join(slots)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _KINDS, strict=True)], _NAMES)

        at = None
        for batch in batches:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if slot != at:
                    if held:
                        close()
                    if slot // records != shard:
                        if slots:
                            yield flush()
                        shard, slots, filled = slot // records, [], 0
                    at = slot
                held.append(data.as_py())
        if held:
            close()
        if slots:
            yield flush()

    return ranged.select("slot", "tokens").mapInArrow(run, "lane int, shard int, first_slot long, n_records int, n_tokens long, stride int, payload binary")


def _pieces(rows: list[tuple[int, int, bytes]], total: int, key: int) -> pa.RecordBatch:
    slots = permute(np.array([r[0] for r in rows], np.int64), total, key)
    return pa.RecordBatch.from_arrays([pa.array(slots), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["slot", "at", "tokens"])


_NAMES = ["lane", "shard", "first_slot", "n_records", "n_tokens", "stride", "payload"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def write(docs: DataFrame, path: str, **options) -> None:
    """Write the shards as Parquet rows, in files of neighbouring shards in order."""
    shards(docs, **options).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, records: int = RECORDS, vocabulary: int = BYTES, lane: int = LANE) -> Iterator[tuple[int, bytes]]:
    """(slot, ids as in a record, of a text its bytes) from a slot on, lane by lane; what lies before is not read.

    The end marks between documents stay in, as the number past the vocabulary.
    """
    kind = f"<u{id_width(vocabulary)}"
    table = spark.read.parquet(path)
    last = table.agg(F.max("lane")).first()[0]
    for k in range(slot // records // lane, -1 if last is None else last + 1):
        # At most `lane` rows, of the files that have them.
        rows = table.where((F.col("lane") == k) & (F.col("shard") >= slot // records)).orderBy("shard")
        for row in rows.toLocalIterator():
            for n in range(row["n_records"]):
                here = row["first_slot"] + n
                if here >= slot:
                    raw = row["payload"][n * row["stride"] : (n + 1) * row["stride"]]
                    size = int.from_bytes(raw[:4], "little")
                    yield here, np.frombuffer(raw[4:], kind)[:size].tobytes()


def digest(found: DataFrame) -> DataFrame:
    """shards() with the payload's SHA-256 in its place."""
    return found.select("shard", "first_slot", "n_records", "n_tokens", "stride", F.sha2("payload", 256).alias("payload_sha256"))


def brute_force(docs: list[list[int]], length: int, records: int, key: int, vocabulary: int) -> dict[int, str]:
    """SHA-256 of every shard of documents in order, token by token and slot by slot; for tests."""
    stream = [t for ids in docs if ids for t in [*ids, vocabulary]]
    rows = [stream[at : at + length] for at in range(0, len(stream), length)]
    half = max(1, -(-(len(rows) - 1).bit_length() // 2))
    size, low, full = id_width(vocabulary), (1 << half) - 1, (1 << 64) - 1

    def mixed(x: int, turn: int) -> int:
        x ^= (key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & full
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    slots = {}
    for index, ids in enumerate(rows):
        at = index
        while True:
            left, right = at >> half, at & low
            for turn in range(ROUNDS):
                left, right = right, left ^ (mixed(right, turn) & low)
            at = left << half | right
            if at < len(rows):
                break
        filled = ids + [vocabulary] * (length - len(ids))
        slots[at] = len(ids).to_bytes(4, "little") + b"".join(t.to_bytes(size, "little") for t in filled)
    return {s: hashlib.sha256(b"".join(slots[k] for k in range(s * records, min(len(rows), (s + 1) * records)))).hexdigest() for s in range(-(-len(rows) // records))}
