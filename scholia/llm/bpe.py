"""BPE encoding and decoding by tree concatenation, exact to the tokenizers library.

A long text is a tree: it is halved, wherever its middle falls, until no part is
longer than `part`; the parts are encoded by different tasks and joined again in
the order of the tree. At a join a window around it is encoded again, with more
and more text on either side, until it gives tokens of both sides at their own
places; what lies between replaces the edges. White space ends every piece of the
supported files, so a join concerns the run that the cut goes through, and a run
too long for one call is a tree of its own. Short texts are encoded where they
are read, many at a time, and a task keeps what it has encoded of frequent runs.

Why agreement is enough: a BPE sequence is the encoding of its text if every two
neighbours are, and each pair of neighbours in the result comes from one of the
three encodings. Windows are cut from composed (NFC) text, any piece of which is
composed too; they start at no apostrophe, so that pieces fall as in the whole
text, and reach farther than any special token is long. Three tokens in a row
must agree on either side. Parts are cut where composition does not reach across.

Decoding looks ids up and joins the tokens as the library does, special tokens
included.

Other kinds of tokenizer files (byte-level ones, or with other normalizers) cut
pieces at other places and are refused with UnsupportedTokenizer.

Defined results: null is the empty text, which has no ids and decodes to the
empty text; a text of any length is encoded whole; repeated rows give repeated
results; an empty table gives no rows; other columns, whatever their names, are
not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.batches import thrifty

#: Characters of a text that one task encodes; longer texts are spread as parts.
PART = 1 << 13
#: Characters of a run without white space that one call encodes.
LEAF = 1 << 12
#: First window on either side of a join; it doubles until both sides agree.
WINDOW = 64
#: Encoded runs a task keeps, in two generations of half as many, and words, of which runs are made; memory, not results, depends on it.
MEMO, WORDS = 200_000, 400_000
#: Letters of a word, and marks, that are kept.
LETTERS, MARKS = 64, 8
#: Characters of texts encoded together, and runs in one call.
TOGETHER, RUNS = 2 << 20, 200

#: A stretch of a run that a cut goes through: its composed text, ids and spans.
Open = tuple[str, np.ndarray, np.ndarray]

_SPACE = re.compile(r"[ \t\n\r]+")
#: White space that not every library counts as such; texts with it are split at the four sure ones alone.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Runs that are two pieces at most, Latin letters in composed form and then marks: what normalizer and pre-tokenizer do to them is known.
_LETTER_RUN, _MARK_RUN = "[A-Za-zÀ-ÖØ-öø-ÿ]*", r"[!-&(-/:-@\[-`{-~]*"
_PLAIN = re.compile(f"({_LETTER_RUN})({_MARK_RUN})")
_PLAIN_PARTS = f"^(?P<word>{_LETTER_RUN})(?P<marks>{_MARK_RUN})$"
#: Bytes as the characters that stand for them in byte-level files: printable ones for themselves, the others from 256 on in order.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}

# The parts of a tokenizer file for which runs between white space can be encoded apart.
SUPPORTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}


class UnsupportedTokenizer(ValueError):
    """A tokenizer file whose pieces may reach across white space."""


def read_spec(path: str) -> dict:
    """The tokenizer file, if its texts can be encoded run by run."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    wrong = [name for name, value in SUPPORTED.items() if spec.get(name) != value]
    model = spec.get("model", {})
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        wrong.append("model")
    added = spec.get("added_tokens", [])
    # Plain runs are not searched for added tokens.
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) or _PLAIN.fullmatch(t["content"]) for t in added):
        wrong.append("added_tokens")
    if wrong:
        raise UnsupportedTokenizer(f"{path}: {', '.join(wrong)} of another kind than this encoder splits texts for")
    return spec


class Codec:
    """Encoder and decoder for one tokenizer file; made once in a task."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        spec = read_spec(path)
        self.leaf, self.window = leaf, window
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = np.array([self.tokenizer.id_to_token(i) or "" for i in range(size)], object)
        self.added = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")" if self.added else "(?!)")
        self.compose = normalizers.NFC().normalize_str
        self.tokenize = self.tokenizer.model.tokenize
        self.marks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.joins = 0

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0][0]

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, int]]:
        """Ids of every text, and joins made for its long runs."""
        split = [runs_of(text) for text in texts]
        tall = self._learn({run for runs in split for run in runs})
        if not tall:
            return [(b"".join(map(self.memo.__getitem__, runs)), 0) for runs in split]
        pieces = [[tall[r] if r in tall else (self.memo[r], 0) for r in runs] for runs in split]
        return [(b"".join([data for data, _ in found]), sum(joins for _, joins in found)) for found in pieces]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, where each text's end, and the joins made for each.

        Every different run is looked at once; its ids are then copied to all its places.
        """
        if pc.any(pc.match_substring_regex(texts, _ODD_SPACE.pattern)).as_py():
            found = self.encode_all(texts.to_pylist())
            counts = np.array([len(data) // 4 for data, _ in found], np.int64)
            return np.frombuffer(b"".join(data for data, _ in found), "<u4"), np.cumsum(counts), np.array([joins for _, joins in found], np.int64)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        flat, sizes, joins_of = self._encode_runs_apart(coded.dictionary)
        place = coded.indices.to_numpy()
        counts = sizes[place]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = gather(flat, (np.cumsum(sizes) - sizes)[place], counts)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        joins = np.zeros(len(texts), np.int64)
        if joins_of.any():
            each = np.concatenate([[0], np.cumsum(joins_of[place])])
            joins = each[bounds[1:]] - each[bounds[:-1]]
        return ids, ends[bounds[1:]], joins

    def _encode_runs_apart(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different runs one after the other, the number of each, and the joins made for each.

        Plain runs are a word and marks, each different one of which is encoded once; others go to _learn().
        """
        parts = pc.extract_regex(runs, _PLAIN_PARTS)
        plain = pc.and_(parts.is_valid(), pc.less_equal(pc.utf8_length(runs), self.leaf)).to_numpy(zero_copy_only=False)
        words, marks = (parts.field(n).filter(pa.array(plain)).dictionary_encode() for n in (0, 1))
        others = runs.filter(pa.array(~plain)).to_pylist()
        tall = self._learn(set(others))
        if len(self.words) > WORDS:
            self.words.clear()
        heads = [self._known(self.words, word, LETTERS) for word in pc.utf8_lower(words.dictionary).to_pylist()]
        tails = [self._known(self.marks, mark, MARKS) for mark in marks.dictionary.to_pylist()]
        rest = [tall[r][0] if r in tall else self.memo[r] for r in others]
        pieces = [*heads, *tails, *rest]
        flat = np.frombuffer(b"".join(pieces), "<u4")
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        starts = np.cumsum(sizes) - sizes
        # A run is a head and a tail, or one of the rest and nothing.
        first, second = np.zeros(len(runs), np.int64), np.full(len(runs), -1)
        first[plain], second[plain] = words.indices.to_numpy(), len(heads) + marks.indices.to_numpy()
        first[~plain] = len(heads) + len(tails) + np.arange(len(others))
        both = np.stack([first, second], 1).ravel()
        counts = np.where(both < 0, 0, sizes[both])
        joins = np.zeros(len(runs), np.int64)
        joins[~plain] = [tall[r][1] if r in tall else 0 for r in others]
        return gather(flat, starts[both], counts), counts.reshape(-1, 2).sum(axis=1), joins

    def _known(self, held: dict[str, bytes], piece: str, most: int) -> bytes:
        """Ids of lower-cased letters or of marks, which are kept where they are short enough."""
        if (data := held.get(piece)) is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
            data = array("I", [t.id for t in self.tokenize(shown)] if piece else []).tobytes()
            if len(piece) < most:
                held[piece] = data
        return data

    def _learn(self, runs: set[str]) -> dict[str, tuple[bytes, int]]:
        """Have every run in the memo, but for those too long for one call, which are returned with their ids and joins."""
        memo, older = self.memo, self.older
        missing = [r for r in runs if r not in memo]
        if len(memo) + len(missing) > MEMO // 2:
            # What these texts need stays; what earlier ones needed goes on as the older generation.
            self.older, self.memo = older, memo = memo, {r: memo[r] for r in runs if r in memo}
        short, tall = [], {}
        for run in missing:
            if (known := older.get(run)) is not None:
                memo[run] = known
            elif len(run) > self.leaf:
                before = self.joins
                tall[run] = (self.open(run)[1].tobytes(), self.joins - before)
            elif (plain := _PLAIN.fullmatch(run)) is not None:
                # At most two pieces, which go to the model without a search for them.
                memo[run] = self._known(self.words, plain[1].lower(), LETTERS) + self._known(self.marks, plain[2], MARKS)
            else:
                short.append(run)
        for at in range(0, len(short), RUNS):
            few = short[at : at + RUNS]
            memo.update(zip(few, self._encode_runs(few), strict=True))
        return tall

    def _encode_runs(self, runs: list[str]) -> Iterator[bytes]:
        """Ids of each run, all runs in one call: white space between them ends pieces, and spans say whose a token is."""
        ids, spans = self.spans(" ".join(runs))
        ends = np.cumsum([len(r) + 1 for r in runs])
        cuts = [0, *np.searchsorted(spans[:, 0], ends).tolist()]
        data = ids.tobytes()
        return (data[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a short text and where each begins and ends in it."""
        got = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(got.ids, "<u4"), np.array(got.offsets, np.int64).reshape(-1, 2)

    def open(self, run: str) -> Open:
        """A run of any length as composed text with its ids and spans.

        Special tokens stand on their own and part what is around them.
        """
        texts, ids, spans, at = [], [], [], 0
        for piece in self.special.split(run):
            if piece in self.added:
                got = (np.array([self.added[piece]], "<u4"), np.array([[0, len(piece)]], np.int64))
            else:
                piece = self.compose(piece)
                got = self.tree(piece)
            texts.append(piece)
            ids.append(got[0])
            spans.append(got[1] + at)
            at += len(piece)
        return "".join(texts), np.concatenate(ids), np.concatenate(spans)

    def tree(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and spans of composed text of any length: its halves, joined."""
        if len(text) <= self.leaf:
            return self.spans(text)
        at = len(text) // 2
        left, right = self.tree(text[:at]), self.tree(text[at:])
        return self.join(text, at, left, (right[0], right[1] + at))

    def join(self, text: str, at: int, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and spans of text from those of text[:at] and text[at:].

        Spans count from the start of text. The window doubles until tokens of
        both sides come out again, at the worst over the whole text.
        """
        wide = self.window
        self.joins += 1
        while True:
            lo, hi = start_before(text, at - wide), min(len(text), at + wide)
            ids, spans = self.spans(text[lo:hi])
            spans = spans + lo
            a = _common(left, (ids, spans), at - wide // 2, True) if lo else (-1, -1)
            b = _common(right, (ids, spans), at + wide // 2, False) if hi < len(text) else (len(right[0]), len(ids))
            if a is not None and b is not None and a[1] < b[1]:
                parts = [(left[0][: a[0] + 1], left[1][: a[0] + 1]), (ids[a[1] + 1 : b[1]], spans[a[1] + 1 : b[1]]), (right[0][b[0] :], right[1][b[0] :])]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            wide *= 2

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode(ids, skip_special_tokens=False): without a decoder, tokens joined by one space."""
        return " ".join(self.tokens[ids].tolist())


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    ends = np.cumsum(counts)
    kind = np.int32 if max(len(flat), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=kind)
    at += np.repeat((starts - (ends - counts)).astype(kind), counts)
    return flat[at]


def runs_of(text: str | None) -> list[str]:
    """Runs of a text without white space, none of them empty."""
    if not text:
        return []
    return text.split() if _ODD_SPACE.search(text) is None else [r for r in _SPACE.split(text) if r]


def slices(batch: pa.RecordBatch, size: int, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with about `size` characters of text together."""
    ends = np.cumsum(pc.utf8_length(batch.column(text)).to_numpy())
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _common(side: tuple[np.ndarray, np.ndarray], window: tuple[np.ndarray, np.ndarray], limit: int, before: bool) -> tuple[int, int] | None:
    """Places of a token that a side and the window share at the same characters.

    before: the last one that ends by `limit`, with the two tokens before it
    shared too; else the first one that starts from `limit`, with the two after.
    """
    theirs = {(int(i), int(a), int(b)): k for k, (i, (a, b)) in enumerate(zip(window[0], window[1].tolist(), strict=True))}
    if before:
        k = int(np.searchsorted(side[1][:, 1], limit, side="right")) - 1
        steps, chain = range(k, max(-1, k - len(theirs)), -1), (0, -1, -2)
    else:
        k = int(np.searchsorted(side[1][:, 0], limit, side="left"))
        steps, chain = range(k, min(len(side[0]), k + len(theirs))), (0, 1, 2)
    for k in steps:
        places = []
        for step in chain:
            if not 0 <= k + step < len(side[0]):
                places = [None]
                break
            places.append(theirs.get((int(side[0][k + step]), *map(int, side[1][k + step]))))
        if None not in places and all(p == places[0] + s for p, s in zip(places, chain, strict=True)):
            return k, places[0]
    return None


def cut_near(text: str, at: int) -> int:
    """A place from `at` on where the text's composed form can be cut, or its length."""
    while 0 < at < len(text):
        around, mid = text[max(0, at - 32) : at + 32], min(at, 32)
        pieces = unicodedata.normalize("NFC", around[:mid]) + unicodedata.normalize("NFC", around[mid:])
        if not unicodedata.combining(text[at]) and pieces == unicodedata.normalize("NFC", around):
            return at
        at += 1
    return at


def start_before(text: str, at: int) -> int:
    """The last place by `at` where a window may start, which is no apostrophe."""
    while at > 0 and text[at] == "'":
        at -= 1
    return max(0, at)


def parts_of(text: str, size: int = PART) -> Iterator[tuple[str, bool]]:
    """The leaves of a text's tree of halves, of at most about `size` characters, and whether the cut at the end goes through a run."""
    stack = [(0, len(text))]
    while stack:
        lo, hi = stack.pop()
        mid = cut_near(text, (lo + hi) // 2) if hi - lo > size else hi
        if mid < hi:
            stack += [(mid, hi), (lo, mid)]
        elif lo < hi:
            yield text[lo:hi], hi < len(text) and text[hi - 1] not in " \t\n\r" and text[hi] not in " \t\n\r"


def encode_part(codec: Codec, text: str, open_left: bool, open_right: bool) -> tuple[Open | None, bytes, Open | None]:
    """The open stretch at the left, ids of the runs between, the open stretch at the right.

    A part that is one run open at both sides is the left stretch alone.
    """
    head = tail = None
    if open_left:
        found = _SPACE.search(text)
        end = found.start() if found else len(text)
        head, text, open_right = codec.open(text[:end]), text[end:], open_right and found is not None
    if open_right:
        start = max(text.rfind(c) for c in " \t\n\r") + 1
        text, tail = text[:start], codec.open(text[start:])
    return head, codec.encode(text), tail


def join_all(codec: Codec, stretches: list[Open]) -> Open:
    """Neighbouring stretches as one, joined pairwise in a tree."""
    if len(stretches) == 1:
        return stretches[0]
    half = len(stretches) // 2
    left, right = join_all(codec, stretches[:half]), join_all(codec, stretches[half:])
    text, at = left[0] + right[0], len(left[0])
    return (text, *codec.join(text, at, left[1:], (right[1], right[2] + at)))


def combine(codec: Codec, parts: list[tuple[Open | None, bytes, Open | None]]) -> bytes:
    """Ids of a whole text from those of its parts in order."""
    out: list[bytes] = []
    pending: list[Open] = []
    for k, (head, body, tail) in enumerate(parts):
        if head is not None:
            pending.append(head)
            through = not body and tail is None and k + 1 < len(parts) and parts[k + 1][0] is not None
            if through:
                continue
            out.append(join_all(codec, pending)[1].tobytes())
            pending = []
        out.append(body)
        if tail is not None:
            pending = [tail]
    if pending:
        out.append(join_all(codec, pending)[1].tobytes())
    return b"".join(out)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", part: int = PART, digests: bool = True, ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256, decoded_sha256, joins.

    joins: how many windows put the text's parts and long runs together. Without
    digests nothing is decoded and the digests are null; without ids these are null
    and stay in the tasks that made them.
    """
    read_spec(path)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL("n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string, joins int").fields])
    name = f"`{id_col}`"
    texts = docs.select(F.col(name).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > part

    def row(codec: Codec, data: bytes, joins: int) -> tuple[int, bytes | None, str | None, str | None, int]:
        kept = data if ids else None
        if not digests:
            return len(data) // 4, kept, None, None, joins
        decoded = codec.decode(np.frombuffer(data, "<u4"))
        return len(data) // 4, kept, hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), joins

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int32())
        for batch in batches:
            codec = codec or Codec(path)
            for few in slices(batch, TOGETHER):
                found, ends, joins = codec.encode_column(few.column(1))
                rows = [row(codec, found[a:b].tobytes(), n) for a, b, n in zip([0, *ends[:-1].tolist()], ends.tolist(), joins.tolist(), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([few.column(0), *columns], schema.fieldNames())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0), (x.as_py() for x in batch.column(1)), strict=True):
                name = hashlib.blake2b(text.encode(), digest_size=16).digest()
                before = False
                for k, (piece, after) in enumerate(parts_of(text, part)):
                    values = [doc.as_py(), name, k, piece, before, after]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, [batch.schema.field(0), *_PARTS], strict=True)], ["id", *[f.name for f in _PARTS]])
                    before = after

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(path)
            for few in slices(batch, TOGETHER, 3):
                got, joins = [], []
                for r in few.select(["part", "before", "after"]).to_pylist():
                    before = codec.joins
                    got.append(encode_part(codec, r["part"], r["before"], r["after"]))
                    joins.append(codec.joins - before)
                columns = [pa.array([_pack(head) for head, _, _ in got], _OPEN), pa.array([body for _, body, _ in got], pa.binary()), pa.array([_pack(tail) for _, _, tail in got], _OPEN), pa.array(joins, pa.int32())]
                yield pa.RecordBatch.from_arrays([few.column("id"), few.column("name"), few.column("k"), *columns], ["id", "name", "k", "head", "body", "tail", "joins"])

    made: list[Codec] = []

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        if not made:  # one for all groups of a task
            made.append(Codec(path))
        codec = made[0]
        copies = int((pdf["k"] == 0).sum())
        pdf = pdf.sort_values("k").drop_duplicates("k")
        before = codec.joins
        data = combine(codec, [(_unpack(h), b, _unpack(t)) for h, b, t in zip(pdf["head"], pdf["body"], pdf["tail"], strict=True)])
        values = row(codec, data, int(pdf["joins"].sum()) + codec.joins - before)
        out = pd.DataFrame([values], columns=schema.fieldNames()[1:])
        out.insert(0, id_col, pdf["id"].iloc[:1].to_numpy())
        return out.loc[out.index.repeat(copies)]

    id_field = T.StructField("id", kind)
    parts = texts.where(long).mapInArrow(thrifty(spread), T.StructType([id_field, *T.StructType.fromDDL("name binary, k int, part string, before boolean, after boolean").fields]))
    stretch = "struct<text:string,ids:binary,spans:binary>"
    coded = parts.repartition("id", "name", "k").mapInArrow(thrifty(each), T.StructType([id_field, *T.StructType.fromDDL(f"name binary, k int, head {stretch}, body binary, tail {stretch}, joins int").fields]))
    joined = coded.groupBy("id", "name").applyInPandas(gather, schema)
    return texts.where(~long).mapInArrow(thrifty(whole), schema).unionByName(joined)


_PARTS = [pa.field("name", pa.binary()), pa.field("k", pa.int32()), pa.field("part", pa.string()), pa.field("before", pa.bool_()), pa.field("after", pa.bool_())]
_OPEN = pa.struct([("text", pa.string()), ("ids", pa.binary()), ("spans", pa.binary())])


def _pack(stretch: Open | None) -> dict | None:
    return stretch and {"text": stretch[0], "ids": stretch[1].tobytes(), "spans": stretch[2].astype(np.int64).tobytes()}


def _unpack(stretch: dict | None) -> Open | None:
    return stretch and (stretch["text"], np.frombuffer(stretch["ids"], "<u4"), np.frombuffer(stretch["spans"], np.int64).reshape(-1, 2))


def vocabulary(path: str) -> int:
    """One more than the greatest id of a tokenizer file."""
    from tokenizers import Tokenizer

    return 1 + max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """encode() without the ids; joins say how many windows put a text together."""
    return found.select(id_col, "n_tokens", "ids_sha256", "decoded_sha256", "joins")
