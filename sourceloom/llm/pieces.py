"""SentencePiece encoding and decoding (BPE models) by suffix-array matching.

The new segments of a batch are laid one after the other and indexed by a suffix array (to
the depth of the longest piece). Every piece is looked up in it by binary search; the range
found holds all its occurrences, and each is an edge from its start to its end. Edges are
sorted by the place of their end and relaxed in that order: the last token of the encoding
of a prefix is the piece whose edge starts where the encoding of a shorter prefix ends with
a token it is compatible with. Two tokens are compatible if the merges of their joined text
give just these two; an encoding is right exactly if all its neighbours are compatible, so
each prefix has exactly one such edge and the result is the model's own encoding.

A segment is a run of spaces with what follows it up to the next space. No piece reaches
over its edges, so segments are encoded once per batch and reused. Characters that no longer
piece contains are segments of their own; without a piece they fall back to bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_format

from sourceloom.llm.words import BASE, CHUNK, INVERSE, LONG_WORD, mix, powers, slices, text_bytes

SPACE = 0x2581
NORMAL, CONTROL, BYTE = 1, 3, 6
KNOWN_SEGMENTS = 300_000
KNOWN_PAIRS = 1_000_000
ENCODE_BYTES = 2 << 20
DECODE_IDS = 100_000


def code_points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.int32)


@dataclass
class Vocabulary:
    """Pieces of a BPE model with identity normalisation, a dummy prefix and byte fallback.

    Tokens are piece ids; a character without a piece is ``len(pieces) + its code point``."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    ids: dict[str, int] = field(init=False)
    bytes_: np.ndarray = field(init=False)

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes_ = np.zeros(256, np.int64)
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                self.bytes_[int(p[1:-1], 16)] = i
        self.longest = max(map(len, self.ids))
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        self.normal = np.array(list(self.ids.values()), np.int64)
        self.symbols = np.full((len(self.ids), self.longest), -1, np.int64)
        for row, piece in zip(self.symbols, self.ids, strict=True):
            row[: len(piece)] = [ord(c) for c in piece]
        # By code point: whether it stands in a piece with others, and whether it is a piece.
        self.merging, self.single = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
        self.merging[code_points("".join(p for p in self.ids if len(p) > 1).encode())] = True
        self.single[[ord(p) for p in self.ids if len(p) == 1]] = True
        # Decoding: the bytes of each piece, one after the other.
        said = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k != NORMAL else p.replace(chr(SPACE), " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.said, self.said_at = np.frombuffer(b"".join(said), np.uint8), np.cumsum([0, *map(len, said)])
        self.pairs, self.agree = np.empty(0, np.int64), np.empty(0, bool)
        self.encoder = Encoder(self)

    def text(self, token: int) -> str:
        return self.pieces[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def merge(self, text: str) -> list[str]:
        """The model's merges: best score first, of equal ones the leftmost."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (joined := parts[a] + parts[b]) in self.ids:
                heapq.heappush(queue, (-self.scores[self.ids[joined]], a, b, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether ``right`` can follow ``left`` (-1: the segment's start)."""
        keys = (left.astype(np.int64) + 1) * (1 << 22) + right
        wanted = np.unique(keys)
        at = np.searchsorted(self.pairs, wanted)
        new = wanted[(at == len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != wanted)] if len(self.pairs) else wanted
        if len(new):
            said = []
            for key in new.tolist():
                a, b = (key >> 22) - 1, key & ((1 << 22) - 1)
                whole = [self.text(b)] if a < 0 else [self.text(a), self.text(b)]
                said.append(self.merge("".join(whole)) == whole)
            if len(self.pairs) > KNOWN_PAIRS:
                self.pairs, self.agree = np.empty(0, np.int64), np.empty(0, bool)
                return self.compatible(left, right)
            pairs = np.concatenate([self.pairs, new])
            order = np.argsort(pairs)
            self.pairs, self.agree = pairs[order], np.concatenate([self.agree, np.array(said, bool)])[order]
        return self.agree[np.searchsorted(self.pairs, keys)]


_vocabularies: dict[int, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a model file's bytes; made once per process."""
    if hash(model) not in _vocabularies:
        proto = model_format.ModelProto()
        proto.ParseFromString(model)
        plain = proto.trainer_spec.model_type == 2 and proto.normalizer_spec.name == "identity" and proto.normalizer_spec.add_dummy_prefix
        if not plain or proto.normalizer_spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with identity normalisation, dummy prefix and byte fallback is due")
        made = Vocabulary([p.piece for p in proto.pieces], [p.type for p in proto.pieces], [p.score for p in proto.pieces])
        if any(chr(SPACE) in p.lstrip(chr(SPACE)) for p in made.ids):
            raise ValueError("pieces with inner spaces are not supported")
        _vocabularies[hash(model)] = made
    return _vocabularies[hash(model)]


class SuffixArray:
    """Suffixes of an integer text, sorted by their first ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        self.symbols, ranks = np.unique(text, return_inverse=True)
        self.bits = max(1, int(len(self.symbols) + 1).bit_length())
        self.per = 63 // self.bits
        ranks = np.concatenate([ranks.astype(np.int64) + 1, np.zeros(depth + self.per, np.int64)])
        keys = []
        for first in range(0, depth, self.per):
            key = np.zeros(len(text), np.int64)
            for i in range(first, first + self.per):
                key = (key << self.bits) | (ranks[i : i + len(text)] if i < depth else 0)
            keys.append(key)
        self.order = np.lexsort(keys[::-1])
        self.keys = [k[self.order] for k in keys]

    def find(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the suffixes that start with each pattern (a row of symbols, filled up
        with -1), by binary search, ``per`` symbols at a time."""
        low, high = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        at = np.minimum(np.searchsorted(self.symbols, patterns), len(self.symbols) - 1)
        there = np.flatnonzero(((self.symbols[at] == patterns) | (patterns < 0)).all(axis=1))
        ranks, size = np.where(patterns[there] < 0, 0, at[there] + 1), length[there]
        last = (1 << self.bits) - 1
        ends = []
        for fill in (0, last):
            filled = np.where(np.arange(ranks.shape[1]) < size[:, None], ranks, fill)
            packed = []
            for first in range(0, ranks.shape[1], self.per):
                key = np.zeros(len(there), np.int64)
                for i in range(first, first + self.per):
                    key = (key << self.bits) | (filled[:, i] if i < ranks.shape[1] else fill * (fill > 0))
                packed.append(key)
            ends.append(packed)
        low[there] = np.searchsorted(self.keys[0], ends[0][0], "left")
        high[there] = np.searchsorted(self.keys[0], ends[1][0], "right")
        for k in range(1, len(self.keys)):
            for i in np.flatnonzero((size > k * self.per) & (low[there] < high[there])).tolist():
                p = there[i]
                own = self.keys[k][low[p] : high[p]]
                a, b = np.searchsorted(own, ends[0][k][i], "left"), np.searchsorted(own, ends[1][k][i], "right")
                low[p], high[p] = low[p] + a, low[p] + b
        return low, high


def encode_segments(text: np.ndarray, begins: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the segments of ``text`` that start at ``begins`` (the last entry is the
    end): all tokens in order, and where each segment's begin."""
    index = SuffixArray(text, vocab.longest)
    low, high = index.find(vocab.symbols, vocab.length[vocab.normal])
    n = high - low
    token = np.repeat(vocab.normal.astype(np.int32), n)
    start = index.order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    alone = np.flatnonzero(~vocab.single[text])
    token, start = np.concatenate([token, text[alone] + np.int32(len(vocab.pieces))]), np.concatenate([start, alone]).astype(np.int32)
    end = start + np.where(token < len(vocab.pieces), vocab.length[np.minimum(token, len(vocab.pieces) - 1)].astype(np.int32), np.int32(1))
    segment = np.searchsorted(begins, start, "right") - 1
    inside = end <= begins[segment + 1]
    token, start, end, segment = token[inside], start[inside], end[inside], segment[inside]
    place = (end - begins[segment]).astype(np.int32)
    at_start = start == begins[segment]
    del inside, segment
    order = np.argsort(place, kind="stable")
    token, start, end, place, at_start = token[order], start[order], end[order], place[order], at_start[order]
    del order
    last = np.full(len(text) + 1, -1, np.int64)  # last token of the encoding that ends here
    bounds = np.flatnonzero(np.diff(place, prepend=0, append=np.iinfo(np.int32).max))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        before = np.where(at_start[a:b], -1, last[start[a:b]])
        good = np.flatnonzero((at_start[a:b] | (before >= 0)))
        good = good[vocab.compatible(before[good], token[a:b][good])]
        last[end[a:b][good]] = token[a:b][good]
    tokens, owners, at, own = [], [], begins[1:].copy(), np.arange(len(begins) - 1)
    while len(own):
        found = last[at]
        tokens.append(found)
        owners.append(own)
        at = at - np.where(found < len(vocab.pieces), vocab.length[np.minimum(found, len(vocab.pieces) - 1)], 1)
        more = at > begins[own]
        at, own = at[more], own[more]
    token, owner = np.concatenate(tokens[::-1]), np.concatenate(owners[::-1])
    order = np.argsort(owner, kind="stable")
    return as_ids(token[order], owner[order], len(begins) - 1, vocab)


def as_ids(token: np.ndarray, owner: np.ndarray, n: int, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Replace characters without a piece by their bytes."""
    point = token - len(vocab.pieces)
    size = np.where(point < 0x80, 1, np.where(point < 0x800, 2, np.where(point < 0x10000, 3, 4)))
    owner, ids = np.repeat(owner, size), np.repeat(token, size)
    k = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
    size, point = np.repeat(size, size), ids - len(vocab.pieces)
    shifted = np.where(point < 0, 0, point) >> (6 * (size - 1 - k))
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    byte = np.where(k == 0, shifted | lead, 0x80 | (shifted & 0x3F)) & 0xFF
    ids = np.where(point < 0, ids, vocab.bytes_[byte])
    return ids, np.searchsorted(owner, np.arange(n + 1))


class Encoder:
    """Encodes batches; segments seen lately are remembered, at most ``KNOWN_SEGMENTS``."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        self.hashes, self.flat, self.first = np.empty(0, np.uint64), np.empty(0, np.int32), np.zeros(1, np.int64)
        self.rank = np.empty(0, np.int64)  # of the hash in order -> number of the segment

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's begin."""
        data, offsets = text_bytes(column)
        docs = [code_points(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes = np.array([len(d) + (len(d) > 0) for d in docs], np.int64)
        ends = np.cumsum(sizes)
        text = np.full(int(ends[-1]) if len(ends) else 0, SPACE, np.int32)
        for d, e in zip(docs, ends.tolist(), strict=True):
            text[e - len(d) : e] = d
        text[text == 32] = SPACE
        if not len(text):
            return np.empty(0, np.int64), np.zeros(len(docs) + 1, np.int64)
        alone = ~self.vocab.merging[text]
        cut = np.ones(len(text), bool)
        cut[1:] = ((text[1:] == SPACE) & (text[:-1] != SPACE)) | alone[1:] | alone[:-1]
        heads = (ends - sizes)[sizes > 0]
        cut[heads] = True
        begins = np.append(np.flatnonzero(cut), len(text))
        number = self.numbers(text, begins)
        count = np.diff(self.first)[number]
        at = np.repeat(self.first[number], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        upto = np.concatenate([[0], np.cumsum(count)])
        return self.flat[at], upto[np.searchsorted(begins, np.concatenate([[0], ends]))]

    def numbers(self, text: np.ndarray, begins: np.ndarray) -> np.ndarray:
        hashes = segment_hashes(text, begins)
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > KNOWN_SEGMENTS:
            self.forget()
        at = np.searchsorted(self.hashes, unique)
        known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        new = where[~known]
        if len(new):
            size = begins[new + 1] - begins[new]
            own = np.concatenate([[0], np.cumsum(size)])
            laid = text[np.repeat(begins[new] - own[:-1], size) + np.arange(own[-1])]
            flat, first = encode_segments(laid, own, self.vocab)
            numbers = np.concatenate([self.rank, len(self.first) - 1 + np.arange(len(new))])
            hashes = np.concatenate([self.hashes, unique[~known]])
            order = np.argsort(hashes)
            self.hashes, self.rank = hashes[order], numbers[order]
            self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        return self.rank[np.searchsorted(self.hashes, unique)][back]


def segment_hashes(text: np.ndarray, begins: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(begins) - 1, np.uint64), 0
    while i < len(out):
        base = begins[i]
        j = max(i + 1, int(np.searchsorted(begins, base + CHUNK, "right")) - 1)
        n = int(begins[j] - base)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(text[base : base + n]) * powers(BASE, n), out=sums[1:])
        a, b = begins[i:j] - base, begins[i + 1 : j + 1] - base
        out[i:j] = mix((sums[b] - sums[a]) * powers(INVERSE, n)[a] + (b - a).astype(np.uint64))
        i = j
    for k in np.flatnonzero(np.diff(begins) > LONG_WORD).tolist():  # as in words.word_hashes
        out[k] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(text[begins[k] : begins[k + 1]]))
    return out


def decode(ids: np.ndarray, first: np.ndarray, vocab: Vocabulary) -> list[str]:
    """Texts of the id lists that start at ``first``; the dummy prefix goes again."""
    out, i = [], 0
    while i < len(first) - 1:  # some lists at a time, of about DECODE_IDS ids
        j = max(i + 1, int(np.searchsorted(first, first[i] + DECODE_IDS, "right")) - 1)
        own = ids[first[i] : first[j]]
        size = np.diff(vocab.said_at)[own]
        at = np.repeat(vocab.said_at[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        data = vocab.said[at].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[first[i : j + 1] - first[i]].tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            out.append(data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace"))
        i = j
    return out


def model_bytes(docs: DataFrame, model_file: str):
    """The model file, read by the driver and broadcast (a vocabulary is bounded)."""
    with open(model_file, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encoded(docs: DataFrame, model_file: str, back: bool = False) -> DataFrame:
    """Piece ids of each text, and with ``back`` the text they decode to (as ``decoded``).

    One row per input row (``doc_id``, ``text``): ``doc_id, text, ids``. Null and empty texts
    have no ids. Repeated rows are encoded alike. Other columns are left out, whatever their
    names. Bytes that are not UTF-8 count as U+FFFD.
    """
    held = model_bytes(docs, model_file)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(held.value)
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids, first = vocab.encoder.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
            columns, names = [batch.column("doc_id"), batch.column("text"), lists], ["doc_id", "text", "ids"]
            if back:
                columns, names = [*columns, pa.array(decode(ids, first, vocab), pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(encode, "doc_id bigint, text string, ids array<int>" + ", decoded string" * back)


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """The rows with ``decoded``, the text of their ``ids``. Null and empty lists give the
    empty text; a column of that name is replaced, all others stay."""
    held = model_bytes(rows, model_file)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(held.value)
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            texts = decode(ids, np.concatenate([[0], np.cumsum(sizes)]), vocab)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    plain = rows.drop("decoded")
    return plain.mapInArrow(read, T.StructType([*plain.schema.fields, T.StructField("decoded", T.StringType())]))
