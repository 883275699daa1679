"""Suffix-array dedup: removal of bytes covered by a string that also starts earlier.

Every window of ``length`` bytes has an anchor: of the ``GRAM``-byte strings in it, the one
with the smallest hash (the first of equal ones). Equal windows have equal anchors at equal
places, so they meet if text is dealt by anchors. Neighbouring windows with one anchor form
a fragment; only fragments whose anchor occurs again are looked at.

Equal fragments collapse first: all but the earliest are covered whole. Where different
fragments share an anchor, windows that no other fragment has are left aside, and a suffix
array over the distinct pieces that remain puts equal windows side by side, so that each
learns the earliest start of its class. Anchors are dealt to groups of
about ``GROUP_BYTES``; an anchor with more distinct text than that has its windows dealt
once more, by their own hash, so that no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.llm.shared import kept
from sourceloom.llm.suffixes import suffix_array
from sourceloom.llm.words import BASE, BYTE_VALUES, INVERSE, mix, powers, slices, text_bytes

LENGTH = 100
GRAM = 32
GROUP_BYTES = 1 << 20
SLICE = 1 << 20
TIE_BITS = 24

FRAGMENTS = "anchor bigint, digest bigint, doc bigint, place bigint, windows int"


def rolling(data: np.ndarray, size: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``size`` bytes from each start on (all starts, if none are given)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=sums[1:])
    if starts is None:
        return mix((sums[size:] - sums[:-size]) * powers(INVERSE, len(data))[: len(data) - size + 1])
    return mix((sums[starts + size] - sums[starts]) * powers(INVERSE, len(data))[starts])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :])


def fragments_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Fragments of one text: first window, number of windows, hash of anchor and of bytes."""
    gram = rolling(data, GRAM)
    marks = (gram & ~np.uint64((1 << 30) - 1)) | np.arange(len(gram), dtype=np.uint64)
    anchor = sliding_least(marks, length - GRAM + 1) & np.uint64((1 << 30) - 1)
    first = np.flatnonzero(np.diff(anchor.astype(np.int64), prepend=-1))
    count = np.diff(np.append(first, len(anchor)))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=sums[1:])
    end = first + count - 1 + length
    at = anchor[first].astype(np.int64)
    place = mix((count * 1024 + at - first).astype(np.uint64))
    whole = mix((sums[end] - sums[first]) * powers(INVERSE, len(data))[first] ^ place)
    return first, count, gram[at], whole


def text_pieces(data: np.ndarray, length: int, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in pieces of about ``limit`` windows that overlap by ``length - 1`` bytes,
    so that every window lies in exactly one."""
    for a in range(0, len(data) - length + 1, limit):
        yield a, data[a : a + limit + length - 1]


def fragments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        data, offsets = text_bytes(batch.column("text"))
        docs, ties = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("tie").to_numpy(zero_copy_only=False)
        parts: list[list[np.ndarray]] = []
        for i in np.flatnonzero(np.diff(offsets) >= length).tolist():
            for start, piece in text_pieces(data[offsets[i] : offsets[i + 1]], length):
                first, count, anchor, digest = fragments_of(piece, length)
                place = (first + start) << TIE_BITS | ties[i]
                parts.append([anchor.view(np.int64), digest.view(np.int64), np.full(len(first), docs[i]), place, count.astype(np.int32)])
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "digest", "doc", "place", "windows"])


def cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted fragments, from their documents."""
    for batch in slices(batches, "text", SLICE):
        data, offsets = text_bytes(batch.column("text"))
        rows = []
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            for w in wanted:
                a = offsets[i] + (w["place"] >> TIE_BITS)
                rows.append((w["anchor"], w["digest"], w["doc"], w["place"], w["windows"], data[a : a + w["windows"] - 1 + length].tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor", "digest", "doc", "place", "windows", "bytes"])


def repeated_pieces(group: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose hash occurs again in the group: for each run its fragment, its
    first byte there and how many windows it has."""
    data = np.frombuffer(b"".join(group["bytes"]), np.uint8)
    windows = group.windows.to_numpy(np.int64)
    begins = np.cumsum(windows + length - 1) - (windows + length - 1)
    owner = np.repeat(np.arange(len(group)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begins[owner]
    hashes = rolling(data, length, start)
    order = np.argsort(hashes, kind="stable")
    equal = np.zeros(len(order) + 1, bool)
    equal[1:-1] = hashes[order][1:] == hashes[order][:-1]
    again = np.zeros(len(order), bool)
    again[order] = equal[1:] | equal[:-1]
    owner, start = owner[again], start[again]
    first = np.ones(len(start), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(first)
    return owner[at], start[at] - begins[owner[at]], np.diff(np.append(at, len(start)))


def earlier_windows(group: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs of windows in the group's fragments that also start earlier.

    Windows without an equal hash are left aside, equal pieces of what remains collapse to
    the earliest, and a suffix array of the distinct pieces shows which windows are equal.
    """
    group = group.sort_values(["doc", "place", "anchor"], kind="stable").reset_index(drop=True)
    owner, offset, windows = repeated_pieces(group, length)
    place, docs = group.place.to_numpy(np.int64), group.doc.to_numpy(np.int64)
    start, doc, tie = (place >> TIE_BITS)[owner] + offset, docs[owner], place[owner] & ((1 << TIE_BITS) - 1)
    pieces: dict[bytes, int] = {}
    late, kept_ = [], []
    for k in np.lexsort((start, doc)).tolist():
        text = group["bytes"][owner[k]][offset[k] : offset[k] + windows[k] + length - 1]
        least = pieces.setdefault(text, k)
        if least == k:
            kept_.append(k)
        elif (doc[least], start[least]) != (doc[k], start[k]):
            late.append(k)
    whole = pd.DataFrame({"doc": doc[late], "place": start[late] << TIE_BITS | tie[late], "windows": windows[late].astype(np.int32), "fragment": place[owner][late]})
    if not kept_:
        return whole
    own = np.array(kept_)
    return pd.concat([whole, equal_windows(list(pieces), doc[own], start[own], tie[own], windows[own], place[owner][own], length)], ignore_index=True)


def equal_windows(
    pieces: list[bytes], doc: np.ndarray, start: np.ndarray, tie: np.ndarray, windows: np.ndarray, fragment: np.ndarray, length: int
) -> pd.DataFrame:
    """Windows of distinct pieces that also start earlier, by a suffix array of the pieces."""
    text: list[int] = []
    begins = []
    for piece in pieces:
        begins.append(len(text))
        text.extend(piece)
        text.append(256)
    order = np.array(suffix_array(text), np.int64)
    flat, begin = np.array(text, np.int16), np.array(begins)
    owner = np.searchsorted(begin, order, "right") - 1
    valid = order - begin[owner] < windows[owner]
    order, owner = order[valid], owner[valid]
    same = np.zeros(len(order), bool)
    view = np.lib.stride_tricks.sliding_window_view(flat, length)
    for a in range(1, len(order), 4096):
        b = min(len(order), a + 4096)
        same[a:b] = (view[order[a:b]] == view[order[a - 1 : b - 1]]).all(axis=1)
    label = np.cumsum(~same)
    at, in_doc = start[owner] + order - begin[owner], doc[owner]
    rank = np.lexsort((at, in_doc, label))
    head = np.ones(len(rank), bool)
    head[1:] = label[rank][1:] != label[rank][:-1]
    group_at = np.cumsum(head) - 1
    least_doc, least_at = in_doc[rank][head][group_at], at[rank][head][group_at]
    late = np.zeros(len(order), bool)
    late[rank] = (in_doc[rank] != least_doc) | (at[rank] != least_at)
    owner, at = owner[late], at[late]
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    first = np.ones(len(at), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    k = np.flatnonzero(first)
    return pd.DataFrame({
        "doc": doc[owner[k]], "place": at[k] << TIE_BITS | tie[owner[k]], "windows": np.diff(np.append(k, len(at))).astype(np.int32),
        "fragment": fragment[owner[k]],
    })


def windows_by_hash(large: DataFrame, length: int) -> DataFrame:
    """The same for anchors with much distinct text: windows meet by 128 bits of hash."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                data = np.frombuffer(row.bytes, np.uint8)
                start = np.arange(row.windows)
                one, two = rolling(data, length), rolling(data ^ np.uint8(0xA5), length)
                yield pd.DataFrame({"one": one.view(np.int64), "two": two.view(np.int64), "doc": row.doc, "place": row.place + (start << TIE_BITS), "fragment": row.place})

    found = large.mapInPandas(explode, "one bigint, two bigint, doc bigint, place bigint, fragment bigint")
    own = F.struct("doc", F.shiftright("place", TIE_BITS).alias("start"))
    least = kept(found.groupBy("one", "two").agg(F.min(own).alias("least"), F.count("*").alias("n")).where("n > 1"))
    late = found.join(least, ["one", "two"]).where(own != F.col("least"))
    return late.select("doc", "place", F.lit(1).alias("windows"), "fragment")


def removed(batches: Iterator[pa.RecordBatch], length: int, as_text: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column("text"))
        spans, rest = [], []
        for i, found in enumerate(batch.column("runs").to_pylist()):
            out: list[list[int]] = []
            for a, b in sorted((r["start"], r["start"] + r["windows"] - 1 + length) for r in found or ()):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b])
            own, at, keep = data[offsets[i] : offsets[i + 1]], 0, []
            for a, b in out:
                keep.append(own[at:a].tobytes())
                at = b
            rest.append(b"".join([*keep, own[at:].tobytes()]))
            spans.append([{"first": a, "last": b} for a, b in out])
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        names = [n for n in batch.schema.names if n not in ("text", "runs")]
        left = pa.array([r.decode("utf-8", "ignore") for r in rest], pa.string()) if as_text else pa.array(rest, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(np.diff(offsets)), pa.array(spans, kind), left], names=[*names, "n_bytes", "spans", "rest"]
        )


def tie(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit((1 << TIE_BITS) - 1))


def without_repeats(docs: DataFrame, length: int = LENGTH, carry: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """Texts (``doc_id``, ``text``) without the bytes covered by a ``length``-byte string that
    also starts earlier: in a smaller ``doc_id``, or in the same document further left.
    Strings are judged on the input and never cross documents; overlaps count.

    One row per input row: ``row, n_bytes, spans, rest``; ``row`` is a struct of ``doc_id`` and
    the columns named in ``carry``, ``spans`` are the maximal removed byte ranges (``first``,
    last-plus-one ``last``), ``rest`` the remaining bytes, or with ``as_text`` the text they
    are, without characters that lost some of their bytes. Null and
    empty texts have no bytes; texts shorter than ``length`` stay whole. Rows that share an id
    are one document: of equal strings at equal starts there neither is the earlier. Null
    ids come after all others and are one document too. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct("doc_id", *(f"`{c}`" for c in carry if c != "doc_id"))
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    base = docs.select(row.alias("row"), doc.alias("doc"), tie(text).alias("tie"), text.alias("text"))
    found = base.select("doc", "tie", "text").mapInArrow(lambda it: fragments(it, length), FRAGMENTS)
    by_anchor, by_both = Window.partitionBy("anchor"), Window.partitionBy("anchor", "digest")
    classed = found.repartition("anchor").withColumns({
        "n": F.count("*").over(by_anchor), "least": F.min(F.struct("doc", "place")).over(by_both),
        "low": F.min("digest").over(by_anchor), "high": F.max("digest").over(by_anchor),
    })
    copy = (F.col("doc") != F.col("least.doc")) | (F.shiftright("place", TIE_BITS) != F.shiftright("least.place", TIE_BITS))
    again = kept(classed.where("n > 1").select(
        "anchor", "digest", "doc", "place", "windows", F.col("least.place").alias("fragment"), copy.alias("copy"), (F.col("low") != F.col("high")).alias("varied")
    ))
    # Different fragments with one anchor: their bytes, once for each.
    distinct = again.where("varied and not copy and place = fragment").dropDuplicates(["anchor", "digest"])
    # The same fragment at the same start of other texts with this id: no copy, but as late.
    twins = again.where("varied and not copy and place != fragment").select("doc", "fragment", F.col("place").alias("twin")).distinct()
    wanted = distinct.groupBy("doc", F.col("place").bitwiseAND(F.lit((1 << TIE_BITS) - 1)).alias("tie")).agg(
        F.collect_list(F.struct("anchor", "digest", "doc", "place", "windows")).alias("wanted")
    )
    once = base.select("doc", "tie", "text").join(wanted, ["doc", "tie"]).dropDuplicates(["doc", "tie"])
    texts = kept(once.select("text", "wanted").mapInArrow(lambda it: cut(it, length), FRAGMENTS + ", bytes binary"))
    weight = texts.groupBy("anchor").agg(F.sum(F.length("bytes")).alias("weight"))
    sized = texts.join(weight, "anchor")
    total = weight.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    groups = max(1, 4 * total // GROUP_BYTES)
    small = sized.where(F.col("weight") <= GROUP_BYTES).withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    late = small.groupBy("group").applyInPandas(lambda g: earlier_windows(g, length), "doc bigint, place bigint, windows int, fragment bigint")
    late = late.unionByName(windows_by_hash(kept(sized.where(F.col("weight") > GROUP_BYTES)), length))
    if not twins.isEmpty():
        late = kept(late)
        late = late.unionByName(late.join(twins, ["doc", "fragment"]).withColumn("place", F.expr("place - fragment + twin")).drop("twin"))
    late = late.drop("fragment").unionByName(again.where("copy").select("doc", "place", "windows"))
    spans = late.groupBy("doc", F.col("place").bitwiseAND(F.lit((1 << TIE_BITS) - 1)).alias("tie")).agg(
        F.collect_list(F.struct(F.shiftright("place", TIE_BITS).alias("start"), "windows")).alias("runs")
    )
    out = base.join(kept(spans), ["doc", "tie"], "left").select("row", "text", "runs")
    added = T.StructType.fromDDL(f"n_bytes bigint, spans array<struct<first:bigint,last:bigint>>, rest {'string' if as_text else 'binary'}")
    schema = T.StructType([out.schema["row"], *added.fields])
    return out.mapInArrow(lambda it: removed(it, length, as_text), schema)
