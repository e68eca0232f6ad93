"""Which stretches of documents may repeat elsewhere: shared anchors, and the segments of text around them.

A repeat of at least W symbols holds the same grams, so its windows of W symbols have the same least gram hash. That
hash, the window's anchor, is kept once for all neighbouring windows that have it. Anchors travel
as packed columns, a blob for each chunk of documents and bucket of hashes, not as rows; a task
sees all of a bucket and answers with those that occur twice.

An anchor with more than ``MANY`` places in one chunk is shared for certain. Only ``MANY`` of its places then go to its
bucket, to tell others of it; the rest are dealt out by place. So no bucket gathers a frequent anchor.

The windows of a shared anchor then travel together, as one segment of text: equal windows have equal anchors, so whoever holds
all segments of an anchor holds all places of its windows and compares them by value. Hashes only choose what is compared. Of a frequent
anchor, equal segments in a portion of documents collapse to the earliest before they travel. Anchors that still have
more than ``CROWD`` segments go window by window instead, through an aggregate that combines before it shuffles.

Exact copies of earlier documents (length and two hashes, 128 bits) are told first, and none of this sees their texts. The texts are
written once, bucketed by document, so that what is found about them joins without moving them again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrays import U, by_document, mix, portions, release, sliding_min
from larkspur.llm.common import discard, written, written_in_buckets

MANY = 32
CHUNK = 1 << 18
#: Places of one anchor from which its segments collapse in a portion, and segments beyond which they aren't compared within a task.
CROWD = 4000
PLACE, HERALD, KNOWN = 0, 1, 2
RUNS = "did long, row long, anchor long, first int, n int, crowded boolean"
#: Windows of a run at most; longer ones (periodic texts) are cut.
LONGEST = 4096
#: Bytes of segments that are compared at once, if one anchor has no more.
COMPARED = 1 << 20
Finder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, byte by byte of significance, so that a compressor finds what is alike."""
    head = "".join(c.dtype.char for c in columns)
    body = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return bytes([len(head)]) + head.encode() + len(columns[0]).to_bytes(4, "little") + b"".join(body)


def unpacked(blob: bytes) -> list[np.ndarray]:
    kinds, at = blob[1 : 1 + blob[0]].decode(), 5 + blob[0]
    n, out = int.from_bytes(blob[at - 4 : at], "little"), []
    for k in kinds:
        size = np.dtype(k).itemsize
        planes = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(k))
        at += n * size
    return out


def least_grams(grams: np.ndarray, offsets: np.ndarray, window: int, gram: int, apart: bool = False):
    """Runs of windows with one anchor. grams: hash at each symbol (those that cross documents are ignored).

    apart: a run ends where its first place of the anchor does, so that places within one run count as several.
    -> anchor, document, first window and number of windows of each run.
    """
    span = window - gram + 1
    at, doc = by_document(offsets, window)
    if not len(at):
        return np.zeros(0, U), doc, at, at
    least = sliding_min(grams, span)[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    if apart:
        place = np.zeros(len(at), np.int64)
        for j in range(span - 1, -1, -1):
            np.copyto(place, at + j, where=grams[at + j] == least)
        new[1:] |= place[1:] != place[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(at)))
    if sizes.max() > LONGEST:
        parts = -(-sizes // LONGEST)
        starts = np.repeat(starts, parts) + LONGEST * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
        sizes = np.diff(np.append(starts, len(at)))
    return least[starts], doc[starts], at[starts] - offsets[:-1][doc[starts]], sizes


def _bucket(hashes: np.ndarray, buckets: int, least_of: int) -> np.ndarray:
    """Buckets of about equal size, in the order of the hashes, which are the least of ``least_of`` even ones: neighbours compress well."""
    even = -np.expm1(least_of * np.log1p(-(hashes >> U(11)).astype(np.float64) / (1 << 53)))
    return np.minimum((even * buckets).astype(np.int64), buckets - 1)


def _flush(did, row, anchor, first, n, buckets, least_of):
    order = np.argsort(anchor, kind="stable")
    did, row, anchor, first, n = (c[order] for c in (did, row, anchor, first, n))
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(anchor)))
    nth = np.arange(len(anchor)) - np.repeat(start, size)
    often = np.repeat(size > MANY, size)
    kind = np.where(often, np.where(nth < MANY, HERALD, KNOWN), PLACE).astype(np.uint8)
    bucket = _bucket(anchor, buckets, least_of)
    known = np.flatnonzero(kind == KNOWN)
    bucket[known] = _bucket(mix(did[known].astype(U) ^ (first[known].astype(U) << U(20))), buckets, 1)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        rows = order[cuts[b] : cuts[b + 1]]
        _, of, at = np.unique(row[rows] ^ did[rows].astype(np.int64), return_index=True, return_inverse=True)
        at = at.astype(np.uint16 if len(of) < 65536 else np.uint32)
        yield b, packed([anchor[rows], at, first[rows].astype(np.uint32), n[rows].astype(np.uint32), kind[rows]]), packed([did[rows][of], row[rows][of]])


def _deal(rows, buckets, least_of):
    found = list(_flush(*(np.concatenate(c) for c in zip(*rows, strict=True)), buckets, least_of))
    for i in range(0, len(found), 64):
        b, blob, ids = zip(*found[i : i + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(blob, pa.binary()), pa.array(ids, pa.binary())], names=["bucket", "blob", "ids"])


def _judge(blobs: list[tuple[bytes, bytes]], across: bool):
    parts = []
    for blob, ids in blobs:
        anchor, at, first, n, kind = unpacked(blob)
        did, row = unpacked(ids)
        parts.append((anchor, did[at], row[at], first, n, kind))
    anchor, did, row, first, n, kind = (np.concatenate(c) for c in zip(*parts, strict=True))
    known = kind == KNOWN
    rows = np.flatnonzero(~known)
    rows = rows[np.argsort(anchor[rows], kind="stable")]
    shared = np.zeros(len(anchor), bool)
    crowded = known.copy()
    shared[known] = True
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = anchor[rows][1:] != anchor[rows][:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(rows)))
        crowd = (np.maximum.reduceat(kind[rows], start) == HERALD) | (size > CROWD)
        d = did[rows]
        twice = (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)) if across else size > 1
        shared[rows] = np.repeat(twice | crowd, size)
        crowded[rows] = np.repeat(crowd, size)
    s = np.flatnonzero(shared)
    for i in range(0, len(s), 50_000):
        k = s[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(did[k]), pa.array(row[k]), pa.array(anchor[k].view(np.int64)), pa.array(first[k].astype(np.int32)), pa.array(n[k].astype(np.int32)), pa.array(crowded[k])],
            names=["did", "row", "anchor", "first", "n", "crowded"],
        )


def shared_runs(docs: DataFrame, finder: Finder, *, symbols: int, across: bool, least_of: int = 1) -> DataFrame:
    """docs: did, row, text. -> the runs of windows whose anchor occurs elsewhere (``across``: in another did): RUNS.

    symbols: about how many anchors there are, which sets the number of buckets (some 250,000 each).
    least_of: of how many hashes an anchor is the least, which sets their borders.
    """
    buckets = max(64, symbols // 250_000)

    def deal(batches):
        rows, held = [], 0
        for b in batches:
            ids, prints = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, data, offsets in portions(b.column(2), 1 << 18):
                anchor, doc, first, n = finder(data, offsets)
                rows.append((ids[i + doc], prints[i + doc], anchor, first, n))
                held += len(anchor)
                if held >= CHUNK:
                    yield from _deal(rows, buckets, least_of)
                    rows, held = [], 0
                    release()
        if held:
            yield from _deal(rows, buckets, least_of)
        rows = []
        release()

    def judge(batches):
        now, blobs = None, []
        for b in batches:
            for k, blob, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != now and blobs:
                    yield from _judge(blobs, across)
                    blobs = []
                    release()
                now = k
                blobs.append((blob, ids))
        if blobs:
            yield from _judge(blobs, across)
        blobs = []
        release()

    dealt = docs.select("did", "row", "text").mapInArrow(deal, "bucket int, blob binary, ids binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(judge, RUNS)


def keyed(docs: DataFrame) -> DataFrame:
    """did (a null doc_id as the least integer), doc_id, row (hash of the text), text (null as empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"), "doc_id", F.xxhash64(text).alias("row"), text.alias("text"))


def exact_copies(base: DataFrame) -> DataFrame:
    """base: keyed(). -> (c_did, c_row) of the rows whose text an earlier did has as well, written.

    Texts are compared by length and two hashes.
    """
    hashed = base.select("did", "row", F.octet_length("text").alias("size"), F.xxhash64(F.lit(7), "text").alias("also"))
    firsts = hashed.groupBy("size", "row", "also").agg(F.min("did").alias("least"), F.max("did").alias("most")).filter("least < most").drop("most")
    firsts = written(firsts, "copy_groups")  # so that the rows of a frequent text can be split in the join
    found = hashed.join(firsts, ["size", "row", "also"]).filter("did > least")
    copies = written(found.select(F.col("did").alias("c_did"), F.col("row").alias("c_row")).distinct(), "copies")
    discard(firsts)
    return copies


def settled(base: DataFrame, size: int, *also) -> DataFrame:
    """base: keyed(). -> did, row, doc_id, columns ``also`` of the text, copy (of an earlier did), text (null for copies); bucketed by (did, row).

    size: bytes of all texts, about. The texts move here, and not again.
    """
    copies = exact_copies(base)
    both = base.join(copies.hint("shuffle_hash"), (F.col("did") == F.col("c_did")) & (F.col("row") == F.col("c_row")), "left")
    copy = F.col("c_did").isNotNull()
    table = written_in_buckets(both.select("did", "row", "doc_id", *also, copy.alias("copy"), F.when(~copy, F.col("text")).alias("text")), "documents", ("did", "row"), size >> 24)
    discard(copies)
    return table


def with_lists(table: DataFrame, rows: DataFrame, name: str, *fields: str, how: str = "left") -> DataFrame:
    """settled() and the rows (did, row, fields) of each document as a sorted list of structs, null where there are none. Only the rows move."""
    lists = rows.groupBy(F.col("did").alias("l_did"), F.col("row").alias("l_row")).agg(F.sort_array(F.collect_set(F.struct(*fields))).alias(name))
    both = table.join(lists.hint("shuffle_hash"), (F.col("did") == F.col("l_did")) & (F.col("row") == F.col("l_row")), how)
    return both.drop("l_did", "l_row")


SEGMENTS = "anchor long, did long, row long, first long, n long, segment binary"
#: at: places of the window ``w`` in the document. Where w is null, an earlier place is in the same portion, and [start, end) are such windows.
WINDOWS = "w binary, did long, row long, at array<long>, start long, end long"
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _binary(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The stretches data[a:b], copied."""
    raw = data.tobytes()
    return pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())


def flat(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array without nulls, on end, and the offsets of its cells."""
    at = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset :][: len(cells) + 1].astype(np.int64)
    data = cells.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)), at - at[0]


def _earlier(code: np.ndarray, did: np.ndarray, place: np.ndarray, across: bool) -> np.ndarray:
    """Which rows have one of the same code before them: with a smaller did or, unless ``across``, an earlier place."""
    order = np.lexsort((place, did, code))
    lead = np.empty(len(code), np.int64)
    first = order[np.flatnonzero(np.diff(code[order], prepend=-1))]
    lead[:] = first[np.searchsorted(code[first], code)]
    return (did > did[lead]) | ((not across) & (place > place[lead]))


def _segments(symbols: Symbols, window: int, crowded: bool, across: bool):
    """did, row, text, runs -> SEGMENTS; of ``crowded`` runs the segment is null if the same one comes earlier in the portion."""

    def cut(batches):
        for b in batches:
            lists, dids, rows = b.column(3), b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, data, offsets in portions(b.column(2)):
                part = lists.slice(i, len(offsets) - 1)
                ends = part.offsets.to_numpy()
                runs = part.values.slice(ends[0], ends[-1] - ends[0])
                first, n, anchor = (runs.field(k).to_numpy().astype(np.int64) for k in (0, 1, 2))
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
                data, starts, stops, by_doc = symbols(data, offsets)
                at = by_doc[:-1][doc] + first
                if crowded:  # places of a segment stay together
                    order = np.argsort(anchor, kind="stable")
                    first, n, anchor, doc, at = (x[order] for x in (first, n, anchor, doc, at))
                did, row = dids[i:][doc], rows[i:][doc]
                for lo, hi in _slices(n + window, 1 << 19):
                    z = slice(lo, hi)
                    cells = _binary(data, starts[at[z]], stops[at[z] + n[z] + window - 2])
                    if crowded:
                        later = _earlier(cells.dictionary_encode().indices.to_numpy(), did[z], first[z], across)
                        cells = cells.take(pa.array(np.arange(hi - lo), mask=later))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[z]) for c in (anchor, did, row, first, n)), cells], names=["anchor", "did", "row", "first", "n", "segment"])

    return cut


def _windows(symbols: Symbols, window: int, across: bool):
    """SEGMENTS -> WINDOWS."""

    def cut(batches):
        for b in batches:
            dids, rows, firsts, counts = (b.column(k).to_numpy() for k in (1, 2, 3, 4))
            for lo, hi in _slices(counts, 100_000):
                did, row, first, n = (x[lo:hi] for x in (dids, rows, firsts, counts))
                data, starts, stops, by_segment = symbols(*flat(b.column(5).slice(lo, hi - lo)))
                of = np.repeat(np.arange(len(n)), n)
                inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                s = by_segment[:-1][of] + inside
                cells = _binary(data, starts[s], stops[s + window - 1])
                code, did, row, place = cells.dictionary_encode().indices.to_numpy(), did[of], row[of], first[of] + inside
                later = _earlier(code, did, place, across)
                gone = np.flatnonzero(later)
                gone = gone[np.lexsort((place[gone], row[gone], did[gone]))]
                new = np.flatnonzero((np.diff(row[gone], prepend=0) != 0) | (np.diff(did[gone], prepend=0) != 0) | (np.diff(place[gone], prepend=-2) > 1))
                if len(gone):
                    new = np.unique(np.append(new, 0))
                last = np.append(new[1:], len(gone))[: len(new)] - 1
                kept = np.flatnonzero(~later)
                kept = kept[np.lexsort((place[kept], row[kept], did[kept], code[kept]))]
                head = np.ones(len(kept), bool)
                head[1:] = (np.diff(code[kept]) != 0) | (np.diff(did[kept]) != 0) | (np.diff(row[kept]) != 0)
                head = np.flatnonzero(head)
                none = pa.nulls(len(new), pa.binary()), pa.nulls(len(head), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(kept)), pa.int32()), pa.array(place[kept]))
                names = ["w", "did", "row", "at", "start", "end"]
                yield pa.RecordBatch.from_arrays([cells.take(pa.array(kept[head])), pa.array(did[kept[head]]), pa.array(row[kept[head]]), lists, none[1], none[1]], names=names)
                yield pa.RecordBatch.from_arrays([none[0], pa.array(did[gone[new]]), pa.array(row[gone[new]]), pa.nulls(len(new), lists.type), pa.array(place[gone[new]]), pa.array(place[gone[last]] + window)], names=names)

    return cut


def _slices(n: np.ndarray, most: int):
    """[lo, hi) with about ``most`` in all."""
    cuts = np.searchsorted(np.cumsum(n), np.arange(most, int(n.sum()) + most, most)) + 1
    cuts = np.unique(np.concatenate(([0], np.minimum(cuts, len(n)))))
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _whole_anchors(batches):
    """Tables of some COMPARED bytes that hold all segments of their anchors. batches: sorted by anchor."""
    held, size, enough = [], 0, COMPARED
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        anchor = table.column(0).to_numpy()
        last = int(np.searchsorted(anchor, anchor[-1]))
        if last:
            yield table.slice(0, last)
            held, size, enough = table.slice(last).to_batches(), 0, COMPARED
            size = sum(x.nbytes for x in held)
        enough = max(enough, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


SPANS = "did long, row long, start long, end long"
Compare = Callable[[pa.Table], pa.RecordBatch]


def repeated_spans(table: DataFrame, runs: DataFrame, symbols: Symbols, compare: Compare, *, window: int, across: bool) -> DataFrame:
    """settled() and its shared runs -> stretches of symbols that occur earlier (SPANS, which may overlap), written.

    compare: all segments of some anchors (SEGMENTS) -> SPANS. across: only what a smaller did has is earlier; else also an earlier place
    of the same did.
    """

    def segments(crowded: bool) -> DataFrame:
        some = with_lists(table, runs.filter("crowded" if crowded else "NOT crowded"), "runs", "first", "n", "anchor", how="inner")
        return some.select("did", "row", "text", "runs").mapInArrow(_segments(symbols, window, crowded, across), SEGMENTS)

    crowd = written(segments(True), "crowds")
    whole = [F.col("first").alias("start"), (F.col("first") + F.col("n") + (window - 1)).alias("end")]
    spans = [crowd.filter("segment IS NULL").select("did", "row", *whole)]
    crowd_left = crowd.filter("segment IS NOT NULL")
    heavy = written(crowd_left.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > CROWD).drop("times"), "heavy_anchors")
    light = segments(False).union(crowd_left.join(heavy, "anchor", "left_anti"))

    def compared(batches):
        for t in _whole_anchors(batches):
            yield compare(t)
            release()

    spans.append(light.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compared, SPANS))
    unused = [crowd, heavy]
    if heavy.limit(1).count():
        windows = written(crowd_left.join(heavy, "anchor", "left_semi").mapInArrow(_windows(symbols, window, across), WINDOWS), "windows", batch=4000)
        spans.append(windows.filter("w IS NULL").select("did", "row", "start", "end"))
        seen = windows.filter("w IS NOT NULL")
        first = F.min("did") if across else F.min(F.struct("did", F.element_at("at", 1).alias("at")))
        firsts = written(seen.groupBy("w").agg(first.alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"), "window_firsts")
        told, at = seen.join(firsts, "w"), F.element_at("at", 1)
        if across:
            told = told.filter(F.col("did") > F.col("first"))
        else:
            told = told.filter((F.col("did") > F.col("first.did")) | ((F.col("did") == F.col("first.did")) & (at > F.col("first.at"))))
        spans.append(told.select("did", "row", F.explode("at").alias("start")).withColumn("end", F.col("start") + window))
        unused += [windows, firsts]
    found = written(reduce(DataFrame.union, spans), "spans", batch=4000)
    discard(*unused)
    return found


def in_steps(batches, rows: int = 250):
    """Batches of few rows: a caller's setting may put thousands of texts in one."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def merged(at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in order of their starts, those that overlap or touch as one."""
    end = np.maximum.accumulate(end)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] > end[:-1]
    first = np.flatnonzero(new)
    return at[first], end[np.append(first[1:], len(at)) - 1]
