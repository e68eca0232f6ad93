"""Substring dedup: documents are joined on winnowed anchors, matches extended both ways, maximal repeats over the threshold go.

Exact copies of earlier documents are told first. Seeds are winnowed anchors (see anchors): two stretches of ``window`` equal words share one, so
all documents that hold a seed meet in one task, each with the words around it that windows with this seed can reach. Equal surroundings
collapse to the earliest place. Of the others, a place is compared with the earliest one that has its first open window: the match is extended to
the left and to the right while the words agree, which settles all windows within it; then comes the next open window. So a place is
compared once for each earlier document it repeats, never with all places of its seed. Matches of at least ``window`` words go; touching ones are joined.

Words are compared, copies by 128 bits of hashes and length.

Defined cases: null and empty texts have no words; rows that share a doc_id (null: the least one) are versions of one document, so a window is earlier in
any of them where it starts earlier; equal rows get the same answer; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.anchors import flat, in_steps, keyed, least_grams, merged, repeated_spans, settled, shared_runs, with_lists
from larkspur.llm.arrays import Prefix, portions, word_prefix, words
from larkspur.llm.common import discard, documents, let, plain_words, written

GRAM = 6


def _places(window: int, gram: int):
    def find(data, offsets):
        starts, ends, by_doc = words(data, offsets)
        if len(starts) < window:
            return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
        h = Prefix(data).hashes(starts, ends)
        a = np.arange(len(h) - gram + 1)
        return least_grams(word_prefix(h).hashes(a, a + gram), by_doc, window, gram, apart=True)

    return find


def _symbols(data, offsets):
    """The words with one blank between them, whatever stood there."""
    starts, ends, by_doc = words(data, offsets)
    sizes = ends - starts
    within = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(within)) + within
    plain = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    plain[place] = data[place - within + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]
    last = np.cumsum(sizes + 1) - 1
    return plain, last - sizes, last, by_doc


def word_numbers(segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each word of the segments as a number, equal for equal words, and the offsets of the segments."""
    data, offsets = flat(segments)
    starts, ends, by_segment = words(data, offsets)
    bare = data[np.repeat(starts - (np.cumsum(ends - starts) - (ends - starts)), ends - starts) + np.arange(int((ends - starts).sum()))]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(bare.tobytes())])
    return column.dictionary_encode().indices.to_numpy(), by_segment


def extended(ids: np.ndarray, cuts: np.ndarray, order: tuple[np.ndarray, np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of segments: number of the segment, start and end in it. ids: words of the segments on end, cuts: their offsets.

    order: (did, place) of each segment's first word; a repeat has an equal stretch that starts earlier by these.
    """
    did, place = order
    n = np.maximum(np.diff(cuts) - window + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    base = np.cumsum(n) - n
    inside = np.arange(len(of)) - base[of]
    at = cuts[:-1][of] + inside
    # Equal windows, the earliest of each first.
    rows = np.lib.stride_tricks.sliding_window_view(ids.astype(">u4"), window)[at]
    keys = np.ascontiguousarray(rows).view(f"S{4 * window}").ravel()
    by = np.lexsort((place[of] + inside, did[of]))
    by = by[np.argsort(keys[by], kind="stable")]
    new = np.ones(len(by), bool)
    new[1:] = keys[by][1:] != keys[by][:-1]
    earliest = np.empty(len(by), np.int64)
    earliest[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    here = place[of] + inside
    is_open = (did[of] > did[of[earliest]]) | (here > here[earliest])
    found = [], [], []
    while len(left := np.flatnonzero(is_open)):
        w = left[np.flatnonzero(np.diff(of[left], prepend=-1))]  # of each segment the first open window
        a, b = at[w], at[earliest[w]]
        s, o = of[w], of[earliest[w]]
        back, on = np.zeros(len(w), np.int64), np.full(len(w), window)
        room = np.minimum(a - cuts[s], b - cuts[o])
        go = np.flatnonzero(room > 0)
        while len(go):
            go = go[ids[a[go] - back[go] - 1] == ids[b[go] - back[go] - 1]]
            back[go] += 1
            go = go[back[go] < room[go]]
        room = np.minimum(cuts[s + 1] - a, cuts[o + 1] - b)
        go = np.flatnonzero(room > window)
        while len(go):
            go = go[ids[a[go] + on[go]] == ids[b[go] + on[go]]]
            on[go] += 1
            go = go[on[go] < room[go]]
        for x, y in zip(found, (s, inside[w] - back, inside[w] + on), strict=True):
            x.append(y)
        settled_here = np.zeros(len(of) + 1, np.int64)
        settled_here[w - back] += 1
        np.subtract.at(settled_here, w + on - window + 1, 1)
        is_open &= np.cumsum(settled_here)[:-1] == 0
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _compare(window: int):
    def compare(t: pa.Table) -> pa.RecordBatch:
        anchor, did, row, first, n = (t.column(k).to_numpy() for k in range(5))
        cells = t.column(5).combine_chunks().dictionary_encode()
        code = cells.indices.to_numpy()
        order = np.lexsort((first, did, code))
        lead = order[np.flatnonzero(np.diff(code[order], prepend=-1))]  # of each different segment the earliest place
        later = (did > did[lead][code]) | (first > first[lead][code])
        whole = np.flatnonzero(later)
        spans = [(did[whole], row[whole], first[whole], first[whole] + n[whole] + window - 1)]
        _, group, several = np.unique(anchor[lead], return_inverse=True, return_counts=True)
        use = np.flatnonzero(several[group] > 1)
        if len(use):
            ids, cuts = word_numbers(cells.dictionary.take(pa.array(use)))
            of, a, z = extended(ids, cuts, (did[lead[use]], first[lead[use]]), window)
            holders = np.flatnonzero(~later)  # rows of one document may share a place
            holders = holders[np.argsort(code[holders], kind="stable")]
            low, high = (np.searchsorted(code[holders], use[of], side) for side in ("left", "right"))
            again = np.repeat(np.arange(len(of)), high - low)
            who = holders[np.arange(len(again)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[again]]
            spans.append((did[who], row[who], first[who] + a[again], first[who] + z[again]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*spans, strict=True)], names=["did", "row", "start", "end"])

    return compare


def substring_dedup(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, ``spans`` [(start, end)] of the removed repeats in
    words, and ``kept_text`` where words went (null: the text is as it was)."""
    gram = min(GRAM, window)
    base = keyed(docs)
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    plain = plain_words(F.col("text"))
    told = let(plain, lambda t: F.struct(F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n"), F.sha2(t, 256).alias("sha")))
    table = settled(base, size, told.alias("told"))
    runs = written(shared_runs(table.filter("NOT copy"), _places(window, gram), symbols=size // 40, across=False, least_of=window - gram + 1), "runs")
    spans = repeated_spans(table, runs, _symbols, _compare(window), window=window, across=False)
    discard(runs)

    def cut(batches):
        for b in in_steps(batches):
            out = []
            lists = b.column(3)
            for k, (size, text, copy) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 4, 5)), strict=True)):
                if copy and size >= window:
                    out.append((size, hashlib.sha256(b"").hexdigest(), [{"start": 0, "end": size}], ""))
                    continue
                at = lists[k]
                if not at.is_valid:
                    out.append((0, None, [], None))
                    continue
                (_, data, offsets), = portions(pa.array([text]), 1 << 62)
                starts, ends, _ = words(data, offsets)
                s, e = merged(at.values.field(0).to_numpy(), at.values.field(1).to_numpy())
                gone = np.zeros(len(starts) + 1, np.int64)
                gone[s] += 1
                gone[e] -= 1
                keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                raw = data.tobytes()
                kept = b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                spans = [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                out.append((len(starts) - len(keep), hashlib.sha256(kept).hexdigest(), spans, kept.decode()))
            n, sha, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
            sha = [x or y for x, y in zip(sha, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"],
            )

    both = with_lists(table, spans, "at", "start", "end")
    return both.select("doc_id", "told.n", "told.sha", "at", "text", "copy").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept_text string"
    )


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup(documents(spark, sf_dir, "doc_id", "text")).drop("spans", "kept_text")


_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
m AS (SELECT word.*, gone.p IS NOT NULL AS out FROM word LEFT JOIN gone USING (doc_id, p)),
s AS (SELECT doc_id, count(*) FILTER (out) AS n, string_agg(word, ' ' ORDER BY p) FILTER (NOT out) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE = {"op10_substring_dedup": _SQL}
