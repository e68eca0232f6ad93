"""Suffix dedup: remove bytes that an earlier document already holds in a stretch of ``window`` bytes.

Exact copies are told first; of the other texts those stretches are taken whose anchor occurs in another document (see anchors).
All stretches of one anchor meet in one task. Equal ones collapse to that of the least document. The suffixes that start in the
others are sorted by their bytes, as far as ``window``; what neighbours in that order share, and the previous and the next
suffix of a smaller document, give the longest previous factor of each: a suffix whose factor
reaches ``window`` repeats an earlier document. The later copy's bytes go, the first stays. Factors are told up to ``window`` bytes: whether one is
longer changes nothing, since each byte position is judged by itself.

The suffix order is that of the stretches of an anchor, not of the whole corpus: equal windows have equal anchors, so no match is lost.
Bytes are compared, copies by 128 bits of hashes and length.

Defined cases: null and empty texts have no bytes; of rows with one doc_id (null: the least one) neither is
earlier, each is judged by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.anchors import flat, in_steps, keyed, least_grams, merged, repeated_spans, settled, shared_runs, with_lists
from larkspur.llm.arrays import Prefix
from larkspur.llm.common import discard, documents, written

GRAM = 20


def _places(window: int, gram: int):
    def find(data, offsets):
        if len(data) < window:
            return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
        a = np.arange(len(data) - gram + 1)
        return least_grams(Prefix(data).hashes(a, a + gram), offsets, window, gram)

    return find


def _symbols(data, offsets):
    at = np.arange(len(data))
    return data, at, at + 1, offsets


def suffix_order(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of ``data`` at ``at`` by their first ``depth`` bytes (equal ones as given), and how many of these
    each shares with the one before it in that order."""
    rows = np.lib.stride_tricks.sliding_window_view(data, depth)[at]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")
    rows = rows[order]
    shared = np.zeros(len(at), np.int64)
    same = rows[1:] == rows[:-1]
    shared[1:] = np.where(same.all(axis=1), depth, same.argmin(axis=1))
    return order, shared


def previous_factors(shared: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """For suffixes in suffix order the longest beginning that a suffix of a smaller document has as well; 0 where below ``least``.

    The best match is the previous or the next suffix of a smaller document in the order. Every suffix starts at its neighbour and jumps to
    where that one points, until it meets a smaller document or the shared beginning falls below ``least``.
    """
    best = np.zeros(len(docs), np.int64)
    for step in (1, -1):
        d = docs[::step]
        m = shared.copy() if step == 1 else np.concatenate(([0], shared[:0:-1]))
        to = np.arange(len(d)) - 1
        while True:
            on = np.flatnonzero((m >= least) & (d[to] >= d))
            if not len(on):
                break
            m[on], to[on] = np.minimum(m[on], m[to[on]]), to[to[on]]
        best = np.maximum(best, np.where(m >= least, m, 0)[::step])
    return best


def _compare(window: int):
    def compare(t: pa.Table) -> pa.RecordBatch:
        anchor, did, row, first, n = (t.column(k).to_numpy() for k in range(5))
        cells = t.column(5).combine_chunks().dictionary_encode()
        code = cells.indices.to_numpy()
        order = np.lexsort((did, code))
        lead = order[np.flatnonzero(np.diff(code[order], prepend=-1))]  # of each different segment the least document
        least = did[lead]
        whole = np.flatnonzero(did > least[code])
        spans = [(did[whole], row[whole], first[whole], first[whole] + n[whole] + window - 1)]
        _, group, several = np.unique(anchor[lead], return_inverse=True, return_counts=True)
        use = np.flatnonzero(several[group] > 1)
        if len(use):
            data, ends = flat(cells.dictionary.take(pa.array(use)))
            count = n[lead[use]]
            of = np.repeat(np.arange(len(use)), count)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            suffixes, shared = suffix_order(data, ends[:-1][of] + inside, window)
            factor = np.zeros(len(of), np.int64)
            factor[suffixes] = previous_factors(shared, least[use][of[suffixes]], window)
            hit = np.flatnonzero(factor >= window)
            # Neighbouring windows of a segment as one stretch, then for each row that has the segment.
            of, inside = of[hit], inside[hit]
            new = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(inside, prepend=-2) > 1))
            last = np.append(new[1:], len(of))[: len(new)] - 1
            of, a, z = of[new], inside[new], inside[last] + window
            holders = np.flatnonzero(did == least[code])
            holders = holders[np.argsort(code[holders], kind="stable")]
            low, high = (np.searchsorted(code[holders], use[of], side) for side in ("left", "right"))
            again = np.repeat(np.arange(len(of)), high - low)
            who = holders[np.arange(len(again)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[again]]
            spans.append((did[who], row[who], first[who] + a[again], first[who] + z[again]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*spans, strict=True)], names=["did", "row", "start", "end"])

    return compare


def suffix_dedup(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, ``spans`` [(start, end)] of removed bytes, and ``kept`` (the
    remaining bytes; null: as they were)."""
    gram = min(GRAM, window)
    base = keyed(docs)
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    table = settled(base, size, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha"))
    runs = written(shared_runs(table.filter("NOT copy"), _places(window, gram), symbols=size // 14, across=True, least_of=window - gram + 1), "runs")
    spans = repeated_spans(table, runs, _symbols, _compare(window), window=window, across=True)
    discard(runs)

    def cut(batches):
        for b in in_steps(batches):
            out = []
            keys, sizes, copies, shas, texts = (b.column(k).to_pylist() for k in range(5))
            lists = b.column(5)
            for k, (size, copy, whole, text) in enumerate(zip(sizes, copies, shas, texts, strict=True)):
                if copy and size >= window:
                    out.append((size, 1, hashlib.sha256(b"").hexdigest(), [{"start": 0, "end": size}], b""))
                    continue
                at = lists[k]
                if not at.is_valid:
                    out.append((0, 0, whole, [], None))
                    continue
                raw = text.encode()
                s, e = merged(at.values.field(0).to_numpy(), at.values.field(1).to_numpy())
                pairs = list(zip(s.tolist(), e.tolist(), strict=True))
                ends = [0, *(x for p in pairs for x in p), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True))
                out.append((len(raw) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in pairs], kept))
            n, count, sha, at, kept = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(at, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    both = with_lists(table, spans, "at", "start", "end")
    return both.select("doc_id", "n_bytes", "copy", "whole_sha", "text", "at").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept binary"
    )


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup(documents(spark, sf_dir, "doc_id", "text")).drop("spans", "kept")


_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 49] AS k FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d)),
least AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM w JOIN least USING (k) WHERE doc_id > m),
cut AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM cut),
span AS (SELECT doc_id, nth, min(i) AS a, max(i) + 49 AS z FROM run GROUP BY doc_id, nth),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM span
        UNION ALL SELECT span.doc_id, max(z) + 1, max(octet_length(b)) FROM span JOIN d USING (doc_id) GROUP BY span.doc_id),
part AS (SELECT gap.doc_id, gap.a, substr(hex(b), CAST(2 * gap.a - 1 AS BIGINT), CAST(2 * (gap.z - gap.a + 1) AS BIGINT)) AS h FROM gap JOIN d USING (doc_id) WHERE gap.z >= gap.a),
kept AS (SELECT doc_id, string_agg(h, '' ORDER BY a) AS h FROM part GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       CASE WHEN removed IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(h, ''))) END AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE = {"op7_suffix_dedup": _SQL}
