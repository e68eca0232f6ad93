"""Packing: deficit round-robin over source queues into windows of equal length.

Each source is a queue of tokens. Every window of ``length`` tokens gives each queue its
target proportion; what a queue could not be given in whole tokens is its deficit, which goes on to
the next window. With the deficits carried without end, the queues' tokens come in the order of their ideal
slots: token t of a queue of n among N tokens wants slot (t + 1/2) N / n. That order has a closed
form (``Schedule``), so any task can say how many tokens each queue has given by the end of any window: windows
and partitions need no pass over what came before, and deficits carry across both.

Texts are encoded once, into a table in the shared folder; each write task numbers its tokens
by queue. One row a (task, queue) then places the tasks in the queues, and the stored ids are cut where windows end.

With target weights of their own, queues empty at different times; the others go on among
themselves at their weights. By default a queue's target is its share of all tokens, so that all
windows have the same mixture to the end. Only the last window can be short.

Defined cases: a null text is the empty text, of the end id alone; null is a source of its own;
rows that repeat are packed each; an empty table gives no pieces.

Every source has a queue of its own, however many there are. Beyond ``max_queues`` sources the order is made in tiers
(``Tiers``): groups of queues by the closed form, then the queues of a group by the same form.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.arrays import portions
from larkspur.llm.common import documents, text_of, written
from larkspur.llm.tokens import encoder


EXACT = 1_400_000_000  # below it products of two counts fit 64 bits


def _below(n: np.ndarray, total: int, x: np.ndarray) -> np.ndarray:
    """Tokens of each queue whose slot is below x: rows of counts by queue."""
    return np.clip(-((total - 2 * n[None, :] * x[:, None]) // (2 * total)), 0, n[None, :])


class Schedule:
    """How many tokens each queue has given when so many were given in all."""

    def __init__(self, counts: list[int], weights: list[float] | None = None):
        self.total = sum(counts)
        dtype = np.int64 if self.total < EXACT else object  # products stay exact
        self.phases, left = [], list(counts)
        if weights is None:
            self.phases.append(left)
        else:
            while any(left):
                time = min(n / w for n, w in zip(left, weights, strict=True) if n)
                took = [n if n <= time * w * (1 + 1e-12) else int(time * w) for n, w in zip(left, weights, strict=True)]
                self.phases.append(took)
                left = [n - t for n, t in zip(left, took, strict=True)]
        self.phases = [np.array(p, dtype) for p in self.phases]
        self.ends = np.cumsum([int(p.sum()) for p in self.phases])
        self.queues = len(counts)

    @staticmethod
    def _merged(n: np.ndarray, given: np.ndarray) -> np.ndarray:
        """The first ``given`` tokens of one phase by ideal slot, ties by queue: rows of counts by queue."""
        total = int(n.sum())

        def below(x):
            return _below(n, total, x)

        low, high = np.maximum(given - len(n) - 1, 0), np.minimum(given + len(n) + 1, total)
        while (low < high).any():  # the last slot below which there are no more than given
            mid = (low + high + 1) // 2
            ok = below(mid).sum(axis=1) <= given
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        out = below(low)
        tied = (below(low + 1) - out) > 0
        rest = (given - out.sum(axis=1))[:, None]
        return out + (tied & (np.cumsum(tied, axis=1) <= rest))

    def given(self, total: np.ndarray) -> np.ndarray:
        """(len(total), queues): tokens of each queue among the first ``total``."""
        total = np.minimum(np.asarray(total, self.phases[0].dtype), self.total)
        out = np.zeros((len(total), self.queues), self.phases[0].dtype)
        start = 0
        for p, end in zip(self.phases, self.ends, strict=True):
            inside = np.minimum(np.maximum(total - start, 0), int(end) - start)
            for i in range(0, len(inside), chunk := max(1, 2_000_000 // self.queues)):
                out[i : i + chunk] += self._merged(p, inside[i : i + chunk])
            start = int(end)
        return out

    def window_of(self, queue: int, token: int, length: int) -> int:
        """The window in which the queue gives its token."""
        low, high = 0, self.total // length
        while low < high:
            mid = (low + high) // 2
            if int(self.given(np.array([(mid + 1) * length]))[0, queue]) > token:
                high = mid
            else:
                low = mid + 1
        return low


class Tiers:
    """The order of many queues: ``fan`` neighbours are a group, its tokens are merged as in ``Schedule``, groups
    likewise. A queue's tokens are found with ``fan`` counts a tier, whatever the number of queues.

    Under weights a phase ends whenever a queue empties; phases are made when they are asked for, a few are kept."""

    def __init__(self, counts: list[int], weights: list[float] | None = None, fan: int = 32):
        self.counts, self.fan, self.total = np.array(counts, np.int64), fan, sum(counts)
        self.weights = None if weights is None else np.array(weights)
        if weights is not None and min(weights) <= 0:
            raise ValueError("weights must be above 0")
        self.times = np.ones(1) if weights is None else np.unique(self.counts / self.weights)
        self.ends = np.array([int(self._until(p).sum()) for p in range(len(self.times))])
        self.kept = {}

    def _until(self, p: int) -> np.ndarray:
        """Tokens of each queue given by the end of phase p."""
        if p < 0:
            return np.zeros_like(self.counts)
        return self.counts if self.weights is None else np.minimum(self.counts, (self.times[p] * self.weights * (1 + 1e-12)).astype(np.int64))

    def _phase(self, p: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Tokens of each queue before the phase; of all queues before each queue; counts in the phase by tier, queues first."""
        if p not in self.kept:
            if len(self.kept) >= 8:
                self.kept.clear()
            before = self._until(p - 1)
            tiers = [self._until(p) - before]
            while len(tiers[-1]) > self.fan:
                tiers.append(np.add.reduceat(tiers[-1], np.arange(0, len(tiers[-1]), self.fan)))
            self.kept[p] = before, np.cumsum(before) - before, tiers
        return self.kept[p]

    def _group(self, tier: np.ndarray, node: int) -> tuple[np.ndarray, int, int]:
        """Counts of the node's group, their sum, and the node's place in it."""
        first = node // self.fan * self.fan
        n = tier[first : first + self.fan]
        total = int(n.sum())
        return n if total < EXACT else n.astype(object), total, node - first

    def given(self, queue: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Among the first ``total`` tokens: those of the queue, and those of all queues before it."""
        total = np.minimum(total, self.total)
        own, lead = np.zeros(len(total), np.int64), np.zeros(len(total), np.int64)
        phase = np.searchsorted(self.ends, total)
        for p in np.unique(phase).tolist():
            before, earlier, tiers = self._phase(p)
            for at in np.array_split(np.flatnonzero(phase == p), 1 + len(total) // 50_000):
                left = total[at] - (self.ends[p - 1] if p else 0)
                lead[at] = earlier[queue]
                for k in reversed(range(len(tiers))):
                    n, in_group, place = self._group(tiers[k], queue // self.fan**k)
                    if not in_group:
                        break  # nothing left to give here
                    t = Schedule._merged(n, left.astype(n.dtype)).astype(np.int64)
                    lead[at] += t[:, :place].sum(axis=1)
                    left = t[:, place]
                own[at] = before[queue] + left
        return own, lead

    def order(self, queue: int, tokens: np.ndarray) -> np.ndarray:
        """The places of the queue's tokens in the order of all."""
        n, w = int(self.counts[queue]), 1.0 if self.weights is None else self.weights[queue]
        until = np.array([n]) if self.weights is None else np.minimum(n, (self.times * w * (1 + 1e-12)).astype(np.int64))
        out = np.zeros(len(tokens), np.int64)
        phase = np.searchsorted(until, tokens, "right")
        for p in np.unique(phase).tolist():
            _, _, tiers = self._phase(p)
            for at in np.array_split(np.flatnonzero(phase == p), 1 + len(tokens) // 50_000):
                t = tokens[at] - (until[p - 1] if p else 0)
                for k, tier in enumerate(tiers):
                    n, total, place = self._group(tier, queue // self.fan**k)
                    cell = ((2 * t.astype(n.dtype) + 1) * total) // (2 * n[place])
                    low = _below(n, total, cell)
                    tied = _below(n, total, cell + 1)[:, :place] - low[:, :place]  # of one cell, earlier queues come first
                    t = (low.sum(axis=1) + tied.sum(axis=1)).astype(np.int64)
                out[at] = t + (self.ends[p - 1] if p else 0)
        return out

    def windows(self, queue: int, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For stretches of the queue's tokens: the windows they are in, the queue's tokens at the borders of these
        (one more), and the tokens of earlier queues in each."""
        first, last = (self.order(queue, np.array([start.min(), (start + n).max() - 1])) // length).tolist()
        if last - first < int(n.sum()):
            w = np.arange(first, last + 1)
        else:
            tokens = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
            w = np.unique(self.order(queue, tokens) // length)
        own, lead = self.given(queue, w * length)
        own_after, lead_after = self.given(queue, (w + 1) * length)
        return w, np.append(own, own_after[-1]), lead_after - lead


def encoded(docs: DataFrame, *, tokenizer: str, end_id: int) -> DataFrame:
    """The stored tokens: doc_id, queue, part, at (tokens of this part and queue before it), n, ids (uint16 or uint32 bytes)."""

    def run(batches):
        part, used, enc = TaskContext.get().partitionId(), {}, encoder(tokenizer)
        for b in batches:
            keys, queues = b.column(0), b.column(1).to_pylist()
            for i, data, offsets in portions(b.column(2)):
                ids, n = enc.encode_ended(data, offsets, end_id)
                j = i + len(n)
                wide = bool(len(ids)) and int(ids.max()) > 65535
                raw = memoryview(ids.astype("<u4" if wide else "<u2")).cast("B")
                size, ends, at = 4 if wide else 2, np.cumsum(n), []
                for q, k in zip(queues[i:j], n.tolist(), strict=True):
                    at.append(used.get(q, 0))
                    used[q] = at[-1] + k
                cells = [bytes(raw[size * (e - k) : size * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(at, pa.int64()), pa.array(n), pa.array(cells, pa.binary())],
                    names=["doc_id", "queue", "part", "at", "n", "ids"],
                )

    rows = docs.select("doc_id", F.col("source").alias("queue"), text_of(docs).alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, queue string, part int, at long, n long, ids binary"), "token_ids")


def pack(
    docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, length: int = 2048,
    weights: dict[str | None, float] | None = None, max_queues: int = 1024, max_broadcast_rows: int = 200_000,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (bytes, little-endian 32-bit).

    weights: target proportions by source (1 where it names none); None: each source's share of all tokens.
    max_queues: more sources than these are merged in tiers.
    """
    stored = encoded(docs, tokenizer=tokenizer, end_id=end_id)
    in_part = stored.groupBy("part", "queue").agg(F.sum("n").alias("in_part"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(in_part.select("part", "queue", "in_part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("base")), "bases")
    totals = bases.groupBy("queue").agg(F.sum("in_part").alias("n")).orderBy(F.col("queue").asc_nulls_first()).toArrow()  # one row a source
    names, counts = totals.column("queue").combine_chunks(), totals.column("n").to_pylist()
    shares = None if weights is None else [float(weights.get(q, 1.0)) for q in names.to_pylist()]
    tiers = Tiers(counts, shares, min(max(max_queues, 2), 32)) if len(counts) > max_queues else None
    plan = Schedule(counts, shares) if counts and tiers is None else None

    def cut(batches):
        for b in batches:
            if not b.num_rows:
                continue
            queue = pc.index_in(b.column(1), value_set=names.cast(b.column(1).type)).to_numpy()
            start, n = b.column(2).to_numpy(), b.column(3).to_numpy()
            by_queue = np.argsort(queue, kind="stable")
            found, firsts = np.unique(queue[by_queue], return_index=True)
            rows_of, spans = dict(zip(found.tolist(), np.split(by_queue, firsts[1:]), strict=True)), {}
            for q in rows_of if tiers is None else ():
                mine = rows_of[q]
                spans[q] = plan.window_of(q, int(start[mine].min()), length), plan.window_of(q, int((start + n)[mine].max()) - 1, length)
            if tiers is None:
                low, high = min(s[0] for s in spans.values()), max(s[1] for s in spans.values())
                together = high - low <= 4 * max(s[1] - s[0] + 1 for s in spans.values())
                table = plan.given(np.arange(low, high + 2) * length) if together else None
            cells, keys = b.column(4), b.column(0)
            for q, rows in rows_of.items():
                if tiers is None:
                    first, last = (low, high) if together else spans[q]
                    t = table if together else plan.given(np.arange(first, last + 2) * length)
                    windows, own = np.arange(first, last + 1), t[:, q].astype(np.int64)
                    lead = np.diff(t[:, :q].sum(axis=1)).astype(np.int64) if q else np.zeros(len(own) - 1, np.int64)
                else:
                    windows, own, lead = tiers.windows(q, start[rows], n[rows], length)
                s, e = start[rows], start[rows] + n[rows]
                w0, w1 = np.searchsorted(own, s, "right") - 1, np.searchsorted(own, e, "left")
                per = w1 - w0
                row = np.repeat(np.arange(len(rows)), per)
                w = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + w0[row]
                a, z = np.maximum(s[row], own[w]), np.minimum(e[row], own[w + 1])
                some = z > a
                row, w, a, z = row[some], w[some], a[some], z[some]
                cells_of = np.searchsorted(np.cumsum(z - a), np.arange(0, int((z - a).sum()), 1 << 19)).tolist()
                for i, j in zip(cells_of, [*cells_of[1:], len(row)], strict=True):
                    crc, out, held, ids = [], [], -1, None
                    for r, x, y in zip(row[i:j].tolist(), (a - s[row])[i:j].tolist(), (z - s[row])[i:j].tolist(), strict=True):
                        if r != held:
                            raw = cells[int(rows[r])].as_py()
                            held, ids = r, np.frombuffer(raw, "<u2" if len(raw) == 2 * n[rows[r]] else "<u4").astype("<u4")
                        out.append(ids[x:y].tobytes())
                        crc.append(zlib.crc32(out[-1]))
                    which = rows[row[i:j]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(which)), pa.array((a - s[row])[i:j]), pa.array((z - a)[i:j]), pa.array(crc, pa.int64()), pa.array(n[which]),
                            pa.array(windows[w[i:j]]), pa.array(lead[w[i:j]] + a[i:j] - own[w[i:j]]), pa.array(out, pa.binary()),
                        ],
                        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
                    )

    if bases.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        bases = F.broadcast(bases)
    b = bases.withColumnsRenamed({"part": "b_part", "queue": "b_queue"})
    placed = stored.join(b, (F.col("part") == F.col("b_part")) & F.col("queue").eqNullSafe(F.col("b_queue")))
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("at")).alias("start"), "n", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op6_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir, "doc_id", "source", "text")).drop("ids")


QUERIES = {"op6_packing": op6_packing}
ORACLE: dict[str, str] = {}
