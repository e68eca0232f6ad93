"""N-gram Jaccard join by prefix trees.

A document is the set of its ``shingle``-word shingles (64-bit hashes). All sets are ordered alike, rare shingles first:
by a frequency sketch of fixed size over the whole corpus, then by hash. Two sets can only reach the similarity
if they share a shingle within their first n - ceil(t n) + 1, the first of which leaves enough to follow; those prefixes meet in buckets (see
anchors), which answer with the shingles that several documents hold.

Equal sets collapse to one before anything is compared. The texts of the others that share a prefix are written once, bucketed by document: pairs
move to them, they don't move again. Then, in rounds, each shared shingle names pivots among its documents,
the one with most shared shingles and four others at first, four times as many each round, and every document of another component is compared with them.
Comparing is a walk of a prefix tree: the documents to compare with a pivot are stored as
a trie of their ordered shingles (sorted, with the length of the path shared with the one before); the walk
carries the overlap along shared paths and leaves a subtree once the shingles that remain can't make up the
overlap. Documents found similar unite; a shingle whose documents are in one component is done with,
as is a pivot. After the last round every pair that shares a prefix shingle was compared or is linked through others: the
components are those of the full join, without its pairs.

Defined cases: upper-case A-Z are lower case; null and empty texts and texts without a word have the empty set, linked
with nothing; fewer words than a shingle are one shingle. Rows that share a doc_id (null: the least one) are versions of one
document and in one component, each compared by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.anchors import keyed, shared_runs
from larkspur.llm.arrays import U, Prefix, by_document, lower_ascii, mix, portions, word_prefix, words
from larkspur.llm.common import discard, documents, written, written_in_buckets
from larkspur.llm.components import components

#: Counters of the frequency sketch: 4 MB whatever the corpus.
SKETCH_BITS = 20
_PARTS = 16
_LEAST = -(1 << 63)


def doc_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's different shingles by hash, on end, and the offsets of the documents."""
    low = lower_ascii(data)
    starts, ends, by_doc = words(low, offsets)
    prefix = word_prefix(Prefix(low).hashes(starts, ends))
    at, doc = by_document(by_doc, shingle)
    n = np.diff(by_doc)
    short = np.flatnonzero((n > 0) & (n < shingle))
    h = np.concatenate([prefix.hashes(at, at + shingle), prefix.hashes(by_doc[short], by_doc[short + 1])])
    doc = np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    cut = np.searchsorted(doc, np.arange(len(n) + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate(([0], np.cumsum(new)))[cut]


def _sums(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, U)
    np.cumsum(x, out=total[1:])
    return total[cut[1:]] - total[cut[:-1]]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (did, row, doc_id, n, s1, s2) of documents: size and fingerprint of the set; rows (part, counts) of each task's sketch."""

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for i, data, offsets in portions(b.column(3)):
                h, cut = doc_sets(data, offsets, shingle)
                sketch += np.bincount((h >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
                k = len(cut) - 1
                cols = [pa.array(x.view(np.int64)) for x in (_sums(mix(h), cut), _sums(mix(h ^ U(0xA5A5A5A55A5A5A5A)), cut))]
                none = [pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, k) for c in range(3)), pa.array(np.diff(cut)), *cols, *none], names=names)
        if sketch.any():
            size = len(sketch) // _PARTS
            cells = [sketch[k * size : (k + 1) * size].astype("<u4").tobytes() for k in range(_PARTS)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(_PARTS, pa.int64()) for _ in range(6)), pa.array(range(_PARTS), pa.int32()), pa.array(cells, pa.binary())], names=names)

    names = ["did", "row", "doc_id", "n", "s1", "s2", "part", "counts"]
    return docs.select("did", "row", "doc_id", "text").mapInArrow(run, "did long, row long, doc_id long, n long, s1 long, s2 long, part int, counts binary")


def _sketch(rows: DataFrame) -> np.ndarray:
    """The tasks' sketches added up part by part: _PARTS rows of fixed size reach the driver."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(c, "<u4").astype(np.int64)
                sums[k] = sums[k] + x if k in sums else x
        if sums:
            cells = [np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(cells, pa.binary())], names=["part", "counts"])

    kind = "part int, counts binary"
    parts = rows.filter("part IS NOT NULL").select("part", "counts")
    total = parts.mapInArrow(add, kind).repartition("part").mapInArrow(add, kind)
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    size = len(out) // _PARTS
    for r in total.collect():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["counts"], "<u4")
    return out


def ordered(h: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Positions of a set's shingles in the global order: rare first."""
    return np.lexsort((h, sketch[(h >> U(64 - SKETCH_BITS)).astype(np.int64)]))


def _prefixes(shingle: int, percent: int, sketch):
    def find(data, offsets):
        h, cut = doc_sets(data, offsets, shingle)
        counts = sketch.value
        tokens, docs, places, sizes = [], [], [], []
        for d, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            n = b - a
            if n:
                k = n - (percent * n + 99) // 100 + 1
                x = h[a:b]
                tokens.append(x[ordered(x, counts)[:k]])
                docs.append(np.full(k, d))
                places.append(np.arange(k))
                sizes.append(np.full(k, n))
        if not tokens:
            return (np.zeros(0, U), *(np.zeros(0, np.int64),) * 3)
        return tuple(np.concatenate(x) for x in (tokens, docs, places, sizes))

    return find


class Trie:
    """Ordered sets as paths that share their beginnings; ``search`` finds those similar to another set."""

    def __init__(self, sets: list[np.ndarray], sketch: np.ndarray):
        self.sketch = sketch
        paths = []
        for k, h in enumerate(sets):
            h = h[ordered(h, sketch)]
            ranks = sketch[(h >> U(64 - SKETCH_BITS)).astype(np.int64)]
            both = np.empty(len(h), [("r", ">u4"), ("h", ">u8")])
            both["r"], both["h"] = ranks, h
            paths.append((both.tobytes(), k, h))
        paths.sort(key=lambda p: p[:2])
        self.paths = [(k, h) for _, k, h in paths]
        self.shared = [0]
        for (_, x), (_, y) in zip(self.paths[:-1], self.paths[1:], strict=True):
            n = min(len(x), len(y))
            other = np.flatnonzero(x[:n] != y[:n])
            self.shared.append(int(other[0]) if len(other) else n)

    def search(self, query: np.ndarray, percent: int, block: int = 64) -> list[int]:
        """Numbers of the sets with 100 * intersection >= percent * union. query: hashes in ascending order."""
        found, size = [], len(query)
        least = -(-percent * size // 100)  # no similar set shares less
        place = np.empty(size, np.int64)
        place[ordered(query, self.sketch)] = np.arange(size)
        overlap, passed, dead = np.zeros(1, np.int64), np.zeros(1, np.int64), None
        for (k, path), shared in zip(self.paths, self.shared, strict=True):
            if dead is not None and shared >= dead:
                continue  # the walk gave up above the fork
            dead = None
            depth = min(shared, len(overlap) - 1)
            overlap, passed = overlap[: depth + 1], passed[: depth + 1]
            need = max(least, -(-percent * (size + len(path)) // (100 + percent)))
            while depth < len(path):
                got, gone = int(overlap[-1]), int(passed[-1])
                if got + size - gone < least:
                    dead = depth  # whatever the rest of the path, or of those that share it
                    break
                if got + min(len(path) - depth, size - gone) < need:
                    break
                tail = path[depth : depth + block]
                at = np.minimum(np.searchsorted(query, tail), size - 1)
                hit = query[at] == tail
                overlap = np.concatenate([overlap, got + np.cumsum(hit)])
                passed = np.concatenate([passed, np.maximum(gone, np.maximum.accumulate(np.where(hit, place[at] + 1, 0)))])
                depth += len(tail)
            else:
                both = int(overlap[-1])
                if 100 * both >= percent * (size + len(path) - both):
                    found.append(k)
        return found


def similar_pairs(pairs: DataFrame, texts: DataFrame, *, shingle: int, percent: int, sketch, chunk: int = 64) -> tuple[DataFrame, list[DataFrame]]:
    """pairs (a, b) -> those that are similar, either way round, and the tables to discard when that is written. texts: bucketed by did; the pairs move to them.

    Of a pair the document of more pairs is searched for, in chunks of the tries of the others, so a document that meets many isn't read
    once for each: among P pairs none is held in more than sqrt(2 P) tries.
    """
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    degrees = written(degrees, "pair_degrees")  # so that a frequent document's rows can be split in the joins
    of_a, of_b = (degrees.select(F.col("node").alias(f"{x}_node"), F.col("degree").alias(f"{x}_degree")) for x in "ab")
    both = pairs.join(of_a, F.col("a") == F.col("a_node")).join(of_b, F.col("b") == F.col("b_node"))
    turned = (F.col("b_degree") > F.col("a_degree")) | ((F.col("b_degree") == F.col("a_degree")) & (F.col("b") < F.col("a")))
    chunks = F.ceil(F.greatest("a_degree", "b_degree") / chunk).cast("int").alias("chunks")
    turned = both.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), chunks)
    part = F.pmod(F.xxhash64("b"), F.col("chunks").cast("long")).cast("int")
    held = written(turned.select("a", part.alias("part"), F.lit(1).alias("kind"), "b"), "asked")
    asked = held.union(held.select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b")).distinct())
    rows = texts.join(asked.hint("shuffle_hash"), F.col("b") == F.col("did")).select("a", "part", "kind", "b", "text")

    def sets(texts_):
        out = []
        for _, data, offsets in portions(pa.array(texts_, pa.large_string())):
            h, cut = doc_sets(data, offsets, shingle)
            out += [h[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return out

    def compare(batches):
        key, queries, ids, held = None, [], [], []

        def close():
            hits = set()
            if held and queries:
                trie = Trie(sets(held), sketch.value)
                for q in sets(queries):
                    hits.update(ids[k] for k in trie.search(q, percent))
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(hits), pa.int64()), pa.array(sorted(hits), pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, part, kind, b, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (a, part) != key or len(held) >= 4 * chunk:
                    if key is not None:
                        yield close()
                    if (a, part) != key:
                        queries = []
                    key, ids, held = (a, part), [], []
                if kind:
                    ids.append(b)
                    held.append(text)
                else:
                    queries.append(text)
        if key is not None:
            yield close()

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "kind").mapInArrow(compare, "a long, b long"), [degrees, held]


def jaccard_components(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, and ``did`` (doc_id, a null as the least integer)."""
    base = keyed(docs)
    signed = written(signatures(base, shingle), "signatures")
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(signed))  # of fixed size
    rows = signed.filter("part IS NULL").select("did", "row", "doc_id", "n", "s1", "s2")
    told = rows.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = told[0] or 0
    first = rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("did").alias("rep"), F.count(F.lit(1)).alias("times"))
    firsts = written(first.filter("times > 1").drop("times"), "copies")
    reps = rows.join(firsts, ["n", "s1", "s2"], "left").select("did", "row", "doc_id", "n", F.coalesce("rep", "did").alias("rep"))
    reps = written(reps, "representatives")
    discard(signed, firsts)
    versions = reps.filter("n > 0").groupBy("did").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("times"))
    links = [written(reps.filter("n > 0").join(versions.filter("times > 1").select("did", "a"), "did").select("a", F.col("rep").alias("b")), "links")]
    copies = reps.filter("did != rep").select("did", "row").distinct()

    runs = shared_runs(base, _prefixes(shingle, percent, sketch), symbols=total * (100 - percent) // 100 + 1, across=True)
    runs = written(runs.join(copies, ["did", "row"], "left_anti").select("did", "row", "anchor", "n", F.col("first").alias("place")), "runs")
    # One plan at every size: the texts move once, also where the list of candidates would be small enough to broadcast.
    # They are dealt by the key of the buckets, so that a task writes whole buckets and not a file in each.
    some = runs.select("did").distinct().hint("shuffle_hash")
    texts = base.join(some, "did", "left_semi").select("did", "text")
    texts = written_in_buckets(texts, "texts", ("did",), base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] >> 24 if told[1] else 1)
    shared = runs.drop("row")
    # Documents with many shared shingles in their prefix are the middle of a group: good pivots.
    degrees = shared.groupBy("did").agg(F.count(F.lit(1)).alias("degree"))
    rows_left = written(shared.join(degrees, "did").withColumn("comp", F.col("did")), "prefixes")
    discard(runs)
    comp = None
    pivots = 4
    # Each round takes four times as many pivots; when all documents of a shingle are pivots nothing is left.
    while True:
        middle = F.max(F.struct("degree", "did")).alias("middle")
        sizes = rows_left.groupBy("anchor").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"), middle)
        sizes = sizes.filter("low != high").select("anchor", "size", F.col("middle.did").alias("middle"))
        drawn = F.pmod(F.xxhash64(F.lit(3), "did"), F.lit(1 << 30)) * F.col("size") < F.lit(pivots << 30)
        live = written(rows_left.join(sizes, "anchor").withColumn("pivot", drawn | (F.col("did") == F.col("middle"))).drop("middle"), "live")
        if not live.limit(1).count():
            break
        a, b = live.filter("pivot").alias("a"), live.alias("b")
        apart = (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.comp") != F.col("b.comp"))
        sizes_fit = (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & (~F.col("b.pivot") | (F.col("a.did") < F.col("b.did")))
        # At the first shingle that two sets share, only what follows can be shared as well. (At a later one
        # the bound is too low, but then the pair is told by the first.)
        follow = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
        enough = (100 + percent) * follow >= percent * (F.col("a.n") + F.col("b.n"))
        pairs = written(a.join(b, apart & sizes_fit & enough).select(F.col("a.did").alias("a"), F.col("b.did").alias("b")).distinct(), "pairs")
        found, unused = similar_pairs(pairs, texts, shingle=shingle, percent=percent, sketch=sketch)
        links.append(written(found, "links"))
        discard(pairs, *unused)
        edges = links[0]
        for x in links[1:]:
            edges = edges.union(x)
        comp = components(edges)
        rows_left_, left = rows_left, live.filter(~F.col("pivot")).select("did", "anchor", "n", "place", "degree")
        rows_left = left.join(comp, F.col("did") == F.col("node"), "left").select("did", "anchor", "n", "place", "degree", F.coalesce("comp", "did").alias("comp"))
        done, rows_left = rows_left_, written(rows_left, "prefixes")
        discard(live, done)
        pivots *= 4
    if comp is None:
        comp = components(links[0])
    named = reps.join(comp, F.col("rep") == F.col("node"), "left").select("did", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("c"))
    return named.select("did", "doc_id", "n_shingles", F.when(F.col("c") != _LEAST, F.col("c")).alias("component_id"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir, "doc_id", "text"), shingle=4, percent=85).drop("did")


_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pair JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 85 * (a.n + b.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON reach.r = edge.x)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN reach ON d.doc_id = reach.doc_id GROUP BY d.doc_id
"""
QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLE = {"op5_jaccard_join": _SQL}
