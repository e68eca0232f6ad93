"""The pipeline's stages, each against plain Python on what the one before kept."""

import random

import pytest

import corpus_pipeline
from larkspur.llm import toxicity
from larkspur.llm.tokens import encoder

from . import brute
from .test_contracts import ROWS, toxic_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    toxic = toxic_rows(150)
    r = random.Random(9)
    rows = [(2000 + d, t, "fr", r.choice(["s0", "s3", None]), len(t)) for d, t, _ in toxic] + [(d, t, "en", s, None) for d, t, s in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(at / "documents.parquet"))
    labels = [(2000 + d, 1, y) for d, _, y in toxic] + [(d, 1, 0) for d, _, _ in ROWS[:40]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    rows = {r["doc_id"]: r for r in docs.collect()}

    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == columns
    model = toxicity.fit_tables(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    kept = {r["doc_id"]: r for r in clean.collect()}
    assert set(kept) == {d for d in rows if score[d] < 0.5} and all(kept[d] == rows[d] for d in kept)
    assert sum(d >= 2000 and any(w in (rows[d]["text"] or "") for w in ("zonk", "vile", "grunk")) for d in kept) <= 2
    assert len([d for d in kept if d < 2000]) >= len(ROWS) - 3

    clean = clean.cache()
    out = stages["line dedup"](spark, clean, folder)
    assert out.columns == columns
    lined = {r["doc_id"]: r["text"] for r in out.collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    where = {}
    for d, r in kept.items():
        for x in (r["text"] or "").split("\n"):
            where.setdefault(key(x), set()).add(d)
    seen, want = set(), {}
    for d in sorted(kept):
        keep = []
        for x in (kept[d]["text"] or "").split("\n"):
            if not key(x) or len(where[key(x)]) < 10 or key(x) not in seen:
                keep.append(x)
            seen.add(key(x))
        want[d] = "\n".join(keep)
    assert lined == want and want != {d: r["text"] or "" for d, r in kept.items()}

    out = out.cache()
    single = stages["n-gram Jaccard join"](spark, out, folder)
    assert single.columns == columns
    groups = brute.jaccard(list(lined.items()), 5, 80)
    left = {r["doc_id"]: r["text"] for r in single.collect()}
    assert left == {d: t for d, t in lined.items() if groups[d][1] == d} and len(left) < len(lined)

    single = single.cache()
    mixed = stages["mixing"](spark, single, folder)
    assert mixed.columns == columns
    mixed = mixed.cache()
    took, size, held = {}, {}, {}
    source = {d: r["source"] for d, r in rows.items()}
    for d, t in left.items():
        size[source[d]] = size.get(source[d], 0) + len(brute.WORD.findall(t))
    for r in mixed.collect():
        words, whole = brute.WORD.findall(r["text"]), brute.WORD.findall(left[r["doc_id"]])
        assert words == whole[: len(words)] and words
        took[r["source"]] = took.get(r["source"], 0) + len(words)
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + len(words)
    assert all(n <= 2 * len(brute.WORD.findall(left[d])) for d, n in held.items())
    assert abs(sum(took.values()) - 1.5 * sum(size.values())) <= len(size) or all(took[s] <= 2 * size[s] for s in took)

    pieces = stages["packing"](spark, mixed, folder).collect()
    enc = encoder("byte_bpe_50k.json").library
    assert sum(p["length"] for p in pieces) == sum(len(enc.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    ends = {}
    for p in pieces:
        assert p["length"] * 4 == len(p["ids"])
        ends.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for k, spans in ends.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == 2048 or (k == max(ends) and at < 2048)
    for x in (clean, out, single, mixed):
        x.unpersist()


def test_run(spark, folder):
    once = corpus_pipeline.run(spark, folder).collect()
    again = corpus_pipeline.run(spark, folder).collect()
    assert sum(p["length"] for p in once) == sum(p["length"] for p in again) > 0


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
