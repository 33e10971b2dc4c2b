"""Operators over whole tables: mixing, line dedup, and the pipeline."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import TEXTS, edge_docs, random_texts
from tidewater.llm import line_dedup, mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing(spark):
    rows = [(i, t, ["b", "a", None, "hot", "hot", "hot", "é"][i % 7]) for i, t in enumerate(random_texts(700, 7))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = lambda x: mixing.plan(x).withColumn("copies", mixing.copies(F.lit(0), F.col("__m"))).collect()
    got = planned(df)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    want = targets(size)
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 2 * 60 for s in want), "within about a document"
    again = {r.doc_id: r.copies for r in planned(df.repartition(3))}
    assert again == {r.doc_id: r.copies for r in got}
    mixed = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert mixed == Counter({k: v for k, v in again.items() if v})


def test_mixing_edges(spark):
    df = edge_docs(spark)
    assert mixing.mix(df).columns == df.columns
    assert mixing.plan(df.limit(0)).count() == 0
    blank = df.filter("n_chars = 1 AND doc_id < 4")
    assert {r.target for r in mixing.plan(blank).collect()} == {0.0} and mixing.mix(blank).count() == 0


def dropped(texts, least):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return ["\n".join(x for x in (t or "").split("\n") if count[key(x)] < least) for t in texts]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
@pytest.mark.parametrize("options", [{}, {"segment_bits": 1 << 11, "filter_mb": 0.0005}])
def test_line_dedup(spark, broadcast, options):
    lines = random_texts(200, 8, 6)
    texts = ["\n".join(lines[(i * j) % (20 + i)] + (" " if j % 2 else "") for j in range(1, 9)) for i in range(60)] + TEXTS + ["  SAME Line \n same line\nx"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dropped(texts, 4)
    got = line_dedup.drop_repeated_lines(df, broadcast_keys=broadcast, min_docs=4, **options).collect()
    assert {r.doc_id: r.kept.decode() for r in got} == dict(enumerate(want))
    assert all(r.n_lines == len((texts[r.doc_id] or "").split("\n")) for r in got)


def test_line_dedup_keeps_first_occurrence(spark):
    df = spark.createDataFrame([(2, "a\nshared\nshared"), (1, "shared\nb\nshared"), (3, "c\n Shared")], "doc_id long, text string")
    for broadcast in (10, 0):
        got = {r.doc_id: r.kept.decode() for r in line_dedup.drop_repeated_lines(df, min_docs=2, keep_first=True, broadcast_keys=broadcast).collect()}
        assert got == {1: "shared\nb", 2: "a", 3: "c"}


def test_line_dedup_edges(spark):
    df = edge_docs(spark)
    assert line_dedup.drop_repeated_lines(df, min_docs=2).count() == df.count()
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = corpus_pipeline.materialise(stage(spark, kept, sf), name)
        assert out.columns == docs.columns and out.exceptAll(kept).isEmpty()
        kept = out
    brute_quality = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in kept.collect()} < brute_quality
    mixed = corpus_pipeline.materialise(corpus_pipeline.STAGES[3][1](spark, kept, sf), "mixed")
    assert mixed.columns == docs.columns and mixed.join(kept, "doc_id", "left_anti").isEmpty()
    index = corpus_pipeline.STAGES[4][1](spark, mixed, sf).orderBy("start").collect()
    assert len(index) == mixed.count() and all(a.start + a.n_tokens == b.start for a, b in zip(index, index[1:]))
    assert hashlib.sha256(repr([r.ids_crc32 for r in index]).encode()).hexdigest()
