import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import TEXTS, edge_docs, random_texts
from tidewater.llm import token_shards as ts

PATH = ts.vocabulary_path(ts.VOCABULARY)
WHOLE = Tokenizer.from_file(PATH)
ENCODER = ts.Encoder(PATH)


@given(s.lists(s.integers(0, 10**7), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values):
    values = sorted(values)
    ef, end = ts.EliasFano.from_bytes(memoryview(b := ts.EliasFano.build(np.array(values, dtype=np.uint64)).to_bytes()), 0)
    assert list(ef.all()) == values and end == len(b)
    assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 400, 20_000))
    assert len(ts.EliasFano.build(values).to_bytes()) * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 1


@given(s.lists(s.text(alphabet=" \t\nab'sd.1é  日<|endoftext|>", max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoder_is_the_library(texts):
    assert [list(x) for x in ENCODER.encode(texts)] == [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]


def test_a_full_cache_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(ts, "CACHE", 50)
    encoder = ts.Encoder(PATH)
    for seed in range(4):
        texts = random_texts(30, seed)
        assert [list(x) for x in encoder.encode(texts)] == [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts():
    texts = [t for t in TEXTS if t] + ["a<|endoftext|>b", "  lead", "trail  ", "a \n b", "don't I'll", "x\x1cy z"] + random_texts(20, 1)
    assert [list(x) for x in ENCODER.encode(texts)] == [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_through_files(spark, tmp_path):
    df = edge_docs(spark)
    got = ts.tokenise(df, str(tmp_path / "shards"), shard_ids=50).orderBy("start").collect()
    rows = [(r.doc_id, r[1] or "") for r in df.collect()]
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]], x[1]))
    assert [r.doc_id for r in got] == [k for k, _ in rows]
    at = 0
    for r, (_, text) in zip(got, rows):
        ids = WHOLE.encode(text, add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_random_access():
    shard = ts.Shard(ts.write_shard([3, 3, 9], [np.array(x, np.uint32) for x in ([1, 2, 0], [0], [5, 6, 7, 0])], False))
    assert [shard.doc_id(i) for i in range(3)] == [3, 3, 9] and list(shard.tokens(2)) == [5, 6, 7, 0] and shard.span(1) == (3, 4)
    with pytest.raises(ValueError):
        ts.Shard(b"x" * 100)


def test_empty_table(spark, tmp_path):
    assert ts.tokenise(edge_docs(spark).limit(0), str(tmp_path / "none")).count() == 0
