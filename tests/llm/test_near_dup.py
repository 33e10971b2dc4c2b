import random
import re
from fractions import Fraction
from itertools import combinations
from math import comb

import numpy as np
import pytest

from tests.llm.helpers import TEXTS, edge_docs, random_texts
from tidewater.llm import near_dup
from tidewater.llm.shingles import shingle_set, text_words


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not w else {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def classes(docs, size, percent):
    sets = {}
    for i, t in docs:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, size))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {i: find(i) for i in sets}


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed):
    """Clusters around the threshold, chains of edits, copies, and a passage that a third of the texts share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for c in range(6):
        base = [f"c{c}w{rng.randrange(500)}" for _ in range(rng.choice([12, 40, 150]))]
        for _ in range(rng.randint(2, 9)):
            texts.append(changed(rng, base, rng.randint(0, 3)))
        link = base
        for _ in range(4):
            link = changed(rng, link, 2)
            texts.append(link)
    for k in range(40):
        own = [f"u{k}x{rng.randrange(500)}" for _ in range(rng.choice([5, 20, 100]))]
        texts.append(passage + own)
    texts = [" ".join(t) for t in texts]
    texts += [texts[0].upper(), texts[1], texts[1], *TEXTS]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size,percent,seed", [(3, 85, 1), (5, 80, 2)])
def test_components_match_all_pairs(spark, size, percent, seed):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.link_components(spark.createDataFrame(docs, "doc_id long, text string"), size, percent).collect()}
    want = classes(docs, size, percent)
    assert got == {i: (len(shingles(t, size)), want[i]) for i, t in docs}


@pytest.mark.parametrize("exact", [False, True])
def test_edited_copies_below_the_threshold_lose_no_link(spark, exact):
    """A large group of copies with so many edits that most pairs miss the threshold, and some pairs hold on only to each other."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**6)}" for _ in range(90)]
    texts = [changed(rng, base, rng.randint(0, 9)) for _ in range(60)]
    for _ in range(12):
        far = changed(rng, base, rng.randint(4, 9))
        texts += [far, [w for k, w in enumerate(far) if k not in (5, 50)], changed(rng, far, 1)]
    docs = list(enumerate(" ".join(t) for t in texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.link_components(df, 3, 85, exact=exact).collect()}
    assert got == classes(docs, 3, 85) and 3 < len(set(got.values())) < len(docs)


def test_sketch_bound_is_the_binomial_tail():
    for percent, k in ((85, 64), (80, 64), (85, 1), (50, 10)):
        t, m = Fraction(percent, 100), near_dup.sketch_least(percent, k)
        below = lambda n: sum(comb(k, j) * t**j * (1 - t) ** (k - j) for j in range(n))  # noqa: B023, E731
        assert below(m) < near_dup.MISS <= below(m + 1)


def test_rows_that_share_a_doc_id_are_one_document(spark):
    texts = random_texts(4, 9, 80)
    texts = [t + " tail of the text" for t in texts]
    docs = [(5, texts[0]), (5, texts[1]), (5, texts[2]), (9, texts[1]), (7, texts[2] + " x"), (8, texts[3]), (8, texts[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_dup.link_components(df, 3, 50).collect()}
    assert got == {(5, 5), (9, 5), (7, 5), (8, 8)}
    kept = [tuple(r) for r in near_dup.keep_one(df, 3, 50).collect()]
    assert sorted(kept) == [(5, min(texts[:3])), (8, texts[3])]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7)]
    got = {r.node: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100 + k: 100 for k in range(1, 20)}


def test_edges(spark):
    df = edge_docs(spark)
    out = near_dup.link_components(df).collect()
    assert len(out) == df.count() and [r.component_id for r in out if r.doc_id is None] == [None]
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert near_dup.link_components(df.limit(0)).count() == 0


def test_shingle_numbers_agree_with_word_tuples():
    texts = [t.encode() for t in TEXTS if t] + [b"a b c", b"a  b\tc", b"A B C"]
    sets = [shingle_set(w, 3) for w in text_words(texts)]
    assert [len(s) for s in sets] == [len(shingles(t.decode(), 3)) for t in texts]
    assert np.array_equal(sets[-1], sets[-2]) and np.array_equal(sets[-1], sets[-3])
