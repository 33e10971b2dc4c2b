"""Operators that judge each text by itself: chats, token counts, licences, decontamination."""

import random
import re

import numpy as np
import pytest

from tests.llm.helpers import TEXTS, edge_docs, random_texts
from tidewater.llm import chat, decontam, licences, token_counts

# ------------------------------------------------------------------- chats


def transcripts(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.3:
            rows.append((c, 0, "system", "Be brief and kind."))
        for k in range(rng.randint(1, 5)):
            rows.append((c, 2 * k + 1, "user", rng.choice(["How so?", "Tell me more\nof it, please.", "Why is that?"])))
            rows.append((c, 2 * k + 2, "assistant", "\n".join(f"Line {i} of the answer goes on at some length here." for i in range(rng.randint(1, 4)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.blocks(df).withColumn("style", chat.style_of())


def test_roles_of_held_out_chats(spark):
    model = chat.train(transcripts(spark, 1, 120))
    got = chat.format_chats(transcripts(spark, 2, 60), model).toPandas()
    assert got.n_right.sum() >= 0.97 * got.n_lines.sum()
    assert (got.n_found == got.n_turns).mean() > 0.95


def test_rendering_keeps_the_words(spark):
    model = chat.train(transcripts(spark, 1, 120))
    long = "Line 1 of the answer goes on at some length here.\nLine 2 of the answer goes on at some length here."
    turns = chat.parse(model, f"User: How so?\nAssistant: {long}\nUser: Why is that?")
    assert turns == [("user", "How so?"), ("assistant", long), ("user", "Why is that?")]
    assert chat.canonical(turns).count("<|end|>") == 3


def test_viterbi_is_the_best_path(spark):
    from itertools import product

    model = chat.train(transcripts(spark, 3, 40))
    seen = chat.features("Q: why?\nA: so.\nmore of it\n\nwell then".split("\n"))

    def score(path):
        told = sum(model.emit[k][s].get(v, model.floor[k][s]) for s, x in zip(path, seen) for k, v in enumerate(x))
        return model.start[path[0]] + sum(model.step[a][b] for a, b in zip(path, path[1:])) + told

    best = max(score(p) for p in product(range(len(chat.STATES)), repeat=len(seen)))
    assert score(model.path(seen)) == pytest.approx(best)


def test_chat_edges(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (2, 1, "narrator", "hm"), (3, 10**6, "user", "x" * 10000)], "conv_id long, turn long, role string, text string")
    t = chat.blocks(df).withColumn("style", chat.style_of())
    assert chat.format_chats(t, chat.train(t)).count() == 4
    none = t.limit(0)
    assert chat.format_chats(none, chat.train(none)).count() == 0


# ------------------------------------------------------------ token counts


def greedy(word, first, later):
    at = n = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in (later if at else first)), None)
        if size is None:
            return None
        at, n = at + size, n + 1
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(4)
    for _ in range(200):
        first = {"_" + "".join(rng.choices("abc", k=rng.randint(0, 4))) for _ in range(6)}
        later = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(6)}
        a = token_counts.LongestMatch(first, later)
        for _ in range(20):
            w = "_" + "".join(rng.choices("abc", k=rng.randint(0, 8)))
            assert a.count(w) == greedy(w, first, later)


def test_counts_of_texts(spark):
    a = token_counts.load(__import__("public_tokenizers").path(token_counts.VOCABULARY))
    df = edge_docs(spark)
    texts = {r.doc_id: r[1] for r in df.collect() if r.doc_id not in (3, 7)}
    for r in token_counts.count_tokens(df).collect():
        if r.doc_id in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
            each = [a.count(token_counts.MARK + x) for x in w]
            assert (r.n_words, r.n_tokens, r.n_unknown) == (len(w), sum(1 if n is None else n for n in each), each.count(None))
    assert token_counts.count_tokens(df.limit(0)).count() == 0


# ---------------------------------------------------------------- licences


def test_matching_statistics():
    rng = random.Random(5)
    for _ in range(60):
        seqs = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(4)]
        parts = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        sa = licences.SuffixAutomaton(seqs)
        text = [rng.randrange(4) for _ in range(40)]
        state = length = 0
        for i, token in enumerate(text):
            state, length = sa.step(state, length, token) if any(token in s for s in seqs) else (0, 0)
            assert length == max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in parts), default=0)
            if length:
                own = tuple(text[i + 1 - length : i + 1])
                assert sa.ends[state] == {(k, e) for k, s in enumerate(seqs) for e in range(len(s)) if tuple(s[max(0, e + 1 - length) : e + 1]) == own}


def test_base_places_and_spans(spark):
    texts = ["Released under the MIT License.", "under the MIT-license, UNDER THE MIT LICENSE", "Licensed under the Apache License, Version 2.0 (the x)", "cc by-nc", "no licence", licences.TEMPLATES[0][1].replace("merge", "melt"), *TEXTS]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        want = sorted((k, label) for p, label in licences.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert got[i].n_words == len(w) and [(b.word, b.label) for b in got[i].base] == want
    assert [(s.label, s.first, s.last) for s in got[5].spans] == [("mit", 0, 66)] and got[5].spans[0].cover > 0.95
    assert not got[4].spans


def test_licence_edges(spark):
    df = edge_docs(spark)
    assert licences.scan(df).count() == df.count() and licences.scan(df.limit(0)).count() == 0


# --------------------------------------------------------- decontamination


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for j, p in enumerate(pattern, 1):
        new = [j]
        for i, t in enumerate(text, 1):
            new.append(min(row[i - 1] + (p != t), row[i] + 1, new[i - 1] + 1))
        row = new
    return min(row)


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randrange(50)) for _ in range(rng.randint(6, 14)))) for k in range(12)]
    docs = []
    for k in range(60):
        item = rng.choice(items)[1]
        out = list(item)
        for _ in range(rng.choice([0, 1, 3, 8, 20])):
            spot = rng.randrange(len(out))
            out[spot] = rng.choice(["", "q", out[spot] + "z"])
        noise = random_texts(2, k, 30)
        docs.append((k, f"{noise[0]} {''.join(out)}! {noise[1]}"))
    docs += [(100 + k, t) for k, t in enumerate(random_texts(20, 9))]
    fold = lambda t: bytes(decontam.normal(np.frombuffer(t.encode(), np.uint8))[0])
    want = set()
    for d, text in docs:
        for i, item in items:
            p = fold(item)
            if len(p) <= decontam.WINDOW and edit_distance_within(p, fold(text)) <= min(len(p) * decontam.EDITS // 100, (len(p) - decontam.Q) // decontam.Q):
                want.add((d, i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()}
    assert got == want and len(want) > 20
    clean = {r.doc_id for r in decontam.decontaminate(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_long_items_and_cut_passages(spark):
    item = " ".join(f"word{i * 7919 % 1000}" for i in range(100))
    docs = [(1, "intro " + item), (2, item[:420]), (3, item[150:430] + " tail"), (4, "clean text of other words")]
    got = {r.doc_id for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1, 2, 3}


def test_cut_passages_of_every_offset(spark):
    rng = random.Random(11)
    texts = {n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))[: n - 1] + "x" for n in (50, 63, 150, 201, 450)}
    least = decontam.PASSAGE
    docs, want = [], {}
    for n, text in texts.items():
        for start in range(n - least + 1):
            cut = text[start : start + least].strip()
            if len(cut) == least:
                want[len(docs)] = n
                docs.append((len(docs), f"Intro zz{cut.upper()}zz tail {start}", cut))
    for n in (201, 450):
        want[len(docs)] = n
        docs.append((len(docs), "before; " + texts[n][:183] + "; after", texts[n][:183]))
    short = len(docs)
    docs += [(short + k, f"Intro zz{texts[450][7 * k : 7 * k + least - 1]}zz tail", "") for k in range(57)]
    df = spark.createDataFrame(docs, "doc_id long, text string, cut string")
    bench = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    got = decontam.find_leaks(df, bench).collect()
    assert {r.doc_id: r.item_id for r in got} == want
    assert all(docs[r.doc_id][1][r.start : r.stop].lower() == docs[r.doc_id][2] for r in got if r.item_id not in (50, 63) and r.edits == 0)
    assert {r.doc_id for r in decontam.decontaminate(df, bench).collect()} == set(range(short, len(docs)))


def test_decontamination_edges(spark):
    df = edge_docs(spark)
    bench = spark.createDataFrame([(None, "one two three four five six seven eight nine ten"), (1, None), (2, "short")], "item_id long, text string")
    assert {r.doc_id for r in decontam.find_leaks(df, bench).collect()} == {len(TEXTS) - 1}
    out = decontam.decontaminate(df, bench)
    assert out.columns == df.columns and out.count() == df.count() - 1
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0 and decontam.find_leaks(df.limit(0), bench).count() == 0
