import re
from collections import Counter

from tests.llm.helpers import TEXTS, edge_docs, random_texts
from tidewater.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    keys = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if keys[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    texts = TEXTS + random_texts(40, 3) + ["a b c d e " * 4, "x\nx\n x\n\n\nx", "a b c d e f a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.ledger(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), repr(texts[r.doc_id])[:80]


def test_policies_share_a_ledger(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "good words " + " ".join(f"w{i}" for i in range(20))), (3, "### " * 30)], "doc_id long, text string")
    book = quality.ledger(df)
    kept = lambda p: {r.doc_id for r in quality.judge(book, quality.POLICIES[p]).filter("kept").collect()}
    assert kept("base-1") == kept("2026-01") == {2}
    found = {r["rule"]: (r.n_failed, r.n_only) for r in quality.ablations(book, quality.POLICIES["2026-01"]).collect()}
    assert found["too_few_words"] == (1, 1) and found["symbol_heavy"][0] == 1 and found["symbol_heavy"][1] == 0


def test_edges(spark):
    df = edge_docs(spark)
    assert quality.ledger(df).count() == df.count()
    out = quality.keep_good(df)
    assert out.columns == df.columns and out.count() < df.count()
    assert quality.ledger(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0
