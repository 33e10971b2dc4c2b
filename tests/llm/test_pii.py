import re

from tests.llm.helpers import edge_docs
from tidewater.llm import pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            out += [(kind, m.start(), m.end())] * ok
    return out


ODD = [
    "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1111-", "x@y.z..w@q.r", "+1 (555) 555-1234 +12", "é𝒳 a.b@c-d.e-f.gh. 12345678901234567890",
    "5" * 30 + " 4111111111111111", "", "@@ a@@b.c .@a.b", "9 " * 5000, "a." * 3000 + "@" + "b." * 3000 + "c", "1-2-3--4111111111111111 -1", "mail me@x.yz, +44 20 7946 0958; 10.0.0.1.",
]


def test_base_spans(spark):
    found = pii.find_base(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")).collect()
    for r in found:
        assert [(s.kind, s.start, s.stop) for k in pii.KINDS for s in r[k]] == brute(ODD[r.doc_id])


def planted(spark):
    rows = [(i, f"the account of Zephyrine Quill is joe{0}@mail.example.org today with the team") for i in range(6)]
    rows += [(10 + i, f"the weather is fine today with the team number {i}") for i in range(60)]
    rows += [(100, "nothing of Zephyrine here but her name"), (101, "write to other@mail.example.org today with the team")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_reveal_an_entity(spark):
    got = {r.doc_id: {s.value for s in r.terms} for r in pii.find_all(planted(spark)).collect()}
    assert all({"Zephyrine", "Quill", "account"} <= got[i] for i in range(6))
    assert all(not got[i] for i in (*range(10, 70), 100, 101)), "documents without the entity stay as they are"
    assert all("today" not in t and "with" not in t for t in got.values())


def test_sanitised_text(spark):
    text = {r.doc_id: r.text for r in pii.sanitise(planted(spark)).collect()}
    assert "joe0@mail" not in text[0] and "[EMAIL]" in text[0] and "Quill" not in text[0]
    assert text[100].startswith("nothing of Zephyrine")


def test_edges(spark):
    df = edge_docs(spark)
    assert pii.find_all(df).count() == df.count() and pii.sanitise(df).count() == df.count()
    assert pii.find_all(df.limit(0)).count() == 0


def test_pairs_in_one_or_two_documents(spark):
    rows = [(i, f"the weather is fine today with the team number {i}") for i in range(3000)]
    rows += [(5000, "today Ottoline wrote from once@mail.example.org"), (5001, "the team of Barnabas has twice@mail.example.org today"), (5002, "today Barnabas is at twice@mail.example.org")]
    got = {r.doc_id: {s.value: s.kind for s in r.terms} for r in pii.find_all(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5000]["Ottoline"] == "term-generalise"
    assert "Barnabas" in got[5001] and "Barnabas" in got[5002]
    assert not any({"today", "team", "with"} & set(t) for t in got.values())
    assert not any(got[i] for i in range(3000))


def test_terms_far_from_the_entity_and_short_ones(spark):
    far = "the weather is fine today with the team number and so on " * 4
    texts = [f"Li and \U0001d4b3 Ottoline {far}li@mail.example.org {far}Ottoline, Ottoline. Li (+1 555 555 0100)" for _ in range(3)]
    rows = list(enumerate(texts)) + [(1, texts[1])] + [(10 + i, f"{far}{i}") for i in range(500)]
    found = pii.find_all(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        want = {(m.start(), m.end(), m[0]) for m in re.finditer(r"(?<![^\W\d_])(Li|and|Ottoline|\U0001d4b3)(?![^\W\d_])", texts[r.doc_id]) if m[0] != "and"} if r.doc_id < 3 else set()
        assert {(s.start, s.stop, s.value) for s in r.terms} == want
    assert len(found) == len(rows)
