"""Personal data: patterns, and terms that give a protected entity away.

The base finds emails, ip addresses, card numbers and phone numbers by pattern.
Each value found is a protected entity.  Terms in a document that holds an entity may
reveal it even when the value itself is taken out: all its words (runs of letters), of any
length and at any distance.  How strongly is estimated over the corpus, by document
counts: with information content IC(e) = log(N / n_e), a term t tells
PMI(t, e) = log(n_te * N / (n_t * n_e)) of it, and discloses the share PMI / IC.  Every
pair is scored, whatever its support: n_te counts less by `DISCOUNT` (absolute
discounting), so few documents must tell more.  From `GENERALISE` on, the term is
generalised to its kind; from `REMOVE` on it is removed, wherever it stands outside base
spans.  Only documents that hold the entity lose terms.

Built-in functions only.  Texts are read twice (patterns, then the document counts of all
words); only texts that hold an entity are shuffled.  What moves besides is one row per
word of a partition, and one per entity and term, aggregated before they do.

Defined results: a null text counts as empty and has no spans; a null doc_id is passed
through; repeated rows get equal spans and each count as a document; of spans at one place
the stronger verdict on a term holds; texts of any length are taken whole; further columns,
whatever their names, are not looked at; an empty table gives an empty result.  Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import guarded, materialise, pick, table

KINDS = ("email", "ip", "card", "phone")
#: The patterns, written so that neither long runs nor many repeats cost more than linear time or any stack:
#: each starts at a run's first character, or where the last match ended, and repeats single characters only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:(?![ -](?![0-9]))[0-9 -])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this (without a digit, where it is empty) can't match; cheap to look for.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

NOT_LETTERS = r"[^\p{L}]+"
PIECES = r"\p{L}++|\P{L}++"
#: What n_te counts less; shares disclosed from which a term is generalised, and removed.
DISCOUNT = 0.75
GENERALISE = 0.8
REMOVE = 0.95

SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"


def _matches(text: Column, pattern: str, hint: str | None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    test = text.rlike("[0-9]") if hint == "" else F.contains(text, F.lit(hint)) if hint else F.lit(True)
    return F.when(test, found).otherwise(F.array().cast("array<string>"))


#: Numbers that are summed up one by one; longer runs are summed in blocks of so many.
BLOCK = 256


def _starts(pieces: Column, values: Column) -> Column:
    """Offset of every value, from the pieces of text between them; in blocks, so that a text of very many values takes no square of them."""
    steps = F.zip_with(pieces, values, lambda p, v: F.length(p) + F.coalesce(F.length(v), F.lit(0)))
    added = lambda x: F.aggregate(x, F.array(F.lit(0)), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y)))
    cut = F.transform(F.sequence(F.lit(0), F.size(steps) - 1, F.lit(BLOCK)), lambda k: added(F.slice(steps, k + 1, BLOCK)))
    before = F.transform(cut, lambda x: F.element_at(x, -1))
    whole = F.zip_with(cut, added(before), lambda x, base: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: y + base))
    return F.flatten(F.slice(whole, 1, F.size(cut)))


def _located(df: DataFrame, text: str, kind: str, pattern: str, out: str, hint: str | None) -> DataFrame:
    """Adds `out`: all matches of a pattern with their places.  One projection a step, so nothing is searched twice."""
    v, p, s = f"__v_{out}", f"__p_{out}", f"__s_{out}"
    df = df.withColumn(v, _matches(F.col(text), pattern, hint))
    df = df.withColumn(p, F.when(F.size(v) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(s, F.when(F.size(v) > 0, _starts(F.col(p), F.col(v))))
    place = lambda i: F.get(s, i) + F.length(F.get(p, i))
    df = df.withColumn(out, F.transform(v, lambda x, i: F.struct(F.lit(kind).alias("kind"), place(i).alias("start"), (place(i) + F.length(x)).alias("stop"), x.alias("value"))))
    return df.drop(v, p, s)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when((n - i) % 2 == 0, digit).otherwise(twice - F.when(twice > 9, F.lit(9)).otherwise(F.lit(0)))

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(F.lit(False))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _valid(kind: str):
    test = VALID[kind]
    return lambda s: test(s["value"])


def find_base(docs: DataFrame) -> DataFrame:
    """(doc_id, text, email, ip, card, phone): the spans of each kind, in order; text with null as empty."""
    df = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        df = _located(df, "text", kind, PATTERNS[kind], f"__all_{kind}", HINTS[kind])
        df = df.withColumn(kind, F.filter(f"__all_{kind}", _valid(kind))).drop(f"__all_{kind}")
    return df


def _shares(counts: DataFrame, n: float, discount: float) -> DataFrame:
    """Adds `share`, PMI over information content, of counts (n_e, n_t, n_te less the discount) among n documents."""
    pmi = F.ln((F.col("n_te") - discount) * F.lit(n) / (F.col("n_t") * F.col("n_e")))
    return counts.withColumn("share", F.coalesce(F.try_divide(pmi, F.ln(F.lit(n) / F.col("n_e"))), F.lit(0.0)))


def _often(docs: DataFrame) -> DataFrame:
    """(term, n_t) of all words: counted whole and combined before the shuffle; only terms that are candidates meet the join."""
    words = pick(docs, "text").select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), NOT_LETTERS))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n_t"))


def _same_text(left: Column, right: Column) -> Column:
    return left.eqNullSafe(F.col("d2")) & (right == F.col("h2"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"doc_id": "d2", "h": "h2"})


def _with_terms(spans: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, h, base, terms) from the base spans of all rows, and (doc_id, h, start, stop, kind, value) of terms."""
    own = hits.groupBy(F.col("doc_id").alias("d2"), F.col("h").alias("h2")).agg(F.sort_array(F.collect_list(F.struct("kind", "start", "stop", "value"))).alias("terms"))
    df = spans.join(own, _same_text(F.col("doc_id"), F.col("h")), "left")
    return df.select("doc_id", "h", "base", F.coalesce("terms", F.array().cast(SPAN)).alias("terms"))


def _pairs(held: DataFrame) -> DataFrame:
    """(doc_id, h, m, key, n_e, term): the entities of a text with each of its words.  Entities of one text alone share all counts, so one key stands for them."""
    entities = F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    each = held.select("doc_id", "h", "m", F.explode(entities).alias("entity"))
    each = each.join(each.groupBy("entity").agg(F.sum("m").alias("n_e")), "entity")
    key = F.when(F.col("n_e") == F.col("m"), F.concat_ws(":", F.lit("one text"), "h", "doc_id")).otherwise(F.col("entity"))
    keys = _named(each.groupBy("doc_id", "h").agg(F.collect_set(F.struct(key.alias("key"), "n_e")).alias("keys")))
    words = held.select("doc_id", "h", "m", F.array_remove(F.array_distinct(F.split("text", NOT_LETTERS)), "").alias("words"))
    df = words.join(keys, _same_text(F.col("doc_id"), F.col("h"))).select("doc_id", "h", "m", "words", F.explode("keys").alias("k"))
    return df.select("doc_id", "h", "m", "k.key", "k.n_e", F.explode("words").alias("term"))


def _places(held: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(doc_id, h, start, stop, kind, value): all places of the terms of each text, given as (doc_id, h, term, kind), but those in base spans."""
    told = _named(verdicts)
    df = held.join(told.select("d2", "h2").distinct(), _same_text(F.col("doc_id"), F.col("h")), "left_semi")
    df = df.select("doc_id", "h", F.posexplode(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).alias("i", "value"))
    so_far = Window.partitionBy("doc_id", "h").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("stop", F.sum(F.length("value")).over(so_far).cast("int"))
    df = df.join(told, _same_text(F.col("doc_id"), F.col("h")) & (F.col("value") == F.col("term")))
    df = df.select("doc_id", "h", (F.col("stop") - F.length("value")).alias("start"), "stop", "kind", "value")
    df = df.join(_named(held.select("doc_id", "h", "base")), _same_text(F.col("doc_id"), F.col("h")))
    return df.filter(~F.exists("base", lambda s: (s["start"] < F.col("stop")) & (s["stop"] > F.col("start")))).drop("d2", "h2", "base")


def find_all(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, discount: float = DISCOUNT) -> DataFrame:
    """(doc_id, h, base, terms): base spans by kind and start, and the disclosing terms, whose kind says what to do with them."""
    found = find_base(docs).select("doc_id", "text", F.xxhash64("text").alias("h"), F.concat(*KINDS).alias("base"))
    spans = materialise(found.drop("text"), "pii-base")
    n = float(max(spans.count(), 1))
    held = guarded(found).filter("size(base) > 0 AND __row >= 0").groupBy("doc_id", "h")
    held = materialise(held.agg(F.count("*").alias("m"), F.first("text").alias("text"), F.first("base").alias("base")), "pii-held")
    pairs = materialise(_pairs(held), "pairs")
    # Documents that hold a term and any entity are a lower bound of n_t, which rules out common words before all texts are counted.
    words = held.select("m", F.explode(F.array_distinct(F.split("text", NOT_LETTERS))).alias("term"))
    anywhere = words.groupBy("term").agg(F.sum("m").alias("n_t"))
    counted = pairs.groupBy("key", "n_e", "term").agg(F.sum("m").alias("n_te"))
    likely = _shares(counted.join(anywhere, "term"), n, discount).filter(F.col("share") >= generalise)
    likely = materialise(likely.drop("n_t", "share"), "likely")
    told = _shares(likely.join(_often(docs), "term"), n, discount).filter(F.col("share") >= generalise)
    kind = F.when(F.col("share") >= remove, F.lit("term-remove")).otherwise(F.lit("term-generalise"))
    told = told.select("key", "term", kind.alias("kind"))
    # Of a term of two entities the stronger verdict holds.
    verdicts = pairs.join(told, ["key", "term"]).groupBy("doc_id", "h", "term").agg(F.max("kind").alias("kind"))
    return _with_terms(spans, _places(held, materialise(verdicts, "verdicts")))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text): base spans replaced by their kind, disclosing terms generalised or removed.  Of overlapping spans the first holds."""
    found = find_all(docs, **options).select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))).alias("spans"))
    found = found.filter(F.size("spans") > 0).dropDuplicates(["d2", "h2"])
    df = pick(docs, "doc_id", "text")
    df = df.join(found, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("h2")), "left")
    put = lambda s: F.when(s["kind"] == "term-remove", F.lit("")).when(s["kind"] == "term-generalise", F.lit("[TERM]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        told = F.struct(F.concat(a["out"], between, put(s)).alias("out"), s["stop"].alias("at"))
        return F.when(s["start"] < a["at"], a).otherwise(told)

    done = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return df.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done).alias("text"))


def _shown(df: DataFrame) -> DataFrame:
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *(count(k) for k in KINDS), F.sha2(told("base"), 256).alias("base_sha256"), told(F.concat("base", "terms")).alias("spans"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return _shown(find_all(table(spark, sf_dir, "documents")))


def _sql_matches(kind: str, order: int, pattern: str) -> str:
    """SELECT of all matches with their places: pieces between matches and the matches themselves, added up."""
    values = f"regexp_extract_all(t, '{pattern}')"
    window = "PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""SELECT *, CAST(sum(length(p)) OVER ({window} CURRENT ROW) + coalesce(sum(length(v)) OVER ({window} 1 PRECEDING), 0) AS BIGINT) AS a
        FROM (SELECT doc_id, '{kind}' AS kind, {order} AS ord, unnest({values}) AS v, unnest(string_split_regex(t, '{pattern}')[1:len({values})]) AS p, unnest(range(1, len({values}) + 1)) AS i FROM d)"""


_SQL_BASE = " UNION ALL ".join(
    f"({_sql_matches(k, n, p)})"
    for n, (k, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"), ("card", r"[0-9](?:[ -]?[0-9])+"), ("phone", r"\+[0-9][ ().0-9-]+[0-9]")), 1)
)
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, a + length(v) AS b, regexp_replace(v, '[^0-9]', '', 'g') AS g FROM ({_SQL_BASE})),
base AS (SELECT doc_id, kind, ord, v, a, b FROM m WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(g) BETWEEN 8 AND 15
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: CAST(x AS DOUBLE) <= 255))
    ELSE length(g) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 0 THEN CAST(substr(g, i, 1) AS BIGINT)
         ELSE 2 * CAST(substr(g, i, 1) AS BIGINT) - CASE WHEN CAST(substr(g, i, 1) AS BIGINT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 END),
own AS (SELECT DISTINCT doc_id, kind || ':' || v AS entity FROM base),
w AS (SELECT doc_id, unnest(list_distinct(string_split_regex(t, '[^\p{{L}}]+'))) AS term FROM d WHERE doc_id IN (SELECT doc_id FROM own)),
te AS (SELECT entity, term, count(*) AS n_te FROM own JOIN w USING (doc_id) WHERE term <> '' GROUP BY 1, 2),
e AS (SELECT entity, count(*) AS n_e FROM own GROUP BY 1),
nt AS (SELECT term, count(*) AS n_t FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(t, '[^\p{{L}}]+')) AS term FROM d) WHERE term IN (SELECT term FROM te) GROUP BY term),
told AS (SELECT entity, term, coalesce(ln((n_te - {DISCOUNT}::DOUBLE) * n.n / (n_t * n_e)) / nullif(ln(n.n / n_e), 0), 0) AS share FROM te JOIN e USING (entity) JOIN nt USING (term), (SELECT CAST(count(*) AS DOUBLE) AS n FROM d) n),
verdict AS (SELECT doc_id, term, max(CASE WHEN share >= {REMOVE} THEN 'term-remove' ELSE 'term-generalise' END) AS kind FROM told JOIN own USING (entity) JOIN w USING (doc_id, term) WHERE share >= {GENERALISE} GROUP BY 1, 2),
pieces AS (SELECT doc_id, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '\p{{L}}+|\P{{L}}+') AS x FROM d WHERE doc_id IN (SELECT doc_id FROM verdict))),
placed AS (SELECT doc_id, v, CAST(sum(length(v)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b FROM pieces),
terms AS (SELECT x.doc_id, verdict.kind, x.b - length(x.v) AS a, x.b FROM placed x JOIN verdict ON x.doc_id = verdict.doc_id AND x.v = verdict.term
    WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = x.doc_id AND base.a < x.b AND base.b > x.b - length(x.v))),
alls AS (SELECT doc_id, kind, ord, a, b FROM base UNION ALL SELECT doc_id, kind, CASE kind WHEN 'term-generalise' THEN 5 ELSE 6 END, a, b FROM terms),
s AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY ord, a) FILTER (ord < 5) AS base_spans, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY ord, a, b) AS spans FROM alls GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
