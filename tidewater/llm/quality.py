"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; a policy is a versioned mask over those bits, so a
new policy or an ablation never reads the texts again.  Only built-in functions
are used: no row ever leaves the JVM, and nothing is shuffled.

Defined results: a null or empty text has no words, no symbols, no lines, and
fails `too_few_words`; a null doc_id is kept as it is; repeated rows are judged
one by one; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import SPACE_RUN, SPACES, guarded, pick

#: Words in a window; a window found twice in a text marks all its words.
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger, and the SQL predicate over the measurements that sets it."""

    name: str
    bit: int
    fails: str


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails any of the named rules."""

    version: str
    rejects: tuple[str, ...]


RULES = (
    Rule("too_few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbol_heavy", 2, "100 * n_symbols > 8 * word_chars"),
    Rule("repeated_lines", 3, "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule("words_too_long", 4, "n_words > 0 AND word_chars > 20 * n_words"),
    Rule("words_too_short", 5, "n_words > 0 AND word_chars < 2 * n_words"),
)
#: The first two rules are the base; every policy for production holds them.
BASE = ("too_few_words", "repeated_windows")
POLICIES = {
    "base-1": Policy("base-1", BASE),
    "2026-01": Policy("2026-01", (*BASE, "symbol_heavy", "repeated_lines", "words_too_long", "words_too_short")),
}
CURRENT = "2026-01"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(policy: Policy, rules: Iterable[Rule] = RULES) -> int:
    by_name = {r.name: r.bit for r in rules}
    return sum(1 << by_name[n] for n in policy.rejects)


def _measured(df: DataFrame) -> DataFrame:
    """Adds the measurements of column `text`.  Each step is a projection of its own, so no long array is built twice."""
    size = lambda c: F.size(c).cast("long")
    empty = F.array().cast("array<string>")
    df = df.withColumn("__t", F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)))
    df = df.withColumn("__w", F.when(F.length("__t") > 0, F.split("__t", SPACE_RUN)).otherwise(empty))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    df = df.withColumn("__l", F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    df = df.withColumns({
        "n_words": size("__w"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": size("__l"),
        "n_dup_lines": size("__l") - size(F.array_distinct("__l")),
        "__k": F.when(
            F.size("__w") > WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("__w") - WINDOW),
                lambda i: F.xxhash64(*(F.get("__w", i + j) for j in range(WINDOW))),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    })
    return df.drop("__w", "__t", "__l")


def _window_repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: the words covered by windows whose key occurs more than once."""
    repeats = F.size("__k") > F.size(F.array_distinct("__k"))
    pair = "array<struct<k:bigint,i:int>>"
    df = df.withColumn("__r", repeats)
    df = df.withColumn("__s", F.when(F.col("__r"), F.sort_array(F.transform("__k", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))).otherwise(F.array().cast(pair)))
    same = lambda s, i, j: F.coalesce(F.get("__s", i + j)["k"] == s["k"], F.lit(False))
    df = df.withColumn("__s2", F.filter("__s", lambda s, i: same(s, i, -1) | same(s, i, 1)))
    df = df.withColumn("__p", F.sort_array(F.transform("__s2", lambda s: s["i"])))
    step = F.transform("__p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(step, F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("__k", "__r", "__s", "__s2", "__p")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each document."""
    return _window_repeats(_measured(pick(docs, "doc_id", "text")).drop("text"))


def failure_bits(rules: Iterable[Rule] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """doc_id, the measurements and `failed`, the bits of the rules that the document fails."""
    return measure(docs).withColumn("failed", failure_bits(rules))


def judge(book: DataFrame, policy: Policy, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The ledger with `kept` under a policy."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy, rules))) == 0)


def ablations(book: DataFrame, policy: Policy, rules: Iterable[Rule] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects (what dropping the rule would win back).

    Works on a histogram of bit patterns, which has 2^rules rows at most.
    """
    whole = mask(policy, rules)
    patterns = book.groupBy("failed").agg(F.count("*").alias("n"))
    active = [r for r in rules if r.name in policy.rejects]
    one = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in active))
    wide = patterns.select("failed", "n", F.explode(one).alias("r")).select("failed", "n", "r.*")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    alone = F.col("failed").bitwiseAND(F.lit(whole)) == F.col("bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return wide.groupBy("rule").agg(count(hit).alias("n_failed"), count(alone).alias("n_only"), F.bit_or(F.when(hit, F.col("failed"))).alias("seen_with"))


def keep_good(docs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The rows of `docs` that the policy keeps, with their columns as they are."""
    cols = docs.columns
    policy = policy or POLICIES[CURRENT]
    spot = cols.index("text") if "text" in cols else [c.lower() for c in cols].index("text")
    plain = docs.toDF(*(f"__in{i}" for i in range(len(cols)))).withColumn("text", F.col(f"__in{spot}"))
    df = _window_repeats(_measured(plain))
    df = judge(df.withColumn("failed", failure_bits()), policy)
    return guarded(df).filter("kept AND __row >= 0").select(*(f"__in{i}" for i in range(len(cols)))).toDF(*cols)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    from tidewater.llm.shared import table

    book = judge(ledger(table(spark, sf_dir, "documents")), POLICIES[CURRENT])
    base = F.col("failed").bitwiseAND(F.lit(mask(POLICIES["base-1"]))) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", F.col("failed").alias("failed_rules")
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
k AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i,
             unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM k),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS j FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END
             + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_symbols > 8 * word_chars THEN 4 ELSE 0 END
             + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN n_words > 0 AND word_chars > 20 * n_words THEN 16 ELSE 0 END
             + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_rules & 3 <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules FROM f
"""
