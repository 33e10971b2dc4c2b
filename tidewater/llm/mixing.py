"""Mixing sources to target weights by systematic sampling.

Sizes are in words.  Each source gets a target in words; every document of it
then has the same expected number of copies, target / size of the source.  The
documents of a source are put in order, their expected copies are summed along
the order, one random offset is added, and a document is emitted once for every
integer that its stretch of the sum crosses.  So each document is emitted either
the number of times below or above its expectation, and because the order is by
size, the words taken stay within about one document of the target.

A hot source is no problem: its order is dealt by range over many tasks, and only
(doc_id, source, size) is moved for it.

Defined results: null text has size 0; the null source is a source of its own, last in
order; rows equal in doc_id, source and text are sampled one after the other, like any
neighbours in the order; ties in size go by a seeded hash; texts of any length count
whole; a source without words, and any source of a table without words, gets target 0 and
no copies; further columns are carried along, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import WORD, materialise, pick, running_total, table

#: Weights of the sources in code point order, repeating; all they take together over all sizes; and the most that a source gives.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20260101
#: The random offset is a multiple of this, so that sums keep their fractions exactly.
OFFSET_STEPS = 1 << 16
#: Units of a plan that is broadcast, some 100 bytes each.
BROADCAST_UNITS = 200_000


def _size() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, source, text): its size, a hash of the text, and how many rows it stands for."""
    df = pick(docs, "doc_id", "text", "source").select("doc_id", "source", _size().alias("size"), F.xxhash64("text").alias("__h"))
    return df.groupBy("doc_id", "source", "size", "__h").agg(F.count("*").alias("__m"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size, __m).

    Every source's target is min(most * size, level * weight) with one level for
    all.  The level rises as sources reach their bound, so it is found by a few
    sums over the table of sources; only two numbers a round reach the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("__m")).alias("source_size"))
    ranked = running_total(sources, [F.col("source").asc_nulls_last()], F.lit(1).cast("long"), "__rank")
    pattern = F.array(*(F.lit(float(w)) for w in weights))
    ranked = materialise(ranked.select("source", "source_size", F.get(pattern, (F.col("__rank") % len(weights)).cast("int")).alias("__w")), "sources")
    full = most * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).head()[0] or 0
    level = 0.0
    while True:
        bound = full < level * F.col("__w")
        capped, open_weight = ranked.agg(F.sum(F.when(bound, full)), F.sum(F.when(~bound, F.col("__w")))).head()
        if not open_weight:
            break
        risen = (share * total - (capped or 0.0)) / open_weight
        if risen <= level:
            break
        level = risen
    return ranked.select("source", "source_size", F.least(full, F.lit(level) * F.col("__w")).alias("target"))


def plan(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """Each unit with its source's size and target, and what `copies` needs."""
    rows = materialise(units(docs), "sizes")
    goal = targets(rows, **options)
    order = [F.col("size").desc(), F.xxhash64(F.lit(seed), "doc_id", "__h"), F.col("doc_id"), F.col("__h")]
    placed = running_total(rows, order, F.col("__m"), "__before", group="source")
    goal = goal.withColumnRenamed("source", "__source")
    df = placed.join(goal, placed["source"].eqNullSafe(goal["__source"])).drop("__source")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\0null"))), F.lit(OFFSET_STEPS)) / F.lit(float(OFFSET_STEPS))
    return df.withColumn("__rate", rate).withColumn("__offset", offset)


def copies(first: Column | str, rows: Column | int = 1) -> Column:
    """Integers that the sum crosses over `rows` rows of a unit, of which `first` of the unit or others of its source stand before."""
    below = lambda k: F.floor(k * F.col("__rate") + F.col("__offset"))
    first = F.col("__before") + first
    return (below(first + rows) - below(first)).cast("long")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as many times as the plan takes it, with its columns as they are.

    The plan has a row per unit: where Spark finds it small enough it is broadcast, else texts are shuffled once.
    """
    cols = docs.columns
    units = plan(docs, **options).withColumn("__all", copies(F.lit(0), F.col("__m"))).filter("__all > 0")
    chosen = units.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("__h").alias("__t"), "__m", "__all", "__before", "__rate", "__offset")
    chosen = materialise(chosen, "plan")
    several = not chosen.filter("__m > 1").isEmpty()
    if chosen.count() <= BROADCAST_UNITS:
        chosen = F.broadcast(chosen)
    lowered = [c.lower() for c in cols]
    at = {n: F.col(f"__in{cols.index(n) if n in cols else lowered.index(n)}") for n in ("doc_id", "source", "text")}
    plain = docs.toDF(*(f"__in{i}" for i in range(len(cols))))
    same = at["doc_id"].eqNullSafe(F.col("__d")) & at["source"].eqNullSafe(F.col("__s")) & F.xxhash64(at["text"]).eqNullSafe(F.col("__t"))
    wide = plain.join(chosen, same)
    out = wide.select(*plain.columns, F.col("__all").alias("__copies"), "__m")
    if several:
        # Of a unit's rows, those equal in all columns are counted as one, and take their stretch of the unit's sum together.
        whole = wide.filter("__m > 1").groupBy(*wide.columns).agg(F.count("*").alias("__rows"))
        order = Window.partitionBy("__d", "__s", "__t").orderBy(*plain.columns).rowsBetween(Window.unboundedPreceding, -1)
        whole = whole.withColumn("__first", F.coalesce(F.sum("__rows").over(order), F.lit(0)))
        out = out.filter("__m = 1").union(whole.select(*plain.columns, copies(F.col("__first"), F.col("__rows")).alias("__copies"), "__m"))
    out = out.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return out.select(*plain.columns).toDF(*cols)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    df = plan(table(spark, sf_dir, "documents"))
    df = df.withColumn("__row", F.explode(F.sequence(F.lit(0), (F.col("__m") - 1).cast("int"))))
    df = df.withColumn("copies", copies(F.col("__row")))
    return df.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
