"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function maps shingles to 64-bit numbers; a text's sketch is the k
smallest of its set.  The steps:

1. Texts with equal sets form a class, a node of what follows.
2. Inverted lists hold, for a retained value, the nodes that retain it.  Two nodes
   at the threshold have at least `sketch_least` values of their sketches in common,
   but for a chance below one in a million, so a node that shares fewer with all
   others together is alone, and the others enter only the lists of their rarest
   values, as many as guarantee a common one (a prefix filter in order of rarity).
3. The leader of a list is its node with the smallest part of shingles that no other
   candidate has: in a group of edited copies, the one closest to what they were
   copied from.  Every node of a list meets its leader on full sets.  Pairs that
   reach the threshold are links; links join components.
4. Two nodes a, b under one leader L that are still in different components are
   compared only if they can be alike.  Let x be the size of a node's difference to L, u
   the part of it that no other candidate has, r = x - u.  The unshared parts can't
   meet and the others differ by |r_a - r_b| at least, so
       |a symmetric difference b| >= u_a + u_b + |r_a - r_b|,
   which rules out nearly all pairs of a large group of edited copies whose differences
   are their own.  What is left passes the union sketch (the k smallest of both) and
   then the exact comparison of full sets.

Components are found by alternating star contraction over the links, each round
written to the shared folder.  Nothing of the kind is gathered on the driver, and no
step lists all pairs of a group.

With `exact`, sketches are whole sets: candidate search then misses nothing, for more
work and disk.

Defined results: texts without words, and null ones, have the empty set and are
linked with nothing; a null doc_id is never linked and keeps a null component;
rows that share a doc_id are one document with several texts, linked with whatever
one of them is; repeated rows get equal results; texts of any length are taken whole, in
pieces of bounded memory; ties of leaders go by a hash of the set and don't change the
result; further columns, whatever their names, are not looked at; an empty table gives
an empty result.  doc_id must be an integer or text that casts to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import byte_runs, drop_tables, materialise, pick, small_batches, table
from tidewater.llm.shingles import shingle_set, text_words

K = 64
#: The chance that a pair at the threshold has fewer values in common than `sketch_least` asks for is below this.
MISS = 1e-6
BROADCAST_IDS = 1_000_000
#: Bands of the bound in step 4, so that a node meets only those that its own bound allows: so many, with four to a doubling.
BANDS = 16


@lru_cache(maxsize=64)
def sketch_least(percent: int, k: int) -> int:
    """The most values m such that a union sketch of k has fewer than m in common with a chance below MISS, at the threshold.

    By the binomial tail, which is above that of drawing without return.
    """
    t, tail = percent / 100, 0.0
    for m in range(k + 1):
        tail += comb(k, m) * t**m * (1 - t) ** (k - m)
        if tail >= MISS:
            return m
    return k


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _text_sets(docs: DataFrame, words: int, k: int | None, whole: bool) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, values): the size of each set, two hashes that name it, and its k smallest values (all, if `whole`)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in byte_runs(batches, 1):
            sets = [shingle_set(w, words) for w in text_words(batch.column(1).to_pylist())]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            kept = sets if whole or k is None else [s[:k] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), _lists(kept)],
                names=["doc_id", "n_shingles", "set_a", "set_b", "values"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, values array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def sketches(docs: DataFrame, words: int, k: int | None = K) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, values) of every row; k = None keeps whole sets."""
    return _text_sets(_texts(docs), words, k, False)


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """What `sketches` gives, with whole sets, of the documents in ids(of)."""
    own = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return _text_sets(_texts(docs).join(own, F.col("doc_id") == F.col("of"), "left_semi"), words, None, True)


def _prefixes(nodes: DataFrame, percent: int, k: int | None) -> DataFrame:
    """(node, lists): the values whose lists each node enters, of those nodes that may be linked at all."""
    n = F.col("n_shingles")
    exact = F.ceil(n * percent / F.lit(100.0)).cast("int")
    # Up to a set of k * percent / 100 its partners' sets are within the sketch, too, and nothing is left to chance.
    least = exact if k is None else F.when(100 * n <= percent * k, exact).otherwise(F.lit(sketch_least(percent, k)))
    values = nodes.select("node", least.alias("least"), F.explode("values").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    held = values.join(often, "value").groupBy("node", "least").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("v"))
    # Values that one node alone retains are the rarest and make no list; of the shared ones, all but least - 1 head the order.
    held = held.filter(F.size("v") >= F.col("least"))
    return held.select("node", F.transform(F.slice("v", F.lit(1), F.size("v") - F.col("least") + 1), lambda x: x["value"]).alias("lists"))


def _reaches(common: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges(a, b) reaches, by alternating large and small stars."""
    spark, last = edges.sparkSession, None
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, F.col("u") == F.col("c"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialise(small, "edges")
        drop_tables(spark, last)
        last = edges
        # Done once every node is either the end of one edge or the centre of a star.
        roles = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("centre")).union(edges.select("v", F.lit(0), F.lit(1)))
        roles = roles.groupBy("n").agg(F.sum("child").alias("child"), F.max("centre").alias("centre"))
        if roles.filter("child > 1 OR (child > 0 AND centre > 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _placed(df: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    """Adds `out`: the component that each node has so far, itself if none."""
    named = labels.select(F.col("node").alias("__of"), F.col("component").alias("__in"))
    return df.join(named, F.col(node) == F.col("__of"), "left").withColumn(out, F.coalesce("__in", node)).drop("__of", "__in")


def _facts(own: DataFrame, percent: int) -> DataFrame:
    """(node, n, alone, rank): set size and shingles that no other candidate has, of the nodes that the rest could link."""
    values = own.select("node", F.explode("values").alias("value")).groupBy("value").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    alone = values.filter("c = 1").groupBy("node").agg(F.count("*").alias("u")).withColumnRenamed("node", "of")
    df = own.select("node", F.col("n_shingles").alias("n"), "set_a").join(alone, F.col("node") == F.col("of"), "left")
    df = df.select("node", "n", F.coalesce("u", F.lit(0)).cast("long").alias("alone"), "set_a").filter(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))
    return df.select("node", "n", "alone", F.struct((F.col("alone") / F.col("n")).alias("part"), "set_a").alias("rank"))


def _stars(prefixes: DataFrame, facts: DataFrame, own: DataFrame) -> DataFrame:
    """(node, n, alone, lead, n_lead, common): every node with the leaders of its lists, and the size of their intersection."""
    lists = prefixes.join(facts, "node").select(F.explode("lists").alias("key"), "node", "n", "alone", "rank")
    heads = lists.groupBy("key").agg(F.min(F.struct("rank", "node", "n")).alias("m")).select("key", F.col("m.node").alias("lead"), F.col("m.n").alias("n_lead"))
    met = lists.join(heads, "key").filter("node <> lead").select("node", "n", "alone", "lead", "n_lead").distinct()
    met = met.join(own.select("node", F.col("values").alias("x")), "node")
    met = met.join(own.select(F.col("node").alias("of"), F.col("values").alias("y")), F.col("lead") == F.col("of"))
    return met.select("node", "n", "alone", "lead", "n_lead", F.size(F.array_intersect("x", "y")).cast("long").alias("common"))


def _rest(stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs under one leader, in different components, that the bound of step 4 lets through."""
    # With p the threshold, a difference d is small enough if (100 + p) d <= (100 - p)(|a| + |b|).  In these units, and the bound
    # above written as the larger of high_a + low_b and high_b + low_a, both of these must be 0 at most.
    differs = F.col("n") + F.col("n_lead") - 2 * F.col("common")
    shared = differs - F.col("alone")
    room = (100 - percent) * F.col("n")
    df = stars.select("lead", "node", "n", "n_lead", ((100 + percent) * differs - room).alias("high"), ((100 + percent) * (F.col("alone") - shared) - room).alias("low"))
    df = materialise(_placed(_placed(df, labels, "node", "at"), labels, "lead", "home").withColumn("out", F.col("at") != F.col("home")), "entries")
    # One of each pair is outside its leader's component, hence not linked with it, hence its `high` is above 0.
    unit = (100 - percent) * F.col("n_lead").cast("double")
    band = lambda x: F.least(F.lit(BANDS - 1), F.greatest(F.lit(0), F.floor(4 * F.log2(F.greatest(x / unit, F.lit(1e-9)))))).cast("int")
    seeks = df.filter("out").select("lead", F.col("node").alias("a"), F.col("n").alias("na"), F.col("high").alias("ha"), F.col("low").alias("la"), F.col("at").alias("ca"), F.explode(F.sequence(band(F.col("high").cast("double")), F.lit(BANDS - 1))).alias("band"))
    least = df.filter("out").groupBy("lead").agg(F.min("high").alias("least"))
    other = df.join(least, "lead").filter(F.col("low") + F.col("least") <= 0)
    other = other.select("lead", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("high").alias("hb"), F.col("low").alias("lb"), F.col("at").alias("cb"), F.col("out").alias("ob"), band(-F.col("low").cast("double")).alias("band"))
    fits = (F.col("ha") + F.col("lb") <= 0) & (F.col("hb") + F.col("la") <= 0) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = seeks.join(other, ["lead", "band"]).filter(fits & (F.col("ca") != F.col("cb")) & (~F.col("ob") | (F.col("a") < F.col("b")))).select("a", "b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, nodes: DataFrame, own: DataFrame, percent: int, k: int | None) -> DataFrame:
    """The pairs (a, b) whose union sketch, and then whose full sets, reach the threshold."""
    if k is not None:
        met = pairs.join(nodes.select(F.col("node").alias("a"), F.col("values").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("values").alias("y")), "b")
        met = met.withColumn("union", F.slice(F.array_sort(F.array_union("x", "y")), 1, k))
        size = F.size("union")
        least = F.when(size < k, F.ceil(size * percent / F.lit(100.0))).otherwise(F.lit(sketch_least(percent, k)))
        # A value of the union sketch that either holds is in its own sketch.
        pairs = met.filter(F.size(F.array_intersect("union", F.array_intersect("x", "y"))) >= least).select("a", "b")
    full = pairs.join(own.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("values").alias("x")), "a")
    full = full.join(own.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("values").alias("y")), "b")
    return full.filter(_reaches(F.size(F.array_intersect("x", "y")), F.col("na"), F.col("nb"), percent)).select("a", "b")


def _same_document(named: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(a, b): the nodes of texts that share a doc_id, or None where none do."""
    sets = F.struct("set_a", "set_b")
    several = named.groupBy("doc_id").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi")).filter("lo <> hi").select(F.col("doc_id").alias("of"), "lo")
    several = materialise(several, "several")
    if several.isEmpty():
        return None
    key = lambda c: nodes.select(F.col("node").alias(c), F.struct("set_a", "set_b").alias(f"set_{c}"))
    met = named.select("doc_id", sets.alias("own")).join(several, F.col("doc_id") == F.col("of")).select("own", "lo").distinct()
    return met.join(key("a"), F.col("own") == F.col("set_a")).join(key("b"), F.col("lo") == F.col("set_b")).select("a", "b")


def _label(docs: DataFrame, named: DataFrame, nodes: DataFrame, words: int, percent: int, k: int | None) -> DataFrame | None:
    """(node, component) of the nodes that have links, or None where nothing has."""
    spark = docs.sparkSession
    same = _same_document(named, nodes)
    prefixes = materialise(_prefixes(nodes, percent, k), "prefixes")
    some = materialise(nodes.join(prefixes.select("node"), "node", "left_semi"), "candidates")
    if some.isEmpty():
        return None if same is None else components(same)
    sets = full_sets(docs, some.select(F.col("doc").alias("of")).distinct(), words).drop("doc_id", "n_shingles")
    own = materialise(some.drop("values").join(sets, ["set_a", "set_b"]), "sets")
    if not own.groupBy("node").count().filter("count > 1").isEmpty():
        own = materialise(own.dropDuplicates(["node"]), "sets")
    facts = materialise(_facts(own, percent), "facts")
    stars = materialise(_stars(prefixes, facts, own), "stars")
    links = stars.filter(_reaches(F.col("common"), F.col("n"), F.col("n_lead"), percent)).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    labels = components(links if same is None else links.union(same))
    rest = materialise(_rest(stars, labels, percent), "rest")
    late = materialise(_confirmed(rest, some, own, percent, k), "links")
    if not late.isEmpty():
        joined = _placed(_placed(late, labels, "a", "ca"), labels, "b", "cb")
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(joined.select("ca", "cb")))
    drop_tables(spark, prefixes, some, own, facts, stars, rest, late)
    return labels


def link_components(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs."""
    kept = None if exact else k
    every = materialise(sketches(docs, words, kept), "sketches")
    named = every.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc"), F.count("*").alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("values").alias("values"))
    # Numbers given once and written: whatever order they are in, a node keeps its own.
    nodes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    labels = _label(docs, named, nodes, words, percent, kept)
    light = nodes.select("set_a", "set_b", "doc", "rows", "node")
    if labels is None:
        placed = light.filter("rows > 1").select(F.col("set_a").alias("pa"), F.col("set_b").alias("pb"), F.col("doc").alias("found"))
    else:
        named_by = labels.select(F.col("node").alias("of"), "component").union(labels.select("component", "component").distinct())
        joined = light.join(named_by, F.col("node") == F.col("of"), "left").filter("rows > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
        least = joined.groupBy("component").agg(F.min("doc").alias("found")).withColumnRenamed("component", "c2")
        placed = joined.join(least, F.col("component") == F.col("c2")).select(F.col("set_a").alias("pa"), F.col("set_b").alias("pb"), "found")
    placed = materialise(placed, "placed")
    drop_tables(docs.sparkSession, nodes)
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    joined = every.drop("values").join(placed, (F.col("set_a") == F.col("pa")) & (F.col("set_b") == F.col("pb")) & linked, "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, **options) -> DataFrame:
    """One row of docs for each component: one with its smallest doc_id, of repeated ones the one with the least text.

    Rows without words or without a doc_id all stay.
    """
    cols = docs.columns
    at = {name: cols.index(name) if name in cols else [c.lower() for c in cols].index(name) for name in ("doc_id", "text")}
    labels = link_components(docs, words, percent, **options)
    gone = materialise(labels.filter("doc_id <> component_id").select(F.col("doc_id").alias("of")).distinct(), "gone")
    many = materialise(labels.filter("n_shingles > 0 AND doc_id = component_id").groupBy(F.col("doc_id").alias("of")).agg(F.count("*").alias("c")).filter("c > 1").select("of"), "repeated")
    plain = docs.toDF(*(f"__in{i}" for i in range(len(cols))))
    key, text = F.col(f"__in{at['doc_id']}"), F.col(f"__in{at['text']}")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    plain = plain.join(gone, key.cast("long") == F.col("of"), "left_anti")
    if many.isEmpty():
        return plain.toDF(*cols)
    # Rows of one doc_id: the least text with a word stays, once.  Rows are numbered by what they hold, so a rerun keeps an equal row.
    words_in = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = plain.join(many, (key.cast("long") == F.col("of")) & words_in, "left_semi")
    one = one.groupBy(key.alias("__id")).agg(F.min_by(F.struct(*plain.columns), F.struct(text, F.xxhash64(*plain.columns))).alias("r")).select("r.*")
    rest = plain.join(many, (key.cast("long") == F.col("of")) & words_in, "left_anti")
    return rest.union(one).toDF(*cols)


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    df = link_components(table(spark, sf_dir, "documents"), words=3, percent=85)
    return df.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: All pairs that share a shingle, and a walk over their links; for small tables.
OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reached) AS component_id, r.doc_id = min(reached) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
