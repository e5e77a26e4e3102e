"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target share of all words; a document's expected number of copies is its source's
target over its source's size. The whole part is taken outright. The fractional parts are rounded
dependently: inside a group of about ``GROUP`` documents, largest first, two fractions meet at a
time; one takes mass from the other at random, in proportion, until one of them is 0 or 1, and the
rest goes on. Each group leaves one fraction, which meets those of other groups in a tree of groups,
until one is left in a source and is drawn. So the number of copies, and nearly the number of words,
is kept at every step, and each document's chance is its fraction.

Everything is made of DataFrame functions. Groups are dealt by a hash of doc_id and size, so a source
of any size is spread evenly; of equal rows that would fill a group alone, each is dealt by its number
in the table as well. Draws are hashes, so reruns agree. Fractions are integers of 1 / 2^40,
so no mass is lost to rounding.

Defined cases: null text has size zero; sources of size zero have target zero; a null source is a
source of its own, last in order; documents of size zero take nothing; repeated rows are units of
their own; equal sizes meet in the order of a hash of doc_id and size; a very long text is one unit of
its size; empty tables give empty results; extra columns are ignored by ``mix`` and kept, whatever
their names, by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

GROUP = 256
MOST_COPIES = 3
ONE = 1 << 40
_UNIT = "struct<size:long,tie:long,id:long,p:long>"
_DONE = "array<struct<size:long,id:long,bit:int>>"
_STATE = f"struct<done:{_DONE},open:{_UNIT}>"


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size[, more]): the words of each whole text."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(words, F.lit(0)).cast("long").alias("size"), *more)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, n, source_size, target) with one row per source.

    Sources in code point order weigh ``weights`` in turn. The share for each unit of weight is the
    one at which capped and uncapped targets add up to the whole; it is found on the sources in the
    order in which they reach their cap. Only these sums per source meet in one task.
    """
    sums = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    t = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", F.lit(float(MOST_COPIES)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("share", share).withColumn("fits", F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.col("share")))
    t = t.withColumn("level", F.first("fits", ignorenulls=True).over(everything))
    return t.select("source", "n", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _meet(state: Column, unit: Column) -> Column:
    """Two fractions meet: the open one and the next."""
    held = state["open"]
    a, b = held["p"], unit["p"]
    mass = a + b
    draw = F.xxhash64(held["tie"], unit["tie"], a, b)
    below = F.pmod(draw, F.greatest(mass, F.lit(1))) < a  # the held one takes all
    above = F.pmod(draw, F.greatest(2 * ONE - mass, F.lit(1))) < ONE - b  # the held one becomes whole
    fixed = lambda u, bit: F.array(F.struct(u["size"].alias("size"), u["id"].alias("id"), F.lit(bit).alias("bit")))
    with_mass = lambda u, p: F.struct(u["size"].alias("size"), u["tie"].alias("tie"), u["id"].alias("id"), p.cast("long").alias("p"))
    result = lambda done, rest: F.struct(F.concat(state["done"], done).alias("done"), rest.alias("open")).cast(_STATE)
    less = F.when(below, result(fixed(unit, 0), with_mass(held, mass))).otherwise(result(fixed(held, 0), with_mass(unit, mass)))
    more = F.when(above, result(fixed(held, 1), with_mass(unit, mass - ONE))).otherwise(result(fixed(unit, 1), with_mass(held, mass - ONE)))
    first = F.struct(state["done"].alias("done"), unit.alias("open")).cast(_STATE)
    return F.when(held.isNull(), first).when(mass < ONE, less).otherwise(more)


def _folded(units: DataFrame, name: str) -> DataFrame:
    """Each group's decided units and its open one. ``units``: source, bucket, buckets, unit."""
    start = F.struct(F.array().cast(_DONE).alias("done"), F.lit(None).cast(_UNIT).alias("open")).cast(_STATE)
    groups = units.groupBy("source", "bucket", "buckets").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("all"))
    return materialise(groups.select("source", "bucket", "buckets", F.aggregate("all", start, _meet).alias("s")).select("source", "bucket", "buckets", "s.done", "s.open"), name)


def _unit(size: Column, tie: Column, key: Column, p: Column) -> Column:
    return F.struct(size.cast("long").alias("size"), tie.alias("tie"), key.cast("long").alias("id"), p.cast("long").alias("p")).cast(_UNIT).alias("unit")


def _decided(groups: DataFrame, above: DataFrame) -> DataFrame:
    """(source, size, id, bit) of all units, the open ones by the decisions on their groups."""
    a, g = above.alias("a"), groups.alias("g")
    joined = g.join(a, F.col("g.source").eqNullSafe(F.col("a.source")) & (F.col("g.bucket") == F.col("a.id")))
    last = F.array(F.struct(F.col("g.open.size").alias("size"), F.col("g.open.id").alias("id"), F.col("a.bit").alias("bit"))).cast(_DONE)
    return joined.select(F.col("g.source").alias("source"), F.explode(F.concat("g.done", last)).alias("u")).select("source", "u.size", "u.id", "u.bit")


def _repeated(sizes: DataFrame, group: int) -> DataFrame:
    """(source, doc_id, size, rows) of equal rows that would fill more than a group of their own."""
    return sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")).where(F.col("rows") > group)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), group: int = GROUP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every document."""
    sizes = sized(docs)
    return _mixed(sizes.withColumn("key", F.col("doc_id")), weights, group).withColumnRenamed("key", "doc_id")


def _mixed(sizes: DataFrame, weights: tuple[int, ...], group: int) -> DataFrame:
    """(key, size, source_size, target, taken, copies) of units (key, doc_id, source, size); the key takes no part in a draw."""
    sizes = materialise(sizes.withColumn("number", F.monotonically_increasing_id()), "sizes")
    shares = materialise(targets(sizes, weights), "targets")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = shares.withColumn("whole", F.floor(expected + F.lit(0.5 / ONE))).withColumn("part", F.greatest(F.lit(0), F.round((expected - F.col("whole")) * ONE)).cast("long"))
    s, d = shares.alias("s"), sizes.alias("d")
    known = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.key", "d.doc_id", "d.source", "d.size", "d.number", "s.n", "s.part")
    k, e = known.alias("k"), _repeated(sizes, group).alias("e")
    alike = F.col("k.doc_id").eqNullSafe(F.col("e.doc_id")) & F.col("k.source").eqNullSafe(F.col("e.source")) & (F.col("k.size") == F.col("e.size"))
    known = k.join(e, alike, "left").select("k.*", F.col("e.rows").isNotNull().alias("spread"))
    tie = F.xxhash64("doc_id", "size")
    deal = F.when(F.col("spread"), F.xxhash64("doc_id", "size", "number")).otherwise(tie)
    buckets = F.ceil(F.col("n") / group).cast("long")
    leaf = known.select("source", F.pmod(deal, buckets).alias("bucket"), buckets.alias("buckets"), _unit(F.col("size"), tie, F.col("key"), F.col("part")))
    levels = [_folded(leaf, "rounding")]
    most = -(-(shares.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n) // group)
    while most > 1:
        fewer = F.ceil(F.col("buckets") / group).cast("long")
        up = levels[-1].select("source", F.pmod(F.xxhash64("bucket", F.lit(len(levels))), fewer).alias("b2"), fewer.alias("n2"), _unit(F.col("open.size"), F.xxhash64("bucket"), F.col("bucket"), F.col("open.p")))
        levels.append(_folded(up.select("source", F.col("b2").alias("bucket"), F.col("n2").alias("buckets"), "unit"), "rounding"))
        most = -(-most // group)
    root = levels[-1]
    chosen = root.select("source", F.col("bucket").alias("id"), (F.pmod(F.xxhash64("source", "open.tie"), F.lit(ONE)) < F.col("open.p")).cast("int").alias("bit"))
    for groups in reversed(levels):
        chosen = _decided(groups, chosen)
        chosen = chosen if groups is levels[0] else chosen.select("source", "id", "bit")
    c = chosen.alias("c")
    out = c.join(s, F.col("c.source").eqNullSafe(F.col("s.source")))
    copies = (F.col("s.whole") + F.col("c.bit")).cast("long")
    return out.select(F.col("c.id").alias("key"), "c.size", "s.source_size", "s.target", (copies * F.col("c.size")).alias("taken"), copies.alias("copies"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), group: int = GROUP) -> DataFrame:
    """The documents, each row as often as the mix takes it (columns as in ``docs``).

    Rows are numbered in a written table first, so repeated rows and rows without an id are units of their own.
    """
    rows = materialise(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")), "units")
    sizes = sized(rows.select("row.doc_id", "row.source", "row.text", "key"), "key")
    mixed = _mixed(sizes, weights, group).where("copies > 0").select("key", F.col("copies").cast("int").alias("copies"))
    return rows.join(mixed, "key").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
