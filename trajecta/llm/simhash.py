"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments, fewer than a plain pigeonhole for two differing bits
would need. Two fingerprints at most two bits apart agree in one segment (the other then differs by
at most two bits), or differ by exactly one bit in each. So each fingerprint is indexed under both
exact segments and under the 32 one-wildcard variants of the first; equality joins on these keys find
every link, and each candidate is verified.

A bucket of at most ``BUCKET`` fingerprints is compared inside. A larger one is split exactly, without
pairs: its members are keyed again by variants of the other segment such that equal keys imply a
link (two wildcards beside an exact segment, one beside a one-wildcard segment), and each
sub-bucket's members link to its smallest. No link between different fingerprints is lost and no cap
is set. Equal fingerprints are one node from the start, so copies never meet as pairs.

``keep_similar`` links texts by the Jaccard similarity of their word shingles instead. At 0.8 two
fingerprints differ by about ten bits of 64, which no segment of useful width survives, so the links
above are only its first generator. Its second is complete: with shingles in any one order, two sets
of that similarity share ``SHARED`` of the first ``n - ceil(0.8 n) + SHARED`` of each (or all, in tiny
sets). The shingles of each set are also counted in ``BINS`` bins: counts that differ by more than two
similar sets can rule a candidate out, and every other is checked on the whole sets. Sets of sizes m
and n have ``ceil(0.8 (m + n) / 1.8)`` in common, and so share more of their first shingles the nearer
their sizes are: all that are due must be there before a pair is made.

A shingle that more than ``CROWD`` sets are found under makes no pairs. Its sets are compared by way of
a centre, the shingles that most of them have: if d(x) is what x and the centre don't have in common,
x and y differ in ``|d(x)| + |d(y)| - 2 |d(x) & d(y)|`` shingles. So two sets near enough to the centre
are similar for certain and link to the nearest; any other similar pair has shingles of its own in both
differences, as many as their sizes make due, and is found under the first of these, the rarest of the
crowd leading. Every centre finds the same links, a good one with fewer pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .components import connected_components
from .store import bound_batches, discard, materialise

SEED = 42
SHINGLE = 3
BUCKET = 32
#: Of ``keep_similar``.
SIMILAR_SHINGLE = 5
SIMILARITY = (4, 5)
SHARED = 3
FREQUENT = 1 << 16
BINS = 64
#: Sets under one shingle that are compared by pairs; the centre of more is made from about ``SAMPLE`` of them.
CROWD = 32
SAMPLE = 256
CENTRE = 1024
#: Whole sets are dealt out in rounds of an eighth of all sets, or of ``ROUND`` shingles where that is more.
ROUNDS = 8
ROUND = 1 << 23
#: Keys that a broadcast may have (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
_FEED = 1 << 16


def shingle_hashes(data: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the lower-cased word shingles, repeats included, some at a time; none without words."""
    words = data.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    ends, starts = end[k - 1 :].tolist(), start[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), _FEED):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _FEED], ends[at : at + _FEED], strict=True)], np.uint64)


def _majority(hashes: Iterator[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Bit majority over the shingles' hashes; 0 without words."""
    return _majority(shingle_hashes(data, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): one row per document; null and blank texts get fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            fp = np.array([fingerprint(part.text_bytes(i), shingle) for i in range(part.n)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _wildcards(width: int, n: int) -> list[int]:
    """Masks of ``width`` bits with ``n`` bits cleared."""
    full = (1 << width) - 1
    if n == 1:
        return [full ^ (1 << i) for i in range(width)]
    return [full ^ (1 << i) ^ (1 << j) for i in range(width) for j in range(i)]


def _variants(segment: Column, masks: list[int]) -> Column:
    """An array of (mask number, masked segment) from the segment under each mask."""
    return F.transform(F.sequence(F.lit(0), F.lit(len(masks) - 1)), lambda i: F.struct(i.alias("mask"), segment.bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), i + 1)).alias("value")))


def _merged(rows: DataFrame) -> DataFrame:
    """Rows that no join may broadcast: Spark takes exploded rows for as many as there were before, and packed columns for their size in files."""
    return rows.hint("merge")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints that connect all those at most two bits apart.

    ``fps``: distinct fingerprints in column fp.
    """
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    one = _wildcards(32, 1)
    keys = F.concat(
        F.array(F.struct(F.lit(-1).alias("mask"), low.alias("value")), F.struct(F.lit(-2).alias("mask"), high.alias("value"))),
        _variants(low, one),
    )
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.mask", "k.value")
    sizes = keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(_merged(keyed).join(sizes, ["mask", "value"]), "buckets")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= 2

    small = shared.where(F.col("n") <= BUCKET).groupBy("mask", "value").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    small = small.select("all", F.posexplode("all").alias("i", "a"))
    small = small.select("a", F.explode(F.filter(F.slice("all", F.col("i") + 2, BUCKET), lambda b: near(F.col("a"), b))).alias("b"))

    large = shared.where(F.col("n") > BUCKET)
    low_, high_ = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    two = _wildcards(32, 2)
    other = F.when(F.col("mask") == -1, high_).otherwise(low_)
    exact = large.where("mask < 0").select("fp", "mask", "value", F.explode(_variants(other, two)).alias("sub"))
    wild = large.where("mask >= 0").select("fp", "mask", "value", F.explode(_variants(high_, one)).alias("sub"))
    stars = []
    for keyed_again in (exact, wild):
        heads = keyed_again.groupBy("mask", "value", "sub").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        stars.append(_merged(keyed_again).join(heads, ["mask", "value", "sub"]).where("fp <> b").select(F.col("fp").alias("a"), "b"))
    return small.unionByName(stars[0]).unionByName(stars[1])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): every document with the smallest doc_id reachable over links.

    Defined cases: null, empty and blank texts share fingerprint zero and link like any other;
    repeated rows each get a row; a null doc_id gets a class but never names one (a class of null
    ids only has a null id); empty tables give empty results; extra columns are ignored.
    """
    found = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The document with the smallest doc_id of every class, with all its columns.

    Of rows with equal doc_id one stays. A document without an id names no class and stays.
    """
    return _least_of_class(docs, near_duplicates(docs, shingle))


def _least_of_class(docs: DataFrame, classes: DataFrame) -> DataFrame:
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    one = named.join(kept, named.doc_id == kept["_id"], "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def _shingle_set(data: bytes, shingle: int) -> tuple[np.ndarray, int, int]:
    """A text's sorted distinct shingles, the set's own hash, and the text's fingerprint."""
    h = list(shingle_hashes(data, shingle))
    own = np.unique(np.concatenate(h)).view(np.int64) if h else np.zeros(0, np.int64)
    return own, xxhash.xxh64_intdigest(own.tobytes(), SEED), _majority(h)


def shingle_sets(docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(doc_id, h, fp, id, n, bins): a hash of the text, its fingerprint, and its shingle set's hash, size and counts by bin.

    The sets themselves are made again from the text where they are needed, which is cheaper than to keep them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            fp, ids, size, bins = np.zeros(part.n, np.uint64), np.zeros(part.n, np.uint64), np.zeros(part.n, np.int64), np.zeros((part.n, BINS), np.int8)
            for i in range(part.n):
                own, ids[i], fp[i] = _shingle_set(part.text_bytes(i), shingle)
                size[i] = len(own)
                bins[i] = np.bincount(own & (BINS - 1), minlength=BINS).clip(max=127)
            binned = pa.ListArray.from_arrays(pa.array(np.arange(part.n + 1, dtype=np.int32) * BINS), pa.array(bins.ravel()))
            yield pa.RecordBatch.from_arrays([part.batch.column(0), part.batch.column(1), pa.array(fp.view(np.int64)), pa.array(ids.view(np.int64)), pa.array(size), binned], ["doc_id", "h", "fp", "id", "n", "bins"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return own.mapInArrow(run, "doc_id long, h long, fp long, id long, n long, bins array<tinyint>")


def _frequent_shingles(docs: DataFrame, shingle: int) -> list[int]:
    """The shingles that most of a sixteenth of the texts have (``FREQUENT`` at most), most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            own = [_shingle_set(part.text_bytes(i), shingle)[0] for i in range(part.n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own))], ["key"])

    sample = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0)
    counts = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    return [r.key for r in counts.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()]


def _first_shingles(docs: DataFrame, frequent: list[int], shingle: int) -> DataFrame:
    """(id, n, key): the shingles under which a set is found, frequent ones last.

    ``frequent``, most frequent first, only sets the order: any order finds the same links.
    """
    known = np.array(frequent, np.int64)
    by_hash = np.argsort(known)
    model = docs.sparkSession.sparkContext.broadcast((known[by_hash], len(known) - by_hash))
    least, whole = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = model.value
        for part in T.slices(batches):
            ids, sizes, keys = [], [], []
            for i in range(part.n):
                own, name, _ = _shingle_set(part.text_bytes(i), shingle)
                common = -(-least * len(own) // whole)
                first = len(own) - common + min(SHARED, common)
                rank = np.zeros(len(own), np.int64)
                if len(hashes) and len(own):
                    near = np.searchsorted(hashes, own).clip(max=len(hashes) - 1)
                    rank = np.where(hashes[near] == own, ranks[near], 0)
                keys.append(own[np.argsort(rank, kind="stable")[:first]])
                ids.append(name)
                sizes.append(len(own))
            count = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.uint64).view(np.int64), count)), pa.array(np.repeat(np.array(sizes, np.int64), count)), pa.array(np.concatenate(keys))], ["id", "n", "key"])

    return docs.select("text").mapInArrow(run, "id long, n long, key long")


def _among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted; ``wanted``, a written table, is broadcast only if it is small."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, key, "left_semi")


def _whole_sets(own: DataFrame, docs: DataFrame, shingle: int, name: str) -> DataFrame:
    """(id, set): the whole sets of the texts with the hashes h of ``own``."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            made = [_shingle_set(part.text_bytes(i), shingle) for i in range(part.n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([x[1] for x in made], np.uint64).view(np.int64)), pa.array([x[0].tobytes() for x in made], pa.binary())], ["id", "set"])

    texts = materialise(own.select("h").distinct(), name)
    sets = _among(docs.select(F.xxhash64("text").alias("h"), "text"), texts, "h").dropDuplicates(["h"])
    return sets.select("text").mapInArrow(sets_of, "id long, set binary").dropDuplicates(["id"])


def _centres(members: DataFrame) -> DataFrame:
    """(group, size, keys, counts): the shingles that most of a sample of each group have, and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = np.frombuffer(own.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), group)), pa.array(keys)], ["group", "key"])

    sample = members.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * F.col("all") < SAMPLE << 20).select("group", "set")
    sizes = sample.groupBy("group").agg(F.count("*").alias("size"))
    counts = sample.mapInArrow(run, "group long, key long").groupBy("group", "key").agg(F.count("*").alias("n")).where("n > 1")
    most = counts.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "key"))).where(F.col("r") <= CENTRE)
    most = most.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("k"))
    return materialise(most.join(sizes, "group").select("group", "size", F.col("k.key").alias("keys"), F.col("k.n").alias("counts")), "centres")


def _differences(members: DataFrame) -> DataFrame:
    """(group, id, class, n, d, slack, at, key): each set's first differences from its group's centre, and one row with ``at`` -1.

    ``d`` is the number of all its differences. Two sets are similar if and only if their slacks add
    up to no more than ``2 * (least + whole)`` times the differences they have in common.
    """
    least, whole = SIMILARITY
    scale, room = whole + least, whole - least
    columns = ["group", "id", "class", "n", "d", "slack", "at", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in columns]
            known: dict[int, tuple] = {}
            sets, keys, counts, sizes = (batch.column(batch.schema.get_field_index(x)) for x in ("set", "keys", "counts", "size"))
            for i, (group, name, of) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if group not in known:
                    k, n, size = (keys[i].values.to_numpy(), counts[i].values.to_numpy(), sizes[i].as_py()) if keys[i].is_valid else (np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
                    known[group] = k, np.minimum(n, size - n), k[2 * n > size]
                k, rare, centre = known[group]
                own = np.frombuffer(sets[i].as_buffer(), np.int64)
                apart, n = np.setxor1d(own, centre, assume_unique=True), len(own)
                rank = np.zeros(len(apart), np.int64)
                if len(k) and len(apart):
                    near = np.searchsorted(k, apart).clip(max=len(k) - 1)
                    rank = np.where(k[near] == apart, rare[near], 0)
                slack = scale * len(apart) - room * n
                nearest = min(max(len(centre), -(-least * n // whole)), whole * n // least)  # the size of the partner that may need fewest
                fewest = max(1, -(-(slack + scale * abs(nearest - len(centre)) - room * nearest) // (2 * scale)))
                first = apart[np.argsort(rank, kind="stable")[: max(0, len(apart) - fewest + 1)]]
                for column, x in zip(out, (group, name, of, n, len(apart), slack), strict=False):
                    column.append(np.full(len(first) + 1, x))
                out[6].append(np.arange(-1, len(first)))
                out[7].append(np.concatenate([np.zeros(1, np.int64), first]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], columns)

    own = members.join(_centres(members), "group", "left").select("group", "id", "class", "set", "keys", "counts", "size")
    return own.mapInArrow(run, ", ".join(f"`{x}` long" for x in columns))


def _rounds(found: DataFrame, shingles: int) -> int:
    """How many rounds bound what so many shingles of whole sets take on disk by a share of all sets."""
    every = found.agg(F.sum("n").alias("n")).first().n or 0
    return max(1, -(-shingles // max(ROUND, every // ROUNDS)))


def _in_round(key: str, k: int, rounds: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(rounds)) == k


def _crowd_pairs(crowded: DataFrame, found: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(a, b): pairs that connect all similar sets of two classes under a key of ``crowded(id, key, class)``.

    A group's sets are compared in one round, and what they take on disk goes with it.
    """
    most = crowded.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "class")).alias("m"))
    members = materialise(crowded.join(most.select("key", F.col("m.class").alias("group")), "key").select("group", "id", "class").distinct(), "crowds")
    members = members.join(members.groupBy("group").agg(F.count("*").alias("all")), "group")
    names = materialise(members.select("id").distinct(), "crowds")
    own = _among(found.select("id", "h", "n"), names, "id").groupBy("id").agg(F.min(F.struct("h", "n")).alias("s"))
    members = materialise(members.join(own.select("id", "s.*"), "id"), "crowds")
    rounds = _rounds(found, members.agg(F.sum("n").alias("n")).first().n or 0)
    return reduce(DataFrame.unionByName, [_pairs_of_groups(members.where(_in_round("group", k, rounds)), docs, shingle) for k in range(rounds)])


def _pairs_of_groups(members: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``_crowd_pairs`` of the groups of ``members(group, id, class, all, h)``."""
    least, whole = SIMILARITY
    sets = _whole_sets(members, docs, shingle, "crowds")
    members = materialise(members.select("group", "id", "class", "all").join(sets, "id"), "crowds")
    rows = materialise(_differences(members), "differences")
    discard(members)

    every = rows.where("at < 0").select("group", "id", "slack")
    nearest = every.groupBy("group").agg(F.min(F.struct("slack", "id")).alias("m"))
    certain = every.join(nearest, "group").where((F.col("slack") + F.col("m.slack") <= 0) & (F.col("id") != F.col("m.id"))).select(F.col("id").alias("a"), F.col("m.id").alias("b"))

    same = Window.partitionBy("group", "key")
    shared = rows.where("at >= 0").withColumn("low", F.min("class").over(same)).withColumn("high", F.max("class").over(same)).where("low <> high").drop("low", "high")
    shared = materialise(shared, "differences")
    side = lambda c: shared.select("group", "key", *[F.col(x).alias(f"{c}_{x}") for x in ("id", "class", "n", "d", "slack", "at")])
    slack = F.col("a_slack") + F.col("b_slack")
    due = F.ceil(slack / (2 * (least + whole)))
    alike = (F.col("a_id") < F.col("b_id")) & (F.col("a_class") != F.col("b_class")) & (whole * F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n"))
    first = (F.col("a_at") + due <= F.col("a_d")) & (F.col("b_at") + due <= F.col("b_d"))
    pairs = _merged(side("a")).join(side("b"), ["group", "key"]).where(alike & (slack > 0) & first)
    pairs = materialise(certain.unionByName(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()), "pairs")
    discard(rows)
    discard(shared)
    return pairs


def _similar(pairs: DataFrame, found: DataFrame, docs: DataFrame, shingle: int, name: str) -> DataFrame:
    """(a, b): those of the pairs whose sets are similar enough: by their bins first, then on the whole sets."""
    least, whole = SIMILARITY
    ends = lambda p: p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id"))).distinct()
    pairs = materialise(pairs.distinct(), name)
    own = _among(found.select("id", "h", "n", "bins"), materialise(ends(pairs), name), "id")
    own = materialise(own.groupBy("id").agg(F.min(F.struct("h", "n", "bins")).alias("s")).select("id", "s.*"), name)
    side = lambda k, c, rows: rows.select(F.col("id").alias(k), *[F.col(x).alias(f"{c}_{x}") for x in rows.columns if x != "id"])
    counts = own.select("id", "n", "bins")
    both = pairs.join(side("a", "x", counts), "a").join(side("b", "y", counts), "b")
    apart = F.aggregate(F.zip_with("x_bins", "y_bins", lambda i, j: F.abs(i.cast("int") - j.cast("int"))), F.lit(0), lambda s, v: s + v)
    pairs = materialise(both.where((whole + least) * apart <= (whole - least) * (F.col("x_n") + F.col("y_n"))).select("a", "b", "x_n"), name)
    rounds = _rounds(found, pairs.agg(F.sum("x_n").alias("n")).first().n or 0)
    pairs = pairs.drop("x_n")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(c)] for c in (2, 3))
            common = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)]
            alike = [whole * c >= least * (len(p) + len(q) - c) for c, p, q in zip(common, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    sets = materialise(_whole_sets(own.join(ends(pairs), "id", "left_semi"), docs, shingle, name), name)
    alike = []
    for k in range(rounds):
        both = pairs.where(_in_round("a", k, rounds)).join(side("a", "x", sets.where(_in_round("id", k, rounds))), "a")
        both = both.join(side("b", "y", sets), "b").select("a", "b", "x_set", "y_set")
        alike.append(materialise(both.mapInArrow(checked, "a long, b long"), name))
    discard(sets)
    return reduce(DataFrame.unionByName, alike)


def similar_links(found: DataFrame, docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(a, b): links between ids that connect all sets of ``SIMILARITY`` or more; ``found``: ``shingle_sets(docs)``.

    The first links are of near fingerprints and of each set to one other under its keys. What these
    connect is not compared again, so a large family costs a pair a member and not its square; all
    pairs that share enough keys across the classes so far follow, those of crowded keys by their centres.
    """
    least, whole = SIMILARITY
    fps = materialise(found.select("fp", "id").distinct(), "fingerprints")
    heads = fps.groupBy("fp").agg(F.min("id").alias("head"))
    near = links(heads.select("fp"))
    at = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_id"))
    first = _merged(_merged(near).join(at("a"), "a")).join(at("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    first = first.unionByName(fps.join(heads, "fp").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))

    same = Window.partitionBy("key")
    shared = _first_shingles(docs, _frequent_shingles(docs, shingle), shingle).withColumn("head", F.min(F.struct("id", "n")).over(same)).withColumn("top", F.max("id").over(same)).where("head.id <> top")
    shared = materialise(shared.select("id", "n", "key", F.col("head.id").alias("head"), F.col("head.n").alias("m")).distinct(), "keys")
    needed = F.least(F.lit(SHARED), F.ceil(least * F.least("m", "n") / whole))
    alike = whole * F.least("m", "n") >= least * F.greatest("m", "n")
    stars = shared.where((F.col("id") != F.col("head")) & alike).groupBy("id", "head", "m", "n").agg(F.count("*").alias("c")).where(F.col("c") >= needed)
    stars = stars.groupBy("id").agg(F.max_by("head", "c").alias("b")).select(F.col("id").alias("a"), "b")
    first = _similar(first.unionByName(stars), found, docs, shingle, "first_links")

    roots = connected_components(first)
    classed = shared.join(roots, shared.id == roots.node, "left").select("id", "n", "key", F.coalesce("root", "id").alias("class"))
    classed = classed.withColumn("low", F.min("class").over(same)).withColumn("high", F.max("class").over(same)).where("low <> high")
    classed = materialise(classed.withColumn("crowd", F.count("*").over(same)).select("id", "n", "key", "class", "crowd"), "keys")
    discard(shared)
    crowded, classed = classed.where(F.col("crowd") > CROWD), classed.where(F.col("crowd") <= CROWD)
    a = classed.select("key", F.col("id").alias("a"), F.col("n").alias("m"), F.col("class").alias("of_a"))
    b = classed.select("key", F.col("id").alias("b"), "n", "class")
    pairs = _merged(a).join(b, "key").where((F.col("a") < F.col("b")) & (F.col("of_a") != F.col("class")) & alike)
    common, most = F.ceil(least * (F.col("m") + F.col("n")) / (least + whole)), F.ceil(least * F.greatest("m", "n") / whole)
    due = common - most + F.least(F.lit(SHARED), most)
    pairs = pairs.groupBy("a", "b", "m", "n").agg(F.count("*").alias("c")).where(F.col("c") >= due).select("a", "b")
    pairs = pairs.unionByName(_crowd_pairs(crowded, found, docs, shingle))
    return first.unionByName(_similar(pairs, found, docs, shingle, "more_links"))


def similar_classes(docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(doc_id, component_id): every document with the smallest doc_id reachable over texts of ``SIMILARITY`` or more.

    Defined cases as of ``near_duplicates``; texts without words are one class.
    """
    bound_batches(docs.sparkSession)
    found = materialise(shingle_sets(docs, shingle), "shingles")
    nodes = found.groupBy("id").agg(F.min("doc_id").alias("least"))
    roots = connected_components(similar_links(found, docs, shingle))
    rooted = materialise(nodes.join(roots, nodes.id == roots.node, "left").select("id", "least", F.coalesce("root", "id").alias("root")), "nodes")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("id", "component_id")
    return found.select("doc_id", "id").join(classes, "id").select("doc_id", "component_id")


def keep_similar(docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """As ``keep_one``, of the classes of ``similar_classes``."""
    return _least_of_class(docs, similar_classes(docs, shingle))
