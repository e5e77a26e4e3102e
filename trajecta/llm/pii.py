"""Personal data by gradient-boosted candidates, in DataFrame functions only.

High-recall generators propose spans that may overlap: the four base patterns, and wider patterns for
written-out and bracketed e-mail addresses, defanged and version-6 IP addresses, card numbers glued
to other digits, and national or glued phone numbers. Each candidate's format and context become
yes/no features. Boosted trees of depth two score it, a threshold calibrated on other candidates
decides, and what is selected joins the base spans unless it overlaps one (or an earlier selection).
Base spans always stay. ``redact`` replaces selected spans.

The trees are trained here on ``TRAINING_ROWS`` generated candidates for each kind (a fixed bound):
DataFrame functions generate and describe them and count each pattern of features; the fit itself
works on that small table of counts. Scoring is a column expression. A document is one row from start
to end and nothing is shuffled.

Defined cases: a null text is empty and has no spans; repeated rows each get a row; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TRAINING_ROWS = 4000
ROUNDS = 24
RATE = 0.4
PRECISION = 0.98
_BLOCK = 512

#: The base patterns. Possessive, and tried only where a run begins, which finds the same leftmost
#: matches without rescanning long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) )[A-Za-z0-9-]+)+"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ (?:at|AT) [A-Za-z0-9-]+(?: (?:dot|DOT) [A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:3[47][0-9]{2}[ .-]?[0-9]{6}[ .-]?[0-9]{5}|[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?(?:[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
#: A text without this has no match of the kind's patterns.
BASE_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDE_NEEDS = {"email": r"[\[({] ?(?:at|AT|@) ?[\])}]| (?:at|AT) [A-Za-z0-9-]+ (?:dot|DOT) ", "ip": r"[0-9](?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]|:[0-9A-Fa-f]{0,4}:", "card": r"[0-9]{4}", "phone": r"[ .-][0-9]{3,4}[ .-][0-9]{3}"}

_GOOD = r"mail|contact|phone|tel|call|fax|mobile|cell|whatsapp|reach|write|host|server|address|addr|ping|login from|card|visa|master|amex|credit|debit|paid with"
_BAD = r"order|invoice|version|isbn|issn|serial|sku|part|total|score|page|ratio|time|clock|duration|model|build|release|ticket|tracking"


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit counting once."""

    def value(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0))
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda acc, x: acc + x)


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn test."""
    return (F.length(digits) > 0) & (_luhn_sum(digits) % 10 == 0)


def features(m: Column, before: Column, after: Column) -> list[Column]:
    """Yes/no features of a candidate: its text and what stands around it."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n, near = F.length(digits), F.lower(before)
    octet = r"(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return [
        _luhn(digits),
        digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        n == 16,
        n == 15,
        n.between(10, 13),
        m.rlike(r"^(?:\+|00)"),
        m.rlike(r"\("),
        m.rlike(r"[0-9]\.[0-9]"),
        m.rlike("[A-Fa-f]"),
        m.rlike("::"),
        m.rlike("(?::[0-9A-Fa-f]+){7}"),
        m.rlike(r"[\[({]"),
        m.rlike(r" (?:dot|DOT) [A-Za-z]{2,6}$"),
        m.rlike(r"[A-Za-z]{2,6}$"),
        F.regexp_replace(m, r"[\[\]()]|dot", ".").rlike(rf"^{octet}(?:\.+{octet}){{3}}$"),
        near.rlike(_GOOD),
        near.rlike(_BAD),
        before.rlike(r"[$€£#=vV/]\s?$"),
        after.rlike(r"^\s?(?:%|[$€£]|am\b|pm\b|GMT|UTC)"),
        m.rlike(r"^(?:19|20)[0-9]{2}[ .-]|^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?$"),
        m.rlike(r"^[^0-9]*([0-9])(?:[^0-9]*\1)*[^0-9]*$"),
        m.rlike(r"[ .-][0-9]{3}[ .-][0-9]{4}$"),
    ]


def _examples(spark: SparkSession, rows: int) -> DataFrame:
    """Generated candidates: kind, label, m, before, after. Every number comes from a hash of the row."""
    base = spark.range(rows)

    def number(width: int, salt: int) -> Column:
        return F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**width)).cast("string"), width, "0")

    def pick(choices: list[str], salt: int) -> Column:
        return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(choices))) + 1).cast("int"))

    name = F.concat(pick("anna ben carla dmitri eva farid".split(), 1), pick(["", ".", "_"], 2), pick("smith lopez meyer roux".split(), 3))
    host, tld = pick("example mailbox corp uni inbox".split(), 4), pick("com org net de fr io".split(), 5)
    octet = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(256)).cast("string")
    hexa = lambda s: F.lower(F.hex(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(65536)).cast("long")))
    sep = pick(["", " ", "-", "."], 6)
    body = F.concat(pick(["4", "51", "6011", "37", "9", "1", "8"], 7), number(15, 8)).substr(1, 15)
    base = base.withColumn("body", body)
    check = (F.pmod(-_luhn_sum(F.concat("body", F.lit("0"))), F.lit(10))).cast("string")
    base = base.withColumn("digits", F.concat("body", F.when(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2)) == 0, check).otherwise(number(1, 10))))
    digits = F.col("digits")
    card = F.concat(digits.substr(1, 4), sep, digits.substr(5, 4), sep, digits.substr(9, 4), sep, digits.substr(13, 4))
    friendly = pick(["contact: ", "please call ", "my e-mail is ", "phone ", "server ", "card no ", "the ", "and ", "in of ", ""], 11)
    hostile = pick(["order ", "invoice ", "version ", "isbn ", "build ", "serial ", "total ", "time "], 12)
    any_before = F.when(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(3)) == 0, hostile).otherwise(friendly)
    plain_card = _luhn(digits) & digits.rlike("^(?:4|5[1-5]|6|37)")
    made = [
        ("email", F.concat(name, pick([" [at] ", "(at)", " {at} ", "[@]"], 14), host, pick([" [dot] ", ".", "(dot)"], 15), tld), F.lit(1), friendly),
        ("email", F.concat(name, F.lit(" at "), host, F.lit(" dot "), tld), F.lit(1), friendly),
        ("email", F.concat(pick("look arrive stop point".split(), 16), F.lit(" at "), pick("the this that a".split(), 17), F.lit(" dot "), pick("on in under at-once 9".split(), 18)), F.lit(0), friendly),
        ("email", F.concat(pick("value x total".split(), 19), F.lit(" (at) "), number(2, 20), F.lit("."), number(2, 21)), F.lit(0), hostile),
        ("ip", F.concat(octet(22), F.lit("[.]"), octet(23), F.lit("[.]"), octet(24), F.lit("[.]"), octet(25)), F.lit(1), friendly),
        ("ip", F.concat_ws(":", *[hexa(26 + k) for k in range(8)]), F.lit(1), friendly),
        ("ip", F.concat(hexa(34), F.lit(":"), hexa(35), F.lit("::"), hexa(36)), F.lit(1), friendly),
        ("ip", F.concat(number(1, 37), F.lit(":"), F.lpad(F.pmod(F.xxhash64("id"), F.lit(60)).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.pmod(F.xxhash64("id", F.lit(38)), F.lit(60)).cast("string"), 2, "0")), F.lit(0), any_before),
        ("ip", F.concat(number(3, 39), F.lit("(.)"), number(3, 40), F.lit("(.)"), number(3, 41), F.lit("(.)"), number(3, 42)), F.lit(0), hostile),
        ("ip", pick(["a::b", "::", ":::", "abc:de:f", "std::add"], 43), F.lit(0), friendly),
        ("card", card, plain_card.cast("int"), friendly),
        ("card", F.concat(F.lit("37"), number(13, 44)), _luhn(F.concat(F.lit("37"), number(13, 44))).cast("int"), friendly),
        ("card", card, F.lit(0), hostile),
        ("card", F.concat(number(4, 45), F.lit(" "), number(4, 46), F.lit(" "), number(4, 47), F.lit(" "), number(4, 48)), F.lit(0), hostile),
        ("phone", F.concat(pick(["+1 ", "+44 ", "001 ", ""], 49), F.lit("("), number(3, 50), F.lit(") "), number(3, 51), F.lit("-"), number(4, 52)), F.lit(1), friendly),
        ("phone", F.concat(pick(["+", "", ""], 53), number(3, 54), pick([" ", "-", "."], 55), number(3, 56), pick([" ", "-", "."], 55), number(4, 57)), F.lit(1), friendly),
        ("phone", F.concat(F.lit("20"), number(2, 58), F.lit("-"), number(3, 59), F.lit("-"), number(3, 60)), F.lit(0), any_before),
        ("phone", F.concat(number(2, 61), F.lit("."), number(3, 62), F.lit("."), number(3, 63)), F.lit(0), any_before),
        ("phone", F.concat(number(3, 64), F.lit(" "), number(3, 65), F.lit(" "), number(3, 66)), F.lit(0), hostile),
        ("phone", F.concat(number(3, 67), F.lit("-"), number(4, 68), F.lit("-"), number(4, 69)), F.lit(0), hostile),
    ]
    share = {k: sum(x[0] == k for x in made) for k in KINDS}
    tables = []
    for kind, m, label, before in made:
        part = base.where(F.col("id") < rows // share[kind])
        tables.append(part.select("id", F.lit(kind).alias("kind"), m.alias("m"), label.alias("label"), before.alias("before"), pick(["", " and", ".", " %", " pm"], 70 + len(tables)).alias("after")))
    return functools.reduce(DataFrame.unionByName, tables)


Tree = tuple[int, int, int, tuple[float, float, float, float]]  # root feature, its split on no and on yes, four leaves


def boost(rows: list[tuple[list[bool], float, float]], rounds: int = ROUNDS, rate: float = RATE) -> list[Tree]:
    """Boosted trees of depth two for logistic loss. rows: features, weight of ones, weight of zeros."""
    width, score, trees = len(rows[0][0]), [0.0] * len(rows), []

    def sums(members: list[int], grad: list[tuple[float, float]]) -> tuple[float, float]:
        return sum(grad[i][0] for i in members), sum(grad[i][1] for i in members)

    def gain(g: float, h: float) -> float:
        return g * g / (h + 1.0)

    def best_split(members: list[int], grad: list[tuple[float, float]]) -> tuple[float, int]:
        g, h = sums(members, grad)
        found = (0.0, 0)
        for f in range(width):
            g1, h1 = sums([i for i in members if rows[i][0][f]], grad)
            found = max(found, (gain(g1, h1) + gain(g - g1, h - h1) - gain(g, h), -f))
        return found[0], -found[1]

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [(one * (1 - q) - zero * q, (one + zero) * q * (1 - q)) for (_, one, zero), q in zip(rows, p, strict=True)]
        everyone = list(range(len(rows)))
        root = best_split(everyone, grad)[1]
        sides = [[i for i in everyone if bool(rows[i][0][root]) == side] for side in (False, True)]
        splits = [best_split(side, grad)[1] for side in sides]
        leaves = []
        for side, split in zip(sides, splits, strict=True):
            for yes in (False, True):
                g, h = sums([i for i in side if bool(rows[i][0][split]) == yes], grad)
                leaves.append(rate * g / (h + 1.0))
        tree = (root, splits[0], splits[1], tuple(leaves))
        trees.append(tree)
        score = [s + _leaf(tree, x) for s, (x, _, _) in zip(score, rows, strict=True)]
    return trees


def _leaf(tree: Tree, x: list[bool]) -> float:
    root, no, yes, leaves = tree
    return leaves[2 * bool(x[root]) + bool(x[yes if x[root] else no])]


def calibrate(rows: list[tuple[list[bool], float, float]], trees: list[Tree], precision: float = PRECISION) -> float:
    """The lowest score from which on the share of ones is at least ``precision``."""
    scored = sorted(((sum(_leaf(t, x) for t in trees), one, zero) for x, one, zero in rows), reverse=True)
    ones = zeros = 0.0
    best = math.inf
    for i, (s, one, zero) in enumerate(scored):
        ones, zeros = ones + one, zeros + zero
        if ones >= precision * (ones + zeros) and (i + 1 == len(scored) or scored[i + 1][0] < s):
            best = s
    return best


_models: dict[int, dict[str, tuple[list[Tree], float]]] = {}


def train(spark: SparkSession, rows: int = TRAINING_ROWS) -> dict[str, tuple[list[Tree], float]]:
    """Trees and threshold of each kind; half of the generated candidates train, half calibrate."""
    if rows not in _models:
        table = _examples(spark, rows)
        f = F.array(*[F.coalesce(x, F.lit(False)) for x in features(F.col("m"), F.col("before"), F.col("after"))])
        counted = table.select("kind", "label", (F.col("id") % 2).alias("half"), f.alias("f")).groupBy("kind", "half", "f").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).collect()  # at most the generated rows
        models = {}
        for kind in KINDS:
            halves = [sorted((list(r.f), float(r.ones), float(r.n - r.ones)) for r in counted if r.kind == kind and r.half == k) for k in (0, 1)]
            trees = boost(halves[0])
            models[kind] = (trees, calibrate(halves[1], trees))
        _models[rows] = models
    return _models[rows]


def _score(trees: list[Tree], f: Column) -> Column:
    def one(tree: Tree) -> Column:
        root, no, yes, v = tree
        return F.when(f[root], F.when(f[yes], v[3]).otherwise(v[2])).otherwise(F.when(f[no], v[1]).otherwise(v[0]))

    return functools.reduce(lambda a, b: a + b, map(one, trees))


def _before_each(lengths: Column) -> Column:
    """Sums of all earlier values of an array, by blocks, so long arrays take no quadratic time."""
    zero = lambda: F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("a"))
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a"))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / _BLOCK).cast("int") - 1), lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, _BLOCK), zero(), step))
    moved = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<array<long>>").alias("a")), lambda acc, b: F.struct((acc["s"] + b["s"]).alias("s"), F.concat(acc["a"], F.array(F.transform(b["a"], lambda x: x + acc["s"]))).alias("a")))
    return F.when(F.size(lengths) > 0, F.flatten(moved["a"])).otherwise(F.array().cast("array<long>"))


_SPAN = "array<struct<start:long,end:long,m:string,before:string,after:string>>"


def _with_matches(df: DataFrame, name: str, pattern: str, needs: str) -> DataFrame:
    """Adds ``name``: leftmost non-overlapping matches of a pattern in t, in code points, with their context."""
    has = F.col("t").contains(needs) if needs == "@" else F.col("t").rlike(needs)
    found = F.when(has, F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))
    df = df.withColumn("_m", found).withColumn("_p", F.when(F.size("_m") > 0, F.split("t", pattern, -1)))
    sizes = F.zip_with("_m", F.slice("_p", F.lit(1), F.size("_m")), lambda m, p: (F.length(m) + F.length(p)).cast("long"))
    df = df.withColumn("_n", F.when(F.size("_m") > 0, sizes)).withColumn("_s", F.when(F.size("_m") > 0, _before_each(F.col("_n"))))
    rows = F.arrays_zip(F.col("_m").alias("m"), F.slice("_p", F.lit(1), F.size("_m")).alias("p"), F.slice("_p", F.lit(2), F.size("_m")).alias("q"), F.col("_s").alias("s"))

    def span(x: Column) -> Column:
        start = x["s"] + F.length(x["p"])
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), F.right(x["p"], F.lit(24)).alias("before"), F.left(x["q"], F.lit(8)).alias("after"))

    spans = F.when(F.size("_m") > 0, F.transform(rows, span)).otherwise(F.array().cast(_SPAN))
    return df.withColumn(name, spans.cast(_SPAN)).drop("_m", "_p", "_n", "_s")


_IS_BASE: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"),
    "card": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(16, 19) & _luhn(F.regexp_replace(m, "[^0-9]", "")),
    "phone": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15),
}


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, t, and for each kind ``<kind>_base`` and ``<kind>_more``: arrays of (start, end)."""
    models = train(docs.sparkSession)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    plain = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    for kind in KINDS:
        df = _with_matches(df, "_found", BASE[kind], BASE_NEEDS[kind])
        valid = _IS_BASE[kind]
        df = df.withColumn(f"{kind}_base", F.transform(F.filter("_found", lambda x: valid(x["m"])), plain)).drop("_found")  # noqa: B023
    df = df.withColumn("_taken", F.concat(*[F.col(f"{k}_base") for k in KINDS]))
    for kind in KINDS:
        trees, least = models[kind]
        df = _with_matches(df, "_found", WIDE[kind], WIDE_NEEDS[kind])
        free = lambda x: ~F.exists("_taken", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        candidates = F.transform(F.filter("_found", free), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array(*[F.coalesce(y, F.lit(False)) for y in features(x["m"], x["before"], x["after"])]).alias("f")))
        chosen = F.filter(candidates, lambda x: _score(trees, x["f"]) >= least) if math.isfinite(least) else F.slice(candidates, 1, 0)
        df = df.withColumn(f"{kind}_more", F.transform(chosen, plain)).drop("_found")
        df = df.withColumn("_taken", F.concat("_taken", f"{kind}_more"))
    return df.drop("_taken")


def _listed(kind: str, spans_: Column) -> Column:
    return F.transform(spans_, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): base counts and digest, and all spans."""
    found = spans(docs)
    base = F.concat(*[_listed(k, F.col(f"{k}_base")) for k in KINDS])
    both = lambda k: F.sort_array(F.concat(f"{k}_base", f"{k}_more"))
    everything = F.concat(*[_listed(k, both(k)) for k in KINDS])
    counts = [F.size(f"{k}_base").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(everything, ",").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every selected span replaced by its kind in angle brackets."""


    def tag(kind: str) -> Column:
        return F.transform(F.concat(f"{kind}_base", f"{kind}_more"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    tagged = F.array_sort(F.concat(*map(tag, KINDS)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # Of overlapping spans of different kinds, the later one only lengthens the cut.
        kept = F.when(x["start"] >= acc["at"], F.array(F.substring(F.col("t"), acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int")), F.concat(F.lit("<"), x["kind"], F.lit(">")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], kept).alias("out"))

    done = spans(docs).withColumn("_r", F.aggregate(tagged, start, step))
    return done.select("doc_id", F.concat(F.array_join("_r.out", ""), F.substring(F.col("t"), F.col("_r.at").cast("int") + 1, F.lit(1 << 30))).alias("text"))
