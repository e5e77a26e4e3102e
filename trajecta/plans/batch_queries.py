"""Queries of index lists, batches and token gathering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.operators import batches as B
from trajecta.plans.registry import FRAMES, POSES, Tables, query, r6, wrap_sql


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, i AS position FROM c, range(0, (SELECT max(n) FROM c)) r(i) WHERE i < n AND (i % 5 = 0 OR i = n - 1)")
def strided_indices(t: Tables) -> DataFrame:
    return B.strided_indices(t.events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "n", 5)


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), d AS (SELECT user_id, n, i, CASE ('0x' || substr(sha256('g1:' || user_id || ':' || i), 1, 15))::BIGINT % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 5 END AS gap FROM c, range(0, (SELECT max(n) FROM c)) r(i) WHERE i <= ceil(n / 2.0)), w AS (SELECT user_id, n, CAST(coalesce(sum(gap) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM d) SELECT user_id, position FROM w WHERE position < n - 1 UNION ALL SELECT user_id, n - 1 FROM c")
def random_gaps(t: Tables) -> DataFrame:
    return B.random_gaps(t.events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "n", [2, 3, 5], "g1")


@query("WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders), k AS (SELECT c_custkey % 40 - 20 AS asked FROM customer) SELECT asked, o_orderkey FROM k JOIN o ON r = CASE WHEN asked < 0 THEN asked + n ELSE asked END")
def signed_positions(t: Tables) -> DataFrame:
    return B.at_positions(t.orders, t.customer.select((F.col("c_custkey") % 40 - 20).alias("position")), ["o_orderdate", "o_orderkey"]).select("asked", "o_orderkey")


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) % 6 AS INTEGER) AS rank FROM customer")
def rank_share(t: Tables) -> DataFrame:
    return B.rank_share(t.customer, ["c_acctbal", "c_custkey"], 6).select("c_custkey", "rank")


@query("WITH b AS (SELECT quantile_cont(n_chars, 0.05) AS lo, quantile_cont(n_chars, 0.95) AS hi FROM documents), k AS (SELECT * FROM documents, b WHERE n_chars BETWEEN lo AND hi), e AS (SELECT source, max(n_chars) AS mx, min(n_chars) AS mn FROM k GROUP BY source), p AS (SELECT a.source AS sa, b.source AS sb, a.mx - b.mn AS span FROM e a JOIN e b ON a.source <> b.source) SELECT max(span) AS span FROM p")
def representative_pair(t: Tables) -> DataFrame:
    return B.representative_pair(t.documents, "doc_id", "source", "n_chars", 0.05, 0.95).select("span")


@query("WITH r AS (SELECT doc_id, CAST(floor(n_chars / 400.0) AS BIGINT) AS bucket, row_number() OVER (PARTITION BY floor(n_chars / 400.0) ORDER BY sha256('s8:' || doc_id), doc_id) - 1 AS r, count(*) OVER (PARTITION BY floor(n_chars / 400.0)) AS n FROM documents) SELECT doc_id, bucket, CAST(floor(r / 8) AS BIGINT) AS step, CAST(floor(r / 2) % 4 AS INTEGER) AS rank, (floor(r / 8) + 1) * 8 <= n AS complete FROM r")
def synchronised_batches(t: Tables) -> DataFrame:
    return B.synchronised_batches(t.documents, "n_chars", 400, 2, 4, "s8", "doc_id").select("doc_id", "bucket", "step", "rank", "complete")


@query("WITH g AS (SELECT user_id, count(*) AS valid, sum(value) AS total FROM events GROUP BY user_id), w AS (SELECT *, max(valid) OVER (PARTITION BY user_id % 5) AS width FROM g) SELECT user_id, valid, width, round(total, 4) AS total FROM w")
def padded_batch(t: Tables) -> DataFrame:
    lists = t.events.groupBy("user_id").agg(F.collect_list("value").alias("values")).withColumn("batch", F.col("user_id") % 5)
    d = B.padded_to_batch(lists, "values", "batch", F.lit(0.0))
    return d.select("user_id", F.col("valid").cast("long").alias("valid"), F.size("values").cast("long").alias("width"), F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query(f"WITH {POSES}, g AS (SELECT episode, frame, CAST(s AS INTEGER) AS slot, frame - 4 + s AS place FROM poses, range(0, 5) r(s)) SELECT g.episode, g.frame, slot, round(coalesce(cos(p.yaw)*(q.x-p.x)+sin(p.yaw)*(q.y-p.y), 0), 6) AS dx, round(coalesce({wrap_sql('q.yaw-p.yaw')}, 0), 6) AS dyaw, p.x IS NULL AS padded FROM g LEFT JOIN poses q ON q.episode = g.episode AND q.frame = place LEFT JOIN poses p ON p.episode = g.episode AND p.frame = place - 1")
def relative_states(t: Tables) -> DataFrame:
    return B.relative_states(t.poses, 5).select("episode", "frame", "slot", r6(F.col("dx"), "dx"), r6(F.col("dyaw"), "dyaw"), "padded")


@query(f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM frames) SELECT event_id, frame - greatest(n - 12, 0) AS step FROM n WHERE frame >= n - 12")
def latest_rebased(t: Tables) -> DataFrame:
    return B.latest(t.frames, "episode", "frame", 12).select("event_id", "step")


@query(f"WITH {FRAMES} SELECT least(frame, 8) AS history, count(*) AS n FROM frames GROUP BY 1")
def history_lengths(t: Tables) -> DataFrame:
    return t.frames.groupBy(F.least(F.col("frame"), F.lit(8)).alias("history")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) SELECT l_orderkey, count(*) AS refs, CAST(count(p_partkey) AS BIGINT) AS found, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS tokens, string_agg(coalesce(p_brand, '-'), ',' ORDER BY r) AS shards FROM l LEFT JOIN (SELECT * FROM part WHERE p_size <> 7) ON p_partkey = l_partkey GROUP BY l_orderkey")
def token_gather(t: Tables) -> DataFrame:
    refs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda e: e["l_partkey"])
    samples = t.lineitem.groupBy("l_orderkey").agg(refs.alias("refs"))
    d = B.gather(samples, "l_orderkey", "refs", t.part.where("p_size <> 7"), "p_partkey", ["p_size", "p_brand"])
    found = F.filter("items", lambda e: e.isNotNull())
    return d.select("l_orderkey", F.size("items").cast("long").alias("refs"), F.size(found).cast("long").alias("found"), F.aggregate(found, F.lit(0).cast("long"), lambda a, e: a + e["p_size"]).alias("tokens"), F.array_join(F.transform("items", lambda e: F.coalesce(e["p_brand"], F.lit("-"))), ",").alias("shards"))


@query("SELECT DISTINCT l_partkey AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)")
def missing_refs(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("ref")).distinct().join(t.part.where("p_size <> 7").select(F.col("p_partkey").alias("ref")), "ref", "left_anti")


@query("SELECT label, sum(n)::BIGINT AS vectors, string_agg(k || '=' || n, ',' ORDER BY k) AS counts FROM (SELECT label, CASE WHEN embedding[1] > 0 THEN 'right' ELSE 'left' END AS k, count(*) AS n FROM embeddings GROUP BY 1, 2) GROUP BY label")
def name_counts(t: Tables) -> DataFrame:
    kind = F.when(F.col("embedding")[0] > 0, "right").otherwise("left")
    n = t.embeddings.groupBy("label", kind.alias("k")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("k", "n")))
    return n.groupBy("label").agg(F.sum("n").alias("vectors"), F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["k"], e["n"].cast("string"))), ",").alias("counts"))
