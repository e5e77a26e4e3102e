import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions import geometry as G
from trajecta.functions import strings as S
from trajecta.operators import history, joins, package, records, sampling, stats, trajectory, windows
from trajecta.plans import queries as Q

POSES = "episode long, frame long, x double, y double, z double, yaw double"


def test_body_delta_literal(spark):
    row = spark.sql("SELECT named_struct('x', 0D, 'y', 0D, 'z', 1D, 'yaw', pi() / 2) a, named_struct('x', 0D, 'y', 2D, 'z', 0D, 'yaw', pi()) b").select(G.body_delta(F.col("a"), F.col("b")).alias("d"), G.from_body_delta(F.col("a"), G.body_delta(F.col("a"), F.col("b"))).alias("r")).first()
    assert np.allclose(row.d, (2, 0, -1, math.pi / 2))
    assert np.allclose(row.r[:3], (0, 2, 0))


def test_wrap_is_half_open(spark):
    row = spark.sql("SELECT pi() a, -pi() b, -7D c").select(*[G.wrap_angle(F.col(c)) for c in "abc"]).first()
    assert row[0] == pytest.approx(-math.pi) and row[1] == pytest.approx(-math.pi) and row[2] == pytest.approx(-7 + 2 * math.pi)


def test_repeat_last_tail(spark):
    poses = spark.createDataFrame([(0, i, float(i), 0.0, 0.0, 0.0) for i in range(4)], POSES)
    got = windows.action_chunk(poses, 8, repeat_last=True).where("frame = 1").orderBy("h").collect()
    assert [r.dx for r in got] == [1, 2, 2, 2, 2, 2, 2, 2]
    last = windows.action_chunk(poses, 8, repeat_last=True).where("frame = 3").collect()
    assert len(last) == 8 and all(r.dx == r.dy == 0 for r in last)
    assert windows.action_chunk(poses, 8).where("frame = 3").count() == 0


def test_even_positions_round_to_even(spark):
    row = spark.range(1).select(sampling.even_positions(F.lit(6), F.lit(3)).alias("a"), sampling.even_positions(F.lit(1), F.lit(4)).alias("b"), sampling.even_positions(F.lit(0), F.lit(4)).alias("c")).first()
    assert row.a == [0, 2, 5] and row.b == [0] and row.c == []


def test_capacity(spark):
    assert spark.range(1).select(history.capacity(F.lit(1024), 64, 1)).first()[0] == 119
    assert spark.range(1).select(history.capacity(F.lit(1024), 64, 1, wrapper_tokens=0)).first()[0] == 191


def test_solved_rate_hits_its_target(spark):
    rows = spark.createDataFrame([(200, 40.0), (200, 20.0), (200, 200.0), (0, 0.0), (200, 199.0)], "n int, target double")
    k = [r.k for r in rows.select(history.solve_rate(F.col("n"), F.col("target")).alias("k")).collect()]
    assert k[1:4] == [1e6, 0, 0]
    for rate, target in ((k[0], 40), (k[4], 199)):
        assert 200 * (0.9 * (1 - math.exp(-rate)) / rate + 0.1) == pytest.approx(target, rel=1e-9)


def test_formulas_by_hand(spark):
    p = lambda h, a: spark.range(1).select(history.keep_probability(F.lit(h), F.lit(a), 4.0)).first()[0]
    assert p(50, 100) == pytest.approx(0.9 * math.exp(-2) + 0.1) and p(0, 0) == 0
    # Two cameras: 2 * (64 + 1 + 3) = 136 now, 2 * (4 + 1 + 3) = 16 a frame.
    assert [spark.range(1).select(history.capacity(F.lit(b), 64, 2)).first()[0] for b in (100, 151, 152, 168)] == [0, 0, 1, 2]


def test_stratified_quotas_refill_and_refuse(spark):
    df = spark.createDataFrame([("a", i) for i in range(2)] + [("b", i) for i in range(100, 120)] + [(None, 500)], "s string, k long")
    got = {r.s: r.n for r in sampling.stratified_sample(df, "s", "k", 20, "x").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 2, "b": 17, None: 1}
    for n in (0, 2, 24):
        with pytest.raises(ValueError):
            sampling.stratified_sample(df, "s", "k", n, "x")


def test_dynamics_in_the_body_frame(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, math.pi / 2, 0.0), (1, 1, 0.0, 2.0, 0.0, math.pi / 2, 1.0), (1, 2, 3.0, 6.0, 0.0, 0.0, 3.0), (2, 0, 5.0, 5.0, 0.0, 1.0, 0.0)]
    d = windows.dynamics(spark.createDataFrame(rows, "episode long, frame long, x double, y double, z double, yaw double, sec double"), "sec")
    got = {(r.episode, r.frame): (r.velocity, r.yaw_rate, r.acceleration) for r in d.collect()}
    assert got[1, 0] == pytest.approx((2, 0, 0)) and got[1, 1] == pytest.approx((2, 0, 0)) and got[1, 2] == pytest.approx((2, -math.pi / 4, 0)) and got[2, 0] == (0, 0, 0)


def test_depth_collision_order_of_reasons(spark):
    rows = [(1, c, 5.0, 5.0) for c in (0, 1)] + [(2, 0, 50.0, 1.0), (2, 1, 50.0, 90.0)] + [(3, c, 50.0, 90.0) for c in (0, 1)] + [(4, c, 50.0, 90.0) for c in (0, 1)]
    pixels = spark.createDataFrame(rows, "k long, camera long, before double, after double")
    moved = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.1), (4, 2.0)], "k long, distance double")
    d = package.depth_collision(pixels, moved, "k", "camera", "before", "after", 2.0, 0.5, 1.0, 0.5)
    assert {r.k: r.reason for r in d.collect()} == {1: "tiny diff", 2: "close", 3: "distance", 4: None}


def test_long_memory_has_no_limit(spark):
    f = spark.range(30).selectExpr("1L AS episode", "id AS frame", "CASE WHEN id > 0 THEN array(id - 1) ELSE array() END AS candidates")
    assert history.long_memory(f).where("frame = 29").first().memory == list(range(28))


def test_one_to_one_rejects_repeats(spark):
    a = spark.createDataFrame([(1,), (1,)], "k long")
    with pytest.raises(ValueError):
        joins.left_one_to_one(a, spark.createDataFrame([(1, 2)], "k long, v long"), "k")


def test_exact_half_subset(spark):
    rows = spark.createDataFrame([(f"e{i}", "excluded" if i < 4 else "s") for i in range(16)] + [(f"x{i}", "s") for i in range(4)], "id string, scene string")
    got = sampling.lightweight_subset(rows, "scene", ["excluded"], "id", 0.5, [2, 3, 4, 5], "seed").collect()
    assert len(got) == 8 and sorted(r.stride for r in got) == [2, 2, 3, 3, 4, 4, 5, 5]


def test_split_keeps_groups_whole(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5), ("d", 2)], "k string, n long")
    sizes = {r.k: r.n for r in counts.collect()}
    assert sum(sizes[k] for k in sampling.exact_group_split(counts, "k", "n", 9, "s")) == 9
    with pytest.raises(ValueError):
        sampling.exact_group_split(counts, "k", "n", 13, "s")


def test_greedy_balance(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate((9, 7, 6, 5, 4, 3))], "k int, n long")
    rank = {r.k: r["rank"] for r in sampling.balanced_ranks(counts, "k", "n", 2).collect()}
    loads = [sum(n for i, n in enumerate((9, 7, 6, 5, 4, 3)) if rank[i] == r) for r in (0, 1)]
    assert abs(loads[0] - loads[1]) <= 2


def test_densify_keeps_knots_and_limits(spark):
    poses = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 3.0), (0, 1, 3.0, 0.0, 0.0, -3.0), (0, 2, 3.0, 4.0, 0.0, -2.0)], POSES)
    got = trajectory.densify(poses, 1.0, 0.5).orderBy("step").collect()
    p = np.array([(r.x, r.y) for r in got])
    for knot in ((0, 0), (3, 0), (3, 4)):
        assert np.abs(p - knot).sum(axis=1).min() < 1e-9
    assert all(-math.pi <= r.yaw < math.pi for r in got)


def test_smoothing_stays_in_its_corridor(spark):
    r = np.random.default_rng(1)
    rows = [(0, i, float(i), float(r.normal()), 0.0, 0.0) for i in range(40)]
    got = {x.step: x for x in trajectory.smooth(spark.createDataFrame(rows, POSES), 3.0, 1.0).collect()}
    assert max(abs(got[i].y - rows[i][3]) for i in range(40)) <= 1.0
    assert got[0].y == rows[0][3] and got[39].y == rows[39][3]


def test_warping_distance():
    a = np.array([[0, 0], [1, 0], [2, 0]], float)
    assert stats.warping_distance(a, a) == 0
    assert stats.warping_distance(a, np.array([[0, 0], [2, 0]], float)) == 1


def test_sanitise_and_refs(spark):
    row = spark.range(1).select(S.sanitise(F.lit("..a b/c..")).alias("a"), S.sanitise(F.lit("___")).alias("b"), S.parse_ref(S.frame_ref(F.lit("e1"), F.lit(7), F.lit("front"))).alias("p"), S.natural_key(F.lit("s10b2")).alias("n"), S.natural_key(F.lit("s9b2")).alias("m"), S.natural_key(F.lit("s" + "9" * 14)).alias("x"), S.natural_key(F.lit("s0" + "1" * 15)).alias("y")).first()
    assert row.a == "a_b_c" and row.b is None and tuple(row.p) == ("e1", 7, "front") and row.n > row.m and row.x < row.y


def test_incomplete_metric_has_no_mean(spark):
    df = spark.createDataFrame([("a", 1.0, False), ("a", None, True), ("b", 2.0, False), ("b", None, False)], "g string, m double, failed boolean")
    got = {(r.g, r.overall): r.m for r in stats.metric_summary(df, ["m"], F.col("failed"), "g").collect()}
    assert got == {("a", 0): 1.0, ("b", 0): None, (None, 1): None}


def test_linked_order_leaves_rings_out(spark):
    from trajecta.operators import chains

    rows = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n9", None), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("s", "gone")]
    got = {r.token: (r.head, r.position) for r in chains.linked_order(spark.createDataFrame(rows, "token string, following string"), "token", "following").collect()}
    assert got == {f"n{i}": ("n0", i) for i in range(10)} | {"s": ("s", 0)}
    assert chains.linked_order(spark.createDataFrame([], "token string, following string"), "token", "following").count() == 0


def test_dense_numbers(spark):
    from trajecta.operators import chains

    got = chains.dense_numbers(spark.range(0, 1000, 3).repartition(5), ["id"]).collect()
    assert {r.id: r.number for r in got} == {i: n for n, i in enumerate(range(0, 1000, 3))}
    assert chains.dense_numbers(spark.range(0), ["id"]).count() == 0


def _plain_warping(a, b):
    best = {(0, 0): 0.0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            before = min(best.get(k, float("inf")) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
            best[i, j] = math.dist(a[i - 1], b[j - 1]) + before
    return best[len(a), len(b)]


def test_ndtw_is_of_whole_paths(spark):
    r = random.Random(6)
    paths = {k: [[tuple(r.random() for _ in range(3)) for _ in range(n)] for n in sizes] for k, sizes in enumerate([(90, 75), (1, 8), (7, 1), (64, 130)])}
    rows = [(k, kind, i, *p) for k, both in paths.items() for kind, path in zip(("predicted", "reference"), both, strict=True) for i, p in enumerate(path)]
    got = {x.k: (x.dtw, x.ndtw) for x in stats.ndtw(spark.createDataFrame(rows, "k long, kind string, step long, x double, y double, z double"), "k", 3.0).collect()}
    for k, (a, b) in paths.items():
        d = _plain_warping(a, b)
        assert got[k] == (pytest.approx(d), pytest.approx(math.exp(-d / (3.0 * len(b)))))


def test_ndtw_query_takes_every_frame(spark, tmp_path):
    r = random.Random(7)
    points = [[r.random() for _ in range(4)] for _ in range(100)]
    spark.createDataFrame([(i, 1, p) for i, p in enumerate(points)], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = Q.QUERIES["ndtw"](spark, str(tmp_path)).first()
    assert got.dtw == pytest.approx(_plain_warping([p[:3] for p in points], [p[:3] for p in points[::2]]), abs=1e-4)


def test_history_reaches_every_earlier_frame(spark):
    draw = lambda a, h: int(hashlib.sha256(f"history:7:{a}:{h}".encode()).hexdigest()[:13], 16) / 2**52
    want = set()
    for a in range(1, 150):
        p = {h: 0.1 + 0.9 * math.exp(6.0 * (h - a) / a) for h in range(a)}
        kept = sorted((draw(a, h) / p[h], h) for h in p if draw(a, h) < p[h])
        want |= {(a, h) for _, h in kept[:5]}
    frames = spark.range(150).selectExpr("7L AS episode", "id AS frame")
    assert {(x.frame, x.history_frame) for x in history.select_history(frames, 6.0, 5).collect()} == want
    assert any(a - h > 40 for a, h in want)


def test_missing_video_start_and_bad_pose_are_errors(spark):
    episodes = spark.createDataFrame([(1, 5)], "episode long, index long")
    video = spark.createDataFrame([(5, "a", True, 10), (5, "b", False, 11)], "index long, camera string, available boolean, video_frame long")
    assert records.first_frame_offsets(episodes, video, ["a"], 5).first().offset == 2.0
    with pytest.raises(Exception, match="start of episode 1 in b"):
        records.first_frame_offsets(episodes, video, ["a", "b"], 5).collect()
    with pytest.raises(Exception, match="finite"):
        spark.range(1).select(records.drone_pose(F.lit(0), F.lit(1), F.lit(float("nan")), F.lit(2))).collect()


def test_names_budgets_and_padding_of_edge_rows(spark):
    rows = spark.createDataFrame([(" Val_Seen",), ("train",)], "v string")
    names = {"val_seen": "val", "train": "train"}
    assert [r.n for r in rows.select(records.named_as(F.col("v"), names).alias("n")).collect()] == ["val", "train"]
    for bad in ("test", None):
        with pytest.raises(Exception, match="unknown name"):
            spark.createDataFrame([(bad,)], "v string").select(records.named_as(F.col("v"), names).alias("n")).collect()

    budgets = spark.createDataFrame([(0, 0, 0.0), (10, 1, 1e4), (10, 2, 4.0), (3, 5, 0.5)], "n long, target long, k double")
    summary = lambda d: tuple(records.budget_summary(d, F.col("n"), F.col("target"), F.col("k")).first())
    assert summary(budgets) == (4, 0, 10, 1, 0.0, 1e4)
    assert summary(budgets.limit(0)) == (0, 0, 0, 0, float("inf"), float("inf"))

    masks = spark.createDataFrame([([True, None, False],), (None,), ([],), ([True, True],)], "m array<boolean>")
    assert tuple(records.padding_counts(masks, F.col("m")).first()) == (2, 3)
    assert tuple(records.padding_counts(masks.limit(0), F.col("m")).first()) == (0, 0)
