"""Expansion over the stored members, and admission of one large scope, against sequential models."""

import random

from pyspark.sql import functions as F

from catalign.functions import values as V
from catalign.operators import budget, expand as X


def sequential(rows, cap_m, cap_b):
    m = b = 0
    out = {}
    for name, members, size in rows:
        out[name] = members <= cap_m and size <= cap_b and m + members <= cap_m and b + size <= cap_b
        if out[name]:
            m, b = m + members, b + size
    return out


def test_one_scope_is_admitted_by_prefixes(spark):
    """A million archives of one scope: most go by running sums, no group is larger than a chunk."""
    n = 1_000_000
    rows = spark.range(n).select(
        F.format_string("%07d", "id").alias("path"), F.lit(1).alias("depth"), F.lit(0).alias("_all"),
        (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).alias("members"),
        F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) == 0, 400_000).otherwise(
            F.pmod(F.xxhash64("id", F.lit(2)), F.lit(90)) + 10).cast("bigint").alias("bytes")).withColumns(
        {"largest": F.lit(1).cast("bigint"), "smallest": F.lit(1).cast("bigint")}).cache()
    limits = {**V.LIMITS_DEFAULT, "max_members": 2_900_000, "max_expanded_bytes": 200_000_000}
    got = budget.admit_under_budget(rows, limits, ["path"], ["_all"], chunk_rows=50_000).select("path", "admitted").toPandas()
    order = rows.select("path", "members", "bytes").toPandas().sort_values("path")
    want = sequential(order.itertuples(index=False), limits["max_members"], limits["max_expanded_bytes"])
    assert dict(zip(got["path"], got["admitted"])) == want
    assert 0 < sum(want.values()) < n - 1000


def model(roots, members, stages, max_depth=None):
    depth, kind, stage_of = {p: 0 for p, _ in roots}, dict(roots), {p: 0 for p, _ in roots}
    for number, kinds in enumerate(stages, 1):
        frontier = [p for p in depth if kind[p] in kinds and (max_depth is None or depth[p] <= max_depth)]
        while frontier:
            found = {}
            for p, c, k in members:
                if p in frontier and c not in depth:
                    old = found.get(c)
                    found[c] = (min(k, old[0]) if old and k and old[0] else k or (old and old[0]), min(depth[p] + 1, old[1] if old else 99))
            for c, (k, d) in found.items():
                kind[c], depth[c], stage_of[c] = k, d, number
            frontier = [c for c in found if kind[c] in kinds and (max_depth is None or depth[c] <= max_depth)]
    return sorted((p, kind[p] or "", depth[p], stage_of[p]) for p in depth)


def test_expansion_equals_model_with_shared_members_and_cycles(spark):
    rng = random.Random(4)
    for _ in range(3):
        names = [f"f{n}" for n in range(60)]
        kind = {n: rng.choice(["A", "B", "C", None]) for n in names}
        members = sorted({(rng.choice(names), c) for c in names for _ in range(rng.choice([1, 1, 1, 2, 3]))})
        members = [(p, c, kind[c]) for p, c in members]
        roots = [(n, kind[n]) for n in names[:4]]
        frames = [spark.createDataFrame(roots, "path string, kind string"),
                  spark.createDataFrame(members, "parent string, child string, kind string")]
        for stages in ([["A"], ["B"], ["C"]], [["A", "B"], ["B"], ["A"]]):
            got = sorted((r.path, r.kind or "", r.depth, r.stage) for r in X.expand_staged(*frames, stages).collect())
            assert got == model(roots, members, stages)
        got = {r.path for r in X.expand_fixed_point(*frames).collect()}
        assert got == {p for p, *_ in model(roots, members, [["A", "B", "C"]])}


def test_a_round_reads_the_partitions_of_its_frontier_only(spark):
    members = spark.range(4000).select(
        F.format_string("d%d", F.col("id") / 4).alias("parent"), F.format_string("f%d", "id").alias("child"), F.lit(None).cast("string").alias("kind"))
    members = members.withColumn("parent", F.format_string("d%d", F.floor(F.substring("child", 2, 9).cast("int") / 4)))
    roots = spark.createDataFrame([("r", "A")], "path string, kind string")
    store = X.store_members(members, roots, slot_rows=100)
    assert store.slots == 40
    frontier = spark.createDataFrame([("d7", 0), ("d9", 0)], "path string, depth int")
    inside = store.inside(frontier)
    assert sorted(r.child for r in inside.collect()) == sorted(f"f{n}" for d in (7, 9) for n in range(4 * d, 4 * d + 4))
    wanted = {r[0] for r in frontier.select(store.slot("path")).collect()}
    plan = inside._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    filters = scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
    assert "slot" in filters
    read = [f for f in store.rows.filter(F.col("slot").isin(list(wanted))).select(F.input_file_name()).distinct().collect()]
    every = store.rows.select(F.input_file_name()).distinct().count()
    assert len(read) <= 2 * X.FILES_PER_SLOT < every


def test_only_shared_members_are_compared_with_what_was_seen(spark):
    members = spark.createDataFrame([("a", "x", "A"), ("b", "x", "A"), ("a", "y", None), ("x", "a", "A")], "parent string, child string, kind string")
    store = X.store_members(members, spark.createDataFrame([("a", "A")], "path string, kind string"))
    assert {(r.child, r.again) for r in store.rows.collect()} == {("x", True), ("y", False), ("a", True)}


def test_gap_stores_members_once(spark, monkeypatch):
    from catalign.operators import expand
    from catalign.plans import ordering

    calls, store = [], expand.store_members
    monkeypatch.setattr(expand, "store_members", lambda *a, **k: calls.append(1) or store(*a, **k))
    assert ordering.staged_gap(spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1
