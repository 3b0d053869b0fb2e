"""Ordered operators against sequential models, hot groups included."""

import random

import pytest
from pyspark.sql import functions as F

from catalign.functions import values as V
from catalign.operators import budget as B, dedupe as DD, naming
from catalign.operators.ranking import number_and_total


def test_numbering_of_hot_groups(spark, rows):
    rnd = random.Random(1)
    data = [("hot" if i % 3 else f"g{i % 7}", i, rnd.randint(0, 9)) for i in range(600)]
    data += [(None, i, 1) for i in range(600, 640)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "g string, o int, v bigint").repartition(7)
    args = (["g"], ["o"], "n", {"t": "v"})
    plain = rows(number_and_total(df, *args))
    spread = rows(number_and_total(df, *args, hot_rows=10, slabs=13))
    assert plain == spread
    hot = sorted((o, v) for g, o, v in data if g == "hot")
    assert max(r[3] for r in plain if r[0] == "hot") == len(hot)
    assert max(r[4] for r in plain if r[0] == "hot") == sum(v for _, v in hot)


def unique_names_model(assets):
    used, out = {}, {}
    for base, owner in sorted(set(assets)):
        name = base
        if name in used and used[name] != owner:
            stem = f"{base}-{owner[:8].lower()}"
            name, n = stem, 2
            while name in used and used[name] != owner:
                name, n = f"{stem}-{n}", n + 1
        used[name] = owner
        out[base, owner] = name
    return out


@pytest.mark.parametrize("seed", range(2))
def test_unique_names(spark, seed):
    rnd = random.Random(seed)
    owners = [f"{rnd.choice(['AAAAAAAA', 'BBBBBBBB'])}{i:08X}" for i in range(6)]
    bases = ["a", "b", "a-aaaaaaaa", "a-aaaaaaaa-2", "a-aaaaaaaa-aaaaaaaa", "b-bbbbbbbb"]
    assets = [(rnd.choice(bases), rnd.choice(owners)) for _ in range(25)]
    df = spark.createDataFrame(assets, "base string, owner string")
    got = {(r["base"], r["owner"]): r["name"] for r in naming.assign_unique_names(df, "base", "owner", hot_rows=3).collect()}
    assert got == unique_names_model(assets)


def within_model(members):
    used, out = {}, {}
    for parent, at, name in sorted(members):
        taken = used.setdefault(parent, set())
        final = name
        if name in taken:
            i = name.rfind(".")
            stem, ext = (name[:i], name[i:]) if i > 0 else (name, "")
            n = 2
            while f"{stem}_{n}{ext}" in taken:
                n += 1
            final = f"{stem}_{n}{ext}"
        taken.add(final)
        out[parent, at] = final
    return out


def test_names_within_archives(spark):
    rnd = random.Random(3)
    pool = ["a.x", "a_2.x", "a_3.x", "a_2_2.x", "a_5.x", "a_02.x", "b", "b_2", "b_3", ".h", "c.x"]
    members = [(p, i, rnd.choice(pool)) for p in "pqrstuv" for i in range(rnd.randint(8, 40))]
    members += [("calm", i, rnd.choice(["m.x", "n.x"])) for i in range(10)]
    df = spark.createDataFrame(members, "parent string, at int, name string")
    got = {(r["parent"], r["at"]): r["unique_name"]
           for r in naming.dedupe_names_within(df, "parent", "name", ["at"], hot_rows=7).collect()}
    assert got == within_model(members)


def admit_model(rows, cap_m, cap_b):
    m = b = 0
    out = {}
    for at, dm, db in sorted(rows):
        ok = m + dm <= cap_m and b + db <= cap_b
        out[at] = ok
        if ok:
            m, b = m + dm, b + db
    return out


@pytest.mark.parametrize("fold_rows, chunk", [(1000, 10), (1, 20)])
def test_admission_is_a_fold(spark, fold_rows, chunk):
    rnd = random.Random(5)
    limits = {**V.LIMITS_DEFAULT, "max_members": 60, "max_expanded_bytes": 700, "max_depth": 2}
    data = [(s, i, rnd.randint(0, 3), rnd.randint(1, 8), rnd.randint(1, 120)) for s in "xyz" for i in range(80)]
    df = spark.createDataFrame(data, "s string, i int, depth int, members bigint, bytes bigint").withColumns(
        {"largest": F.col("bytes"), "smallest": F.lit(0).cast("bigint")})
    got = B.admit_under_budget(df, limits, ["i"], ["s"], fold_rows=fold_rows, chunk_rows=chunk).collect()
    assert len(got) == len(data)
    for s in "xyz":
        model = admit_model([(i, m, b) for q, i, d, m, b in data if q == s and d <= 2], 60, 700)
        assert {r["i"]: r["admitted"] for r in got if r["s"] == s and r["depth"] <= 2} == model
        assert all(r["reason"] == "depth" for r in got if r["depth"] > 2)
        assert all((r["reason"] is None) == r["admitted"] for r in got)


def test_rejection_leaves_usage(spark):
    limits = {**V.LIMITS_DEFAULT, "max_members": 3, "max_expanded_bytes": 12, "max_depth": 1}
    df = spark.createDataFrame([(1, 0, 2, 8), (2, 0, 1, 5), (3, 0, 1, 4), (4, 2, 1, 1)],
                               "i int, depth int, members bigint, bytes bigint").withColumns(
        {"largest": F.col("bytes"), "smallest": F.lit(1).cast("bigint"), "s": F.lit(0)})
    got = {r["i"]: r["reason"] for r in B.admit_under_budget(df, limits, ["i"], ["s"]).collect()}
    assert got == {1: None, 2: "expanded_bytes", 3: None, 4: "depth"}


def test_capped_sample(spark):
    data = [(0, i, f"s{i % 5}", 10 * (i % 4)) for i in range(12)] + [(1, i, f"s{i}", 25) for i in range(12, 20)]
    got = B.capped_sample(spark.createDataFrame(data, "r int, i int, src string, size bigint"), "r", ["i"], "src", "size",
                          max_rows=5, max_bytes=90, quotas={0: 2}).orderBy("pick").collect()
    used, seen, want, first = 0, set(), [], 0
    for r, i, src, size in sorted(data):
        if len(want) == 5 or size <= 0 or used + size > 90 or src in seen or (r == 0 and first >= 2):
            continue
        used, first = used + size, first + (r == 0)
        seen.add(src)
        want.append(i)
    assert [g["i"] for g in got] == want


def test_last_write_and_slots(spark, rows):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 5, "c"), ("p", 3, "b"), ("q", 2, "z")], "path string, i int, data string")
    assert rows(DD.last_write_wins(df, ["path"], ["i"], ["data"])) == [("p", 1, "c", 3), ("q", 2, "z", 1)]
    b = spark.createDataFrame([("m", 0, False, 1, "x"), ("m", 0, True, 2, "y"), ("m", 0, True, 3, "z"), ("m", 1, False, 4, "w"),
                               ("m", 7, True, 5, "v")], "m string, slot int, on boolean, i int, a string")
    assert rows(DD.pick_slot(b, ["m"], "slot", "on", ["i"], [0, 1, 2]), "slot", "a") == [(0, "y"), (1, "w")]


def test_layout_and_pages(spark, rows):
    df = spark.createDataFrame([("a", i, 10 + i) for i in range(5)], "g string, lvl int, size bigint")
    for hot in (100, 1):
        assert rows(DD.segment_layout(df, ["g"], ["lvl"], "size", hot_rows=hot), "lvl", "offset", "end") == [
            (0, 0, 10), (1, 10, 21), (2, 21, 33), (3, 33, 46), (4, 46, 60)]
        assert [r[2:] for r in rows(DD.paginate(df, ["g"], ["lvl"], 2, hot_rows=hot), "g", "lvl", "page", "cell")] == [
            (1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]


def test_chunks_of_many_scopes_pass_through_one_call(spark, rows, monkeypatch):
    """No call for each scope, of which there may be millions; scopes go on over the borders of batches."""
    from pyspark.sql.group import GroupedData

    from catalign.operators.budget import admit_under_budget

    def none(*_):
        raise AssertionError("a call for each scope")

    monkeypatch.setattr(GroupedData, "applyInPandas", none)
    # Scope 0 has as many rows as half of the others together.
    n = F.col("id")
    archives = spark.range(12_000).select(
        F.when(n % 3 == 0, 0).otherwise(n % 700).alias("scope"), n.alias("at"), F.lit(0).alias("depth"), (n * 7 % 11 + 1).alias("members"),
        (n * 13 % 97).alias("bytes"), F.lit(1).cast("bigint").alias("largest"), F.lit(1).cast("bigint").alias("smallest"))
    limits = {"max_depth": 3, "max_members": 60, "max_expanded_bytes": 500, "max_member_bytes": 49, "max_archive_bytes": 10}
    want, used = {}, {}
    for r in archives.orderBy("at").collect():
        m, b = used.get(r.scope, (0, 0))
        why = "members" if m + r.members > 60 else "expanded_bytes" if b + r.bytes > 500 else None
        want[r.at] = why
        if why is None:
            used[r.scope] = m + r.members, b + r.bytes
    got = admit_under_budget(archives, limits, ["at"], ["scope"], fold_rows=2, chunk_rows=5)
    assert {r.at: r.reason for r in got.collect()} == want
