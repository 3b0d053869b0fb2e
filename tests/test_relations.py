"""Joins, evidence, state, materials, validation, fingerprints on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalign.functions import hashes as H
from catalign.operators import (dedupe as DD, evidence as EV, expand as X, filters as FI, fingerprint as FP, lookup as L,
                                matching as MA, materials as M, state as ST, summary as S, validate as VA)


def test_bind_only_unambiguous(spark, rows):
    catalog = spark.createDataFrame([("a1", "x"), ("a2", "y"), ("a3", "y"), ("a1", "x"), ("a4", "")], "asset string, name string")
    refs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "x")], "ref int, name string")
    got = rows(L.bind_by_unique_name(refs, catalog, "name", "asset"), "ref", "status", "bound_asset")
    assert got == [(1, "resolved", "a1"), (2, "ambiguous", None), (3, "missing", None), (4, "resolved", "a1")]
    assert rows(L.ambiguous_candidates(refs, catalog, "name", "asset"), "name", "asset") == [("y", "a2"), ("y", "a3")]


def test_reconcile_message_counts_before_truncation(spark):
    refs = spark.createDataFrame([("m", f"n{i:02d}") for i in range(25)], "p string, name string")
    catalog = spark.createDataFrame([("a", "n00"), ("b", "n01"), ("c", "n01")], "asset string, name string")
    got = {r["status"]: r for r in L.reconcile_refs(refs, catalog, "p", "name", "asset", 20).collect()}
    assert got["missing"]["total"] == 23 and got["missing"]["message"].endswith("n21, ... (+3 more)")
    assert got["ambiguous"]["message"].endswith(": n01")


def test_pairs(spark, rows):
    f = spark.createDataFrame([(1, "D/A.hpi"), (2, "d/a.HPB"), (3, "d/b.hpi"), (4, "d/c.hpb"), (5, "d/a.hpb")], "i int, path string")
    assert rows(L.pair_files(f, "hpi", "hpb", "path", ["i"]), "index_path", "data_path") == [
        ("D/A.hpi", "d/a.HPB"), ("d/b.hpi", None)]


def test_exact_match_counts_assets(spark, rows):
    catalog = spark.createDataFrame([("a", "1", "1"), ("b", "2", "3"), ("c", "3", "4")], "asset string, d string, m string")
    dump = spark.createDataFrame([("i", "1", "1"), ("j", "3", "9"), ("k", "4", "8"), ("l", "7", "7")], "item string, d string, m string")
    assert rows(MA.match_exact(dump, catalog, "item", "asset", ["d", "m"])) == [
        ("i", "a", "verified"), ("j", None, "ambiguous"), ("k", "c", "verified"), ("l", None, "unmatched")]


@pytest.mark.parametrize("tile", [5, 2048])
def test_nearest_is_exact(spark, tile):
    rnd = np.random.default_rng(0)
    base = rnd.random((12, 10))
    cat = [(i, "b" if (i // 12) % 2 else "a", (base[i % 12] + rnd.normal(0, 0.03, 10)).tolist(), 64 + i % 3, 64) for i in range(60)]
    ask = [(i, "b" if i % 3 else "a", (base[i % 12][::-1 if i % 2 else 1] + rnd.normal(0, 0.02, 10)).tolist(), 64, 64) for i in range(40)]
    ddl = "id bigint, blk string, v array<double>, w int, h int"
    for aspect in (None, ("w", "h")):
        got = {r["id"]: r for r in MA.match_nearest(
            spark.createDataFrame(ask, ddl), spark.createDataFrame(cat, ddl).withColumnRenamed("id", "cid"), "id", "cid", "v", "blk",
            tile_rows=tile, aspect=aspect).collect()}
        assert len(got) == len(ask)
        for i, blk, v, w, h in ask:
            near = sorted(
                (min(np.abs(np.array(v) - c).mean(), np.abs(np.array(v)[::-1] - c).mean()), j)
                for j, cb, c, cw, ch in cat if cb == blk and (not aspect or abs(cw / ch - w / h) <= max(0.02, 0.02 * cw / ch)))
            second = near[1][0] if len(near) > 1 else 1.0
            assert got[i]["cid"] == near[0][1]
            assert got[i]["score"] == pytest.approx(near[0][0]) and got[i]["runner_up_score"] == pytest.approx(second)
            assert got[i]["accepted"] == (near[0][0] <= 0.055 and (second - near[0][0] >= 0.012 or second >= 0.10))


def test_nearest_of_few_candidates(spark):
    ddl = "id bigint, blk string, v array<double>"
    ask = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "b", [0.0, 0.0]), (3, "c", [0.0, 0.0])], ddl)
    cat = spark.createDataFrame([(7, "a", [0.9, 0.9]), (8, "b", [5.0, 5.0]), (9, "b", [0.0, 0.01])], ddl).withColumnRenamed("id", "cid")
    got = {r["id"]: (r["cid"], r["score"], r["runner_up_score"], r["accepted"]) for r in MA.match_nearest(ask, cat, "id", "cid", "v", "blk").collect()}
    assert got == {1: (7, pytest.approx(0.9), 1.0, False), 2: (9, pytest.approx(0.005), pytest.approx(5.0), True), 3: (None, None, None, False)}


def test_nearest_compares_few_pairs_of_clustered_vectors(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(0, 1, (200, 16))
    vectors = [(i, "a", (base[i % 200] + rnd.normal(0, 0.01, 16)).tolist()) for i in range(2000)]
    frame = spark.createDataFrame(vectors, "id bigint, blk string, v array<double>")
    cat, ask = (MA.prepare_vectors(frame, "id", "v", "blk", None, side) for side in "cd")
    c_side, d_side = MA.Grid(0.067, 2048, False).sides(cat, ask)
    pairs = c_side.groupBy(*MA.Grid.KEYS).count().withColumnRenamed("count", "n").join(d_side.groupBy(*MA.Grid.KEYS).count(), MA.Grid.KEYS)
    assert pairs.selectExpr("sum(n * count)").first()[0] < 2000 * 2000 / 20


def test_profiles(spark, rows):
    profiles = spark.createDataFrame([("one", "T1", None, 0), ("two", None, "AB", 1), ("three", None, "B", 2)],
                                     "profile string, exact_id string, family string, priority int")
    df = spark.createDataFrame([("T1", "zzz"), ("T9", "xABx"), ("T8", "xBx"), ("T7", "q")], "t string, c string")
    assert rows(L.lookup_profile(df, profiles, "t", "c"), "t", "profile", "profile_status") == [
        ("T1", "one", "exact"), ("T7", None, "unsupported"), ("T8", "three", "family"), ("T9", "two", "family")]
    # As many profiles as there are: no limit on their number.
    many = spark.range(20_000).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("profile"), F.lit(None).cast("string").alias("exact_id"),
        F.lpad(F.col("id").cast("string"), 5, "0").alias("family"), F.col("id").cast("int").alias("priority"))
    codes = spark.createDataFrame([("a", "x19999y00123"), ("b", "none")], "t string, c string")
    assert rows(L.lookup_profile(codes, many, "t", "c"), "t", "profile") == [("a", "p123"), ("b", None)]


def test_mapping_resolution(spark, rows):
    files = spark.createDataFrame([("a/x.png",), ("b/y.png",), ("c/y.png",)], "path string")
    m = spark.createDataFrame([("01", "a/x.png"), ("02", "x.png"), ("03", "y.png"), ("04", "x.png"), ("04", "b/y.png"), ("05", "no"),
                               ("06", "x.png"), ("06", "a/x.png"), ("zz", "x.png")], "hash string, name string")
    assert rows(L.resolve_mapping(m.filter("hash <> 'zz'"), files)) == [
        ("01", "a/x.png", 1), ("02", "a/x.png", 1), ("03", None, 0), ("04", None, 2), ("05", None, 0), ("06", "a/x.png", 1)]
    assert rows(VA.validate_mapping(m, files, roots=files)) == [
        ("bad_hash", "zz"), ("no_file", "03"), ("no_file", "05"), ("root_documents", "3"), ("several_files", "04")]


def test_precedence_and_two_keys(spark, rows):
    a = spark.createDataFrame([(1, "n1", "h1"), (2, "n2", "h2"), (3, "n3", None)], "id int, n string, h string")
    alias = spark.createDataFrame([("h1", "by-hash"), ("n1", "by-name"), ("h2", "by-hash2")], "alias string, target string")
    assert rows(L.resolve_precedence(a, alias, "id", [F.col("n"), F.col("h")]), "id", "target") == [(1, "by-name"), (2, "by-hash2")]
    man = spark.createDataFrame([("n1", "h9", "v1"), ("n9", "h2", "v2")], "n string, h string, v string")
    assert rows(L.ingest_external(a, man, "n", "h", "v", ["v"]), "id", "v", "matched_by") == [
        (1, "v1", "first"), (2, "v2", "second"), (3, None, None)]


def test_changed_and_live(spark, rows):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1), (4, "d", 1)], "id int, dg string, sz int")
    cur = spark.createDataFrame([(1, "a", 1), (2, "x", 1), (3, "c", 2), (4, None, None), (5, "n", 1)], "id int, dg string, sz int")
    assert rows(L.changed_rows(base, cur, "id", "dg", "sz")) == [(2,), (3,), (4,)]
    assets = spark.createDataFrame([(1, "old", ["A", "B"]), (2, "old", ["A", "C"]), (3, "old", [])], "id int, name string, hs array<string>")
    live = spark.createDataFrame([("A", "d/new.png"), ("B", "d/new.png"), ("C", "d/other.png")], "hash string, file string")
    assert rows(L.keep_live_name(assets, live, "id", "hs", "name"), "id", "name") == [(1, "new.png"), (2, "old"), (3, "old")]


def test_evidence_never_downgrades(spark, rows):
    ev = spark.createDataFrame([("a", "h", 3, 1), ("a", "h", 1, 2), ("a", "h", 3, 0), ("a", "g", 0, 5)], "asset string, hash string, rank int, at int")
    want = [("a", "g", 0, 5), ("a", "h", 3, 0)]
    for parts in (1, 7, 50):
        assert rows(EV.merge_evidence(ev.repartition(parts), ["asset", "hash"], "rank", ["at"])) == want


def test_confirm_and_apply(spark, rows):
    ev = spark.createDataFrame([("a", "1", "candidate", "m", 1), ("a", "2", "verified", "m", 2)], "asset string, hash string, status string, method string, at int")
    out, errors, log = EV.confirm(ev, spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "asset string, hash string"), ["asset", "hash"])
    assert rows(out, "hash", "status", "method") == [("1", "verified", "user_confirmed_visual_candidate"), ("2", "verified", "m")]
    assert rows(errors) == [("a", "2", "no_pending"), ("b", "1", "unknown_asset")]
    assert rows(log, "asset", "hash", "candidate_method", "method") == [("a", "1", "m", "user_confirmed_visual_candidate")]
    stored = spark.createDataFrame([("a", 1, 2, "old"), ("a", 2, 1, "old"), ("c", 1, 1, "old")], "asset string, hash int, rank int, file string")
    scan = spark.createDataFrame([("a", 1, 1, "new"), ("a", 2, 1, "new"), ("c", 1, 3, "new"), ("d", 1, 1, "new")], stored.schema)
    assert rows(EV.rescan_evidence(stored, scan, ["asset", "hash"], "rank", ["file"])) == [
        ("a", 1, 2, "old"), ("a", 2, 1, "old"), ("c", 1, 3, "new"), ("d", 1, 1, "new")]
    new = spark.createDataFrame([("a", "1", "verified", "exact", 3), ("a", "2", "candidate", "similar", 4), ("c", "9", "candidate", "similar", 5)], ev.schema)
    assert rows(EV.apply_evidence(ev, new, ["asset", "hash"], ["at"]), "asset", "hash", "status", "method", "log_rows") == [
        ("a", "1", "verified", "exact", 2), ("a", "2", "verified", "m", 2), ("c", "9", "candidate", "similar", 1)]


def test_rescan_keeps_user_columns(spark, rows):
    old = spark.createDataFrame([(1, 10, "mine", "pinned", True), (2, 20, "mine", "auto", False), (3, 30, None, "auto", False)],
                                "id int, w int, note string, cat string, ov boolean")
    new = spark.createDataFrame([(1, 11, "scan"), (2, 21, "scan"), (4, 41, "scan")], "id int, w int, cat string")
    assert rows(ST.rescan_upsert(old, new, ["id"], ["w"], ["note"], ["cat"], "ov")) == [
        (1, 11, "mine", "pinned", True), (2, 21, "mine", "scan", False), (3, 30, None, "auto", False), (4, 41, None, "scan", False)]
    done, unknown = ST.set_user_metadata(old, spark.createDataFrame([(1, None), (9, "x")], "id int, note string"), "id", ["note"])
    assert rows(done, "id", "note") == [(1, None), (2, "mine"), (3, None)] and rows(unknown) == [(9,)]


def test_sanitize(spark):
    df = spark.createDataFrame([("tmp\\work/a", [("tmp/work/b",), ("keep",)])], "p string, s array<struct<f: string>>")
    r = ST.sanitize_nested(ST.sanitize_refs(df, ["p"], "tmp/work/", "gone"), "s", "f", "tmp/work/", "gone").first()
    assert (r["p"], r["p_status"]) == ("", "gone") and [tuple(x) for x in r["s"]] == [("", "gone"), ("keep", None)]


def stage_rows(spark, data):
    return spark.createDataFrame(data, "material string, stage int, input int, combiner_id int, source_id int, operand_id int")


def test_stages(spark, rows):
    inputs = stage_rows(spark, [
        ("ok", 0, 0, 0, 3, 0), ("ok", 1, 0, 1, 15, 1), ("ok", 1, 1, 1, 4, 2),
        ("previous_first", 0, 0, 0, 15, 0), ("previous_first", 1, 0, 0, 3, 0),
        ("arity", 0, 0, 1, 3, 0), ("dot", 0, 0, 6, 3, 0), ("operand", 0, 0, 0, 3, 8), ("no_slot", 0, 0, 0, 5, 0),
        ("constant", 0, 0, 0, 14, 0), ("previous_rgb", 0, 0, 0, 3, 0), ("previous_rgb", 1, 0, 0, 15, 2),
    ])
    slots = inputs.select("material").distinct().withColumns({"slot": F.explode(F.array(F.lit(0), F.lit(1))), "format": F.lit(1)})
    got = dict(rows(M.stage_resolvable(inputs, ["material"], slots)))
    assert {k for k, v in got.items() if v} == {"ok"} and len(got) == 8
    # A stage without inputs, and materials without stages or without slots.
    stages = inputs.select("material", "stage", "combiner_id").unionByName(
        spark.createDataFrame([("ok", 2, 0), ("empty", 0, 0)], "material string, stage int, combiner_id int"))
    with_empty = M.stage_resolvable(inputs, ["material"], slots, stages)
    assert dict(rows(with_empty)) == {**got, "ok": False, "empty": False}
    bound = slots.filter("material <> 'dot'").unionByName(spark.createDataFrame([("no_stage", 0, 1)], slots.schema))
    report = dict(rows(M.material_report(bound, M.stage_resolvable(inputs, ["material"], slots), M.stage_use_counts(inputs, slots, ["material"]),
                                         ["material"]), "material", "status"))
    assert report["ok"] == "resolved" and report["no_stage"] == "no_texture_alpha" and report["arity"] == "unresolved" and "dot" not in report
    uses = {r["material"]: (r["constant_inputs"], r["explicit_channels"]) for r in M.stage_use_counts(inputs, slots, ["material"]).collect()}
    assert uses["ok"] == (1, 1) and uses["operand"] == (0, 0) and "constant" not in uses


def test_staged_order_misses_what_fixed_point_finds(spark, rows):
    roots = spark.createDataFrame([("r1", "A"), ("r2", "B")], "path string, kind string")
    members = spark.createDataFrame([
        ("r1", "r1/b", "B"), ("r1/b", "r1/b/f", None), ("r2", "r2/a", "A"), ("r2/a", "r2/a/f", None), ("r2", "r2/a", "A"),
        ("r1", "r1/a", "A"), ("r1/a", "r1/a/g", None)], "parent string, child string, kind string")
    staged = X.expand_staged(roots, members, [["A"], ["B"]])
    full = X.expand_fixed_point(roots, members)
    assert rows(X.staged_gap(full, staged), "path", "depth") == [("r2/a/f", 2)]
    assert staged.join(full, "path", "left_anti").isEmpty()
    assert rows(X.expand_fixed_point(roots, members, max_depth=0), "path") == [("r1",), ("r1/a",), ("r1/b",), ("r2",), ("r2/a",)]


def test_expansion_charges_in_order(spark):
    rnd = random.Random(4)
    paths, members = ["r0", "r1", "r2"], []
    kind = {p: "A" for p in paths}
    for depth in range(3):
        nxt = []
        for p in [x for x in kind if x.count("/") == depth]:
            for i in range(rnd.randint(0, 5)):
                child = f"{p}/{i}"
                kind[child] = rnd.choice(["A", "B", None])
                members.append((p, child, kind[child], rnd.randint(1, 30)))
                nxt.append(child)
    limits = {"max_depth": 2, "max_members": 25, "max_expanded_bytes": 320, "max_member_bytes": 29, "max_archive_bytes": 1 << 40}
    known, used, refused = list(paths), [0, 0], {}
    for k in ("A", "B"):
        frontier = [p for p in known if kind[p] == k]
        while frontier:
            fresh = []
            for p in sorted(frontier):
                inside = [m for m in members if m[0] == p]
                size = sum(m[3] for m in inside)
                if (p.count("/") > 2 or any(m[3] > 29 for m in inside) or used[0] + len(inside) > 25 or used[1] + size > 320):
                    refused[p] = True
                    continue
                used = [used[0] + len(inside), used[1] + size]
                fresh += [m[1] for m in inside]
            known += fresh
            frontier = [p for p in fresh if kind[p] == k]
    files, no, usage = X.expand_under_budget(
        spark.createDataFrame([(p, "A") for p in paths], "path string, kind string"),
        spark.createDataFrame(members, "parent string, child string, kind string, size bigint"), [["A"], ["B"]], limits)
    assert sorted(r["path"] for r in files.collect()) == sorted(known)
    assert sorted(r["path"] for r in no.collect()) == sorted(refused)
    assert [usage["members"], usage["bytes"]] == used and refused


def test_validation(spark, rows):
    assets = spark.createDataFrame([("a", "g"), ("a", "g"), ("b", "other")], "asset string, game string")
    ev = spark.createDataFrame([("a", "1", 2), ("b", "1", 3), ("a", "2", 0), ("b", "2", 1), ("a", "3", 2), ("a", "3", 3)], "asset string, hash string, rank int")
    assert rows(VA.validate_catalog(assets, ev, "asset", "game", "g")) == [
        ("conflicting_hash", "1"), ("duplicate_id", "a"), ("game_mismatch", "b")]
    plan = VA.plan_mapping(ev.withColumn("path", F.concat("asset", F.lit(".png"))), "hash", "path")
    assert rows(plan) == [("1", None, "conflict"), ("3", "a.png", "mapped")]


def test_fingerprint_is_stable(spark, rows):
    rnd = random.Random(2)
    data = [(f"/secret/{i}", f"{i % 9:04X}", 8 * (i % 3), "cat", ["B", "a"][: i % 3], i % 2) for i in range(90)]
    schema = "source string, candidate_hash string, width int, category string, verified_hashes array<string>, material_binding_count int"
    sections = {"category": F.col("category"), "width": F.col("width")}
    results = []
    for parts in (1, 7, 40):
        rnd.shuffle(data)
        results.append(rows(FP.fingerprint(spark.createDataFrame(data, schema).repartition(parts), sections)))
    assert results[0] == results[1] == results[2]
    assert not any("secret" in str(r) for r in results[0])
    one = FP.fingerprint(spark.createDataFrame(data, schema), sections)
    two = FP.fingerprint(spark.createDataFrame(data[:-1], schema), sections)
    assert FP.diff_fingerprints(one, one).isEmpty()
    keys = {r["key"] for r in FP.diff_fingerprints(one, two).collect()}
    assert {"asset_count", "asset_descriptor_sha256"} <= keys
    row = spark.createDataFrame(data[:1], schema)
    assert '"verified_hashes":[' in row.select(FP.descriptor(row)).first()[0]


def test_dedupe_and_sets(spark, rows):
    a = spark.createDataFrame([("h", 1, "s1"), ("h", 2, "s2"), ("h", 3, "s1"), ("g", 4, "s9")], "h string, i int, src string")
    kept = DD.dedupe_assets(a, ["h"], ["i"])
    assert rows(kept, "h", "i", "src", "copies") == [("g", 4, "s9", 1), ("h", 1, "s1", 3)]
    assert rows(DD.merged_values(a, kept, ["h"], "src", exclude_kept=True)) == [("h", "s2")]
    assert rows(DD.carry_forward(kept.select("h", "i"), spark.createDataFrame([("h", 9), ("z", 8)], "h string, i int"), ["h"])) == [
        ("g", 4), ("h", 1), ("z", 8)]
    u = DD.union_nested([a.filter("i > 1"), a], ["h"], "src", ["i"])
    assert rows(u, "h", "src", "i") == [("g", "s9", 4), ("h", "s1", 3), ("h", "s2", 2)]
    assert rows(DD.leaf_files(spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a",)], "parent string"))) == [("b",)]


def test_union_of_roots_keeps_the_first(spark, rows):
    a = spark.createDataFrame([("x", 2, "late"), ("x", 1, "early"), ("y", 3, "a")], "path string, i int, v string")
    b = spark.createDataFrame([("x", 0, "other root"), ("z", 0, "b")], "path string, i int, v string")
    for parts in (1, 9):
        assert rows(DD.union_roots([a.repartition(parts), b], ["i"]), "path", "v") == [("x", "early"), ("y", "a"), ("z", "b")]


def test_countable_issues(spark):
    data = [("a.bin", "romfs_read", True), ("a.HPI", "romfs_read", False), ("x/a.stex", "texture_decode", True),
            ("a.bch", "texture_decode", False), ("a", "bch", True), ("a", "archive_budget", False)]
    df = spark.createDataFrame(data, "source string, stage string, want boolean")
    assert all(r[0] == r[1] for r in df.select(FI.countable(), "want").collect())


def test_reports(spark):
    m = spark.createDataFrame([("verified", True), ("verified", True), ("ambiguous", None), ("unmatched", None)], "status string, agrees boolean")
    r = S.evidence_report(m).first()
    assert (r["found"], r["matched_exact"], r["verdict"]) == (4, 2, "PASS")
    assert S.evidence_report(m.filter("status <> 'verified'")).first()["verdict"] == "NO_EXACT_SAMPLES"
    assert S.evidence_report(m.withColumn("agrees", F.lit(False))).first()["verdict"] == "FAIL"
    s = spark.createDataFrame([("resolved",)], "status string")
    assert tuple(S.status_rollup(s, "status", ["resolved", "unresolved"]).first()) == (1, 0)


def test_depth(spark, rows):
    f = spark.createDataFrame([("a/b/c/f",), ("a/x",), ("z",), ("ab/f",)], "path string")
    r = spark.createDataFrame([("a", 1), ("a/b", 2)], "root string, depth int")
    assert rows(L.nesting_depth(f, r)) == [("a/b/c/f", 3), ("a/x", 2), ("ab/f", 1), ("z", 1)]


def test_binding_key(spark):
    assert spark.range(1).select(H.binding_key(F.lit("a"), F.lit(None), F.lit(True))).first()[0] == "a||true"


def test_hand_over_counts_only_new_bindings(spark, rows):
    catalog = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y"), ("d", "z")], "asset string, name string")
    held = spark.createDataFrame([("a", "m|1", 9), ("d", "m|1", 9), ("e", "k", 9)], "asset string, binding string, ref int")
    refs = spark.createDataFrame(
        [("x", "m|1", 1), ("x", "m|2", 3), ("x", "m|2", 2), ("y", "m|1", 1), ("w", "m|1", 1), ("z", None, 1), (None, "m|1", 1), ("z", "m|3", None)],
        "name string, binding string, ref int")
    got = L.hand_over_bindings(refs, catalog, held, "name", "asset", "binding", ["ref"])
    assert rows(got) == [("a", "m|1", 9, False), ("a", "m|2", 2, True), ("d", "m|1", 9, False), ("d", "m|3", None, True), ("e", "k", 9, False)]
    assert rows(L.count_handed_over(got, "asset")) == [("a", 2, 1), ("d", 2, 1), ("e", 1, 0)]
    # A second hand-over adds nothing.
    again = L.hand_over_bindings(refs, catalog, got.drop("added"), "name", "asset", "binding", ["ref"])
    assert again.filter("added").isEmpty()


def test_leaves_below_kind(spark, rows):
    files = spark.createDataFrame([(p,) for p in (
        "r.BCH", "r.BCH/a.png", "r.bch/s.ctpk", "R.bch\\S.ctpk\\i.png", "r.bch/empty.ctpk", "x.bchk/a.png", "x.bch", "plain.png", None)], "path string")
    assert rows(DD.leaves_below(files, "bch")) == [("R.bch\\S.ctpk\\i.png",), ("r.BCH/a.png",), ("r.bch/empty.ctpk",)]
    assert rows(DD.leaves_below(files, "ctpk")) == [("R.bch\\S.ctpk\\i.png",)]


def test_mapping_names_must_be_relative_images(spark, rows):
    names = ["a/b.png", "a//b.png", "../b.png", "/a.png", "a/b.PNG", "a/b.tga", "", "a/..png"]
    mapping = spark.createDataFrame([(f"{n:016X}", p) for n, p in enumerate(names)], "hash string, name string")
    files = mapping.selectExpr("name AS path")
    got = rows(VA.validate_mapping(mapping, files, image_ext="png").filter("rule = 'bad_path'"), "subject")
    assert got == [("",), ("../b.png",), ("/a.png",), ("a//b.png",), ("a/b.tga",)]
    assert "bad_path" not in {r.rule for r in VA.validate_mapping(mapping, files).collect()}


def test_members_are_grouped_once(spark, rows):
    from catalign.operators.budget import check_members

    limits = {"max_members": 3, "max_expanded_bytes": 50, "max_member_bytes": 45, "max_archive_bytes": 90}
    data = [("a", 0, 5, 90), ("a", -1, -2, 90), ("a", -1, 4, 90), ("a", 88, 4, 90), ("b", 0, 46, 91), ("b", 0, 6, 91), (None, 0, None, None), ("c", 0, 1, 9)]
    found = check_members(spark.createDataFrame(data, "archive string, off long, size long, whole long"), "archive", "off", "size", "whole", limits)
    assert rows(found, "archive", "rule", "n") == [
        ("a", "members", 1), ("a", "negative_size", 1), ("a", "outside_source", 2), ("b", "archive_bytes", 1), ("b", "expanded_bytes", 1), ("b", "member_bytes", 1)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
