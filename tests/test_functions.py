import pytest
from pyspark.sql import functions as F

from catalign.functions import content as C, dims as D, hashes as H, names as N, paths as P


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


UNSAFE = [
    "", "/abs/x", "\\rooted", "C:\\x", "C:x", "../up", "a/../b", "a//b", "./a", "a/.", "name.", "name ", "a:stream",
    "CON", "dir/com1.txt", "nul\x00x", "dir/LPT9", "trail /x",
]
SAFE = ["graphics\\monsters\\enemy01.stex", "a/b.c", "console/com10.txt", ".hidden", "a..b/c"]


def test_unsafe_paths(spark):
    got = column(spark, UNSAFE + SAFE + [None], P.is_safe("v"))
    assert got == [False] * len(UNSAFE) + [True] * len(SAFE) + [False]


def test_child_path(spark):
    assert column(spark, ["x/y", "../x", "a\\b"], P.child_path(F.lit("arc.hpi/"), "v")) == [
        "arc.hpi/x/y", None, "arc.hpi/a/b"]


def test_extension_stem_partner(spark):
    names = ["A/b.TAR.Gz", "x", ".rc", "d.x/plain", "end."]
    assert column(spark, names, P.extension("v")) == ["gz", None, "rc", None, None]
    assert column(spark, names, P.stem("v")) == ["b.TAR", "x", ".rc", "plain", "end."]
    assert column(spark, ["d/A.HPI"], P.replace_extension("v", "hpb")) == ["d/A.hpb"]


def test_ancestors(spark):
    assert column(spark, ["a/b/c", "a"], P.ancestors("v")) == [["a", "a/b"], []]


@pytest.mark.parametrize("path, label", [
    ("ui\\Enemy_face.png", "characters"), ("a/scene.bin", "monsters"), ("floor1", "maps"), ("bg3d/x", "dungeon"),
    ("nothing", "misc"), ("font1", "fonts"), ("EFFECT", "effects"),
])
def test_categories_first_rule_wins(spark, path, label):
    assert column(spark, [path], N.categorize("v")) == [label]


def test_slug(spark):
    assert column(spark, ["dir/My  Tex_01.PNG", "___", None, "é-x", "a.b.c"], N.slug("v")) == [
        "my-tex-01", "texture", "texture", "x", "a-b"]


def test_safe_components(spark):
    assert column(spark, [" ..a/b:c?\x01 \u00a0d.. ", "", "x" * 200, "..", "a   b"], N.safe_flat("v")) == [
        "a_b_c__ \u00a0d", "unnamed", "x" * 180, "unnamed", "a b"]
    assert column(spark, ["a/..b c.", ""], N.safe_package("v", "member_0001")) == ["b_c", "member_0001"]
    assert column(spark, ["con", "a:/b  c", "", "COM1.png", "___"], N.safe_export("v")) == [
        "_con", "a_b_c", "texture", "_COM1.png", "texture"]


def test_asset_name_round_trip(spark):
    name = column(spark, ["ab12cd34"], N.format_asset_name(F.lit(64), F.lit(32), "v", F.lit(12), F.lit(None).cast("int")))[0]
    assert name == "tex1_64x32_00000000AB12CD34_12_mip0.png"
    p = column(spark, [name, "TEX1_1x2_deadbeef_3.PNG", "other.png", "tex1_1x2_zz_3.png"], N.parse_asset_name("v"))
    assert tuple(p[0]) == (64, 32, "00000000AB12CD34", 12, 0)
    assert tuple(p[1]) == (1, 2, "00000000DEADBEEF", 3, 0)
    assert p[2] is None and p[3] is None


def test_hashes(spark):
    assert column(spark, [" ab ", "g", "", "0" * 17, None, "FFFFFFFFFFFFFFFF"], H.normalize_hash("v")) == [
        "00000000000000AB", None, None, None, None, "FFFFFFFFFFFFFFFF"]
    df = spark.createDataFrame([(["a", "A", "a"], "c"), ([], "c"), (None, "c"), ([], "")], "v array<string>, c string")
    got = [r[0] for r in df.select(H.hashes_or_candidate("v", "c")).collect()]
    pad = "0" * 15
    assert got == [[pad + "A", pad + "A"], [pad + "C"], [pad + "C"], []]
    off = [r[0] for r in df.select(H.hashes_or_candidate("v", "c", use_candidates=False)).collect()]
    assert off[1] == []


def test_ids(spark):
    assert column(spark, ["a:b.c-d_1", "", "x" * 129, "a b", None], H.is_asset_id("v")) == [True, False, False, False, False]
    assert column(spark, ["00040000000BD300", "4000", None], H.is_title_id("v")) == [True, False, False]


def test_digests(spark):
    direct, mirrored = column(spark, ["abc"], F.array(H.direct_digest("v"), H.mirrored_digest("v")))[0]
    assert direct == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert mirrored == column(spark, ["cba"], H.direct_digest("v"))[0]
    assert column(spark, ["abc"], H.source_group(F.lit("m"), "v", F.lit(7)))[0].startswith("m-")


def test_mask_and_seed(spark):
    assert column(spark, ["enemy_mask", "mask.x", "masked", "a-alpha-b", None], N.is_mask_name("v")) == [
        True, True, False, True, False]
    df = spark.createDataFrame([
        ("hero_tex01", "hero_b", "s/x.bch", "a1"), ("hero_mask", "", "s/x.bch", "a1"), ("", "Dragon Model", "", "a1"),
        ("", "", "dir/Source One.bch", "a1"), ("", "", "", "a1"), ("hero-b-diffuse1", "hero_b", "", "x"), ("other", "hero", "", "x"),
    ], "n string, m string, s string, i string")
    got = [r[0] for r in df.select(N.display_seed("n", "m", "s", "i")).collect()]
    assert got == ["hero", "hero-alpha", "dragon-model", "source-one", "a1", "hero-b", "other"]
    aux = [r[0] for r in df.limit(1).select(N.display_seed("n", "m", "s", "i", F.lit(True))).collect()]
    assert aux == ["hero-alpha"]


def test_dimensions(spark):
    df = spark.createDataFrame([(1, 8, 0), (9, 4096, 12), (0, 8, 0), (8, 4097, 0), (8, 8, 99)], "w int, h int, f int")
    got = [tuple(r) for r in df.select(D.storage_side("w"), D.encoded_size("w", "h", "f"), D.max_levels("w", "h")).collect()]
    assert got == [(8, 256, 4), (16, 16 * 4096 // 2, 13), (0, None, 4), (8, None, 13), (8, None, 4)]
    assert [r[0] for r in df.select(D.stores_alpha("f")).collect()] == [True, False, True, True, False]


@pytest.mark.parametrize("cat, w, h, scale", [
    ("characters", 2048, 8, 4), ("ui", 512, 512, 4), ("ui", 513, 8, 2), ("fonts", 255, 8, 4), ("fonts", 256, 8, 2),
    ("misc", 511, 8, 4), ("misc", 8, 512, 2),
])
def test_target_scale(spark, cat, w, h, scale):
    assert spark.range(1).select(D.target_scale(F.lit(cat), F.lit(w), F.lit(h))).first()[0] == scale


def test_content(spark):
    df = spark.createDataFrame([
        (bytearray(b"STEX..."), None), (bytearray(b"\x00\x01\xffA"), "bin"), (bytearray(b"junk" * 50000 + b"BCH\x00"), None),
        (bytearray(b"ATBCxx"), "bam"), (bytearray(b"ATBCxxCGFX"), None), (bytearray(b"plain"), "stex"),
    ], "content binary, ext string")
    assert [r[0] for r in df.select(C.candidate("ext", "content")).collect()] == [True, False, True, True, True, True]
    assert [r[0] for r in df.select(C.signature("ext", "content")).collect()] == [
        "magic", None, "embedded", None, "wrapped", None]
    assert [r[0] for r in df.select(C.magic_label("content")).collect()][:2] == ["STEX", "...A"]
    assert [r[0] for r in df.select(C.guess_suffix_flat("content")).collect()][:3] == [".stex", ".bin", ".bchbin"]
    named = df.withColumn("name", F.when(F.col("ext").isNull(), "x").otherwise("x.Foo"))
    assert [r[0] for r in named.select(C.guess_suffix_package("content", "name")).collect()] == [
        ".stex", ".foo", ".bin", ".bam", ".bam", ".foo"]


def test_token_offsets(spark):
    assert column(spark, ["aXXbXXXX", "none", "XX" * 20, ""], C.token_offsets("v", "XX", 4)) == [
        [1, 4, 6], [], [0, 2, 4, 6], []]


def test_render(spark):
    df = spark.createDataFrame([(["a", "b"], 2), (["a", "b"], 5)], "s array<string>, n int")
    assert [r[0] for r in df.select(N.render_names("s", "n", "x", "lost")).collect()] == [
        "2 x reference(s) lost: a, b", "5 x reference(s) lost: a, b, ... (+3 more)"]
