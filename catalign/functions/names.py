"""Naming and labelling expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V
from .paths import col, extension, forward, leaf, stem


def categorize(c, rules=V.CATEGORY_RULES, default: str = V.CATEGORY_DEFAULT) -> Column:
    """First rule with any substring hit, in rule order."""
    text = F.lower(forward(c))
    out = None
    for label, needles in rules:
        # A needle that holds another needle of its rule can never decide alone.
        needles = [n for n in needles if not any(m != n and m in n for m in needles)]
        hit = text.contains(needles[0])
        for needle in needles[1:]:
            hit = hit | text.contains(needle)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def _slug_text(text: Column, fallback: str) -> Column:
    t = F.regexp_replace(text, r"[^A-Za-z0-9]+", "-")
    t = F.lower(F.regexp_replace(t, r"^-+|-+$", ""))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(fallback)).otherwise(t)


def slug(c, fallback: str = "texture") -> Column:
    """Readable lower-case stem of letters, digits and single dashes."""
    return _slug_text(stem(c), fallback)


def safe_flat(c) -> Column:
    """Component for archives without directories (at most 180 characters)."""
    t = F.regexp_replace(F.trim(F.translate(col(c), "\\/", "__")), r"^\.+|\.+$", "")
    t = F.regexp_replace(t, r'[\x00-\x1f<>:"|?*]', "_")
    t = F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, 180)
    return F.when(F.coalesce(t, F.lit("")) == "", "unnamed").otherwise(t)


def safe_package(c, fallback) -> Column:
    """Component for package members: last path part, ASCII only, at most 120."""
    t = F.regexp_replace(F.trim(leaf(c)), r"[^A-Za-z0-9._@+\-]", "_")
    t = F.substring(F.regexp_replace(t, r"^[._]+|[._]+$", ""), 1, 120)
    fb = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(F.coalesce(t, F.lit("")) == "", fb).otherwise(t)


def member_name_flat(index, name, suffix: Column) -> Column:
    """Member name in archives without directories; unnamed members get their index and a guessed suffix."""
    safe = safe_flat(name)
    return (
        F.when(col(name).isNull(), F.concat(F.format_string("hash_00000000_%05d", col(index)), suffix))
        .when(extension(safe).isNull(), F.concat(safe, suffix)).otherwise(safe)
    )


def member_name_package(index, name, suffix_of) -> Column:
    """Member name in packages: index first, so it is unique. ``suffix_of`` maps the safe name to a suffix."""
    base = safe_package(F.coalesce(col(name), F.lit("")), F.format_string("member_%04d", col(index)))
    want = suffix_of(base)
    have = F.coalesce(F.concat(F.lit("."), extension(base)), F.lit(""))
    return F.concat(F.format_string("%04d_", col(index)), base, F.when(have == want, "").otherwise(want))


def safe_export(c, fallback: str = "texture") -> Column:
    """Component for exports: 96 characters read, reserved names prefixed."""
    t = F.regexp_replace(F.substring(col(c), 1, 96), r'[\x00-\x1f\x7f\s<>:"/\\|?*_]+', "_")
    t = F.regexp_replace(t, r"^[._ ]+|[._ ]+$", "")
    t = F.when(F.coalesce(t, F.lit("")) == "", F.lit(fallback)).otherwise(t)
    return F.when(t.rlike(rf"(?i)^{V.DEVICE_NAMES} *(\..*)?$"), F.concat(F.lit("_"), t)).otherwise(t)


def parse_asset_name(c) -> Column:
    """struct(width, height, hash, format, mip), null when the name has another shape."""
    name = leaf(c)

    def group(i):
        return F.regexp_extract(name, V.ASSET_NAME_PATTERN, i)

    return F.when(
        name.rlike(V.ASSET_NAME_PATTERN),
        F.struct(
            group(1).cast("int").alias("width"),
            group(2).cast("int").alias("height"),
            F.lpad(F.upper(group(3)), 16, "0").alias("hash"),
            group(4).cast("int").alias("format"),
            F.coalesce(F.nullif(group(5), F.lit("")), F.lit("0")).cast("int").alias("mip"),
        ),
    )


def format_asset_name(width, height, hash_, fmt, mip) -> Column:
    """Canonical file name; the inverse of parse_asset_name."""
    return F.concat(
        F.lit("tex1_"), col(width).cast("string"), F.lit("x"), col(height).cast("string"), F.lit("_"),
        F.lpad(F.upper(col(hash_)), 16, "0"), F.lit("_"), col(fmt).cast("string"),
        F.lit("_mip"), F.coalesce(col(mip), F.lit(0)).cast("string"), F.lit(".png"),
    )


def is_mask_name(c) -> Column:
    return F.coalesce(F.lower(col(c)).rlike(V.MASK_NAME_PATTERN), F.lit(False))


def is_aux_mask(name, slot, operand) -> Column:
    """Name says mask, or a non-primary slot's channel is used. One row per use."""
    return is_mask_name(name) | F.coalesce(
        (col(slot) > 0) & col(operand).isin(V.CHANNEL_OPERANDS), F.lit(False)
    )


def display_seed(name, model, source, asset_id, aux_mask=None) -> Column:
    """Readable identity: name, else model, else source stem, else id.

    A texture name that only repeats the model collapses to the model; mask
    words become ``-alpha``.
    """
    def filled(c):
        return F.nullif(F.trim(col(c)), F.lit(""))

    n, m = filled(name), filled(model)
    seed = slug(F.coalesce(n, m, F.nullif(stem(source), F.lit("")), filled(asset_id), F.lit("texture")))
    t, full = slug(n), slug(m)
    root = F.regexp_replace(full, V.MODEL_TAIL_PATTERN, "")

    def repeats(r):
        tail = F.substring(t, F.length(r) + 1, F.length(t))
        return (t == r) | (F.startswith(t, r) & tail.rlike("^" + V.GENERIC_TEXTURE_TAIL + "$"))

    both = n.isNotNull() & m.isNotNull()
    s = F.when(both & repeats(full), full).when(both & (root != "") & repeats(root), root).otherwise(seed)
    s = F.regexp_replace(s, "-(" + "|".join(V.MASK_WORDS) + ")$", "-alpha")
    if aux_mask is not None:
        s = F.when(aux_mask & ~s.rlike(V.MASK_SLUG_PATTERN), F.concat(s, F.lit("-alpha"))).otherwise(s)
    return s


def export_name(base, width, height, fmt, hash_) -> Column:
    """File name of an exported asset."""
    return F.concat(
        safe_export(base), F.lit("__"), col(width).cast("string"), F.lit("x"), col(height).cast("string"),
        F.lit("_f"), col(fmt).cast("string"), F.lit("_"), col(hash_), F.lit(".png"))


def render_names(shown, total, label: str, detail: str) -> Column:
    """``n label reference(s) detail: a, b (+k more)`` from the shown names and the full count."""
    more = col(total) - F.size(col(shown))
    return F.concat(
        col(total).cast("string"), F.lit(f" {label} reference(s) {detail}: "), F.array_join(col(shown), ", "),
        F.when(more > 0, F.concat(F.lit(", ... (+"), more.cast("string"), F.lit(" more)"))).otherwise(""),
    )
