"""Tests on file content (binary or string columns). Whole content is read."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V
from .paths import col, suffix


def _lit_like(c: Column, token: str, binary: bool) -> Column:
    return F.lit(token.encode("latin-1")) if binary else F.lit(token)


def starts_with(content, magics, binary: bool = True) -> Column:
    c, out = col(content), F.lit(False)
    for m in magics:
        out = out | F.startswith(c, _lit_like(c, m, binary))
    return out


def contains_token(content, token: str, binary: bool = True) -> Column:
    c = col(content)
    return F.contains(c, _lit_like(c, token, binary))


def magic_label(content, binary: bool = True) -> Column:
    """First four characters, unprintable ones shown as a dot."""
    head = F.substring(col(content), 1, 4)
    if binary:
        head = F.decode(head, "ISO-8859-1")
    return F.regexp_replace(head, "[^ -~]", ".")


def candidate(ext, content, exts=V.CANDIDATE_EXTENSIONS, magics=V.CANDIDATE_MAGICS,
              needle=V.EMBEDDED_NEEDLE, binary: bool = True) -> Column:
    """Cheap tests first: extension, then leading magic, then needle anywhere."""
    keep = F.coalesce(col(ext).isin(list(exts)), F.lit(False)) | starts_with(content, magics, binary)
    return keep | contains_token(content, needle, binary) if needle else keep


def signature(ext, content, magics=V.DIRECT_MAGICS, wrapper=V.WRAPPER_MAGIC, wrapped=V.WRAPPED_NEEDLES,
              exts=V.SIGNATURE_EXTENSIONS, needle=V.EMBEDDED_NEEDLE, binary: bool = True) -> Column:
    """Ordered decision naming the rule that selects a file, null when none does."""
    inner = F.lit(False)
    for w in wrapped:
        inner = inner | contains_token(content, w, binary)
    return (
        F.when(starts_with(content, [wrapper], binary), F.when(inner, "wrapped"))
        .when(starts_with(content, magics, binary), "magic")
        .when(contains_token(content, needle, binary),
              F.when(F.coalesce(col(ext).isin(list(exts)), F.lit(False)), "extension").otherwise("embedded"))
    )


def guess_suffix_flat(content, table=V.FLAT_SUFFIXES, embedded=V.EMBEDDED_NEEDLE,
                      embedded_suffix=V.FLAT_EMBEDDED_SUFFIX, binary: bool = True) -> Column:
    out = F.when(contains_token(content, embedded, binary), embedded_suffix)
    for magic, suf in table:
        out = out.when(starts_with(content, [magic], binary), suf)
    return out.otherwise(V.DEFAULT_SUFFIX)


def guess_suffix_package(content, name, table=V.PACKAGE_SUFFIXES, binary: bool = True) -> Column:
    own, out = suffix(name), None
    for magic, suf in table:
        hit = starts_with(content, [magic], binary)
        out = F.when(hit, suf) if out is None else out.when(hit, suf)
    return out.when((own != "") & (F.length(own) <= V.PACKAGE_SUFFIX_MAX), own).otherwise(V.DEFAULT_SUFFIX)


def token_offsets(text, token: str, limit: int = V.TOKEN_LIMIT_WIDE) -> Column:
    """Zero-based positions of the first ``limit`` non-overlapping hits."""
    c = col(text)
    parts = F.split(c, "\\Q" + token + "\\E", limit + 1)
    lengths = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p))
    start = F.struct(F.lit(-len(token)).alias("at"), F.array().cast("array<int>").alias("hits"))

    def step(acc, n):
        at = acc["at"] + F.lit(len(token)) + n
        return F.struct(at.alias("at"), F.concat(acc["hits"], F.array(at)).alias("hits"))

    return F.aggregate(lengths, start, step, lambda acc: acc["hits"])
