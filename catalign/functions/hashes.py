"""Identity, hash and key expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V
from .paths import col


def normalize_hash(c) -> Column:
    """Upper-case, 16 digits, null when not 1 to 16 hex digits."""
    t = F.trim(col(c))
    return F.when(t.rlike(V.HASH_PATTERN), F.lpad(F.upper(t), 16, "0"))


def is_asset_id(c) -> Column:
    return F.coalesce(col(c).rlike(V.ASSET_ID_PATTERN), F.lit(False))


def is_title_id(c) -> Column:
    return F.coalesce(col(c).rlike(V.TITLE_ID_PATTERN), F.lit(False))


def is_runtime_hash(c) -> Column:
    return F.coalesce(F.trim(col(c)).rlike(V.HASH_PATTERN), F.lit(False))


_DIGESTS = {
    "sha256": lambda c: F.sha2(c, 256),
    "md5": F.md5,
    "xxhash64": lambda c: F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0")),
}


def direct_digest(c, algorithm: str = "sha256") -> Column:
    return _DIGESTS[algorithm](col(c))


def mirrored_digest(c, algorithm: str = "sha256") -> Column:
    return _DIGESTS[algorithm](F.reverse(col(c)))


def hashes_or_candidate(verified, candidate, use_candidates: bool = True) -> Column:
    """Verified list, else the candidate as a one-element list; distinct, normalised."""
    verified, candidate = col(verified), col(candidate)
    raw = F.when(F.size(F.coalesce(verified, F.array().cast("array<string>"))) > 0, verified)
    if use_candidates:
        raw = raw.when(F.length(candidate) > 0, F.array(candidate))
    raw = raw.otherwise(F.array().cast("array<string>"))
    return F.transform(F.array_distinct(raw), lambda h: F.lpad(F.upper(h), 16, "0"))


def source_group(stem_col, source, offset) -> Column:
    """Readable stem plus ten digits of a digest over source and offset."""
    return F.concat(
        col(stem_col), F.lit("-"),
        F.substring(F.sha1(F.concat_ws("|", col(source), col(offset).cast("string"))), 1, 10),
    )


def binding_key(*cols) -> Column:
    """Canonical identity of a nested record: its fields joined with a pipe."""
    return F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols])


def source_kind(parser, kinds: dict[str, str], default: str) -> Column:
    """Label for the parser that produced a row."""
    c = col(parser)
    out = None
    for name, label in kinds.items():
        out = F.when(c == name, label) if out is None else out.when(c == name, label)
    return out.otherwise(default)


def confidence_rank(c) -> Column:
    c, out = col(c), None
    for rank, name in enumerate(V.CONFIDENCE):
        out = F.when(c == name, rank) if out is None else out.when(c == name, rank)
    return out
