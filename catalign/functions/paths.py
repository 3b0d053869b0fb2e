"""Path helpers on string columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V

# One pattern per way in which a member path can be unsafe.
UNSAFE_PATTERNS = [
    ("nul", r"\x00"),
    ("absolute", r"^/"),
    ("colon", r":"),
    ("component", r"(^|/)(\.{1,2})?(/|$)"),
    ("trailing", r"[ .](/|$)"),
    ("device", rf"(?i)(^|/){V.DEVICE_NAMES}(\.[^/]*)?(/|$)"),
]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def forward(c) -> Column:
    """Back slashes to slashes."""
    return F.replace(col(c), F.lit("\\"), F.lit("/"))


def path_key(c) -> Column:
    return F.lower(forward(c))


def leaf(c) -> Column:
    return F.substring_index(forward(c), "/", -1)


def folder(c) -> Column:
    """Path without its last component, empty for a bare name."""
    return F.regexp_extract(forward(c), r"(?s)^(.*)/[^/]*$", 1)


def extension(c) -> Column:
    """Lower-case extension of the last component, null when there is none."""
    tail = F.trim(F.regexp_extract(leaf(c), r"\.([^.]*)$", 1))
    return F.nullif(F.lower(tail), F.lit(""))


def stem(c) -> Column:
    """Last component without its suffix; a leading dot is no suffix."""
    return F.regexp_replace(leaf(c), r"(?s)^(.+)\.[^.]+$", "$1")


def suffix(c) -> Column:
    """Suffix including the dot, lower-case, empty when there is none."""
    return F.lower(F.regexp_extract(leaf(c), r"(?s)^.+(\.[^.]+)$", 1))


def replace_extension(c, ext: str) -> Column:
    return F.concat(F.regexp_replace(forward(c), r"\.[^.]*$", ""), F.lit("." + ext))


def unsafe_reason(c) -> Column:
    """Name of the first rule a path breaks, null for a safe path."""
    p = forward(c)
    out = F.when(p.isNull() | (p == ""), F.lit("empty"))
    for name, pattern in UNSAFE_PATTERNS:
        out = out.when(p.rlike(pattern), F.lit(name))
    return out


def is_safe(c) -> Column:
    return unsafe_reason(c).isNull()


def child_path(parent, child) -> Column:
    """Path of a member inside its archive, null when the member is unsafe."""
    base = F.regexp_replace(forward(parent), "/+$", "")
    return F.when(is_safe(child), F.concat(base, F.lit("/"), forward(child)))


def ancestors(c) -> Column:
    """Every proper path prefix, shortest first."""
    parts = F.split(forward(c), "/")
    n = F.size(parts)
    return F.when(
        n > 1,
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def has_ancestor_kind(c, kind: str) -> Column:
    """True when a container with this extension lies above the path."""
    return path_key(c).contains(f".{kind}/")
