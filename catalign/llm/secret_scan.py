"""Secret scans: fixed patterns, and windows of high entropy inside candidate strings.

Fixed kinds are leftmost non-overlapping matches. Where they stand follows from
splitting the text at the pattern: a match starts after all pieces and matches
before it. Positions count code points, the end is exclusive.

The method adds spans of kind ``entropy``. For each character class a candidate
is a maximal run of the class's characters. A window moves over it one character
at a time; the counts of its characters and the sum of n*log2(n) change by the
character that enters and the one that leaves, which gives the Shannon entropy
of every window. The span reaches from the first window at or above the class's
threshold to the end of the last one. A candidate that an allow-list pattern
matches, or that lacks a digit or a letter, is suppressed. Base spans stay.

Edge cases: a null text is empty and has no spans; the digest is then that of
the empty string. Work grows linearly with the text, also within one candidate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

#: Kinds in order, with pattern, the group whose length counts (0: the match) and the least length.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


@dataclass(frozen=True)
class CharClass:
    """Characters of a candidate, its least length, the window and the entropy in bits at which it counts."""
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return "[" + "".join("\\" + c if c in "-+/=_" else c for c in self.alphabet) + "]{%d,}" % self.window


DIGITS, LOWERS, UPPERS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = [
    CharClass(DIGITS + "ABCDEF", 24, 3.0),
    CharClass(DIGITS + LOWERS + UPPERS + "+/_=-", 20, 3.75),
]
#: Candidates that are no secrets: UUIDs, samples, web paths, and words joined by one mark.
#: Possessive, so that matching takes no stack however long a candidate is.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|0123456789",
    r"^/?(?:[A-Za-z]++|[0-9]++)(?:[/_=-](?:[A-Za-z]++|[0-9]++))*+/?$",
]


def _spans(text: Column, pattern: str, matches: Column, keep) -> Column:
    """Array of (start, end) of the pattern's matches for which ``keep(match)`` holds."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    paired = F.zip_with(gaps, matches, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    # After the last match stands one piece more; it has no match and closes the list.
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        found = F.when(F.coalesce(keep(x["m"]), F.lit(False)), F.array(F.struct(start.alias("s"), end.alias("e")))).otherwise(none)
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.concat(acc["out"], found).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(
        paired, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)


def run_pattern(kind: str) -> str:
    """The pattern to search for. Of a run the longest match starts first, so the least length can stand in it."""
    pattern, group, least = next(k[1:] for k in KINDS if k[0] == kind)
    return pattern if group else pattern[:-1] + "{%d,}" % (least - (4 if kind == "access" else 0))


def base_spans(text: Column, kind: str, matches: Column) -> Column:
    pattern, group, least = next(k[1:] for k in KINDS if k[0] == kind)
    keep = (lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least) if group else (lambda m: m.isNotNull())
    return _spans(text, run_pattern(kind), matches, keep)


def _hot_range(candidate: Column, cls: CharClass) -> Column:
    """(a, b): zero-based start of the first and end of the last window at or above the threshold; nulls if none."""
    w, size = cls.window, len(cls.alphabet)
    gain = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 2)])
    # S = sum of n*log2(n) over the counts n; the entropy of a full window is log2(w) - S / w.
    most = (math.log2(w) - cls.bits) * w + 1e-9
    alphabet = F.lit(cls.alphabet)

    # Each step sees the character that enters and the one that leaves, as positions in the alphabet; -1 is none.
    entering = F.transform(F.split(candidate, ""), lambda ch: F.instr(alphabet, ch) - 1)
    leaving = F.concat(F.array_repeat(F.lit(-1), w), entering)
    moves = F.zip_with(entering, F.slice(leaving, F.lit(1), F.size(entering)),
                       lambda i, o: F.struct(i.alias("i"), o.alias("o")))

    def step(acc, x):
        n_in = F.element_at(acc["n"], x["i"] + 1)
        n_out = F.element_at(acc["n"], F.greatest(x["o"], F.lit(0)) + 1)
        enters = F.element_at(gain, n_in + 2) - F.element_at(gain, n_in + 1)
        leaves = F.when(x["o"] >= 0, F.element_at(gain, F.greatest(n_out, F.lit(1))) - F.element_at(gain, n_out + 1)).otherwise(0.0)
        same = x["i"] == x["o"]
        total = acc["s"] + F.when(same, 0.0).otherwise(enters + leaves)
        counts = F.transform(acc["n"], lambda c, k: c + F.when(k == x["i"], 1).otherwise(0) - F.when(k == x["o"], 1).otherwise(0))
        at = acc["at"] + 1
        high = (at >= w) & (total <= most)
        return F.struct(counts.alias("n"), total.alias("s"), at.alias("at"),
                        F.when(high, F.coalesce(acc["a"], at - w)).otherwise(acc["a"]).alias("a"),
                        F.when(high, at).otherwise(acc["b"]).alias("b"))

    none = F.lit(None).cast("int")
    start = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("at"),
                     none.alias("a"), none.alias("b"))
    return F.aggregate(moves, start, step, lambda acc: F.struct(acc["a"].alias("a"), acc["b"].alias("b")))


def entropy_spans(text: Column, cls: CharClass, matches: Column, allow: list[str]) -> Column:
    """Array of (s, e) of the high parts of the candidates of one class."""
    def is_candidate(m: Column) -> Column:
        good = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        for pattern in allow:
            good = good & ~m.rlike(pattern)
        return good

    def inside(span: Column) -> Column:
        return F.transform(
            F.array(_hot_range(F.substring(text, span["s"] + 1, span["e"] - span["s"]), cls)),
            lambda r: F.struct((span["s"] + r["a"]).alias("s"), (span["s"] + r["b"]).alias("e")))

    candidates = _spans(text, cls.pattern, matches, is_candidate)
    return F.filter(F.flatten(F.transform(candidates, inside)), lambda r: r["s"].isNotNull())


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: list[CharClass] = CLASSES,
                 allow: list[str] = ALLOW) -> DataFrame:
    """One row per document: doc_id, and for each kind an array of (s, e); ``entropy`` holds those of all classes."""
    kinds = [k for k, *_ in KINDS]
    patterns = {k: run_pattern(k) for k in kinds} | {f"class{i}": c.pattern for i, c in enumerate(classes)}
    read = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    # One search per pattern; only texts with a match are split to find where it stands.
    found = read.withColumns({f"m_{k}": F.regexp_extract_all(F.col("text"), F.lit(p), F.lit(0)) for k, p in patterns.items()})
    text = F.col("text")
    high = [entropy_spans(text, c, F.col(f"m_class{i}"), allow) for i, c in enumerate(classes)]
    return found.select("doc_id", *[base_spans(text, k, F.col(f"m_{k}")).alias(k) for k in kinds],
                        F.array_sort(F.array_distinct(F.concat(*high))).alias("entropy"))


def listed(kinds: list[str]) -> Column:
    """Spans of the named kinds as kind:start:end, by start and then kind as listed, joined by commas."""
    def ranked(n: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda r: F.struct(
            r["s"].alias("s"), F.lit(n).alias("n"), r["e"].alias("e"), F.lit(kind).alias("k")))

    parts = F.transform(F.array_sort(F.concat(*[ranked(n, k) for n, k in enumerate(kinds)])), lambda r: F.concat_ws(":", r["k"], r["s"].cast("string"), r["e"].cast("string")))
    return F.array_join(parts, ",")
