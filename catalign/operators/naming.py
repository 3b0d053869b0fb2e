"""Unique names, set-based."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths as P
from ..session import cut
from .ranking import HOT_ROWS, number_and_total


#: A stem that ends in a number; eighteen digits are more than any count of repeats.
NUMERIC_TAIL = r"(?s)^(.+)_([1-9]\d{0,17})$"


def assign_unique_names(assets: DataFrame, base: str, owner: str, out: str = "name",
                        hot_rows: int = HOT_ROWS) -> DataFrame:
    """One name per (base, owner), unique over all owners.

    The smallest owner of a base keeps it. The others get ``base-<owner8>``,
    then ``-2``, ``-3`` … inside the same eight characters. A generated name
    may be somebody's natural base; such bases belong to the owner of the
    generated name, and the numbering is repeated until that set is stable.
    """
    keyed = assets.withColumns({
        "_base": F.lower(F.coalesce(base, F.lit(""))), "_owner": F.coalesce(F.col(owner).cast("string"), F.lit(""))})
    pairs = cut(keyed.select("_base", "_owner").distinct())
    taken = None
    while True:
        keepers = pairs.groupBy("_base").agg(F.min("_owner").alias("_keeper"))
        if taken is not None:
            keepers = keepers.join(taken, "_base", "left").select(
                "_base", F.coalesce("_taken_by", "_keeper").alias("_keeper"))
        owned = pairs.join(keepers, "_base")
        rest = owned.filter(F.col("_owner") != F.col("_keeper")).withColumn(
            "_short", F.lower(F.substring("_owner", 1, 8)))
        numbered = number_and_total(rest, ["_base", "_short"], ["_owner"], number="_k", hot_rows=hot_rows)
        stem = F.concat_ws("-", "_base", "_short")
        made = numbered.withColumn(
            "_name", F.when(F.col("_k") == 1, stem).otherwise(F.concat_ws("-", stem, F.col("_k").cast("string"))))
        clash = made.select(F.col("_name").alias("_base"), F.col("_owner").alias("_taken_by")).join(
            pairs.select("_base").distinct(), "_base", "left_semi")
        if taken is None:
            if clash.isEmpty():
                break
        elif _same(clash, taken):
            break
        taken = cut(clash)
    names = made.select("_base", "_owner", "_name").unionByName(
        owned.filter(F.col("_owner") == F.col("_keeper")).select("_base", "_owner", F.col("_base").alias("_name")))
    return keyed.join(names, ["_base", "_owner"]).withColumn(out, F.col("_name")).drop("_base", "_owner", "_name")


def _same(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def dedupe_names_within(members: DataFrame, parent: str, name: str, order: list[str], out: str = "unique_name",
                        hot_rows: int = HOT_ROWS) -> DataFrame:
    """Repeats of a name inside an archive become ``stem_2.ext``, ``stem_3.ext`` …

    A number is skipped when a member that comes earlier already carries that
    very name; a member whose own name was handed out before its turn counts as
    a repeat. Names are settled shortest stem chain first, because a generated
    name only ever collides with longer ones.
    """
    leafed = members.withColumn("_name", F.col(name)).withColumn("_at", F.struct(*order))
    cut_at = r"(?s)^(.+)(\.[^.]*)$"
    leafed = leafed.withColumns({
        "_stem": F.when(F.col("_name").rlike(cut_at), F.regexp_extract("_name", cut_at, 1)).otherwise(F.col("_name")),
        "_ext": F.when(F.col("_name").rlike(cut_at), F.regexp_extract("_name", cut_at, 2)).otherwise(F.lit("")),
    })
    # A generated name can only meet a member whose own stem ends in a number.
    numeric_tail = NUMERIC_TAIL
    could_clash = not leafed.filter(F.col("_stem").rlike(numeric_tail)).isEmpty()
    numbered = number_and_total(leafed, [parent, "_name"], order, number="_k", hot_rows=hot_rows)
    named = numbered.withColumn(out, F.when(F.col("_k") == 1, F.col("_name")).otherwise(
        F.concat("_stem", F.lit("_"), F.col("_k").cast("string"), "_ext")))
    if not could_clash:
        return named.select(*members.columns, out)
    named = cut(named.withColumn("_root", F.regexp_replace("_stem", r"(_\d+)+$", "")))
    keys = [parent, "_root", "_ext"]
    natural = named.filter((F.col("_k") == 1) & F.col("_stem").rlike(numeric_tail)).select(
        parent, F.col("_name").alias(out)).distinct()
    clash = cut(named.filter(F.col("_k") > 1).join(natural, [parent, out], "left_semi").select(*keys).distinct())
    settled = _settle(named.join(clash, keys, "left_semi"), parent, order, out, hot_rows)
    calm = named.join(clash, keys, "left_anti").select(*members.columns, out)
    return calm.unionByName(settled.select(*members.columns, out))


def _settle(rows: DataFrame, parent: str, order: list[str], out: str, hot_rows: int) -> DataFrame:
    """Rounds over the clashing names; every round fixes at least the next number of each stem.

    Holders are members that own their name outright. A repeat k of a stem
    takes the smallest free number, which is k + 1 plus the held numbers below
    it, where a number counts as held if its holder came before the repeat.
    """
    held = None
    while True:
        if held is None:
            state = rows.withColumn("_push", F.lit(0).cast("bigint"))
        else:
            state = rows.join(held, [parent, "_name"], "left").withColumn(
                "_push", F.coalesce("_displaced", F.lit(0).cast("bigint"))).drop("_displaced")
        repeats = state.filter((F.col("_k") > 1) | (F.col("_push") == 1)).withColumn(
            "_r", F.col("_k") - 1 + F.col("_push"))
        made = _number_repeats(repeats, state, parent, out)
        own = state.filter((F.col("_k") == 1) & (F.col("_push") == 0)).withColumn(out, F.col("_name"))
        first = rows.filter(F.col("_k") == 1).select(
            parent, F.col("_name").alias(out), F.col("_at").alias("_own_at"))
        displaced = cut(
            made.join(first, [parent, out]).filter(F.col("_at") < F.col("_own_at"))
            .select(parent, F.col(out).alias("_name")).distinct().withColumn("_displaced", F.lit(1).cast("bigint")))
        if (displaced.isEmpty() if held is None else _same(displaced, held)):
            cols = [*rows.columns]
            return made.select(*cols).unionByName(own.select(*cols))
        held = displaced


def _number_repeats(repeats: DataFrame, state: DataFrame, parent: str, out: str) -> DataFrame:
    """Smallest free number of each repeat, skipping numbers whose holder came earlier."""
    tail = NUMERIC_TAIL
    holders = state.filter((F.col("_k") == 1) & (F.col("_push") == 0) & F.col("_stem").rlike(tail)).select(
        parent, F.regexp_extract("_stem", tail, 1).alias("_stem"), "_ext",
        F.regexp_extract("_stem", tail, 2).cast("bigint").alias("_number"), F.col("_at").alias("_held_at"),
    )
    keys = [parent, "_stem", "_ext"]
    placed, skips = repeats.withColumn("_number", F.col("_r") + 1), None
    while True:
        meets = placed.join(holders, [*keys, "_number"]).filter(F.col("_held_at") < F.col("_at"))
        # Below the smallest meeting number everything is settled, so that one is final.
        new = cut(meets.groupBy(*keys).agg(F.min("_number").alias("_number")))
        if new.isEmpty():
            return placed.withColumn(out, F.concat("_stem", F.lit("_"), F.col("_number").cast("string"), "_ext"))
        skips = new if skips is None else cut(skips.unionByName(new))
        placed = _shift(repeats, skips, keys)


def _shift(repeats: DataFrame, skips: DataFrame, keys: list[str]) -> DataFrame:
    """Number of each repeat when the given numbers are left out.

    The j-th skipped number moves every repeat from ``number - j`` on by one,
    so a repeat's shift is a running count of skips at or below it.
    """
    starts = number_and_total(skips, keys, ["_number"], number="_j").select(
        *keys, (F.col("_number") - F.col("_j")).alias("_pos"), F.col("_j").alias("_tie"),
        F.lit(1).cast("bigint").alias("_skip"))
    events = repeats.withColumns({
        "_pos": F.col("_r"), "_tie": F.lit(1 << 62).cast("bigint"), "_skip": F.lit(0).cast("bigint"),
    }).unionByName(starts, allowMissingColumns=True)
    counted = number_and_total(events, keys, ["_pos", "_tie"], number=None, totals={"_shifted": "_skip"})
    return counted.filter(F.col("_skip") == 0).withColumn(
        "_number", F.col("_r") + 1 + F.col("_shifted")).drop("_pos", "_tie", "_skip", "_shifted")
