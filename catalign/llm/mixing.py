"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources share the budget by weight. A source that would be read more than
``max_epochs`` times is clamped there, and what it leaves is shared by the
others in proportion, until nobody is above its clamp. Each round aggregates the
narrow table of sources to one row.

A source with target t and size s is read floor(t / s) times as a whole; for the
fraction, its documents are taken in the order of a seeded hash until the sum is
as near to the rest of the target as it can be. Where the order is cut is found
in two steps, so that no source is sorted as a whole: sums per slice of the hash
space, then the documents of the one slice in which the goal lies.

Edge cases: a null text has size 0; null is a source of its own, after all
others. A source of size 0 has target 0 and takes nothing. Rows that repeat an
id stand at the same place of the order and are taken together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ranking import number_and_total
from ..session import cut
from .common import attach_groups, text_of

#: Fixed value: words are runs of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size in words and the place in the seeded order."""
    return docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
        F.regexp_count(text_of(docs, text_col), F.lit(WORD)).cast("bigint").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs[id_col].cast("string"), F.lit("")))).alias("place"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to rows of (source, source_size, weight)."""
    total, level = sources.agg(F.sum("source_size"), F.sum("source_size") / F.sum("weight")).first()
    clamp, level = F.col("source_size") * max_epochs, level or 0.0
    while True:
        full = clamp <= F.lit(level) * F.col("weight")
        held, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(full, clamp)), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        raised = (total - held) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(clamp.cast("double"), F.lit(float(level)) * F.col("weight")))


def plan_mix(rows: DataFrame, total_rows: int, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: rows, source_size, target, whole and where the order is cut (slice, place)."""
    counted = rows.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    keyed = counted.withColumns({"_all": F.lit(0), "_null": F.col("source").isNull()})
    ranked = number_and_total(keyed, ["_all"], ["_null", "source"], "rank").drop("_all", "_null")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = cut(ranked.withColumn("weight", weight).drop("rank"))
    goals = cut(water_fill(sources, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size")))

    digits = max(1, round(math.log(max(total_rows, 1), 16) / 2))
    slices = rows.groupBy("source", F.substring("place", 1, digits).alias("slice")).agg(F.sum("size").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("source").orderBy("slice"))
    run = slices.withColumn("upto", upto)
    run = run.join(goals.select(F.col("source").alias("_s"), "goal"), F.col("source").eqNullSafe(F.col("_s")))
    # The slice in which the goal lies: what stands before is below it, with it at or above.
    edge = cut(run.filter((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("held") < F.col("goal")))
               .select("source", "slice", (F.col("upto") - F.col("held")).alias("before"), "goal"))
    inside = rows.join(edge.select(F.col("source").alias("_s"), F.col("slice").alias("_slice"), "before", "goal"),
                       F.col("source").eqNullSafe(F.col("_s")) & (F.substring("place", 1, digits) == F.col("_slice")))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("_s", "_slice").orderBy("place"))
    best = (inside.withColumn("upto", upto).groupBy("_s").agg(
        F.min(F.struct(F.abs(F.col("upto") - F.col("goal")).alias("off"), "place")).alias("near"),
        F.first(F.abs(F.col("before") - F.col("goal"))).alias("off_before")))
    places = best.select("_s", F.when(F.col("near.off") < F.col("off_before"), F.col("near.place")).alias("cut_place"))
    cuts = edge.select("source", F.col("slice").alias("cut_slice")).join(places, F.col("source").eqNullSafe(F.col("_s")), "left")
    cuts = cuts.select(F.col("source").alias("_s"), "cut_slice", "cut_place")
    return goals.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "goal")


def copies_of(digits_of: str = "cut_slice") -> Column:
    """How often a document is taken, from its place and its source's row."""
    before = F.substring(F.col("place"), F.lit(1), F.length(digits_of)) < F.col(digits_of)
    return F.col("whole") + F.when(before | (F.col("place") <= F.col("cut_place")), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED,
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    rows = cut(sized(docs, id_col, text_col, source_col, seed))
    total = rows.count()
    plan = cut(plan_mix(rows, total, weights, max_epochs))
    return attach_groups(rows, plan, "source", "source_rows", total, "inner").withColumn("copies", copies_of()).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeat_to_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    rows = cut(sized(docs, id_col, text_col, source_col, seed))
    total = rows.count()
    plan = cut(plan_mix(rows, total, weights, max_epochs))
    place = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs[id_col].cast("string"), F.lit(""))))
    packed = docs.select(F.struct(*docs.columns).alias("doc"), docs[source_col].alias("source"), place.alias("place"))
    taken = attach_groups(packed, plan, "source", "source_rows", total, "inner").withColumn("copies", copies_of().cast("int"))
    return taken.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
