"""Materials, their texture slots and alpha stages.

Relations: bindings (material keys, slot, name, …), stage inputs (material,
stage, combiner, input, source_id, operand_id) — one row per input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dims as D, values as V
from .ranking import first_per_group


def slot_of():
    """Texture slot of an input, null for other sources."""
    lo, hi = V.TEXTURE_SOURCE_IDS
    return F.when(F.col("source_id").between(lo, hi), F.col("source_id") - lo)


def stage_resolvable(inputs: DataFrame, material: list[str], slots: DataFrame | None = None,
                     stages: DataFrame | None = None) -> DataFrame:
    """Whether a material's alpha pipeline resolves, per material.

    ``stages`` lists all stages (material, stage, combiner_id); one without any
    input makes its material unresolvable. Left out, the stages are those with
    inputs.

    Every input is a bound texture slot or the previous stage, the first stage
    has no previous, arity suffices and some texture is used. All stages must
    resolve, so "previous is there" means "not in the first stage", and the
    whole test is a few partial aggregates without any ordering.
    """
    if stages is not None:
        given = inputs.select(*material, "stage", "source_id", "operand_id")
        inputs = stages.select(*material, "stage", "combiner_id").distinct().join(given, [*material, "stage"], "left")
    rows = inputs.withColumn("_slot", slot_of())
    if slots is not None:
        bound = slots.select(*material, F.col("slot").alias("_slot")).distinct().withColumn("_bound", F.lit(True))
        rows = rows.join(bound, [*material, "_slot"], "left")
    else:
        rows = rows.withColumn("_bound", F.lit(True))
    texture = F.col("_slot").isNotNull()
    previous = F.col("source_id") == V.PREVIOUS_SOURCE_ID
    good = F.when(texture, F.coalesce("_bound", F.lit(False)) & (F.col("operand_id") <= V.MAX_OPERAND_ID)).otherwise(
        previous & F.col("operand_id").isin(V.SCALAR_OPERANDS))
    need = None
    for mode, n in V.COMBINER_ARITY.items():
        hit = F.col("combiner_id") == mode
        need = F.when(hit, n) if need is None else need.when(hit, n)
    per_stage = rows.groupBy(*material, "stage").agg(
        F.bool_and(F.coalesce(good, F.lit(False))).alias("_good"), F.bool_or(texture).alias("_texture"),
        F.bool_or(previous).alias("_previous"),
        (F.count("source_id") >= F.coalesce(F.min(need), F.lit(1 << 30))).alias("_arity"))
    per_material = per_stage.groupBy(*material).agg(
        F.bool_and(F.col("_good") & F.col("_arity")).alias("_all"), F.bool_or("_texture").alias("_used"),
        F.min("stage").alias("_first"), F.min(F.when(F.col("_previous"), F.col("stage"))).alias("_previous_at"))
    return per_material.select(*material, (
        F.col("_all") & F.col("_used") & F.coalesce(F.col("_previous_at") > F.col("_first"), F.lit(True))
    ).alias("resolvable"))


def stage_use_counts(inputs: DataFrame, slots: DataFrame, material: list[str], fmt: str = "format") -> DataFrame:
    """Distinct uses of bound slots per material, split into explicit channels and constants.

    A scalar operand on a format without alpha is a constant.
    """
    uses = inputs.withColumn("slot", slot_of()).filter(F.col("slot").isNotNull()).select(
        *material, "stage", "input", "slot", "operand_id").distinct()
    bound = uses.join(slots.select(*material, "slot", fmt), [*material, "slot"])
    constant = F.col("operand_id").isin(V.SCALAR_OPERANDS) & ~D.stores_alpha(fmt)
    return bound.groupBy(*material).agg(
        F.count_if(constant).alias("constant_inputs"),
        F.count_if(~constant & (F.col("operand_id") <= V.MAX_OPERAND_ID)).alias("explicit_channels"))


def material_rollup(bindings: DataFrame, material: list[str], slot: str, enabled: str, asset: str,
                    order: list[str], slots: list[int] = V.MATERIAL_SLOTS) -> DataFrame:
    """One row per material with its slots nested; at most one asset per slot, so rows stay small."""
    rows = bindings.filter(F.col(slot).isin(slots)).withColumn("_off", ~F.col(enabled))
    return nest_slots(first_per_group(rows, [*material, slot], ["_off", *order], [asset]), material, slot, asset)


def nest_slots(chosen: DataFrame, material: list[str], slot: str, asset: str) -> DataFrame:
    """Slots with their chosen asset, nested per material."""
    nested = chosen.groupBy(*material).agg(
        F.array_sort(F.collect_list(F.struct(F.col(slot).alias("slot"), F.col(asset).alias("asset")))).alias("slots"))
    return nested.withColumn("slot_count", F.size("slots"))


def material_report(slots: DataFrame, resolvable: DataFrame, uses: DataFrame, material: list[str]) -> DataFrame:
    """Status of every material with at least one bound slot; materials without stages use no texture alpha."""
    return material_status(
        slots.select(*material).distinct().join(resolvable, material, "left").join(uses, material, "left").withColumns({
            "resolvable": F.coalesce("resolvable", F.lit(False)),
            "alpha_rows": F.coalesce(F.col("constant_inputs") + F.col("explicit_channels"), F.lit(0).cast("bigint")),
        }).drop("constant_inputs", "explicit_channels"))


def material_status(materials: DataFrame, resolvable="resolvable", rows="alpha_rows"):
    """resolved / unresolved / no_texture_alpha."""
    return materials.withColumn(
        "status", F.when(F.col(resolvable), "resolved").when(F.col(rows) > 0, "unresolved")
        .otherwise("no_texture_alpha"))


def bindings_by_name(bindings: DataFrame, uses: DataFrame, stages: DataFrame, material: list[str], name: str,
                     slot: str) -> DataFrame:
    """Bindings seen from the referenced name: (name, material, slot) with uses of that slot and the stage count.

    A relation keyed by name; popular names keep all their rows without being gathered anywhere.
    """
    per_slot = uses.groupBy(*material, slot).agg(F.count("*").alias("uses"))
    per_material = stages.groupBy(*material).agg(F.count_distinct("stage").alias("stages"))
    return (
        bindings.select(name, *material, slot).distinct()
        .join(per_slot, [*material, slot], "left").join(per_material, material, "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("uses", "stages")})
    )


def unresolved_rows(materials: DataFrame, status="status", reasons="reasons") -> DataFrame:
    """Problem rows only, reasons joined into one text column."""
    return materials.filter(F.col(status) == "unresolved").withColumn(reasons, F.array_join(reasons, " | "))
