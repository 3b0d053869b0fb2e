"""Admission under a budget, in order, and capped sampling.

A rejected archive leaves the usage unchanged, so a running sum is not enough:
later, smaller archives may still fit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import values as V
from ..session import cut
from .ranking import number_and_total

FOLD_ROWS = 2_000     # scopes folded by one expression
CHUNK_ROWS = 200_000  # rows of a large scope folded per step


def archive_totals(members: DataFrame, archive: list[str], size: str, stored: str | None = None) -> DataFrame:
    """One row per archive: members, bytes, largest and smallest member."""
    big = F.greatest(F.col(size), F.col(stored)) if stored else F.col(size)
    return members.groupBy(*archive).agg(
        F.count("*").alias("members"), F.sum(size).cast("bigint").alias("bytes"),
        F.max(big).cast("bigint").alias("largest"), F.min(size).cast("bigint").alias("smallest"),
    )


def standing_reason(limits: dict[str, int], archive_size: str | None = None):
    """Why an archive can never be admitted, whatever was admitted before it."""
    out = F.when(F.col("smallest") < 0, "negative_size")
    if archive_size:
        out = out.when(F.col(archive_size) > limits["max_archive_bytes"], "archive_bytes")
    return (
        out.when(F.col("depth") > limits["max_depth"], "depth")
        .when(F.col("largest") > limits["max_member_bytes"], "member_bytes")
        .when(F.col("members") > limits["max_members"], "members")
        .when(F.col("bytes") > limits["max_expanded_bytes"], "expanded_bytes")
    )


def admit_under_budget(archives: DataFrame, limits: dict[str, int], order_by: list[str], scope: list[str],
                       archive_size: str | None = None, fold_rows: int = FOLD_ROWS,
                       chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every archive with ``admitted`` and the ``reason`` when it is not.

    ``archives`` has depth, members, bytes, largest, smallest, one row per
    archive; ``order_by`` is a total order inside a scope. Scopes that fit as a
    whole need no ordering at all. Small overflowing scopes are folded by one
    expression each; large ones chunk by chunk, all scopes side by side.
    """
    # Archives are read by several branches below; members are not read again.
    judged = cut(archives.withColumn("reason", standing_reason(limits, archive_size)))
    open_rows = judged.filter(F.col("reason").isNull())
    cap_m, cap_b = limits["max_members"], limits["max_expanded_bytes"]
    size = open_rows.groupBy(*scope).agg(
        F.count("*").alias("_n"), F.sum("members").alias("_m"), F.sum("bytes").alias("_b"))
    over = (F.col("_m") > cap_m) | (F.col("_b") > cap_b)
    out = judged.filter(F.col("reason").isNotNull()).withColumn("admitted", F.lit(False))
    longest, longest_over = size.agg(F.max("_n"), F.max(F.when(over, F.col("_n")))).first()
    if longest_over is None:
        return out.unionByName(open_rows.withColumn("admitted", F.lit(True)))
    if longest <= fold_rows:
        return out.unionByName(_fold(open_rows, order_by, scope, cap_m, cap_b))
    route = size.select(*scope, F.when(~over, "whole").when(F.col("_n") <= fold_rows, "fold").otherwise("chunks")
                        .alias("_route"))
    routed = cut(open_rows.join(route, scope))

    def part(name):
        return routed.filter(F.col("_route") == name).drop("_route")

    out = out.unionByName(part("whole").withColumn("admitted", F.lit(True)))
    out = out.unionByName(_fold(part("fold"), order_by, scope, cap_m, cap_b))
    if longest_over > fold_rows:
        out = out.unionByName(_by_chunks(part("chunks"), order_by, scope, cap_m, cap_b, chunk_rows))
    return out


def _fold(rows: DataFrame, order: list[str], scope: list[str], cap_m: int, cap_b: int) -> DataFrame:
    rest = [c for c in rows.columns if c not in scope and c not in order and c != "reason"]
    item = F.struct(*order, *rest)
    zero = F.lit(0).cast("bigint")

    def step(acc, x):
        m, b = acc["m"] + x["members"], acc["b"] + x["bytes"]
        why = F.when(m > cap_m, F.lit("members")).when(b > cap_b, F.lit("expanded_bytes"))
        fits = why.isNull()
        return F.struct(
            F.when(fits, m).otherwise(acc["m"]).alias("m"), F.when(fits, b).otherwise(acc["b"]).alias("b"),
            F.concat(acc["why"], F.array(F.coalesce(why, F.lit("")))).alias("why"))

    start = F.struct(zero.alias("m"), zero.alias("b"), F.array().cast("array<string>").alias("why"))
    folded = rows.groupBy(*scope).agg(F.array_sort(F.collect_list(item)).alias("_rows")).withColumn(
        "_why", F.aggregate("_rows", start, step, lambda acc: acc["why"]))
    flat = folded.select(*scope, F.explode(F.arrays_zip("_rows", "_why")).alias("_x"))
    return flat.select(
        *scope, *[F.col("_x._rows")[c].alias(c) for c in [*order, *rest]],
        F.nullif(F.col("_x._why"), F.lit("")).alias("reason"), (F.col("_x._why") == "").alias("admitted"),
    )


def _by_chunks(rows: DataFrame, order: list[str], scope: list[str], cap_m: int, cap_b: int, chunk: int) -> DataFrame:
    """Large scopes, by running sums over chunks of rows in order.

    Usage only grows, so in each round all rows above the remaining budget are out for
    good. Of what is left, the longest prefix of chunks that fits as a whole is admitted at
    once; the chunk in which the budget first runs short is folded, and the next round goes
    on behind it. A group is one chunk, however large its scope.
    """
    numbered = cut(number_and_total(rows, scope, order, number="_at").withColumn(
        "_chunk", F.floor((F.col("_at") - 1) / chunk).cast("bigint")))
    zero = F.lit(0).cast("bigint")
    usage = numbered.select(*scope).distinct().select(
        *scope, zero.alias("_m"), zero.alias("_b"), F.lit(-1).cast("bigint").alias("_done"))
    slim = numbered.select(*scope, "_at", "_chunk", "members", "bytes")
    admitted = None

    def fold(batches):
        # Rows come by scope and position; a scope may go on in the next batch.
        now, m, b = None, 0, 0
        for batch in batches:
            scopes = zip(*[[None if v != v else v for v in batch.column(c).to_pylist()] for c in scope])
            taken = []
            for key, start_m, start_b, dm, db in zip(scopes, *[batch.column(c).to_pylist() for c in ("_m", "_b", "members", "bytes")]):
                if key != now:
                    now, m, b = key, start_m, start_b
                fits = m + dm <= cap_m and b + db <= cap_b
                taken.append(fits)
                if fits:
                    m, b = m + dm, b + db
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], names=[*batch.schema.names, "_taken"])

    while True:
        able = slim.join(usage, scope).filter(
            (F.col("_chunk") > F.col("_done")) & (F.col("_m") + F.col("members") <= cap_m)
            & (F.col("_b") + F.col("bytes") <= cap_b))
        sums = able.groupBy(*scope, "_chunk").agg(F.sum("members").alias("_cm"), F.sum("bytes").alias("_cb"))
        before = Window.partitionBy(*scope).orderBy("_chunk")  # one row per chunk
        upto = sums.join(usage, scope).withColumns({
            "_fits": (F.sum("_cm").over(before) + F.col("_m") <= cap_m) & (F.sum("_cb").over(before) + F.col("_b") <= cap_b)})
        short = F.min(F.when(~F.col("_fits"), F.col("_chunk")))
        turn = cut(upto.groupBy(*scope).agg(
            F.coalesce(short, F.max("_chunk") + 1).alias("_turn"),
            F.sum(F.when(F.col("_fits"), F.col("_cm")).otherwise(0)).alias("_wm"),
            F.sum(F.when(F.col("_fits"), F.col("_cb")).otherwise(0)).alias("_wb")))
        here = able.join(turn, scope)
        whole = here.filter(F.col("_chunk") < F.col("_turn")).withColumn("_taken", F.lit(True))
        step = here.filter(F.col("_chunk") == F.col("_turn")).withColumns({"_m": F.col("_m") + F.col("_wm"), "_b": F.col("_b") + F.col("_wb")})
        # One chunk of each scope, so a task holds whole chunks; many small scopes pass through one call.
        folded = step.repartition(*scope).sortWithinPartitions(*scope, "_at").mapInArrow(fold, f"{_ddl(step)}, _taken boolean")
        done = cut(whole.unionByName(folded).drop("_turn", "_wm", "_wb"))
        if done.isEmpty():
            break
        won = done.filter("_taken").select(*scope, "_at")
        admitted = won if admitted is None else admitted.unionByName(won)
        spent = done.groupBy(*scope).agg(
            F.sum(F.when(F.col("_taken"), F.col("members")).otherwise(0)).alias("_dm"),
            F.sum(F.when(F.col("_taken"), F.col("bytes")).otherwise(0)).alias("_db"),
            F.max("_chunk").alias("_dc"))
        usage = cut(usage.join(spent, scope, "left").select(
            *scope, (F.col("_m") + F.coalesce("_dm", zero)).alias("_m"),
            (F.col("_b") + F.coalesce("_db", zero)).alias("_b"), F.coalesce("_dc", "_done").alias("_done")))
    if admitted is None:
        return _rejected(numbered, usage, scope, cap_m).drop("_at", "_chunk")
    admitted = cut(admitted)
    # The usage before each rejected row is what earlier admitted rows add up to.
    won = numbered.join(admitted, [*scope, "_at"], "left_semi").withColumn("admitted", F.lit(True))
    lost = numbered.join(admitted, [*scope, "_at"], "left_anti").withColumn("admitted", F.lit(False))
    both = won.unionByName(lost).withColumns({
        "_dm": F.when(F.col("admitted"), F.col("members")).otherwise(0).cast("bigint")})
    run = number_and_total(both, scope, ["_at"], number=None, totals={"_used_m": "_dm"})
    why = F.when(F.col("admitted"), F.lit(None).cast("string")).when(
        F.col("_used_m") + F.col("members") > cap_m, "members").otherwise("expanded_bytes")
    return run.withColumn("reason", why).drop("_at", "_chunk", "_dm", "_used_m")


def _rejected(rows: DataFrame, usage: DataFrame, scope: list[str], cap_m: int) -> DataFrame:
    return rows.withColumn("admitted", F.lit(False)).withColumn(
        "reason", F.when(F.col("members") > cap_m, "members").otherwise("expanded_bytes"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def capped_sample(rows: DataFrame, rule: str, order: list[str], source: str, size: str,
                  max_rows: int = V.SAMPLE_MAX_FILES, max_bytes: int = V.SAMPLE_MAX_BYTES,
                  quotas: dict[int, int] | None = None) -> DataFrame:
    """A few small samples in rule priority.

    Duplicates of a source, empties and rows that do not fit are skipped and
    the walk goes on. Each round finds the next row that can be taken with one
    aggregation over what is left; there are at most ``max_rows`` rounds.
    """
    quotas = quotas or {}
    keep = [c for c in dict.fromkeys([rule, *order, source, size])]
    left = rows.filter((F.col(size) > 0) & (F.col(size) <= max_bytes)).select(*keep)
    # A repeat of a source can only matter at another size or under another rule.
    left = cut(left.groupBy(rule, source, size).agg(
        F.min_by(F.struct(*keep), F.struct(*order)).alias("_row")).select("_row.*"))
    used, taken = 0, []
    while len(taken) < max_rows:
        fits = left.filter(F.col(size) <= max_bytes - used)
        if taken:
            last = F.struct(*[F.lit(taken[-1][c]).cast(left.schema[c].dataType).alias(c) for c in [rule, *order]])
            fits = fits.filter(F.struct(rule, *order) > last)
            fits = fits.filter(~F.col(source).isin([t[source] for t in taken]))
        for r, quota in quotas.items():
            if sum(t[rule] == r for t in taken) >= quota:
                fits = fits.filter(F.col(rule) != r)
        nxt = fits.agg(F.min_by(F.struct(*keep), F.struct(rule, *order)).alias("_row")).first()[0]
        if nxt is None:
            break
        taken.append(nxt)
        used += nxt[size]
    spark = rows.sparkSession
    schema = rows.select(*keep).schema
    done = [(i + 1, *[t[c] for c in keep]) for i, t in enumerate(taken)]
    return spark.createDataFrame(done, f"pick bigint, {_ddl(spark.createDataFrame([], schema))}")


def check_members(members: DataFrame, archive: str, offset: str, size: str, archive_size: str,
                  limits: dict[str, int]) -> DataFrame:
    """Violations: negative size, extent outside the source, member and archive ceilings."""
    size, offset = F.col(size), F.col(offset)
    broken = F.when(size < 0, "negative_size").when((offset < 0) | (offset + size > F.col(archive_size)), "outside_source").when(
        size > limits["max_member_bytes"], "member_bytes")
    judged = members.select(F.col(archive), size.alias("_size"), F.col(archive_size).alias("_whole"), broken.alias("_rule"))
    # One row per archive holds all counts, so members are read and grouped once.
    rules = ("negative_size", "outside_source", "member_bytes")
    totals = judged.groupBy(archive).agg(
        *[F.count_if(F.col("_rule") == r).alias(f"_{r}") for r in rules],
        F.count("*").alias("_n"), F.sum("_size").alias("_b"), F.max("_whole").alias("_a"))
    one = F.lit(1).cast("bigint")
    found = [(r, F.col(f"_{r}") > 0, F.col(f"_{r}")) for r in rules] + [
        ("members", F.col("_n") > limits["max_members"], one),
        ("expanded_bytes", F.col("_b") > limits["max_expanded_bytes"], one),
        ("archive_bytes", F.col("_a") > limits["max_archive_bytes"], one)]
    return totals.select(archive, F.inline(F.array_compact(F.array(
        *[F.when(test, F.struct(F.lit(name).alias("rule"), n.alias("n"))) for name, test, n in found]))))
