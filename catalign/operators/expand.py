"""Expansion of nested containers over a members table.

``members`` has (parent, child, kind): the container's path, the member's path
and the kind of container the member itself is (null for a plain file).

Members are first stored as Parquet, partitioned by a hash of the parent. A round reads
only the partitions that its frontier hashes to, opens the frontier, and writes what is
new, so lineage stays short however deep the nesting is. A member with one parent can turn
up once only; just those that several parents hold, or that are roots, are compared with
what was seen before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, scratch_path
from .budget import admit_under_budget

BROADCAST_ROWS = 100_000
#: Members of one partition of the store, about, and how many partitions there are at most.
SLOT_ROWS, MAX_SLOTS = 250_000, 1024
#: Files that the members of one partition are dealt to, so that a container with very many is not one task's.
FILES_PER_SLOT = 4


@dataclass
class Store:
    """Members by a hash of their parent: slot, parent, child, kind, further columns, and again (whether a member may turn up twice)."""

    path: str
    slots: int
    rows: DataFrame

    def slot(self, parent: str) -> Column:
        return F.pmod(F.xxhash64(parent), F.lit(self.slots)).cast("int")

    def inside(self, frontier: DataFrame) -> DataFrame:
        """Members of the containers in (path, depth), with parent, depth of the parent and their own columns."""
        opened = frontier.select(F.col("path").alias("parent"), "depth")
        wanted = [r[0] for r in opened.select(self.slot("parent").alias("slot")).distinct().collect()]  # at most MAX_SLOTS
        if opened.count() <= BROADCAST_ROWS:
            # Counted just now: small frontiers save the shuffle of the members read.
            opened = F.broadcast(opened)
        return self.rows.filter(F.col("slot").isin(wanted)).join(opened, "parent")


def store_members(members: DataFrame, roots: DataFrame, reopens: bool = False, slot_rows: int = SLOT_ROWS) -> Store:
    """Write the members by slot. With ``reopens`` every member may turn up again."""
    spark = members.sparkSession
    members = cut(members)  # it is read three times
    slots = min(MAX_SLOTS, max(1, -(-members.count() // slot_rows)))
    out = Store(scratch_path(spark, "members"), slots, members)
    if reopens:
        flagged = members.withColumn("again", F.lit(True))
    else:
        several = members.groupBy("child").count().filter("count > 1").select("child")
        several = cut(several.unionByName(roots.select(F.col("path").alias("child"))).distinct())
        few = several.count() <= BROADCAST_ROWS
        marked = several.withColumn("again", F.lit(True))
        flagged = members.join(F.broadcast(marked) if few else marked, "child", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    dealt = flagged.withColumn("slot", out.slot("parent"))
    dealt.repartition(slots * FILES_PER_SLOT, "slot", F.pmod(F.xxhash64("child"), F.lit(FILES_PER_SLOT))).write.partitionBy("slot").parquet(out.path)
    out.rows = spark.read.schema(dealt.schema).parquet(out.path)
    return out


def _fresh(store: Store, frontier: DataFrame, seen: DataFrame, stage: int) -> DataFrame:
    """Members of the frontier that were not seen before: path, kind, depth, stage, again."""
    inside = cut(store.inside(frontier).select(
        F.col("child").alias("path"), "kind", (F.col("depth") + 1).alias("depth"), F.lit(stage).alias("stage"), "again"))
    once = inside.filter("NOT again")
    more = inside.filter("again").groupBy("path").agg(
        F.min("kind").alias("kind"), F.min("depth").alias("depth"), F.lit(stage).alias("stage"), F.lit(True).alias("again"))
    return once.unionByName(more.join(seen.filter("again").select("path"), "path", "left_anti"))


def _known(roots: DataFrame) -> DataFrame:
    return roots.select("path", "kind", F.lit(0).alias("depth"), F.lit(0).alias("stage"), F.lit(True).alias("again"))


def _closure(known: DataFrame, store: Store, kinds: list[str] | None, stage: int,
             max_depth: int | None) -> DataFrame:
    """Open every container of the given kinds, once each, until nothing new appears."""
    def containers(files):
        c = files.filter(F.col("kind").isNotNull() if kinds is None else F.col("kind").isin(kinds))
        return c if max_depth is None else c.filter(F.col("depth") <= max_depth)

    frontier, seen = cut(containers(known)), known
    while not frontier.isEmpty():
        fresh = cut(_fresh(store, frontier, seen, stage))
        seen = seen.unionByName(fresh)
        frontier = containers(fresh)
    return seen


def _reopens(stages: list[list[str]]) -> bool:
    kinds = [k for stage in stages for k in stage]
    return len(kinds) > len(set(kinds))


def expand_staged(roots: DataFrame, members: DataFrame, stages: list[list[str]],
                  max_depth: int | None = None, store: Store | None = None) -> DataFrame:
    """One kind after the other: A to closure, then B over roots and A's output, …

    A later stage never reopens an earlier kind, so a container of an early
    kind found late stays closed. Result: path, kind, depth, stage. ``store``
    holds these members for the same roots, if they are stored already; a kind
    in two stages needs one that reopens.
    """
    known = _known(roots)
    store = store or store_members(members.select("parent", "child", "kind"), roots, _reopens(stages))
    for number, kinds in enumerate(stages, 1):
        known = _closure(known, store, kinds, number, max_depth)
    return known.drop("again")


def expand_fixed_point(roots: DataFrame, members: DataFrame, max_depth: int | None = None, store: Store | None = None) -> DataFrame:
    """All kinds until no growth; ``stage`` is 1 for everything that was opened."""
    store = store or store_members(members.select("parent", "child", "kind"), roots)
    return _closure(_known(roots), store, None, 1, max_depth).drop("again")


def staged_gap(full: DataFrame, staged: DataFrame) -> DataFrame:
    """What the staged order would miss."""
    return full.join(staged.select("path"), "path", "left_anti")


def expand_under_budget(roots: DataFrame, members: DataFrame, stages: list[list[str]], limits: dict[str, int],
                        order: str = "path") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Staged expansion in which every container has to be admitted before it is opened.

    ``members`` also has ``size`` (bigint). Containers of a round are charged
    in ``order``; what earlier rounds used is gone. Returns the files, the
    refused containers with the reason, and the usage.
    """
    known = _known(roots)
    store = store_members(members.select("parent", "child", "kind", "size"), roots, _reopens(stages))
    used = {"archives": 0, "members": 0, "bytes": 0, "max_depth_seen": 0}
    refused = None
    for number, kinds in enumerate(stages, 1):
        frontier = cut(known.filter(F.col("kind").isin(kinds)))
        while not frontier.isEmpty():
            held = store.inside(frontier).groupBy(F.col("parent").alias("path")).agg(
                F.count("*").alias("members"), F.sum("size").alias("bytes"), F.max("size").alias("largest"),
                F.min("size").alias("smallest"))
            none = F.lit(0).cast("bigint")
            archives = frontier.select("path", "depth").join(held, "path", "left").withColumns(
                {c: F.coalesce(c, none) for c in ("members", "bytes", "largest", "smallest")}).withColumn("_all", F.lit(0))
            left = {**limits, "max_members": limits["max_members"] - used["members"],
                    "max_expanded_bytes": limits["max_expanded_bytes"] - used["bytes"]}
            decided = cut(admit_under_budget(archives, left, [order], ["_all"]))
            sums = decided.filter("admitted").agg(
                F.count("*").alias("archives"), F.sum("members").alias("members"), F.sum("bytes").alias("bytes"),
                F.max("depth").alias("deepest")).first()
            used = {"archives": used["archives"] + sums["archives"], "members": used["members"] + (sums["members"] or 0),
                    "bytes": used["bytes"] + (sums["bytes"] or 0),
                    "max_depth_seen": max(used["max_depth_seen"], sums["deepest"] or 0)}
            no = decided.filter(~F.col("admitted")).select("path", "reason", F.lit(number).alias("stage"))
            refused = no if refused is None else refused.unionByName(no)
            fresh = cut(_fresh(store, decided.filter("admitted"), known, number))
            known = known.unionByName(fresh)
            frontier = fresh.filter(F.col("kind").isin(kinds))
    if refused is None:
        refused = known.limit(0).select("path", F.lit("").alias("reason"), "stage")
    return known.drop("again"), refused, used
