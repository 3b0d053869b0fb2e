"""Matching a dump against a catalogue: exact by digest, similar by vectors."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import values as V
from ..session import cut
from .ranking import top_per_group

TILE_ROWS = 2048
#: How much wider each further search is.
WIDER = 2.0


def match_exact(dump: DataFrame, catalog: DataFrame, item: str, asset: str, digests: list[str],
                carry: list[str] | None = None) -> DataFrame:
    """Items with the one catalogue asset sharing any digest; status verified, ambiguous or unmatched.

    The catalogue is reduced to (digest, smallest, largest asset) first, so
    popular digests never multiply. Smallest equal to largest over all digests
    of an item means one distinct asset. ``carry`` names item columns to keep.
    """
    carry = carry or []

    def spread(df, *keep):
        return df.select(*keep, F.explode(F.array_distinct(F.array(*digests))).alias("digest"))

    index = spread(catalog, asset).filter(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min(asset).alias("_lo"), F.max(asset).alias("_hi"))
    hits = spread(dump, item, *carry).join(index, "digest", "left").groupBy(item).agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *[F.first(c).alias(c) for c in carry])
    return hits.select(
        item,
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(asset),
        F.when(F.col("_lo").isNull(), "unmatched").when(F.col("_lo") == F.col("_hi"), "verified")
        .otherwise("ambiguous").alias("status"),
        *carry,
    )


def aspect_position(w, h):
    """Aspect ratio on a scale where the accepted tolerance is a constant distance.

    The tolerance is absolute below a ratio of one and relative above it, so
    the scale is linear first and logarithmic then.
    """
    ratio = F.col(w) / F.col(h)
    return F.when(ratio < 1, ratio).otherwise(F.lit(1.0) + F.log(ratio))


ASPECT_REACH = -math.log(1 - V.ASPECT_TOLERANCE) * 1.02


def sign_means(vec: str) -> list:
    """Signed means of a vector.

    Each moves by at most the mean absolute difference, and mirroring a vector
    leaves them alone because the signs are symmetric.
    """
    def signed(pattern):
        n = F.size(vec)
        near = lambda i: F.least(i, n - 1 - i)
        band = lambda i: F.floor((near(i) * 2 + 1) * len(pattern) / n).cast("int")
        return F.transform(vec, lambda x, i: x * F.element_at(F.array(*[F.lit(s) for s in pattern]), band(i) + 1))

    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(vec)

    return [mean(F.col(vec)), mean(signed([1.0, -1.0])), mean(signed([1.0, -1.0, 1.0, -1.0]))]


@dataclass
class Grid:
    """Rows of both sides in cells along signed means, for scores up to ``reach``.

    Signed means bound the score from below, so cells are twice the reach wide and an item
    visits its cell and the nearer neighbour in each direction. Full cells are cut into
    tiles on both sides; a task compares one bounded pair of tiles.
    """

    reach: float
    tile_rows: int
    aspect: bool

    KEYS = ["block", "cell", "c_tile", "d_tile"]

    def _axes(self) -> list:
        widths = [(f"_m{i}", self.reach) for i in range(3)] + ([("_aspect", ASPECT_REACH)] if self.aspect else [])
        return [F.col(c) / (2 * r * (1 + 1e-9)) for c, r in widths]

    def sides(self, cat: DataFrame, ask: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Catalogue and items by pair of tiles."""
        axes = self._axes()
        cat = cat.withColumn("cell", F.concat_ws(",", *[F.floor(x).cast("string") for x in axes]))
        choices = []
        for x in axes:
            home = F.floor(x)
            near = F.when(x - home < 0.5, home - 1).otherwise(home + 1)
            choices.append([home.cast("string"), near.cast("string")])
        ask = ask.withColumn("cell", F.explode(F.array(*[F.concat_ws(",", *way) for way in itertools.product(*choices)])))

        def tiles(df, name):
            return df.groupBy("block", "cell").agg(F.ceil(F.count("*") / self.tile_rows).cast("int").alias(name))

        def tile_of(key, count):
            return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

        def every(count):
            return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

        grid = tiles(cat, "c_tiles").join(tiles(ask, "d_tiles"), ["block", "cell"])
        c_side = cat.join(grid, ["block", "cell"]).withColumn("c_tile", tile_of("c_id", "c_tiles")).withColumn("d_tile", every("d_tiles"))
        d_side = ask.join(grid, ["block", "cell"]).withColumn("d_tile", tile_of("d_id", "d_tiles")).withColumn("c_tile", every("c_tiles"))
        return c_side.select(*self.KEYS, "c_id", "c_vec", "c_ratio"), d_side.select(*self.KEYS, "d_id", "d_vec", "d_ratio")


def prepare_vectors(df: DataFrame, key: str, vector: str, block: str, aspect: tuple[str, str] | None, prefix: str) -> DataFrame:
    """What a grid needs of one side: id, block, vector in doubles, its signed means, ratio and position of the aspect."""
    slim = df.select(
        F.col(key).alias(f"{prefix}_id"), F.col(block).alias("block"),
        F.transform(vector, lambda x: x.cast("double")).alias(f"{prefix}_vec"),
        (F.col(aspect[0]) / F.col(aspect[1]) if aspect else F.lit(1.0)).alias(f"{prefix}_ratio"),
        (aspect_position(*aspect) if aspect else F.lit(1.0)).alias("_aspect"))
    return slim.withColumns({f"_m{i}": m for i, m in enumerate(sign_means(f"{prefix}_vec"))})


def match_nearest(
    dump: DataFrame, catalog: DataFrame, item: str, asset: str, vector: str, block: str,
    best_max: float = V.NEAREST_BEST_MAX, gap_min: float = V.NEAREST_GAP_MIN, second_ok: float = V.NEAREST_SECOND_OK,
    mirrored: bool = True, exclude_same: bool = False, aspect: tuple[str, str] | None = None,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Closest catalogue vector by mean absolute difference within a block, accepted only when clear.

    Exact for every item, without forming all pairs. Items look for their two best within a
    reach first that decides acceptance. Two hits within the reach are proven to be the two
    best; items that have fewer look again over rings ``WIDER`` times as wide, until the reach
    covers whatever two vectors can differ by.

    With ``aspect`` (width and height columns) both sides must also agree in
    aspect ratio within the tolerance.

    Every item, each with an id of its own, gets a row with best asset, ``score``,
    ``runner_up_score`` (1.0 when its block has no second candidate) and ``accepted``; an
    item without any candidate has neither asset nor scores and is not accepted.
    """
    cat = cut(prepare_vectors(catalog, asset, vector, block, aspect, "c"))
    ask = cut(prepare_vectors(dump, item, vector, block, aspect, "d"))
    tolerance = V.ASPECT_TOLERANCE

    def within(reach: float):
        def compare(c: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(c) and len(d):
                matrix, ids = np.array(c["c_vec"].tolist()), c["c_id"].to_numpy()
                ratio = c["c_ratio"].to_numpy()
                allowed = np.maximum(tolerance, tolerance * ratio)
                for d_id, vec, r in zip(d["d_id"].to_numpy(), d["d_vec"], d["d_ratio"]):
                    v = np.asarray(vec)
                    score = np.abs(matrix - v).mean(axis=1)
                    if mirrored:
                        score = np.minimum(score, np.abs(matrix - v[::-1]).mean(axis=1))
                    score = np.where(np.abs(ratio - r) > allowed, np.inf, score)
                    if exclude_same:
                        score = np.where(ids == d_id, np.inf, score)
                    for i in np.lexsort((ids, score))[:2]:
                        if score[i] <= reach:
                            out.append((d_id, ids[i], float(score[i])))
            return pd.DataFrame(out, columns=["d_id", "c_id", "score"])
        return compare

    def extent(df, vec):
        return df.agg(F.max(F.array_max(F.transform(vec, lambda x: F.abs(x))))).first()[0] or 0.0

    # A runner-up beyond the first reach leaves enough of a gap to any best that is near enough.
    reach, widest = max(best_max, min(best_max + gap_min, second_ok)), extent(cat, "c_vec") + extent(ask, "d_vec")
    schema = f"d_id {_type(ask, 'd_id')}, c_id {_type(cat, 'c_id')}, score double"
    proven = None
    while True:
        c_side, d_side = Grid(reach, tile_rows, aspect is not None).sides(cat, ask)
        found = c_side.groupBy(*Grid.KEYS).cogroup(d_side.groupBy(*Grid.KEYS)).applyInPandas(within(reach), schema=schema)
        two = top_per_group(found, ["d_id"], ["score", "c_id"], 2, "_n")
        best = cut(two.groupBy("d_id").agg(
            F.max(F.when(F.col("_n") == 1, F.col("c_id"))).alias(asset),
            F.max(F.when(F.col("_n") == 1, F.col("score"))).alias("score"),
            F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("runner_up_score")))
        if reach >= widest:
            break
        settled = best.filter("runner_up_score IS NOT NULL")
        proven = settled if proven is None else proven.unionByName(settled)
        ask = cut(ask.join(settled.select("d_id"), "d_id", "left_anti"))
        if ask.isEmpty():
            best = settled.limit(0)
            break
        reach *= WIDER
    best = best if proven is None else proven.unionByName(best)
    best = best.withColumnRenamed("d_id", item).withColumn("runner_up_score", F.coalesce("runner_up_score", F.lit(1.0)))
    clear = (F.col("score") <= best_max) & (
        (F.col("runner_up_score") - F.col("score") >= gap_min) | (F.col("runner_up_score") >= second_ok))
    return dump.select(item).join(best, item, "left").withColumn("accepted", F.coalesce(clear, F.lit(False)))


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
