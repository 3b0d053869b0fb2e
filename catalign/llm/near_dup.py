"""Near-duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. Equal texts are one document from here on; the smallest id stands for them.
2. Shingles are windows of five words; a shorter text is one shingle. Document
   frequencies of all shingles are summed up in a sketch of fixed size: a bucket
   holds the documents of all shingles that hash there, less the mean bucket. The
   weight of a shingle is (1 + ln tf) * idf, where idf = ln(1/f) / ln(1/RARE) for a
   share f of the documents, at most 1, at least ``IDF_FLOOR``: what very many
   documents share counts less, but a large group of near copies, which makes its own
   shingles frequent, still finds itself.
3. Improved consistent weighted sampling draws for each of BANDS * ROWS samples and
   each shingle r, c ~ Gamma(2, 1) and b ~ U(0, 1) from a table by the shingle's hash;
   t = floor(ln w / r + b), ln a = ln c - r * (t - b) - r; the shingle with the least
   a is the sample, together with t. Two documents agree in a sample with about
   the probability of their weighted Jaccard similarity. ROWS samples make a band.
4. Documents that share a band meet in its bucket. Each is paired with two centres
   of the bucket, first those documents that meet most others, which in a group of
   copies are near its origin, and with the next ones in the order of their other
   bands, where neighbours agree in most; only in a bucket of at most SMALL documents
   with all others. Hot buckets are dealt out by a further band; the centres join the
   parts. Pairs whose weights differ too much for the threshold are left out, and
   those that agree in fewer than AGREE of all samples: at the threshold that happens
   to about one pair in a hundred thousand.
5. Pairs at or above the threshold are links. Documents that are one or two links apart
   are contracted. One round does nearly all; further rounds with other centres found one link
   in 50,000 pairs.
6. What centres and neighbours leave open is finished exactly: in each bucket of more
   than SMALL documents that still holds several components, all documents outside its
   largest component are compared with all of other components, block against block,
   each pair of blocks a group of its own. Blocks carry the samples and the shingles of
   their documents; pairs that agree in enough samples are verified there and then, and
   of the links only a spanning forest leaves the task, at most one row for each document
   of the two blocks. After that every two documents that share a band are in one
   component or were tested.

Documents are known by a digest of their text, so repeated and null ids do no harm.

Edge cases: texts without words are near-duplicates of nothing but equal texts; a
null text equals the empty text. Rows that repeat an id, or have none, are judged each
by its text. The id of a class is the smallest id in it, null only if all are null.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .common import SMALL_SLICE, attach_groups, keep_one, lean, likely_ids, row_key, text_chunks, text_of
from .text_scan import Scan

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
SKETCH_BITS, BLOCK_BITS = 20, 12
RARE, IDF_FLOOR = 1e-3, 0.75
#: Bits for how often a shingle occurs in a text.
TF_BITS = 20
SMALL, AHEAD, AGREE = 6, 2, 26
#: Members of one part of a bucket, about.
PART = 500
#: Members of one block of the exact finish, about.
BLOCK = 512

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, 44-bit hash, how often; by text."""
    s = Scan(texts)
    first = np.cumsum(s.n_words) - s.n_words
    at = np.arange(len(s.begin))
    size = np.minimum(words, s.n_words)[s.owner]
    at = at[at + size <= (first + s.n_words)[s.owner]]
    h = s.over_words.of(at, at + size[at])
    keys = np.sort(s.owner[at].astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    tf = np.diff(np.concatenate([new, [len(keys)]]))
    keys = keys[new]
    return (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1), tf


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h * _M1 >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Documents with words, and for each bucket of hashes the documents of its shingles."""
    @lean
    def count(batches):
        held, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for _, texts in text_chunks(batches):
            owner, h, _tf = shingles(texts)
            held += np.bincount(bucket_of(h), minlength=len(held))
            n += len(np.unique(owner))
        part = TaskContext.get().partitionId() % 64
        for block, counts in enumerate(held.reshape(-1, 1 << BLOCK_BITS)):
            if counts.any():
                yield row(block, part, counts, n if block == 0 else 0)
        if n and not held[:1 << BLOCK_BITS].any():
            yield row(0, part, held[:1 << BLOCK_BITS], n)

    def row(block, part, counts, n):
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary()),
             pa.array([n], pa.int64())], names=["block", "part", "counts", "n"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, part = np.zeros(1 << BLOCK_BITS, np.int64), 0, 0
        for batch in batches:
            for block, part, counts, m in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "counts", "n"))):
                total += np.frombuffer(zlib.decompress(counts), np.int64)
                n += m
        yield row(key[0].as_py(), 0, total, n)

    schema = "block int, part int, counts binary, n long"
    # Two levels, so that no group has more than a 64th of the tasks.
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, schema)
    blocks = parts.groupBy("block", "part").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    sketch, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for r in blocks.collect():  # of fixed size
        sketch[r["block"] << BLOCK_BITS:(r["block"] + 1) << BLOCK_BITS] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        n += r["n"]
    return n, sketch


def idf_table(n: int, sketch: np.ndarray) -> np.ndarray:
    share = np.maximum(sketch - sketch.mean(), 0) / max(n, 1)
    return np.clip(np.log(1 / np.maximum(share, RARE)) / math.log(1 / RARE), IDF_FLOOR, 1).astype(np.float32)


def weigh(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)).astype(np.float32) * idf[bucket_of(h)]


_TABLES: list = []


def draw_tables() -> tuple:
    """ln c, r and b for each table row; the same in every process."""
    if not _TABLES:
        rng = np.random.default_rng(6)
        size = 1 << 16
        r, c = rng.gamma(2, 1, size).astype(np.float32), rng.gamma(2, 1, size).astype(np.float32)
        b = rng.random(size, np.float32)
        multipliers = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _TABLES.append((np.log(c), r, b, multipliers))
    return _TABLES[0]


def ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of floats."""
    bits = x.view(np.int32)
    return np.where(bits < 0, ~bits, bits | np.int32(-0x80000000)).view(np.uint32).astype(np.uint64)


def band_keys(owner: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that have shingles, and for each a row of band hashes and one of the samples, in 32 bits."""
    if not len(owner):
        return owner, np.zeros((0, BANDS), np.int64), np.zeros((0, BANDS * ROWS), np.int32)
    log_c, r, b, multipliers = draw_tables()
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    unit = ordered(log_c + r * b - r) << np.uint64(32)  # weight 1: t = 0
    other = np.flatnonzero(w != 1)
    log_w = np.log(w[other])
    low = h * _M2 >> np.uint64(32)
    out = np.zeros((len(begin), BANDS), np.uint64)
    samples = np.zeros((len(begin), BANDS * ROWS), np.uint32)
    for k, m in enumerate(multipliers):
        at = (h * m >> np.uint64(48)).astype(np.int64)
        keys = unit[at]
        if len(other):
            at = at[other]
            t = np.floor(log_w / r[at] + b[at])
            keys[other] = ordered(log_c[at] - r[at] * (t - b[at]) - r[at]) << np.uint64(32)
        sample = np.minimum.reduceat(keys | low, begin)
        samples[:, k] = sample * _M2 >> np.uint64(32)
        band = k // ROWS
        out[:, band] = (out[:, band] ^ sample) * _M1
        out[:, band] ^= out[:, band] >> np.uint64(31)
    return owner[begin], (out + np.arange(BANDS, dtype=np.uint64) * _M2).view(np.int64), samples.view(np.int32)


def sign(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(id, weight, bands, samples) of each document with words."""
    @lean
    def run(batches):
        for part, texts in text_chunks(batches, SMALL_SLICE):
            owner, h, tf = shingles(texts)
            w = weigh(h, tf, sent.value)
            has, bands, samples = band_keys(owner, h, w)

            def rows(table):
                at = pa.array(np.arange(len(has) + 1, dtype=np.int32) * table.shape[1])
                return pa.ListArray.from_arrays(at, pa.array(table.ravel()))

            total = np.bincount(owner, weights=w, minlength=len(texts))[has]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(has)), pa.array(total), rows(bands), rows(samples)],
                names=["id", "weight", "bands", "samples"])

    return docs.select("id", "text").mapInArrow(
        run, f"id {docs.schema['id'].dataType.simpleString()}, weight double, bands array<long>, samples array<int>")


def similarities(left: list[str], right: list[str], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of pairs of texts."""
    owner, h, tf = shingles(left + right)
    w = weigh(h, tf, idf).astype(np.float64)
    pair = owner % len(left)
    keys = pair.astype(np.uint64) << np.uint64(44) | h
    total = np.bincount(pair, weights=w, minlength=len(left))
    order = np.argsort(keys, kind="stable")
    keys, w, pair = keys[order], w[order], pair[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    shared = np.bincount(pair[same], weights=np.minimum(w[same], w[same + 1]), minlength=len(left))
    return shared / np.maximum(total - shared, 1e-12)


def verify(pairs: DataFrame, texts: DataFrame, sent: Broadcast, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) that are at or above the threshold, with their similarity. ``sent`` is the idf table."""

    @lean
    def run(batches):
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            begin = held = 0
            for n in range(len(left)):
                held += len(left[n]) + len(right[n])
                if held > SMALL_SLICE or n == len(left) - 1:
                    sim = similarities(left[begin:n + 1], right[begin:n + 1], sent.value)
                    good = np.flatnonzero(sim >= threshold - 1e-9)
                    part = batch.slice(begin, n + 1 - begin)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(good)), part.column(1).take(pa.array(good)), pa.array(sim[good])],
                        names=["a", "b", "similarity"])
                    begin, held = n + 1, 0

    id_type = pairs.schema["a"].dataType.simpleString()
    # Only the texts of these pairs are shuffled.
    texts = likely_ids(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    with_left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
    with_both = with_left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")
    return with_both.mapInArrow(run, f"a {id_type}, b {id_type}, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in edges (a, b): the smallest id of its connected component.

    Large-star and small-star steps in turn: each hangs neighbours onto the smallest one.
    Both sides of a step are combined in map tasks; the neighbours of a hub, which has one
    row on the other side, are a skewed join that adaptive execution splits.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("id")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots.withColumn("label", F.col("id")))


def nearby_labels(links: DataFrame) -> DataFrame:
    """(id, label) of every id in links (a, b): the smallest id at most two links away, so that one label is in one component.

    This contracts each star of a centre, which is most of what a round of links has, in two steps.
    """
    both = cut(links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("id"), F.col("a").alias("other"))))
    one = cut(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("label")))
    return both.join(one.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.least(F.min("label"), F.col("id")).alias("label"))


def candidates(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components that meet in a bucket: with its centres, and with the next ones in order."""
    row = F.struct("id", "comp", "weight")
    draws = [F.struct(-F.col("met"), "id"), F.xxhash64("bucket", "id")]
    centres = cut(members.groupBy("bucket").agg(
        *[F.min_by(row, d).alias(f"c{k}") for k, d in enumerate(draws)], F.count("*").alias("size"),
        F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket", "c0", "c1", "size"))
    mixed = cut(members.join(centres, "bucket"))
    part = F.pmod("next", F.ceil(F.col("size") / PART))
    w = Window.partitionBy("bucket", part).orderBy("next", "after", "weight", "id")
    ahead = mixed.select(*mixed.columns, *[F.lead(row, k).over(w).alias(f"n{k}") for k in range(1, SMALL)])
    others = [F.when((F.col("size") <= SMALL) | F.lit(k <= AHEAD), F.col(f"n{k}")) for k in range(1, SMALL)]
    pairs = ahead.select("id", "comp", "weight", F.explode(F.array("c0", "c1", *others)).alias("o")).filter(
        "o IS NOT NULL AND o.comp <> comp").filter(
        F.least("weight", "o.weight") >= (threshold - 1e-6) * F.greatest("weight", "o.weight"))
    return pairs.select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b")).distinct()


def agreeing(pairs: DataFrame, samples: DataFrame, least: int = AGREE) -> DataFrame:
    """Pairs that agree in enough samples to be worth the shuffle of their texts."""
    both = pairs.join(samples.select(F.col("id").alias("a"), F.col("samples").alias("x")), "a").join(
        samples.select(F.col("id").alias("b"), F.col("samples").alias("y")), "b")
    same = F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda z: z))
    return both.filter(same >= least).select("a", "b")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, shingles): the shingles of each text and how often they occur, eight bytes each, in order."""
    @lean
    def run(batches):
        for part, chunk in text_chunks(batches, SMALL_SLICE):
            owner, h, tf = shingles(chunk)
            packed = (h << np.uint64(TF_BITS) | np.minimum(tf, (1 << TF_BITS) - 1).astype(np.uint64)).astype("<u8")
            at = np.searchsorted(owner, np.arange(len(chunk) + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([packed[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, shingles binary")


def cross_similarities(left: list[bytes], right: list[bytes], idf: np.ndarray, width: int = 2048) -> np.ndarray:
    """Weighted Jaccard similarity of each of some shingle sets with each of others.

    The smaller of two weights of a shingle is a sum over the frequencies up to the smaller
    one, so what two texts share is a product of flags, taken by slices of shingles that
    occur on both sides.
    """
    sets = [np.frombuffer(b, "<u8") for b in left + right]
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    h = known >> np.uint64(TF_BITS)
    w = weigh(h, (known & np.uint64((1 << TF_BITS) - 1)).astype(np.int64), idf).astype(np.float64)
    new = np.concatenate([[True], h[1:] != h[:-1]])
    step = w - np.where(new, 0, np.concatenate([[0], w[:-1]]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))[at]
    total = np.bincount(owner, w[at], len(sets))
    n = at - first + 1
    flag = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    owner = np.repeat(owner, n)
    is_left = owner < len(left)
    seen = [np.bincount(flag[side], minlength=len(h)) > 0 for side in (is_left, ~is_left)]
    column = np.cumsum(seen[0] & seen[1]) - 1
    keep = (seen[0] & seen[1])[flag]
    flag, owner = flag[keep], owner[keep]
    order = np.argsort(flag, kind="stable")
    flag, owner = flag[order], owner[order]
    place = column[flag]
    shared = np.zeros((len(left), len(right)))
    for begin in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        part = slice(*np.searchsorted(place, [begin, begin + width]))
        x, y = np.zeros((len(left), width)), np.zeros((len(right), width))
        o, c, f = owner[part], place[part] - begin, flag[part]
        is_left = o < len(left)
        x[o[is_left], c[is_left]] = 1
        y[o[~is_left] - len(left), c[~is_left]] = step[f[~is_left]]
        shared += x @ y.T
    return shared / np.maximum(total[:len(left), None] + total[None, len(left):] - shared, 1e-12)


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links (a, b) between numbered nodes join two trees, taken in order."""
    parent = list(range(int(max(a.max(initial=-1), b.max(initial=-1))) + 1))
    kept = []
    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            kept.append(n)
    return kept


def open_links(members: DataFrame, texts: DataFrame, samples: DataFrame, sent: Broadcast, threshold: float, least: int = AGREE) -> DataFrame:
    """Links (a, b, similarity) that join all components which meet in a bucket of more than SMALL and are linked.

    A member outside the bucket's largest component meets all blocks, one inside only the blocks of those outside.
    """
    parts = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    buckets = cut(parts.groupBy("bucket").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("size")).filter(
        (F.col("size") > SMALL) & (F.col("size") > F.col("inside"))).select(
        "bucket", "main", F.ceil((F.col("size") - F.col("inside")) / BLOCK).alias("outer"), F.ceil(F.col("inside") / BLOCK).alias("inner")))
    is_outer = F.col("comp") != F.col("main")
    draw = F.xxhash64(F.lit("block"), "id")
    placed = cut(members.select("bucket", "id", "comp", "weight").join(buckets, "bucket").withColumn(
        "block", F.when(is_outer, F.pmod(draw, "outer")).otherwise(F.col("outer") + F.pmod(draw, "inner"))).withColumn(
        "blocks", F.when(is_outer, F.col("outer") + F.col("inner")).otherwise(F.col("outer"))))
    sets = shingle_sets(likely_ids(texts, placed.select("id"), "id"))
    dealt = placed.join(samples.join(sets, "id"), "id").select(
        "bucket", "block", "id", "comp", "weight", "samples", "shingles",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        block, weight, ids = group.column("block").to_numpy(), group.column("weight").to_numpy(), group.column("id").combine_chunks()
        comp = group.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        drawn = group.column("samples").combine_chunks().flatten().to_numpy().reshape(len(block), -1)
        x, y = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        agree = np.zeros((len(x), len(y)), np.uint8)
        for k in range(drawn.shape[1]):
            agree += drawn[x, k][:, None] == drawn[y, k][None, :]
        good = (agree >= least) & (comp[x][:, None] != comp[y][None, :])
        u, v = weight[x][:, None], weight[y][None, :]
        good &= np.minimum(u, v) >= (threshold - 1e-6) * np.maximum(u, v)
        rows, columns = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
        x, y, good = x[rows], y[columns], good[np.ix_(rows, columns)]
        a = b = sim = np.zeros(0, np.int64)
        if len(x):
            held = group.column("shingles").combine_chunks()
            similar = cross_similarities(*([held[n].as_py() for n in side.tolist()] for side in (x, y)), sent.value)
            a, b = np.nonzero(good & (similar >= threshold - 1e-9))
            sim = similar[a, b]
            order = np.argsort(-sim, kind="stable")
            a, b, sim = x[a[order]], y[b[order]], sim[order]
            kept = forest(comp[a], comp[b])
            a, b, sim = a[kept], b[kept], sim[kept]
        a_at, b_at = pa.array(a, pa.int64()), pa.array(b, pa.int64())
        return pa.table({"a": ids.take(a_at), "b": ids.take(b_at), "similarity": pa.array(sim, pa.float64())})

    id_type = members.schema["id"].dataType.simpleString()
    return dealt.groupBy("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).applyInArrow(
        compare, f"a {id_type}, b {id_type}, similarity double")


def near_links(texts: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) between texts (id, text), and components (id, label) of those that have any."""
    sent = texts.sparkSession.sparkContext.broadcast(idf)  # of fixed size
    signed = cut(sign(texts, sent))

    def band(at):
        return F.element_at("bands", at % BANDS + 1)

    banded = signed.select("id", "weight", "bands", F.posexplode("bands").alias("at", "bucket")).select(
        "id", "weight", "bucket", band(F.col("at") + 1).alias("next"), band(F.col("at") + 2).alias("after"))
    shared = cut(banded.groupBy("bucket").count().filter("count > 1"))
    # A plain join: a hot bucket has one row in ``shared``, and adaptive execution splits the other side.
    members = cut(banded.join(shared, "bucket"))
    # How many others a document meets, over all its buckets.
    met = members.groupBy("id").agg(F.sum("count").alias("met"))
    members = cut(members.drop("count").join(met, "id").withColumn("comp", F.col("id")))
    samples = signed.select("id", "samples")
    pairs = cut(agreeing(candidates(members, threshold), samples))
    links = cut(verify(pairs, texts, sent, threshold))
    near = nearby_labels(links)
    members = cut(members.drop("comp", "met").join(near, "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label"))
    links = links.unionByName(cut(open_links(members, texts, samples, sent, threshold)))
    sent.destroy()
    return links, cut(components(links))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, id, row, first) for every document, where id is the digest of its text, row the key of document and text, and
    first the smallest document id with that text; and (id, text) for each text once."""
    kept = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    digest = F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    rows = cut(kept.select("doc_id", digest.alias("id")))
    total = rows.count()
    groups = cut(rows.groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    owners = cut(attach_groups(rows, groups, "id", "n", total, "inner").select("doc_id", "id", row_key("doc_id", "id").alias("row"), "first"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first"))
    lost = owners.filter(~is_first).select("row")
    twice = owners.filter(is_first).groupBy("row").count().filter("count > 1").select("row")
    return owners, keep_one(kept, row_key("doc_id", digest), lost, twice).select(digest.alias("id"), "text")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), class_size, copy_of (smallest id with the
    same text), n_links (links of its text to other texts that were found)."""
    owners, texts = distinct_texts(docs, id_col, text_col)
    n, sketch = frequency_sketch(texts)
    links, label = near_links(texts, idf_table(n, sketch), threshold)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    known = cut(label.join(degree, "id", "left"))
    rows = cut(owners.join(known, "id", "left").select(
        "doc_id", F.coalesce("label", "id").alias("_class"), F.col("first").alias("copy_of"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    sizes = cut(rows.groupBy("_class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).withColumn("n", F.col("class_size")))
    return attach_groups(rows, sizes, "_class", "n", rows.count(), "inner").select(
        "doc_id", "class_id", "class_size", "copy_of", "n_links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Documents without all but one of each class: the row with the smallest id, of several such the one of the smallest digest."""
    owners, texts = distinct_texts(docs, id_col, text_col)
    n, sketch = frequency_sketch(texts)
    _, label = near_links(texts, idf_table(n, sketch), threshold)
    rows = cut(owners.join(label, "id", "left").select("doc_id", "id", "row", F.coalesce("label", "id").alias("_class")))
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "row")
    classes = cut(rows.groupBy("_class").agg(F.min(best)["row"].alias("stays"), F.count("*").alias("n")))
    judged = cut(attach_groups(rows, classes.filter("n > 1"), "_class", "n", rows.count(), "inner").select("row", "stays"))
    stays = F.col("row") == F.col("stays")
    lost = judged.filter(~stays).select("row")
    twice = judged.filter(stays).groupBy("row").count().filter("count > 1").select("row")
    key = row_key(docs[id_col], F.substring(F.unhex(F.sha2(text_of(docs, text_col), 256)), 1, 16))
    return keep_one(docs, key, lost, twice)
