"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document is its token ids and a closing id. Only longer ones are cut, into
pieces of full length; the first piece takes the rest. Texts are tokenized where
they are read; what is packed, and shuffled, are rows of (doc_id, piece, length).

Packing is bounded-space online best-fit. Pieces come in a seeded order. A bitset
has a bit for each amount of free space that some open bin has; the lowest bit at
or above a piece's length is the best fit. A full bin is closed; when a bin too
many is open the fullest is closed. Pieces are dealt to as many packers as there
are ``per_packer`` pieces, so that the bins left open at the end of each are a
small part of all.

Edge cases: a null or empty text is the closing id alone. Rows that repeat an id
are packed each by itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .bpe_transducer import load
from .common import lean, text_chunks

SEQUENCE = 1024
CLOSING_ID = 2
OPEN_BINS = 256
PER_PACKER = 50_000
SEED = "pack-1"


def piece_lengths(total: int, most: int) -> list[int]:
    """Lengths of the pieces of a document with so many ids."""
    rest = total % most
    return ([rest] if rest else []) + [most] * (total // most)


class Packer:
    """Open bins by free space. ``place`` returns the bin of a piece and its offset there."""

    def __init__(self, most: int, open_bins: int):
        self.most, self.open_bins = most, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(most + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def _put(self, free: int, number: int) -> None:
        if free:
            self.by_free[free].append(number)
            self.bits |= 1 << free
            self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.most, self.made
            self.made += 1
        self._put(free - length, number)
        if self.open > self.open_bins:
            self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.most - free


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE,
             closing_id: int = CLOSING_ID) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @lean
    def run(batches):
        machine = load(path)
        for part, texts in text_chunks(batches):
            owner, rows = [], []
            for n, ids in enumerate(machine.ids_of(texts)):
                data = np.append(ids, closing_id).astype("<u4")
                start = 0
                for piece, length in enumerate(piece_lengths(len(data), sequence)):
                    owner.append(n)
                    rows.append((piece, start, length, zlib.crc32(data[start:start + length].tobytes())))
                    start += length
            piece, start, length, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE,
         closing_id: int = CLOSING_ID, open_bins: int = OPEN_BINS, per_packer: int = PER_PACKER) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(tokenize(docs, path, id_col, text_col, sequence, closing_id))
    packers = max(1, -(-pieces.count() // per_packer))
    order = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("piece"))
    dealt = pieces.withColumn("_order", order).repartition(packers, "_order").sortWithinPartitions(
        "_order", "doc_id", "piece", "start", "length", "ids_crc32").drop("_order")

    @lean
    def run(batches):
        packer, first = Packer(sequence, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([first + n for n, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes) + ", sequence_id long, offset long")
