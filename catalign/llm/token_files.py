"""Token ids of all documents in files of Re-Pair grammars, in ascending order of the documents.

Writing. Texts travel once, to range partitions of the document id; each partition
tokenizes its documents in order and writes them as blocks of about ``block_ids`` ids.
Words between ASCII white space are tokenized once and remembered, as a tokenizer that
drops white space does not look across it. A block is one row of a Parquet folder, so that Spark's own commit protects the files on any store and a reader can skip
blocks by ``first_doc`` and ``last_doc``:

| column | content |
|---|---|
| part, block, start, n_ids | partition, number of the block in it, ids of the partition before the block, ids in it |
| first_doc, last_doc, doc_ids, doc_sizes | which documents, and how many ids each has |
| base, width, rules, lengths, sequence | the grammar (``repair_grammar``); symbols have ``width`` bytes, lengths eight, little-endian |

Reading. Blocks are decoded one by one. What comes before a partition is the sum over
earlier ones, of which there are at most ``MAX_PARTS``.

Edge cases: a null or empty text is the closing id alone. Null ids come first. Rows that
repeat an id are documents of their own, the one of fewer bytes first; rows equal in full are dealt to
several partitions if they are many. A document longer than a block is a block of its own.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from ..session import scratch_path
from .bpe_transducer import byte_symbols
from .common import text_chunks
from .repair_grammar import Grammar, compress

BLOCK_IDS = 1 << 18
#: Text of one partition, about.
BYTES_PER_PART = 1 << 24
MAX_PARTS = 20_000
#: Words and ids remembered at a time.
HELD_WORDS, HELD_IDS = 3 << 18, 1 << 23
SIGNS = ".,;:!?"
PLAIN = re.compile(f"([a-zà-öø-þ]+)([{SIGNS}]?)")


class Numbered(dict):
    """Numbers words as they come up, from 1; ``new`` lists those that have no ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self) + 1
        return n


class Words:
    """Ids of words that were met, end to end. The first entry is the closing id."""

    def __init__(self, path: str, closing_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library, self.closing_id = Tokenizer.from_file(path), closing_id
        self.size = max(self.library.get_vocab_size(with_added_tokens=True), closing_id + 1)
        self.model = self.library.model
        self.symbols = {b: c for c, b in byte_symbols().items()}
        # Whether the library treats plain letters as ``_tokens`` does: lower case, byte by byte, signs apart.
        self.is_plain = all(
            [t.id for w in (letters.encode().decode("latin-1").translate(self.symbols), sign) for t in self.model.tokenize(w)]
            == self.library.encode(letters.upper() + sign, add_special_tokens=False).ids
            for letters, sign in [(chr(c) * 2 + "at", s) for c in [*range(97, 123), *range(224, 247), *range(248, 255)] for s in SIGNS])
        self.signs = {s: self._model(s) for s in SIGNS}
        self._forget()

    def _forget(self) -> None:
        self.known, self.letters = Numbered(), {}
        self.ids = np.array([self.closing_id], np.uint32)
        self.starts, self.sizes = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _learn(self) -> None:
        found = self._tokens([w.decode() for w in self.known.new])
        self.known.new = []
        sizes = np.array([len(f) for f in found], np.int64) // 4
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint32)])
        self.sizes = np.concatenate([self.sizes, sizes])

    def _model(self, letters: str) -> bytes:
        """Ids of lower-case letters or a sign, four bytes each: plain bytes are no burden for Python's garbage collection."""
        symbols = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def _tokens(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Plain letters, with or without one sign behind them, go to the library's model at once."""
        found, rest, known = [], [], self.letters
        for n, w in enumerate(words):
            plain = PLAIN.fullmatch(w.lower()) if self.is_plain else None
            if plain:
                letters, sign = plain.groups()
                ids = known.get(letters)
                if ids is None:
                    ids = known[letters] = self._model(letters)
                found.append(ids + self.signs[sign] if sign else ids)
            else:
                found.append(b"")
                rest.append(n)
        for n, e in zip(rest, self.library.encode_batch_fast([words[n] for n in rest], add_special_tokens=False)):
            found[n] = array("I", e.ids).tobytes()
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each closed, and how many each has."""
        if len(self.known) > HELD_WORDS or len(self.ids) > HELD_IDS:
            self._forget()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        words = split.flatten().dictionary_encode()
        # Only different words of these texts become Python objects; none holds a line feed. White space at an end leaves an empty word.
        listed = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary)
        spelled = pc.binary_join(listed, pa.scalar("\n", pa.large_string()))[0].as_buffer().to_pybytes().split(b"\n")[:len(words.dictionary)]
        at = np.fromiter(map(self.known.__getitem__, spelled), np.int64, len(spelled))[words.indices.to_numpy()]
        if self.known.new:
            self._learn()
        at = np.insert(at, np.cumsum(n_words), 0)
        sizes = self.sizes[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[at] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(n_words + 1)])])


_LOADED: dict[tuple[str, int], Words] = {}


def load(path: str, closing_id: int) -> Words:
    """The words of a vocabulary file, one store for each Python worker."""
    if (path, closing_id) not in _LOADED:
        _LOADED[path, closing_id] = Words(path, closing_id)
    return _LOADED[path, closing_id]


def number_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def write(docs: DataFrame, path: str, closing_id: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          block_ids: int = BLOCK_IDS, bytes_per_part: int = BYTES_PER_PART) -> str:
    """Write the files below ``out``, a new folder by default, and return it. ``path`` is the vocabulary file on every node."""
    spark = docs.sparkSession
    out = out or scratch_path(spark, "token-files")
    size = load(path, closing_id).size
    texts = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumns(
        {"n_bytes": F.octet_length("text").cast("bigint"), "place": F.monotonically_increasing_id()})
    total = texts.agg(F.sum("n_bytes")).first()[0] or 0
    parts = min(MAX_PARTS, max(1, -(-total // bytes_per_part)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_bytes"), F.col("place")]
    id_type = texts.schema["doc_id"].dataType.simpleString()
    fields = {"part": "int", "block": "int", "start": "long", "n_ids": "long", "first_doc": id_type, "last_doc": id_type,
              "doc_ids": f"array<{id_type}>", "doc_sizes": "array<long>", "base": "int", "width": "int", "rules": "binary",
              "lengths": "binary", "sequence": "binary"}

    def run(batches):
        words = load(path, closing_id)
        part, block, start, held, waiting = TaskContext.get().partitionId(), 0, 0, [], 0
        for docs, texts in text_chunks(batches, 1 << 22):
            ids, sizes = words.encode(texts)
            upto = 0
            for doc, n in zip(docs.column(0).to_pylist(), sizes.tolist()):
                if held and waiting + n > block_ids:
                    yield row(part, block, start, held)
                    block, start, held, waiting = block + 1, start + waiting, [], 0
                held.append((doc, n, ids[upto:upto + n]))
                upto += n
                waiting += n
        if held:
            yield row(part, block, start, held)

    def row(part, block, start, held):
        ids = np.concatenate([d[2] for d in held])
        g = compress(ids, size)
        kind = np.dtype(number_type(size + len(g.rules)))
        values = [part, block, start, len(ids), held[0][0], held[-1][0], [d[0] for d in held], [d[1] for d in held], size, kind.itemsize,
                  g.rules.astype(kind).tobytes(), g.lengths.astype("<i8").tobytes(), g.sequence.astype(kind).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], schema.field(k).type) for k, v in zip(fields, values)], schema=schema)

    ddl = ", ".join(f"{k} {t}" for k, t in fields.items())
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    texts.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(
        run, ddl).write.parquet(out)
    return out


def grammar_of(block: dict) -> Grammar:
    """The grammar in a row of the files."""
    kind = f"<u{block['width']}"
    return Grammar(block["base"], np.frombuffer(block["rules"], kind).astype(np.int64).reshape(-1, 2),
                   np.frombuffer(block["lengths"], "<i8"), np.frombuffer(block["sequence"], kind).astype(np.int64))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone."""
    blocks = spark.read.parquet(path)
    sums = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # at most MAX_PARTS
    order = sorted(sums)
    before = dict(zip(order, np.cumsum([0, *[sums[p] for p in order]]).tolist()))

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                block = batch.slice(n, 1)
                values = {k: block.column(k)[0].as_py() for k in block.schema.names if k != "doc_ids"}
                ids = grammar_of(values).decode().astype("<u4")
                sizes = np.array(values["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[e - s:e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_ids").flatten(), pa.array(before[values["part"]] + values["start"] + ends - sizes), pa.array(sizes),
                     pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.select("part", "start", "doc_ids", "doc_sizes", "base", "width", "rules", "lengths", "sequence").mapInArrow(
        run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id) -> list[np.ndarray]:
    """Ids of the documents with one id. Parquet skips other blocks, and of a block only that stretch is expanded."""
    found = []
    # Null ids come first, so a block may start with them.
    within = (F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id)) & (F.col("last_doc") >= doc_id)
    for r in spark.read.parquet(path).filter(within).orderBy("part", "block").collect():
        begin = 0
        for doc, size in zip(r["doc_ids"], r["doc_sizes"]):
            if doc == doc_id:
                found.append(grammar_of(r.asDict()).decode_range(begin, begin + size))
            begin += size
    return found

