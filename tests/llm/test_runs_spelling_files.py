"""Periodic runs, spelling variants and token files against plain versions, with odd and empty input."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from catalign.llm import periodic, queries, spelling, token_files
from catalign.llm.repair_grammar import compress
from catalign.llm.text_scan import Scan
from odd import ODD

WORD_BPE, BYTE_BPE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            begin = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - begin + q >= max(24, 3 * q):
                found.setdefault((begin - q, i - begin + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, *(hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_runs_of_generated_words():
    rng = random.Random(11)
    for _ in range(150):
        texts = []
        for _ in range(4):
            n, letters = rng.choice([0, 5, 24, 60, 200, 400]), rng.choice([1, 2, 3, 10])
            words = [str(rng.randrange(letters)) for _ in range(n)]
            for _ in range(rng.randrange(4) if n >= 24 else 0):
                s, p = rng.randrange(n - 10), rng.randrange(1, n // 3 + 1)
                for i in range(s + p, rng.randrange(s + 5, n + 1)):
                    words[i] = words[i - p]
            texts.append(words)
        scan = Scan([" ".join(t) for t in texts])
        first, found = np.cumsum(scan.n_words) - scan.n_words, [[] for _ in texts]
        for s, n, q in periodic.diagonal_runs(scan).tolist():
            owner = scan.owner[s]
            found[owner].append((s - first[owner], n, q))
        assert found == [plain_runs(t) for t in texts]


def test_one_word_repeated_takes_few_steps():
    scan = Scan(["a " * 100_000, "b c " * 50_000])
    assert sum(len(at) for _, at, _ in periodic.earlier_occurrences(scan)) < 250_000
    assert periodic.diagonal_runs(scan).tolist() == [[0, 100_000, 1], [100_000, 100_000, 2]]


def test_periodic_runs_query(spark, small, monkeypatch, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, small, "documents").collect()]
    found = rows_of(queries.periodic_runs(spark, small))
    assert found == sorted((plain_row(*d) for d in docs), key=str) and sum(r[1] for r in found) > 10
    monkeypatch.setattr(queries, "table", lambda *_: odd_docs.unionByName(odd_docs.selectExpr(
        "CAST(NULL AS long) AS doc_id", *[f"`{c}`" for c in odd_docs.columns[1:]])))
    want = sorted([plain_row(n, t) for n, t in enumerate(ODD + ODD)], key=str)
    got = queries.periodic_runs(spark, "").collect()
    assert sorted((tuple(r) for r in got if r["doc_id"] is not None), key=str) == want and len(got) == 2 * len(want)
    monkeypatch.setattr(queries, "table", lambda *_: no_docs)
    assert queries.periodic_runs(spark, "").count() == 0


def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    letters, near, form = {c for w in n for c in w}, {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = [x for x in edits - {w} if x in n]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


TYPOS = " ".join(w for w, k in {
    "harbour": 40, "harbor": 18, "harbur": 8, "harbuur": 3, "harboor": 18, "aaaaa": 9, "aaaaaa": 4, "Éclair": 3, "éclair": 9, "cafés": 3,
    "caféß": 7, "colour": 2, "x" * 3000: 3, "x" * 2999: 6, "×÷×÷×": 3}.items() for _ in range(k))


@pytest.mark.parametrize("max_blocks", [spelling.MAX_BLOCKS, 40])
def test_spelling_variants(spark, small, odd_docs, no_docs, max_blocks):
    docs = queries.table(spark, small, "documents").select("doc_id", "text")
    frame = docs.unionByName(odd_docs.select("doc_id", "text")).unionByName(
        spark.createDataFrame([(None, TYPOS), (None, None), (7, "")], "doc_id long, text string"))
    found = rows_of(spelling.variants(spelling.count_words(frame, change=spelling.drop_letter), max_blocks=max_blocks))
    want = plain_variants([tuple(r) for r in frame.collect()])
    assert found == want and sum(r[1] is not None for r in want) > 20
    assert any(r[0] == "harbuur" and r[2] == "harbour" for r in want)
    assert spelling.variants(spelling.count_words(no_docs)).count() == 0


def test_false_hits_are_few(spark):
    rng = random.Random(12)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(5000)})
    vocabulary = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    shape = spelling.Filter({12: len(words)})
    sent = spark.sparkContext.broadcast(spelling.build(vocabulary, shape, 0, shape.total))
    alphabet = np.arange(97, 123, dtype=np.uint32)
    # 12 deletions and 150 later letters a word are probed; next to none is a word.
    assert spelling.hits(vocabulary, alphabet, shape, 0, shape.total, sent).count() < len(words) / 20
    # Each word passes itself.
    letters = spelling.Letters(words)
    block = shape.block_of(letters.hash, letters.length)
    for turn in range(spelling.HASHES):
        bit = block * 512 + spelling.Filter.bits(letters.hash, turn)
        assert (sent.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).all()


def test_grammar_round_trip_and_ranges():
    rng = random.Random(13)
    for n in (0, 1, 2, 60, 5000):
        for letters in (1, 2, 5, 200):
            ids = np.array([rng.randrange(letters) for _ in range(n)], np.int64)
            g = compress(ids, letters, 3)
            assert g.decode().tolist() == ids.tolist() and g.sizes().sum() == n
            for _ in range(6):
                begin = rng.randrange(n + 1)
                end = rng.randrange(begin, n + 1)
                assert g.decode_range(begin, end).tolist() == ids[begin:end].tolist()
    g = compress(np.tile(np.arange(40), 500), 40)
    assert len(g.sequence) + 2 * len(g.rules) < 400  # of 20,000


def plain_files(docs, path, closing_id):
    library, start, out = Tokenizer.from_file(path), 0, []
    coded = [(d, len((t or "").encode()), library.encode(t or "", add_special_tokens=False).ids + [closing_id]) for d, t in docs]
    for d, _, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("size", [token_files.BLOCK_IDS, 700])
def test_token_files(spark, small, odd_docs, no_docs, tmp_path, size):
    docs = queries.table(spark, small, "documents").select("doc_id", "text").unionByName(
        odd_docs.selectExpr("doc_id + 1000000 AS doc_id", "text")).unionByName(
        spark.createDataFrame([(None, "no id"), (None, "no id, longer")], "doc_id long, text string"))
    path = token_files.write(docs, WORD_BPE, 1, block_ids=size, bytes_per_part=size * 100)
    want = plain_files([tuple(r) for r in docs.collect()], WORD_BPE, 1)
    assert rows_of(token_files.read(spark, path)) == sorted(want, key=str)
    one = want[len(want) // 2]
    ids, = token_files.read_document(spark, path, one[0])
    assert len(ids) == one[2] and zlib.crc32(ids.astype("<u4").tobytes()) == one[3]
    assert token_files.read(spark, token_files.write(no_docs, WORD_BPE, 1)).count() == 0


def test_token_files_of_repeated_rows(spark):
    docs = spark.createDataFrame([(5, "same text here")] * 300 + [(5, "other"), (4, None)], "doc_id long, text string")
    path = token_files.write(docs, WORD_BPE, 1, block_ids=64, bytes_per_part=700)
    assert rows_of(token_files.read(spark, path)) == sorted(plain_files([tuple(r) for r in docs.collect()], WORD_BPE, 1), key=str)
    assert spark.read.parquet(path).select("part").distinct().count() > 2


def test_words_equal_library():
    words = token_files.Words(WORD_BPE, 1)
    assert words.is_plain
    texts = [t or "" for t in ODD] + ["Naïve CAFÉ, straße. ÀÉÎõü; x×y÷z a.b,c don't! I'LL été? <|endoftext|>end   \u0085\x1cx"]
    for _ in range(2):
        ids, sizes = words.encode(texts)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for n, t in enumerate(texts):
            assert ids[at[n]:at[n + 1]].tolist() == words.library.encode(t, add_special_tokens=False).ids + [1]
