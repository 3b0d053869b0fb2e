"""A byte-pair tokenizer compiled into a deterministic transducer.

Two machines in a row. The first marks where pre-tokens start; it is a function
of the classes of neighbouring characters and runs over whole arrays. The second
reads the bytes of a pre-token and writes tokens.

State of the second machine. The last token of the encoding of each prefix of a
word is unique, and it fits the last token of the prefix it leaves over: merges
left of a boundary do not depend on what follows, and a row of tokens is an
encoding exactly if each neighbouring pair is one. So the next last token follows
from the last tokens at those earlier positions from which some token of the
vocabulary may still reach beyond the current byte. A state is the longest suffix
read that is a proper prefix of a token, with the last token and the relative
count at each such position. The smallest count among them is settled whatever
comes next; the amount by which it rises is written on the transition. A state
also holds how the count changes if the word ends there; with word-end tokens this
may take back some of what is settled for longer words.

States and transitions are made when first met. Texts are read in segments that
end at a pre-token; when the table is full it is dropped and grown again between
two of them. So memory is bounded by a segment, or by the longest pre-token.

Running. Bytes are cut into chunks of one length that advance side by side, one
table lookup per byte. A pre-token start resets the machine, so the map of a chunk
with a start, from entry state to exit state, is constant. The map of a chunk
without one is a table of entries and exits, held for live entries only: the state
the machine would enter in if it had started at the chunk before, the exits of that
chunk's own table, and entries found true at an earlier chunk of the same word. All tables grow side by side. They are composed by a
parallel prefix scan: each row points at the row of the next chunk whose entry is
its exit, and pointers are doubled until all rows are known that a constant chunk
leads to. A state depends on few bytes read, so entries agree after a few rounds;
a round resolves at least one more chunk of each row of chunks in any case. Last,
all heads are run from their entries at once.
"""

from __future__ import annotations

import json
import math
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

LETTER, NUMBER, OTHER, SPACE, TAIL = 1, 2, 3, 4, 5
DEAD, START = 0, 1
#: Letters that follow an apostrophe as a pre-token of their own.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
CHUNK = 256
#: Live entries of a chunk, on average; beyond, maps grow at the known entries only.
LIVE = 64
#: Bytes of a segment, after which the table of states may be dropped.
SEGMENT = 1 << 22
BEYOND = re.compile("[^\x00-\u02ff]")
MAX_STATES = 1 << 19


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Transducer:
    def __init__(self, path: str, max_states: int = MAX_STATES):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.end = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()

        def parts(token: str) -> tuple[bytes, bool]:
            ends = bool(self.end) and token.endswith(self.end)
            return bytes(symbols[c] for c in (token[:-len(self.end)] if ends else token)), ends

        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        vocab = model["vocab"]
        single = {t for t in vocab if len(parts(t)[0]) == 1}
        # Rank and halves of every token that merges make; a single byte has neither.
        self.rank, self.halves, self.made = {}, {}, dict.fromkeys((vocab[t] for t in single), -1)
        for n, (left, right) in enumerate(merges):
            token = vocab[left + right]
            self.rank[vocab[left], vocab[right]] = n
            if token not in self.made:
                self.made[token], self.halves[token] = n, (vocab[left], vocab[right])
        self.ids = {parts(t): i for t, i in vocab.items() if i in self.made}
        self.length = np.zeros(max(vocab.values()) + 1, np.int32)
        for (text, _), i in self.ids.items():
            self.length[i] = len(text)
        self.prefixes = {t[:n] for t, _ in self.ids for n in range(len(t))}
        self.whole = {}
        self.max_states = max_states
        normalizer = self.library.normalizer
        # Below U+0300 composition changes nothing; whether the rest is lower case only is tried out.
        white = re.compile(r"[\t-\r \x85\xa0]")
        self.lowers = normalizer is not None and all(
            normalizer.normalize_str(chr(c)) == white.sub(" ", chr(c).lower()) for c in range(0x300))
        self.classes = np.zeros(0x110000, np.uint8)
        self.reset()

    # The second machine.

    def reset(self) -> None:
        self.slots = 1 << 16
        self.keys = np.full(self.slots, -1, np.int64)
        self.values = np.zeros(self.slots, np.int32)
        self.used = 0
        self.states = {}
        self.info = [b"", array("i", (0, -1, 0)).tobytes()]
        self.closing, self.last = np.zeros(1 << 12, np.int16), np.zeros(1 << 12, np.int32)
        self._add(np.arange(256), np.zeros(256, np.int32))  # dead bytes lead to the dead state

    def _joins(self, a: int, b: int, until_a: float, until_b: float) -> bool:
        """Whether some merge crosses the boundary of two neighbours that merge on, left and right, at these ranks.

        Ranks grow along a derivation. Going back in time, the younger neighbour
        is taken apart, until both are bytes. Of equal merges the left one is made
        first.
        """
        rank, made, halves = self.rank.get, self.made, self.halves
        while True:
            r = rank((a, b))
            if r is not None and r < until_a and r <= until_b:
                return True
            if made[a] > made[b]:
                until_a, a = made[a], halves[a][1]
            elif made[b] >= 0:
                until_b, b = made[b], halves[b][0]
            else:
                return False

    def _is_whole(self, token: int) -> bool:
        """Whether the token's text is encoded as this one token."""
        known = self.whole.get(token)
        if known is None:
            known = True
            if token in self.halves:
                a, b = self.halves[token]
                n = self.made[token]
                # The merge that makes the token is the only one that may cross its middle.
                known = self._is_whole(a) and self._is_whole(b) and not self._joins(a, b, n, n - 1)
            self.whole[token] = known
        return known

    def _last(self, text: bytes, open_at: list, ends: bool) -> tuple[int, int]:
        """Last token of a word that reads ``text`` behind the earliest open position, and the count with it."""
        size = len(text) - 1
        for k in range(0, len(open_at), 3):
            token = self.ids.get((text[size - open_at[k]:], ends))
            if token is not None and self._is_whole(token) and (
                    open_at[k + 1] < 0 or not self._joins(open_at[k + 1], token, math.inf, math.inf)):
                return token, open_at[k + 2] + 1
        raise AssertionError("no token fits")

    def _step(self, state: int, byte: int) -> int:
        """Make the transition; returns next state and emitted count, packed.

        A state is written as the open positions (bytes read since, token before,
        relative count), the bytes since the earliest, how many positions there are
        less one, and what closes the word.
        """
        written = self.info[state]
        open_at = array("i")
        size = 12 * (1 + written[-2]) if state != START else 12
        open_at.frombytes(written[:size])
        text = (written[size:-2] if state != START else b"") + bytes((byte,))
        token, count = self._last(text, open_at, False)
        closing = self._last(text, open_at, True)[1] if self.end else count
        ahead = array("i")
        for k in range(0, len(open_at), 3):  # Those from which a token may still reach further.
            if text[len(text) - 1 - open_at[k]:] in self.prefixes:
                ahead.extend((open_at[k] + 1, open_at[k + 1], open_at[k + 2]))
        ahead.extend((0, token, count))
        settled = min(ahead[2::3])
        for k in range(2, len(ahead), 3):
            ahead[k] -= settled
        key = ahead.tobytes() + text[len(text) - ahead[0]:] + bytes((len(ahead) // 3 - 1, closing - settled + 128))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.info)
            self.info.append(key)
            if to >= len(self.last):
                self.closing = np.concatenate([self.closing, np.zeros_like(self.closing)])
                self.last = np.concatenate([self.last, np.zeros_like(self.last)])
            self.closing[to], self.last[to] = closing - settled, token
        return to << 8 | settled

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(0x9E3779B97F4A7C1)) >> np.int64(20) & np.int64(self.slots - 1)

    def _add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Enter new transitions into the open-addressing table."""
        if (self.used + len(keys)) * 2 > self.slots:
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            while len(keys) * 2 > self.slots:
                self.slots *= 2
            self.keys, self.values, self.used = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32), 0
        self.used += len(keys)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            # Of several that want one free slot the last written gets it.
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            lost = self.keys[at] != keys
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) & (self.slots - 1)

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """Packed results of transitions (state << 8 | byte); made where they are new."""
        at = self._slot(keys)
        out = self.values.take(at).astype(np.int64)
        off = np.flatnonzero(self.keys.take(at) != keys)
        while len(off):
            want, here = keys[off], at[off]
            seen = self.keys[here]
            out[off] = self.values[here]
            if (seen < 0).any():
                unknown = np.unique(want[seen < 0])
                self._add(unknown, np.array([self._step(n >> 8, n & 255) for n in unknown.tolist()], np.int32))
                return self._look_up(keys)
            miss = seen != want
            off = off[miss]
            at[off] = (at[off] + 1) & (self.slots - 1)
        return out

    def _run(self, data: np.ndarray, starts: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Advance all columns; returns packed (state, emitted) after each byte."""
        out = np.empty(data.shape, np.int32)
        packed = entry.astype(np.int64) << 8
        for k in range(len(data)):
            np.putmask(packed, starts[k], START << 8)
            packed = self._look_up((packed & -256) | data[k])
            out[k] = packed
        return out

    def _last_states(self, columns: np.ndarray, chunk: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """State after all bytes of each chunk without a start; nothing is held for the bytes between."""
        packed = entry << 8
        for row in columns:
            packed = self._look_up((packed & -256) | row.take(chunk))
        return packed >> 8

    def _exits(self, columns: np.ndarray, marked: np.ndarray, exits: np.ndarray) -> np.ndarray:
        """Exit states of all chunks. ``exits`` holds those of chunks with a start; the others are scanned for."""
        exits = exits.copy()
        opened = ~marked.any(0)
        chunk = np.flatnonzero(opened)
        if not len(chunk):
            return exits
        sure = ~opened[chunk - 1]
        entry = np.where(sure, exits[chunk - 1], START).astype(np.int64)
        # Rows of all maps, by chunk and entry, and where the true entries are known from the start.
        wanted, heads = chunk << 32 | entry, (chunk << 32 | entry)[sure]
        rows, leads = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.flatnonzero(~np.concatenate([opened, [False]]))
        while True:
            new = self._last_states(columns, wanted >> 32, wanted & 0xFFFFFFFF)
            rows, leads = np.concatenate([rows, wanted]), np.concatenate([leads, new])
            order = np.argsort(rows)
            rows, leads = rows[order], leads[order]
            ahead = ((rows >> 32) + 1) << 32 | leads
            inside = np.concatenate([opened, [False]])[(rows >> 32) + 1]
            at = np.minimum(np.searchsorted(rows, ahead), len(rows) - 1)
            met = inside & (rows[at] == ahead)
            # Composition by doubling; a row without a next one points at itself.
            jump, true = np.where(met, at, np.arange(len(rows))), np.zeros(len(rows), bool)
            true[np.searchsorted(rows, heads)] = True
            for _ in range(len(chunk).bit_length()):
                true[jump[true]] = True
                jump = jump[jump]
            exits[rows[true] >> 32] = leads[true]
            if true.sum() == len(chunk):
                return exits
            done = np.zeros(len(opened) + 1, bool)
            done[rows[true] >> 32] = True
            missing = inside & ~met & ~done[(rows >> 32) + 1]
            wanted = np.unique(ahead[missing])
            # Where the true entry is one that no chunk guessed, as in periodic words, all chunks behind it try it.
            front = ahead[missing & true]
            span = ends[np.searchsorted(ends, front >> 32)] - (front >> 32)
            if len(rows) + len(wanted) + span.sum() <= LIVE * len(chunk):
                shift = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
                tried = np.unique(np.concatenate([wanted, np.repeat(front, span) + (shift << 32)]))
                wanted = tried[rows[np.minimum(np.searchsorted(rows, tried), len(rows) - 1)] != tried]
            else:
                wanted = np.unique(front)

    def _read(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Packed (state, emitted) after each byte of an array whose first byte starts a pre-token."""
        n = len(data)
        chunks = -(-n // CHUNK)
        wide = np.zeros(chunks * CHUNK, np.int32)
        wide[:n] = data
        marks = np.zeros(chunks * CHUNK, bool)
        marks[:n] = starts
        marks[n:] = True
        columns, marked = np.ascontiguousarray(wide.reshape(chunks, CHUNK).T), np.ascontiguousarray(marks.reshape(chunks, CHUNK).T)
        out = self._run(columns, marked, np.zeros(chunks, np.int32))
        # Heads: bytes before the first start of a chunk, run from the exit of the chunk before.
        head = np.where(marked.any(0), marked.argmax(0), CHUNK)
        now = np.flatnonzero(head > 0)
        if len(now):
            entry = self._exits(columns, marked, out[-1] >> 8)[now - 1]
            size = int(head[now].max())
            stop = np.arange(size)[:, None] >= head[now]
            part = self._run(columns[:size, now], np.zeros((size, len(now)), bool), entry)
            out[:size, now] = np.where(stop, out[:size, now], part)
        return out.T.ravel()[:n]

    def read(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """After each byte: count emitted, count that closes the word here, last token. The first byte starts a pre-token."""
        n, begin = len(data), 0
        emitted, closing, last = np.empty(n, np.uint8), np.empty(n, np.int16), np.empty(n, np.int32)
        while begin < n:
            if len(self.info) > self.max_states:
                self.reset()
            end = begin + SEGMENT
            if end < n:
                back = np.flatnonzero(starts[begin + 1:end + 1])
                after = starts[end:].argmax() if not len(back) else 0
                end = begin + 1 + int(back[-1]) if len(back) else end + int(after) if starts[end + after] else n
            packed = self._read(data[begin:end], starts[begin:end])
            state = packed >> 8
            emitted[begin:end], closing[begin:end], last[begin:end] = packed & 255, self.closing[state], self.last[state]
            begin = end
        return emitted, closing, last

    # Normalisation and the first machine.

    def normal(self, text: str) -> bytes:
        """The text as the library normalises it; white space is kept as it is where it gets dropped anyway."""
        if self.library.normalizer is None:
            return text.encode()
        if self.lowers and not BEYOND.search(text):
            return text.lower().encode()
        return self.library.normalizer.normalize_str(text).encode()

    def class_of(self, code: int) -> int:
        """Class of a character as the library's own pre-tokenizer sees it."""
        whole = lambda t: [o for _, o in self.library.pre_tokenizer.pre_tokenize_str(t)] == [(0, 2)]
        c = chr(code)
        if whole("a" + c):
            return LETTER
        if whole("!" + c):
            return OTHER
        if whole("1" + c) or (self.end and self.library.pre_tokenizer.pre_tokenize_str(c)):
            return NUMBER
        return SPACE

    def classify(self, data: np.ndarray) -> np.ndarray:
        """Class of the character that starts at each byte; TAIL inside one."""
        if not self.classes[32]:
            for code in range(128):
                self.classes[code] = self.class_of(code)
        out = self.classes[data]
        out[(data & 0xC0) == 0x80] = TAIL
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b = data.astype(np.int32)
            at = lambda k: b[np.minimum(lead + k, len(b) - 1)] & 63
            first = b[lead]
            code = np.where(first < 0xE0, (first & 31) << 6 | at(1), np.where(
                first < 0xF0, (first & 15) << 12 | at(1) << 6 | at(2), (first & 7) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
            kinds = self.classes[code]
            if not kinds.all():
                for new in np.unique(code[kinds == 0]).tolist():
                    self.classes[new] = self.class_of(new)
                kinds = self.classes[code]
            out[lead] = kinds
        return out

    def starts(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens start, and the class of each byte's character. ``texts``: first byte of each text."""
        kind = self.classify(data)
        # Class of the character before: carried over the tails of longer characters.
        chars = np.flatnonzero(kind != TAIL)
        k = kind[chars]
        first = np.zeros(len(data), bool)
        first[texts[texts < len(data)]] = True
        first = first[chars]
        prev = np.concatenate([k[:1], k[:-1]])  # all arrays here have one byte an entry
        prev[first] = 0
        blank = data[chars] == 32
        blank_before = np.concatenate([[False], blank[:-1]]) & ~first
        nxt_first = np.concatenate([first[1:], [True]])
        nxt = np.where(nxt_first, np.uint8(SPACE), np.concatenate([k[1:], k[:1]]))
        mark = k != prev
        if self.end:  # White space is dropped, numbers stand alone.
            mark |= k == NUMBER
            quote_starts = prev != OTHER
        else:  # A blank joins what follows; the last white space before text stands alone.
            mark &= ~(blank_before & (k != SPACE))
            mark |= (k == SPACE) & (prev == SPACE) & (nxt != SPACE)
            quote_starts = (prev != OTHER) & ~blank_before
        mark[first] = True
        quotes = np.flatnonzero((data[chars] == 39) & quote_starts)
        if len(quotes):
            same = np.concatenate([first, [True] * 3])
            raw = np.concatenate([data[chars], np.zeros(3, np.uint8)])
            for tail in CONTRACTIONS:
                hit = quotes
                for j, c in enumerate(tail, 1):
                    hit = hit[(raw[hit + j] == c) & ~same[hit + j]]
                mark[hit] = True
                for j in range(1, len(tail) + 1):
                    mark[hit + j] = False
                after = hit + len(tail) + 1
                mark[after[after < len(mark)]] = True
        out = np.zeros(len(data), bool)
        out[chars] = mark
        if self.end:
            dropped = (k == SPACE)[np.cumsum(kind != TAIL) - 1]
            return out | dropped, dropped
        return out, np.zeros(len(data), bool)

    def read_texts(self, texts: list[bytes]):
        """Run over texts laid end to end: offsets of the texts, what ``read`` gives, ends of pre-tokens, dropped bytes."""
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            none = np.zeros(0, bool)
            return offsets, (np.zeros(0, np.int32),) * 3, none, none
        starts, dropped = self.starts(data, offsets[:-1])
        return offsets, self.read(data, starts), np.concatenate([starts[1:], [True]]) & ~dropped, dropped

    def pieces(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, list[list[int]]]:
        """Normalised texts cut at special strings, how many pieces each text has, and the special tokens between."""
        cut = [self.special.split(t) if self.specials and self.special.search(t) else [t] for t in texts]
        return ([self.normal(p) for c in cut for p in c[::2]], np.array([(len(c) + 1) // 2 for c in cut], np.int64),
                [[self.specials[p] for p in c[1::2]] for c in cut])

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text: what transitions emit, what closes each pre-token, and special strings."""
        pieces, per_text, special = self.pieces(texts)
        held = np.concatenate([[0], np.cumsum(self.piece_counts(pieces))])
        last = np.cumsum(per_text)
        return held[last] - held[last - per_text] + np.array([len(x) for x in special], np.int64)

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        pieces, per_text, special = self.pieces(texts)
        ids, at = self.encode(pieces)
        out, k = [], 0
        for n, between in zip(per_text.tolist(), special):
            if n == 1:
                out.append(ids[at[k]:at[k + 1]])
            else:
                parts = [ids[at[k]:at[k + 1]]]
                for j, token in enumerate(between, k + 1):
                    parts += [np.array([token], np.int32), ids[at[j]:at[j + 1]]]
                out.append(np.concatenate(parts))
            k += n
        return out

    def piece_counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each normalised text without special strings."""
        offsets, (emitted, closing, _), ends, dropped = self.read_texts(texts)
        emitted = np.where(dropped, 0, emitted.astype(np.int64)) + np.where(ends, closing, 0)
        total = np.concatenate([[0], np.cumsum(emitted, dtype=np.int64)])
        return np.diff(total[offsets])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and where each text's ids begin (vocabularies without word-end tokens)."""
        offsets, (_, _, last), ends, _ = self.read_texts(texts)
        tokens = np.full(len(last), -1, np.int32)
        begin = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if len(last) else np.zeros(0, np.int64)
        at = np.flatnonzero(ends)
        while len(at):  # From the end of every pre-token back by its last token.
            token = last[at]
            tokens[at] = token
            at = at - self.length[token]
            more = at >= begin
            at, begin = at[more], begin[more]
        held = np.concatenate([[0], np.cumsum(tokens >= 0)])
        return tokens[tokens >= 0], held[offsets]


_LOADED: dict[str, Transducer] = {}


def load(path: str) -> Transducer:
    """The transducer of a vocabulary file, one for each Python worker, with the states it has grown."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]
