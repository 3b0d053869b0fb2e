"""Re-Pair: frequent pairs of neighbouring ids become nonterminals, over and over, until no pair is frequent.

A round counts all pairs, takes those at least an eighth as frequent as the most frequent one,
gives each a nonterminal, and replaces its occurrences from left to right. Where
occurrences of two pairs overlap, the more frequent pair wins and the other waits for a
later round. A grammar is

* ``rules``: two symbols for each nonterminal, both older than it,
* ``lengths``: how many ids each nonterminal expands to,
* ``sequence``: what is left of the ids.

Symbols below ``base`` are ids, ``base + n`` is the n-th nonterminal. The lengths say where
in the sequence a given place of the ids is, so any stretch is decoded without the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A pair is replaced if it occurs so often.
MIN_COUNT = 24
#: A round replaces pairs at least one so-manieth as frequent as the most frequent.
SHARE = 8


@dataclass
class Grammar:
    base: int
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray

    def sizes(self) -> np.ndarray:
        """How many ids each symbol of the sequence stands for."""
        return self._sizes(self.sequence)

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        made = symbols >= self.base
        out[made] = self.lengths[symbols[made] - self.base]
        return out

    def _expanded_rules(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all nonterminals end to end, and where each starts. Rules of one round are expanded together."""
        start = np.cumsum(self.lengths) - self.lengths
        held = np.zeros(int(self.lengths.sum()), np.int64)
        newest = self.rules.max(axis=1, initial=0) - self.base
        done = 0
        while done < len(self.rules):
            later = np.flatnonzero(newest[done:] >= done)
            upto = done + int(later[0]) if len(later) else len(self.rules)
            ids = self._expand(self.rules[done:upto].ravel(), held, start)
            held[start[done]:start[done] + len(ids)] = ids
            done = upto
        return held, start

    def _expand(self, symbols: np.ndarray, held: np.ndarray, start: np.ndarray) -> np.ndarray:
        sizes = self._sizes(symbols)
        made = symbols >= self.base
        out = np.repeat(symbols, sizes)
        n = sizes[made]
        at = np.repeat(start[symbols[made] - self.base] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.repeat(made, sizes)] = held[at]
        return out

    def decode(self) -> np.ndarray:
        return self._expand(self.sequence, *self._expanded_rules())

    def decode_range(self, begin: int, end: int) -> np.ndarray:
        """The ids from begin to end; only the symbols that hold them, and what these are made of, are expanded."""
        upto = np.cumsum(self.sizes())
        end = min(end, int(upto[-1]) if len(upto) else 0)
        if begin >= end:
            return np.zeros(0, np.int64)
        first, last = np.searchsorted(upto, [begin, end - 1], side="right")
        symbols = self.sequence[first:last + 1]
        while (made := symbols >= self.base).any():
            wide = np.repeat(symbols, np.where(made, 2, 1))
            at = np.cumsum(np.where(made, 2, 1))[made]
            pairs = self.rules[symbols[made] - self.base]
            wide[at - 2], wide[at - 1] = pairs[:, 0], pairs[:, 1]
            symbols = wide
        before = int(upto[first - 1]) if first else 0
        return symbols[begin - before:end - before]


def _occurrences(at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to replace, with their ranks: of overlapping pairs the one of lower rank, of a pair that overlaps itself every other one."""
    beside = at[1:] == at[:-1] + 1
    edge = np.flatnonzero(np.concatenate([[True], ~beside | (rank[1:] != rank[:-1])])[:len(at)])
    size = np.diff(np.concatenate([edge, [len(at)]]))
    value = rank[edge]
    touches = beside[edge[1:] - 1]
    wins = np.ones(len(edge), bool)
    wins[1:] &= ~touches | (value[1:] < value[:-1])
    wins[:-1] &= ~touches | (value[:-1] < value[1:])
    n = (size[wins] + 1) // 2
    place = np.repeat(at[edge[wins]], n) + 2 * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return place, np.repeat(value[wins], n)


def compress(ids: np.ndarray, base: int, min_count: int = MIN_COUNT) -> Grammar:
    """The grammar of ids below ``base``."""
    seq, rules, lengths, made = ids.astype(np.uint32), [], [], 0
    while len(seq) > 1:
        # Pairs as numbers of 32 bits, as long as 16 hold a symbol.
        kind, shift = (np.uint32, 16) if base + made <= 1 << 16 else (np.uint64, 32)
        key = seq[:-1].astype(kind) << kind(shift) | seq[1:]
        held = np.sort(key)
        edge = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        count = np.diff(np.concatenate([edge, [len(held)]]))
        top = int(count.max())
        if top < min_count:
            break
        often = count >= max(min_count, -(-top // SHARE))
        pairs, count = held[edge[often]], count[often]
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(pairs), np.int64)
        place[order] = np.arange(len(pairs))
        # Both letters must occur in a chosen pair, which most pairs fail; the rest are looked up.
        left, right = np.zeros(base + made, bool), np.zeros(base + made, bool)
        first, second = pairs >> kind(shift), pairs & kind((1 << shift) - 1)
        left[first] = right[second] = True
        maybe = np.flatnonzero(left.take(seq[:-1]) & right.take(seq[1:]))
        key = key[maybe]
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        hit = pairs[at] == key
        where, rank = _occurrences(maybe[hit], place[at[hit]])
        used = np.flatnonzero(np.bincount(rank, minlength=len(pairs)) > 1)
        symbol = np.full(len(pairs), -1)
        symbol[used] = base + made + np.arange(len(used))
        symbol = symbol[rank]
        where, symbol = where[symbol >= 0], symbol[symbol >= 0]
        new = np.stack([first[order[used]], second[order[used]]], axis=1).astype(np.int64)
        known = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        lengths.append(np.where(new < base, 1, known[np.maximum(new - base, 0)] if made else 1).sum(axis=1))
        rules.append(new)
        made += len(used)
        seq[where] = symbol
        stays = np.ones(len(seq), bool)
        stays[where + 1] = False
        seq = seq[stays]
    return Grammar(base, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64),
                   np.concatenate(lengths) if lengths else np.zeros(0, np.int64), seq.astype(np.int64))
