"""Plain Python versions of operators that SQL cannot express."""

import hashlib
import math
import re
from collections import Counter

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text, classes, allow):
    text = text or ""
    out = {"assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6],
           "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
           "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]}
    high = set()
    for alphabet, window, bits in classes:
        for m in re.finditer("[" + re.escape(alphabet) + "]+", text):
            run = m[0]
            if len(run) < window or not re.search("[0-9]", run) or not re.search("[A-Za-z]", run) or any(re.search(p, run) for p in allow):
                continue
            hot = []
            for i in range(len(run) - window + 1):
                n = Counter(run[i:i + window])
                if -sum(v / window * math.log2(v / window) for v in n.values()) >= bits - 1e-9:
                    hot.append(i)
            if hot:
                high.add((m.start() + hot[0], m.start() + hot[-1] + window))
    out["entropy"] = sorted(high)
    return out


def listed(found, kinds):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted((s, n, e, k) for n, k in enumerate(kinds) for s, e in found[k]))


def secret_row(doc_id, text, classes, allow):
    f, kinds = secrets(text, classes, allow), ["assign", "access", "hex"]
    return (doc_id, *[len(f[k]) for k in kinds], hashlib.sha256(listed(f, kinds).encode()).hexdigest(), listed(f, [*kinds, "entropy"]))


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def cover(text, words, n):
    """Flags of the words in n-word windows found twice or more."""
    at = [" ".join(w[0] for w in words[i:i + n]) for i in range(len(words) - n + 1)]
    seen, inside = Counter(at), [False] * len(words)
    for i, k in enumerate(at):
        if seen[k] > 1:
            inside[i:i + n] = [True] * n
    return inside


def quality_row(doc_id, text, ngrams, max_line_share):
    text = text or ""
    words = list(WORDS.finditer(text))
    chars = sum(len(w[0]) for w in words)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    seen = Counter(lines)
    repeat = sum(cover(text, words, 8))
    lines_cover = sum(len("".join(WORDS.findall(x))) for x in lines if seen[x] > 1)
    covers = {n: sum(len(w[0]) for w, c in zip(words, cover(text, words, n)) if c) for n in ngrams}
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    kept = not failed and lines_cover <= max_line_share * chars and all(covers[n] <= m * chars for n, m in ngrams.items())
    return (doc_id, len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(seen), repeat, lines_cover,
            *covers.values(), failed, kept)

