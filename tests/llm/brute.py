"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def exact(rows):
    """(doc_id, keep_id, group_size, kept, sha256) of (doc_id, text)."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[lower(text)].append(doc)
    return [(doc, max(g := groups[lower(t)]), len(g), doc == max(g), hashlib.sha256(lower(t).encode()).hexdigest()) for doc, t in rows]


def fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    ones = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def components(rows, bits=3, n=3):
    """(doc_id, hex, component) of (doc_id, text)."""
    fps = [fingerprint(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                up[root(a)] = root(b)
    low = {}
    for k, (doc, _) in enumerate(rows):
        low[root(k)] = min(low.get(root(k), doc), doc)
    return [(doc, f"{fps[k]:016x}", low[root(k)]) for k, (doc, _) in enumerate(rows)]


KINDS = ["email", "ip", "card", "phone"]


def luhn(s):
    digits = [int(c) for c in reversed(s) if c.isdigit()]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0


def personal(text):
    """Base spans (kind, start, end), in order."""
    text, out = text or "", []
    n = lambda s: sum(c in "0123456789" for c in s)
    for kind, pattern, good in (
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (2, r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= n(s) <= 19 and luhn(s)),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= n(s) <= 15),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def base_digest(text):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in personal(text)).encode()).hexdigest()


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licence(text):
    """n_words, n_base, first, last, base labels."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def repeats(rows, size=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256 of the rest) of (doc_id, text)."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            w = b[k : k + size]
            if w in seen:
                gone[k : k + size] = b"\x01" * size
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[doc] = (doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return [out[doc] for doc, _ in rows]
