"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=5, lower=lambda t: t.translate(LOWER)):
    w = words(lower(text or ""))
    if len(w) >= size:
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    return {tuple(w)} if w else set()


def components(docs, num=85, den=100):
    """doc_id -> (set size, smallest doc_id reachable), by all pairs that
    share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held = {}
    for i in sorted(sets):
        met = Counter()
        for s in sets[i]:
            met.update(held.get(s, ()))
            held.setdefault(s, []).append(i)
        for j, both in met.items():
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


SECRET = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def written(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def digest(spans, kinds):
    return hashlib.sha256(written(spans, kinds).encode()).hexdigest()


def secret_spans(text):
    found = [(m.start(), 0, m.end()) for m in SECRET.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def pii_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return found


def mask(text):
    if text is None:
        return None
    out, at = [], 0
    for a, k, b in sorted(pii_spans(text)):
        if a >= at:
            out += [text[at:a], ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[k]]
        at = max(at, b)
    return "".join(out) + text[at:]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n, chars, dup = len(w), sum(map(len, w)), len(lines) - len(set(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = n < 20 or 100 * len(covered) > 30 * n
    letters = sum(c.isalpha() for c in text)
    capitals = sum(c.isupper() for c in text)
    rejected = (
        10 * symbols > n
        or chars < 2 * n
        or chars > 15 * n
        or (dup >= 3 and 100 * dup > 40 * len(lines))
        or (letters >= 40 and 10 * capitals > 5 * letters)
        or 2 * letters < chars
        or (n < 400 and 10 * len(set(w)) < n)
    )
    return n, chars, symbols, dup, len(covered), failed, not failed and not rejected


def repeats(docs, length=200):
    """One (n_bytes, n_removed, n_spans, sha) per text, from all substrings."""
    raw = [(t or "").encode() for t in docs]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contained(docs, items):
    own = {i: shingles(t, lower=str.lower) for i, t in items}
    out = {}
    for d, t in docs:
        w = words((t or "").lower())
        for i, s in own.items():
            if not s:
                continue
            size = len(next(iter(s)))
            have = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
            n = len(s & have)
            if 10 * n >= 8 * len(s):
                out[d, i] = (n, len(s))
    return out
