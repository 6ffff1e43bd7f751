"""Plain statements of what the operators compute, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def least_reachable(ids, linked):
    """Smallest id that each id reaches over linked pairs."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def cut_substrings(docs, length):
    """doc -> (bytes, removed, spans, kept) with docs as (id, text)."""
    first, out = {}, {}
    for i, text in sorted((i, (t or "").encode()) for i, t in docs):
        covered = bytearray(len(text))
        for k in range(len(text) - length + 1):
            if first.setdefault(text[k : k + length], i) < i:
                covered[k : k + length] = b"\1" * length
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out[i] = (len(text), sum(covered), spans, bytes(b for b, c in zip(text, covered) if not c))
    return out


def simhash(text, shingle=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    rows = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] if len(words) >= shingle else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text, k):
    """The set of k-word shingles; fewer words than that are one shingle."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def secrets(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def quality(text):
    """(words, their characters, symbols, repeated lines, words in repeated windows)."""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count = Counter(windows)
    repeated = {p for k, w in enumerate(windows) if count[w] > 1 for p in range(k, k + 8)}
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(lines.values()) - len(lines), len(repeated)


def wide_lines(docs, least):
    """id -> (text without lines on ``least`` sites or more, lines removed), docs as (id, text, site)."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites, first = defaultdict(set), {}
    for i, text, site in docs:
        for line in map(strip, (text or "").split("\n")):
            sites[line].add(site or "")
            first[line] = min(first.get(line, i), i)
    out = {}
    for i, text, _ in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not strip(x) or len(sites[strip(x)]) < least or first[strip(x)] == i]
        out[i] = ("\n".join(kept), len(lines) - len(kept))
    return out
