"""Plain versions of the operators, for holding results against."""

import html as html_lib
import re

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
_LIBRARY = Tokenizer.from_file(VOCABULARY)


def ids(text, end=2):
    """The library's ids of a whole text and the end id."""
    return np.array(_LIBRARY.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def n_tokens(text):
    return len(ids(text)) - 1


def fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints, names, distance=4):
    """For each fingerprint the smallest name reachable over links of at most ``distance`` bits."""
    parent = list(range(len(fingerprints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fingerprints)):
        for j in range(i):
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, n in enumerate(names):
        if n is not None:
            groups[root(i)] = min(n, groups.get(root(i), n))
    return [groups.get(root(i)) for i in range(len(fingerprints))]


def secrets(text):
    """Base spans as (start, kind, end)."""
    text = text or ""
    out = []
    assign = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    for m in re.finditer(assign, text):
        if len(m[2]) >= 6:
            out.append((m.start(), "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), "hex", m.end()))
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[1])))


def article(page):
    """The text inside the article element of a generated page."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inner = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
    return " ".join(html_lib.unescape(inner).split())


def smith_waterman(a, b, match=2, mismatch=-1, gap=-2):
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (match if x == y else mismatch), row[j + 1] + gap, new[j] + gap))
        best = max(best, *new)
        row = new
    return best


def top_k(vectors, query, k=10, scale=1024):
    """(score, id) of the k best others of one vector, whole numbers throughout."""
    whole = {i: [int(np.floor(float(x) * scale)) for x in v] for i, v in vectors}
    mine = whole[query]
    scores = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in whole.items() if i != query)
    return [(-s, i) for s, i in scores[:k]]
