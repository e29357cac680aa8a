"""Brute-force versions of what the contracts ask for."""

import hashlib
import re
from functools import cache

import numpy as np

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def fingerprint_shingles(text):
    """The word shingles, and those of eight characters of long words and of texts of few words."""
    w = words(lower(text))
    some = [x for x in w if len(x.encode()) > 24 or len(w) < 5]
    return shingles(text) | {x[i : i + 8] for x in some for i in range(max(1, len(x) - 7))}


@cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def repeats(docs, window=50):
    """doc_id, n_words, n_removed, kept_sha256 of (doc_id, text) rows."""
    first, all_ = {}, []
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = words(text)
        all_.append((i, w))
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = set()
    for i, w in all_:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.add((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def components(docs):
    """doc_id, n_shingles, component_id of (doc_id, text) rows with distinct ids."""
    docs = sorted(docs)
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a and b and 4 * len(b) <= 5 * len(a) + 1 and 4 * len(a) <= 5 * len(b) + 1 and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {(d[0], len(s), docs[find(i)][0]) for i, (d, s) in enumerate(zip(docs, sets, strict=True))}
