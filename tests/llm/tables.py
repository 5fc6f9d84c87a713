"""Small tables with every awkward case, and plain versions of what operators compute."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, **more):
    """Documents of texts, numbered from 0; more: extra columns of constants."""
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({k: F.lit(v) for k, v in more.items()}) if more else df


def awkward():
    long = " ".join(f"w{k % 977}é" for k in range(30_000))
    return [None, "", " \n\t", "a", "A b", "same text here is the one", "same text here is the one", long, "\u2003wide\u00a0space \U0001f600 \x1c odd", "'s I'll  x's\n\n", "日本語 text ½²", "tail ", "x" * 5000]


def removed(rows, window=13):
    """(doc_id, n_words, n_removed, kept text) of (doc_id, text), by all windows."""
    last = float("inf")
    first, out = {}, []
    cut = [(last if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    for key, _, words in cut:
        for k in range(len(words) - window + 1):
            own = tuple(words[k : k + window])
            first[own] = min(first.get(own, last), key)
    for key, i, words in cut:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < key:
                gone[k : k + window] = [True] * window
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def near(rows, n=4, percent=80):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text), by all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least[find(k)], least[find(k)] == i) for k, (i, _) in enumerate(rows)]


def crc(data):
    return zlib.crc32(data)


def sha(data):
    return hashlib.sha256(data).hexdigest()
