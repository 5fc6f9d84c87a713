"""near_pairs against brute force on short texts behind strangers with smaller ids."""

import random

import numpy as np
import pytest

from leafmill.llm import fingerprints
from tests.llm.tables import table


def roots(n, pairs):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            label[x] = x = label[label[x]]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("part", [1000, 100])
def test_links_of_short_texts(spark, monkeypatch, part):
    monkeypatch.setattr(fingerprints, "PART_CLASSES", part)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    texts = [word(rng.randrange(10, 16)) for _ in range(1500)]  # strangers of smaller ids, which lead the short runs
    for _ in range(300):
        base = word(rng.randrange(12, 20))
        texts += [base, base[:-1] + "x"]
    prints = fingerprints.fingerprints(texts)
    walks = [p[2:].split("/") for p in prints]
    assert all(p[0] == "0" for p in prints) and all(len(w) <= fingerprints.FEW for own in walks for w in own)
    likest = np.zeros((len(texts), len(texts)))
    for walk in zip(*walks):
        size = np.array([len(w) for w in walk])
        grid = np.full((len(texts), fingerprints.FEW), 255, np.uint8)
        for k, w in enumerate(walk):
            grid[k, : size[k]] = np.frombuffer(w.encode(), np.uint8)
        for k in range(len(texts)):
            same = ((grid == grid[k]) & (grid[k] != 255)).sum(1) / np.maximum(1, np.maximum(size, size[k]))
            likest[k] = np.maximum(likest[k], (same - 1 / 16) / (15 / 16))
    want = [(k, int(j)) for k in range(len(texts)) for j in np.flatnonzero(likest[k, :k] >= 0.8)]
    found = [(r.doc_id, r.like_id) for r in fingerprints.near_pairs(table(spark, texts), band=2).collect()]
    assert set(found) <= set(want)
    assert roots(len(texts), found) == roots(len(texts), want)


def test_links_of_edited_texts(spark):
    """Recall against all pairs: long texts, each with copies that were edited in a few places, some at the start."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz    "
    texts = []
    for _ in range(120):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(300, 3000)))
        texts.append(text)
        for at in (0, rng.randrange(len(text))):
            texts.append(text[:at] + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) + text[at + rng.randrange(3) :])
    prints = fingerprints.fingerprints(texts)
    want = [(k, j) for k in range(len(texts)) for j in range(k) if fingerprints.likeness(prints[k], prints[j]) >= 0.8]
    found = [(r.doc_id, r.like_id) for r in fingerprints.near_pairs(table(spark, texts)).collect()]
    assert set(found) <= set(want)
    wanted, got = roots(len(texts), want), roots(len(texts), found)
    joined = sum(got[k] == got[j] for k, j in want)
    assert joined >= 0.98 * len(want) and len(want) > 300
    assert len(set(wanted)) > 100
