"""Near-duplicates, repeated passages, fingerprints and components against plain versions."""

import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import fingerprints, near, substrings
from leafmill.llm.components import components
from leafmill.llm.words import words_of
from tests.llm.tables import WORD, awkward, near as near_plain, removed, sha, shingles, table


def test_words():
    texts = [t or "" for t in awkward()]
    words = words_of([t.encode() for t in texts])
    assert words.counts.tolist() == [len(WORD.findall(t)) for t in texts]
    flat = [w for t in texts for w in WORD.findall(t)]
    by = {}
    for w, h in zip(flat, words.hashes.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    low = words_of([t.encode() for t in texts], lower=True)
    assert words_of([t.lower().encode() if t.isascii() else t.encode() for t in texts], lower=True).hashes.tolist() == low.hashes.tolist()


def copies(seed, n=60):
    """Texts that share passages, at any shift, and are edited copies of one another."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared, out = [passage(rng.randint(10, 40)) for _ in range(6)], []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and out:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = passage(rng.randint(0, 40))
            for _ in range(rng.randint(0, 2)):
                at = rng.randint(0, len(words))
                words[at:at] = rng.choice(shared)
        out.append(" ".join(words))
    return out


def test_cover_covers_all_shifts():
    for a in range(substrings.PERIOD):
        for b in range(substrings.PERIOD):
            assert any((a + d) % substrings.PERIOD in substrings.COVER and (b + d) % substrings.PERIOD in substrings.COVER for d in range(substrings.PERIOD))
    assert substrings.GRAM + substrings.PERIOD - 1 <= substrings.WINDOW


def found_repeats(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(df).collect())


def plain_repeats(rows):
    return sorted((i is None, i or 0, n, g, k) for i, n, g, k in removed(rows))


def test_repeats(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2000)  # several blocks, also within the driver's own calls
    for seed in range(3):
        texts = copies(seed) + awkward()
        assert found_repeats(table(spark, texts)) == plain_repeats(list(enumerate(texts)))


def test_windows_of_one_key_are_told_apart(spark, monkeypatch):
    """Windows are equal only if all 96 bits are: with keys of 4 bits the rest decides."""
    own = substrings._digests
    monkeypatch.setattr(substrings, "_digests", lambda *a: (own(*a)[0] % np.uint64(16), own(*a)[1]))
    texts = [t.encode() for t in copies(5, 40)]
    words = words_of(texts)
    places = np.flatnonzero(words.inside(substrings.WINDOW))
    keys, rest, bounds, index = substrings._windows(substrings._digests(texts, words, places), 3)
    cut = [t.split() for t in texts]
    said = [tuple(cut[d][k : k + substrings.WINDOW]) for d, k in zip(words.owner[places].tolist(), (places - words.first[words.owner[places]]).tolist())]
    assert len(keys) == len(set(said)) and len({(i, w) for i, w in zip(index.tolist(), said)}) == len(keys)


def test_repeats_in_many_blocks_and_buckets(spark, monkeypatch):
    texts = copies(9, 200)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 4000)
    assert found_repeats(table(spark, texts).repartition(7)) == plain_repeats(list(enumerate(texts)))


def test_repeats_odd_rows(spark):
    text = " ".join(f"t{k}" for k in range(20))
    rows = [(3, text), (3, text), (None, text), (7, text + " more"), (None, None), (1, "short")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, n_words string, other string")
    assert found_repeats(df) == plain_repeats(rows)
    out = substrings.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "other", "n_words", "n_removed", "kept_text"]
    assert substrings.remove_repeats(table(spark, [])).count() == 0


def test_op4(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert {tuple(r) for r in substrings.op4_repeated_passages(spark, data).collect()} == {(i, n, g, sha(k.encode())) for i, n, g, k in removed(rows)}


def found_near(df, **more):
    return sorted(tuple(r) for r in near.near_duplicates(df, **more).collect())


def test_near(spark):
    for seed, n in ((1, 4), (2, 5)):
        texts = copies(seed, 80) + awkward()
        assert found_near(table(spark, texts), words=n) == sorted(near_plain(list(enumerate(texts)), n))


def test_near_large_groups_in_parts(spark, monkeypatch):
    texts = copies(3, 120)
    monkeypatch.setattr(near, "GROUP_MEMBERS", 200)
    monkeypatch.setattr(near, "KEY_ROWS", 3)
    assert found_near(table(spark, texts).repartition(5)) == sorted(near_plain(list(enumerate(texts))))


def test_near_chains_behind_strangers(spark, monkeypatch):
    """Chains of texts, each like the next alone, that share most words with all others of their page."""
    rng = random.Random(11)
    page = [f"p{k}" for k in range(120)]
    texts = []
    for _ in range(25):
        words = page + [f"w{rng.randrange(10**6)}" for _ in range(90)]
        for _ in range(6):
            texts.append(" ".join(words))
            at = rng.randrange(120, 190)
            words = words[:at] + [f"x{rng.randrange(10**6)}" for _ in range(3)] + words[at + 3 :]
    rng.shuffle(texts)
    want = sorted(near_plain(list(enumerate(texts))))
    assert found_near(table(spark, texts)) == want
    monkeypatch.setattr(near, "GROUP_MEMBERS", 900)
    monkeypatch.setattr(near, "KEY_ROWS", 7)
    assert found_near(table(spark, texts)) == want
    assert 20 < len({r[2] for r in want}) < 120


def test_many_small_sets_are_linked_in_time():
    """100,000 sets that hold one common member, in chains of three."""
    rng = np.random.default_rng(4)
    sets = []
    for k in range(33_334):
        own = rng.integers(1 << 20, 1 << 60, 10).astype(np.uint64)
        sets += [np.unique(np.concatenate([[np.uint64(1)], own[a : a + 9]])) for a in (0, 1, 1)]
    began = time.process_time()
    links = near.linked(sets, 80)
    assert time.process_time() - began < 60
    assert len(links) == 2 * 33_334


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 12), min_size=1, max_size=8), st.integers(0, 3)), min_size=2, max_size=14), st.sampled_from([50, 80]))
def test_links_of_those_asked(rows, percent):
    """Every set that is outside the component of label 0, which is home, is held against all; the others are joined already."""
    sets, labels = [s for s, _ in rows], np.array([v if v == 0 else k + 10 for k, (_, v) in enumerate(rows)])
    home = int(labels.argmin()) if labels.min() == 0 else -1
    got = near.linked([np.array(sorted(s), np.uint64) for s in sets], percent, labels, np.flatnonzero(labels != 0), home)
    like = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    assert all(like(a, b) for a, b in got)

    def roots(links):
        root = labels.tolist()
        for a, b in links:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return [[r == s for s in root] for r in root]

    assert roots(got) == roots([(a, b) for a in range(len(sets)) for b in range(a) if like(a, b)])


def test_sketches_differ_no_more_than_signatures():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 16, (50, near.SYMBOLS), np.uint16)
    b = np.where(rng.random(a.shape) < 0.3, rng.integers(0, 1 << 16, a.shape, np.uint16), a).astype(np.uint16)
    short = near._HALVES[near.sketch_of(a) ^ near.sketch_of(b)].sum(1)
    assert (short <= (a != b).sum(1)).all() and short.sum() >= 0.9 * (a != b).sum()


def test_near_odd_rows(spark):
    df = spark.createDataFrame([(4, "a b c d e"), (4, "a b c d e"), (9, "A B c d e"), (None, "a b c d e"), (2, None), (1, "x"), (0, "X")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df).collect())
    assert got == [(False, 0, 1, 0, True), (False, 1, 1, 0, False), (False, 2, 0, 2, True), (False, 4, 2, 4, True), (False, 4, 2, 4, True), (False, 9, 2, 4, False), (True, 0, 2, None, True)]
    assert near.near_duplicates(table(spark, [])).count() == 0
    assert near.near_duplicates(table(spark, [None, ""])).count() == 2


def test_op7(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert {tuple(r) for r in near.op7_minhash_join(spark, data).collect()} == set(near_plain(rows))


def test_pigeonhole():
    """Signatures within REACH share a key; two of fewer differences than chunks always do."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, (200, near.SYMBOLS), np.uint16)
    other = base.copy()
    for row in other:
        row[rng.permutation(near.SYMBOLS)[: near.REACH]] ^= 1
    a, b = near.keys_of(base), near.keys_of(other)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))
    far = near.keys_of(rng.integers(0, 1 << 16, (200, near.SYMBOLS), np.uint16))
    assert not set(far.ravel().tolist()) & set(a.ravel().tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=8), min_size=2, max_size=14), st.sampled_from([50, 80]))
def test_links_join_all_components(sets, percent):
    got = near.linked([np.array(sorted(s), np.uint64) for s in sets], percent)
    like = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    assert all(like(sets[a], sets[b]) for a, b in got)

    def roots(links):
        root = list(range(len(sets)))
        for a, b in links:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return [[r == s for s in root] for r in root]

    assert roots(got) == roots([(a, b) for a in range(len(sets)) for b in range(a) if like(sets[a], sets[b])])


def test_signature_misses_are_rare():
    rng = np.random.default_rng(5)
    near_sets = []
    for _ in range(300):
        common = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        near_sets += [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 50).astype(np.uint64)])) for _ in range(2)]
    signs = near.signatures(near_sets).astype(np.int64)
    differ = (signs[::2] != signs[1::2]).sum(1)
    assert abs(differ.mean() / near.SYMBOLS - 0.2) < 0.01 and differ.max() <= near.REACH


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_print(text):
    """A fingerprint by single steps, from the tables' bits and the hashes' definitions."""
    bits = np.random.Generator(np.random.PCG64(20_250_117)).integers(0, 2, (fingerprints.WALKS, fingerprints.PERIOD, fingerprints.STRIDE, 16), np.uint8)
    mask, size = 0xFFFFFFFF, len(text)
    hashes = [(ord(c) + 1) * 0x9E3779B1 & mask for c in text] + [0x9E3779B1] * 8

    def seen(k):
        if k < 3:
            return (ord(text[k]) * 0x9E3779B1 & mask) >> 28
        h = sum(hashes[k - j] * (pow(0x85EBCA6B, j, 1 << 32) | 1 if j else 1) for j in range(4)) & mask
        h ^= h >> 15
        return (h * 0x2C1B3C6D & mask) >> 28

    level, walks = fingerprints.level_of(size), []
    for walk in range(fingerprints.WALKS):
        at, stride, out = 0, 0, []
        while at < size:
            if fingerprints.step_levels(np.array([stride]))[0] >= level:
                out.append(f"{seen(at):x}")
            for own in bits[walk, stride % fingerprints.PERIOD]:
                at += int(own[hashes[at] >> 28]) if at < len(hashes) else 0
            stride += 1
        walks.append("".join(out))
    return f"{level:x}:" + "/".join(walks)


def test_fingerprints_are_those_of_single_steps():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc déf\U0001f600日 ") for _ in range(n)) for n in (1, 2, 3, 4, 5, 17, 255, 256, 300, 511, 512, 1500, 5000)]
    assert fingerprints.fingerprints(texts) == [plain_print(t) for t in texts]


def test_slow_texts_lose_no_samples():
    """Texts on which walks hardly move have more samples than others, and keep them all."""
    bits = np.random.Generator(np.random.PCG64(20_250_117)).integers(0, 2, (fingerprints.WALKS, fingerprints.PERIOD, fingerprints.STRIDE, 16), np.uint8)
    signs = {(ord(c) + 1) * 0x9E3779B1 % (1 << 32) >> 28: c for c in map(chr, range(32, 300))}
    steps, text, at = bits[0].reshape(-1, 16), "", 0
    while len(text) < 500:
        stay = [int(np.argmax(np.append(steps[at % len(steps) :, c], 1))) for c in range(16)]
        text += signs[int(np.argmax(stay))]
        at += max(stay) + 1
    (own,) = fingerprints.fingerprints([text])
    assert own == plain_print(text) and max(map(len, own[2:].split("/"))) > 320


def test_edits_at_the_start_are_like():
    rng = random.Random(6)
    for n in (300, 2000):
        texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for _ in range(200)]
        likest = [fingerprints.likeness(*fingerprints.fingerprints([t, "xy" + t])) for t in texts]
        assert sum(x >= 0.8 for x in likest) >= 0.99 * len(texts)


def test_fingerprints():
    texts = [t or "" for t in awkward()]
    prints = fingerprints.fingerprints(texts)
    assert prints == [fingerprints.fingerprints([t])[0] for t in texts]  # whatever stands beside it
    assert fingerprints.fingerprints(["", "é"])[0] == "0://"
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    edits = [text]
    for _ in range(3):
        t = edits[-1]
        k = rng.randrange(len(t))
        edits.append(t[:k] + "q" + t[k + rng.randint(0, 2) :])
    own = fingerprints.fingerprints([*edits, text[::-1], text * 2])
    assert fingerprints.likeness(own[0], own[1]) > 0.5 > 0.2 > fingerprints.likeness(own[0], own[4])
    assert fingerprints.likeness(own[0], own[0]) == 1.0
    assert 0 <= fingerprints.likeness(own[0], own[5]) <= 1


def plain_next(texts):
    out = set()
    for k, t in enumerate(texts):
        changed = fingerprints.edited(t, texts[(k + 1) % len(texts)])
        a, b, c = fingerprints.fingerprints([t, changed, texts[(k + 1) % len(texts)]])
        out.add((k, len(t), sha(changed.encode()), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return out


def test_next_documents(spark, monkeypatch):
    texts = [t or "" for t in awkward()] + copies(4, 30)
    for size in (1 << 24, 2000):
        monkeypatch.setattr(fingerprints, "RANGE_CHARS", size)
        df = table(spark, [None if t == "" and k == 0 else t for k, t in enumerate(texts)], fingerprint="clash").repartition(3)
        assert {tuple(r) for r in fingerprints.with_next(df).collect()} == plain_next(texts)
    assert {r.near_next for r in fingerprints.with_next(table(spark, ["only one"])).collect()} == {1.0}
    assert fingerprints.with_next(table(spark, [])).count() == 0


def test_fingerprints_of_odd_ids(spark):
    """Null and repeated doc_ids: each row is a document, in the order of doc_id (nulls first), then of the text."""
    rows = spark.createDataFrame([(None, "a b"), (5, "b"), (5, None), (5, "b"), (2, "x" * 9)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_chars, r.near_next) for r in fingerprints.with_next(rows).collect())
    assert [g[:2] for g in got] == [(-1, 3), (2, 9), (5, 0), (5, 1), (5, 1)] and got[3][2] == 1.0 or got[4][2] == 1.0


def test_op10(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    rows = fingerprints.op10_edit_fingerprints(spark, data).collect()
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in rows} == {(k, len(t), sha(fingerprints.edited(t, texts[(k + 1) % len(texts)]).encode())) for k, t in enumerate(texts)}
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


def test_near_pairs(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefghij ") for _ in range(2000))
    other = "".join(rng.choice("abcdefghij ") for _ in range(2000))
    pairs = {(r.doc_id, r.like_id) for r in fingerprints.near_pairs(table(spark, [base, base, base[:1990] + "xyz", other, None])).collect()}
    assert {(1, 0), (2, 0)} <= pairs and not {p for p in pairs if 3 in p}


def test_shingles_of_short_texts():
    assert len(near.sets_of([b"a b", b"A  B", b"", b"a b c d e"], 4)[3]) == 2
    a, b, c, _ = near.sets_of([b"a b", b"A  B", b"", b"a b c d e"], 4)
    assert a.tolist() == b.tolist() and len(c) == 0 and len(shingles("a b", 4)) == 1
