"""Packing, the token store, and byte-level BPE against the libraries."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafmill.llm import bpe, crc, packing, token_store, tokens
from tests.llm.tables import awkward, sha, table
from tests.llm.tables import crc as crc32

BYTES, WORDS, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
SIGNS = "".join(map(chr, range(0x180))) + "''''ssttrreevvmmlldd    \n\n\u2003\u0301日½ſΣ\U0001f600"


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "kind"), [(BYTES, tokens.ByteEncoder), (WORDS, tokens.WordEncoder)])
def test_encoders_equal_the_library(path, kind):
    random.seed(4)
    texts = [t or "" for t in awkward()] + ["".join(random.choices(SIGNS, k=random.randint(0, 50))) for _ in range(3000)]
    texts += [a + s + b for s in ("<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|", "<|end of text|>") for a in ("", "a ", "Été") for b in ("", " b", "!")]
    plain = library(path)
    assert [x.tolist() for x in tokens.encoder(path, kind).encode(texts)] == [plain(t) for t in texts]


RANKED = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
TIKTOKEN = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKED, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(SIGNS), max_size=60), max_size=20))
def test_bpe_equals_tiktoken(texts):
    own = bpe.loaded(RANKS)
    for text, (ids, offsets) in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
        assert own.decode(np.frombuffer(ids, "<u4")) == text.encode()
        assert len(offsets) == 0 or offsets[0] == 0


@pytest.mark.parametrize("signs", ["abcdefghijklmnopqrstuvwxyz", "x", "et", "é日a", "\u0301 \t", "=-"])
def test_long_pieces(signs):
    """Pieces of up to a million signs, some beside others, in seconds."""
    random.seed(5)
    own = bpe.loaded(RANKS)
    for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3000, 300_000 if len(signs) < 20 else 1_000_000):
        text = "so " + "".join(random.choices(signs, k=n)) + " it goes"
        ((ids, offsets),) = own.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
        assert own.decode(np.frombuffer(ids, "<u4"), offsets) == text.encode()
    assert max(map(len, own.known)) <= bpe.LONG


def test_offsets_cut_texts_into_pieces():
    own = bpe.loaded(RANKS)
    for text in [t or "" for t in awkward()] + ["it's 12 o'clock,  isn't it\n\n é日"]:
        ((ids, offsets),) = own.encode([text])
        ids, data = np.frombuffer(ids, "<u4"), text.encode()
        cut = [*offsets.tolist(), len(data)]
        pieces = [data[a:b] for a, b in zip(cut, cut[1:])]
        assert b"".join(pieces) == data and all(pieces)
        assert np.concatenate([np.zeros(0, int), *[TIKTOKEN._core_bpe.encode_single_piece(p) for p in pieces]]).tolist() == ids.tolist()
        assert own.decode(ids, offsets) == data
        if len(ids) > 1 and len(offsets) > 1:
            with pytest.raises(ValueError, match="do not fit"):
                own.decode(ids[:-1] if ids[0] == ids[-1] else ids[::-1][: len(ids) - 1], np.append(offsets, len(data) + 5))


def test_scan_equals_steps():
    random.seed(2)
    kind = np.array(random.choices(range(10), weights=[4, 1, 2, 9, 2, 3, 3, 4, 3, 1], k=50_000), np.uint8)
    state, want = bpe.OVER, []
    for k in kind.tolist():
        want.append(bool(bpe.BEGINS[state, k]))
        state = bpe.TO[state, k]
    assert bpe.begins(kind).tolist() == want


def test_bpe_tables(spark):
    texts = awkward()
    rows = bpe.decode(bpe.encode(table(spark, texts, ids="x"), RANKS), RANKS).collect()
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded).decode(), r.n_tokens) for r in rows}
    assert got == {k: (TIKTOKEN.encode_ordinary(t or ""), t or "", len(TIKTOKEN.encode_ordinary(t or ""))) for k, t in enumerate(texts)}
    assert bpe.encode(table(spark, []), RANKS).count() == 0


def test_odd_ids(spark):
    """Null and repeated doc_ids: each row is a document of its own."""
    rows = spark.createDataFrame([(None, "a b"), (5, "b"), (5, None), (5, "b"), (None, "a b")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_tokens) for r in bpe.encode(rows, RANKS).collect())
    assert got == [(-1, 2), (-1, 2), (5, 0), (5, 1), (5, 1)]
    packed = packing.pack(packing.pieces(rows, WORDS)).collect()
    assert sorted((r.doc_id or -1, r.length) for r in packed) == [(-1, 3), (-1, 3), (5, 1), (5, 2), (5, 2)] and packed_well(packed) == 1


def test_op3(spark, data):
    rows = bpe.op3_byte_bpe(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = {k: np.array(TIKTOKEN.encode_ordinary(t), "<u4") for k, t in texts.items()}
    assert {tuple(r) for r in rows} == {(k, len(ids[k]), sha(ids[k].tobytes()), sha(t.encode())) for k, t in texts.items()}


def test_crc_of_parts():
    random.seed(1)
    for _ in range(30):
        parts = [random.randbytes(4 * random.choice([0, 1, 5, 100, 30_000])) for _ in range(5)]
        units = np.array([len(p) // 4 for p in parts])
        moved = crc.moved(np.array([crc32(p) for p in parts]), units.sum() - np.cumsum(units))
        assert np.bitwise_xor.reduce(moved) == crc32(b"".join(parts))


def test_cuts_follow_content():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_000, 20_000).astype("<u4")
    whole = token_store.cut(ids)
    assert whole[-1] == len(ids) and max(np.diff([0, *whole])) <= token_store.MOST
    moved = token_store.cut(np.concatenate([ids[:10], ids[7:]]))
    assert len({len(ids) - e for e in whole} & {len(ids) + 3 - e for e in moved}) > 0.9 * len(whole)
    assert token_store.cut(ids[:0]) == [0] and token_store.cut(np.zeros(5000, "<u4"))[-1] == 5000
    assert token_store.merkle([b"a"]) == b"a" and token_store.merkle([b"a", b"b"]) != token_store.merkle([b"b", b"a"])


def test_store_round_trip(spark, tmp_path):
    texts, plain = awkward() + ["same text here is the one"], library(BYTES)
    docs = table(spark, texts, start="clash", n_tokens="clash")
    path = f"file://{tmp_path}/store"
    token_store.write(docs, path, BYTES, end_id=2)
    want, start = {}, 0
    for k, t in enumerate(texts):
        ids = [*plain(t), 2]
        want[k] = (start, ids)
        start += len(ids)
    assert {r.doc_id: (r.start, list(r.ids)) for r in token_store.read_ids(spark, path).collect()} == want
    got = {tuple(r) for r in token_store.read_checked(spark, path).collect()}
    assert got == {(k, s, len(ids), crc32(np.array(ids, "<u4").tobytes())) for k, (s, ids) in want.items()}
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    top = spark.read.parquet(f"{path}/manifest").where("part is null").first()
    assert (top.n_docs, top.n_tokens) == (len(texts), start)


def test_store_notices_damage(spark, tmp_path):
    from pyspark.sql import functions as F

    path, bad = f"file://{tmp_path}/store", f"file://{tmp_path}/bad"
    token_store.write(table(spark, ["one text", "another", "one text"]), path, BYTES)
    parts = {n: spark.read.parquet(f"{path}/{n}") for n in ("chunks", "recipes", "manifest")}
    lost = parts["chunks"].orderBy("digest").limit(1).select("digest")
    damage = [
        ({"chunks": parts["chunks"].withColumn("data", F.unhex(F.concat(F.hex("data"), F.lit("0000"))))}, "does not hold"),
        ({"chunks": parts["chunks"].join(lost, "digest", "left_anti")}, "missing"),
        ({"recipes": parts["recipes"].where("doc_id <> 1")}, "do not match"),
        ({"recipes": parts["recipes"].withColumn("doc_id", F.col("doc_id") + 1)}, "do not match"),
        ({"recipes": parts["recipes"].withColumn("digests", F.expr("concat(digests, substring(digests, 1, 16))"))}, "Merkle root"),
        ({"manifest": parts["manifest"].where("part is null")}, "do not match"),
        ({"manifest": parts["manifest"].where("part is not null")}, "own Merkle root"),
        ({"manifest": parts["manifest"].withColumn("n_docs", F.when(F.col("part").isNull(), 9).otherwise(F.col("n_docs")))}, "own Merkle root"),
    ]
    for changed, match in damage:
        for name, df in {**parts, **changed}.items():
            df.write.mode("overwrite").parquet(f"{bad}/{name}")
        for read in (token_store.read_checked, token_store.read_ids):
            with pytest.raises(Exception, match=match):
                read(spark, bad).collect()


def test_store_refuses_wide_ids(spark, tmp_path):
    with pytest.raises(Exception, match="does not fit"):
        token_store.write(table(spark, ["a text"]), f"file://{tmp_path}/a", BYTES, end_id=70_000)
    token_store.write(table(spark, ["a text"]), f"file://{tmp_path}/b", BYTES, end_id=70_000, width=4)
    assert list(token_store.read_ids(spark, f"file://{tmp_path}/b", 4).first().ids)[-1] == 70_000


def test_store_of_nothing_and_odd_ids(spark, tmp_path):
    token_store.write(table(spark, []), f"file://{tmp_path}/a", BYTES)
    assert token_store.read_checked(spark, f"file://{tmp_path}/a").count() == 0
    rows = spark.createDataFrame([(None, "a"), (5, "b"), (5, "c"), (5, "b")], "doc_id long, text string")
    token_store.write(rows, f"file://{tmp_path}/b", BYTES, end_id=2)
    got = sorted((r.doc_id is not None, r.start) for r in token_store.read_checked(spark, f"file://{tmp_path}/b").collect())
    assert got == [(False, 0), (True, 2), (True, 4), (True, 6)]


def test_op6(spark, data):
    plain, start, want = library(BYTES), 0, set()
    for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*plain(r.text), 2], "<u4")
        want.add((r.doc_id, start, len(ids), crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in token_store.op6_token_store(spark, data).collect()} == want


def check_plan(histogram, capacity):
    plan, bins = packing.solve(histogram, capacity), {}
    for length, _, n, base, each, offset in plan.runs:
        for k in range(n):
            bins.setdefault(base + k // each, []).append((offset + k % each * length, length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(plan.sequences))
    assert sum(map(len, bins.values())) == sum(histogram.values())
    for length, n in histogram.items():
        assert sorted(k for x, r, m, *_ in plan.runs if x == length for k in range(r, r + m)) == list(range(n))
    return plan


def fewest(items, capacity):
    best = len(items)

    def go(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(items):
            best = len(room)
            return
        for j in {r: j for j, r in enumerate(room)}.values():
            if room[j] >= items[k]:
                go(k + 1, [r - items[k] * (i == j) for i, r in enumerate(room)])
        go(k + 1, [*room, capacity - items[k]])

    go(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8), st.integers(12, 14))
def test_reduction_keeps_the_optimum(items, capacity):
    """What the criterion fixes belongs to a best packing: the rest packs into as few more sequences as the whole needs."""
    left = np.zeros(capacity + 1, np.int64)
    for x in items:
        left[x] += 1
    plan = packing.Plan(capacity)

    def put(length, n, base, each, offset):
        left[length] -= n
        plan.runs.append((length, 0, n, base, each, offset))

    while packing._reduce(left, capacity, plan, put):
        pass
    rest = sorted(np.repeat(np.arange(capacity + 1), left).tolist(), reverse=True)
    assert plan.sequences + fewest(rest, capacity) == fewest(sorted(items, reverse=True), capacity)
    check_plan({x: items.count(x) for x in set(items)}, capacity)


def test_large_histogram():
    random.seed(6)
    histogram = {random.randint(1, 4096): random.randint(1, 100_000) for _ in range(2000)}
    plan = packing.solve(histogram)
    bound = max(-(-sum(k * n for k, n in histogram.items()) // 4096), sum(n for k, n in histogram.items() if k > 2048))
    assert plan.sequences <= 1.02 * bound
    with pytest.raises(ValueError):
        packing.solve({4097: 1})


def packed_well(rows, capacity=4096):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_awkward(spark):
    texts, plain = awkward() * 3, library(WORDS)
    found = packing.pieces(table(spark, texts, rank="clash", length="clash"), WORDS)
    rows = packing.pack(found).collect()
    want = set()
    for k, t in enumerate(texts):
        ids = np.array([*plain(t), 1], "<u4")
        want |= {(k, n, b, ids[b : b + 4096].tobytes()) for n, b in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows} == want and len(rows) == len(want)
    n = packed_well(rows)
    whole = packing.sequences(packing.pack(found)).collect()
    assert len(whole) == n and all(len(s.ids) == 4 * s.length for s in whole)
    assert packing.pack(packing.pieces(table(spark, []), WORDS)).count() == 0


def test_op1(spark, data):
    rows = packing.op1_best_fit_packing(spark, data).collect()
    plain, want = library(WORDS), set()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = np.array([*plain(r.text), 1], "<u4")
        want |= {(r.doc_id, n, b, len(ids[b : b + 4096]), crc32(ids[b : b + 4096].tobytes())) for n, b in enumerate(range(0, len(ids), 4096))}
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    assert packed_well(rows) <= 1.02 * sum(r.length for r in rows) / 4096 + 1
