"""Byte-level BPE: encoding and decoding of whole texts as arrays.

Where pieces begin is found without a regular expression. Each code point gets a
class, which also says what follows it where the pattern looks ahead. A class is
a function from the states of a small automaton to its states; functions are put
together block by block and the blocks' functions by an associative scan, so that
each block's first state is known and all blocks run side by side. Pieces that
were met before have their ids at hand; the others are merged together, one merge
in each of them at a time, but long ones by a heap of their pairs, in n log n steps.
The pieces' offsets in the text are kept: decoding is a gather of tokens' bytes,
and each piece must begin where its offset says.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import ship

# Classes of code points. SPACE, OTHER_SPACE: white space (U+0020, another) before what is none; RUN_SPACE: before
# more of it, or the end. SINGLE: s t m d; PAIRED: r or v before e, l before l.
SPACE, OTHER_SPACE, RUN_SPACE, LETTER, NUMBER, SIGN, QUOTE, SINGLE, PAIRED, BREAK = range(10)
# States: a piece is over; the space before a piece; in white space, letters, numbers, signs; a quote began a piece;
# it and the first of a pair.
OVER, BEFORE, IN_SPACE, IN_LETTERS, IN_NUMBERS, IN_SIGNS, QUOTED, HALF = range(8)
BLOCKS, BATCH_ROWS, BATCH_CHARS, MOST_PIECES = 8192, 512, 1_000_000, 400_000
#: Pieces of more bytes are merged by a heap, and not kept.
LONG = 96


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by state and class."""
    to, begins = np.zeros((8, 10), np.uint8), np.ones((8, 10), np.bool_)
    run = {LETTER: IN_LETTERS, SINGLE: IN_LETTERS, PAIRED: IN_LETTERS, NUMBER: IN_NUMBERS, SIGN: IN_SIGNS}
    for state in range(8):
        to[state, SPACE], to[state, OTHER_SPACE], to[state, RUN_SPACE], to[state, BREAK] = BEFORE, OVER, IN_SPACE, OVER
        begins[state, RUN_SPACE] = state != IN_SPACE
        for kind, own in run.items():
            to[state, kind] = own
            begins[state, kind] = state not in (BEFORE, own)
        goes_on = state in (BEFORE, IN_SIGNS, QUOTED)
        to[state, QUOTE] = IN_SIGNS if goes_on else QUOTED
        begins[state, QUOTE] = not goes_on
    begins[QUOTED, SIGN] = False
    to[QUOTED, SINGLE], begins[QUOTED, SINGLE] = OVER, False
    to[QUOTED, PAIRED], begins[QUOTED, PAIRED] = HALF, False
    for kind in (LETTER, SINGLE, PAIRED):
        to[HALF, kind], begins[HALF, kind] = OVER, False
    return to, begins


TO, BEGINS = automaton()
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER_SPACE or SIGN for each code point, as the library's own patterns class it."""
    if not _CLASSES:
        import tiktoken

        table = np.full(0x110000, SIGN, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([b]): b for b in range(256)}
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", OTHER_SPACE)):
            found = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
            table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), "<u4")] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def kinds(points: np.ndarray) -> np.ndarray:
    """The class of each code point of texts that U+0000 ends; that sign itself counts as BREAK here."""
    kind = classes()[points]
    kind[points == 0] = BREAK
    after = np.append(points[1:], np.uint32(0))
    last = (kind == OTHER_SPACE) & np.append((kind[1:] != OTHER_SPACE) & (kind[1:] != BREAK), False)
    kind[(kind == OTHER_SPACE) & ~last] = RUN_SPACE
    kind[last & (points == 0x20)] = SPACE
    kind[points == 0x27] = QUOTE
    low = points < 0x80
    kind[low & np.isin(points, [ord(c) for c in "stmd"])] = SINGLE
    kind[((points == ord("r")) | (points == ord("v"))) & (after == ord("e"))] = PAIRED
    kind[(points == ord("l")) & (after == ord("l"))] = PAIRED
    return kind


def begins(kind: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each place."""
    n = len(kind)
    blocks = max(1, min(BLOCKS, n // 64))
    steps = -(-n // blocks)
    padded = np.full(blocks * steps, BREAK, np.uint8)
    padded[:n] = kind
    across = np.ascontiguousarray(padded.reshape(blocks, steps).T)  # a row holds the blocks' places of one number
    flat, states = TO.ravel(), TO.shape[0]
    whole = np.tile(np.arange(states, dtype=np.uint8), (blocks, 1))
    for row in across:
        whole = flat[whole * np.uint8(10) + row[:, None]]
    width = 1
    while width < blocks:  # whole[i] becomes the function of all blocks up to i
        later = whole.copy()
        later[width:] = np.take_along_axis(whole[width:], whole[:-width], 1)
        whole, width = later, width * 2
    state = np.concatenate([[OVER], whole[:-1, OVER]]).astype(np.uint8)
    out, starts = np.empty((steps, blocks), np.bool_), BEGINS.ravel()
    for k, row in enumerate(across):
        at = state * np.uint8(10) + row
        out[k] = starts[at]
        state = flat[at]
    return np.ascontiguousarray(out.T).ravel()[:n]


class Bpe:
    """Ranks of a vocabulary file, and what encoding and decoding with them need."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(self.ranks.values()) + 1
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    pairs[a * self.size + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.pairs = pairs
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.known: dict[bytes, bytes] = {}

    def pieces(self, texts: list[str]) -> tuple[bytes, np.ndarray, list[int]]:
        """All texts' bytes, the bounds of their pieces, and the number of pieces up to the end of each text.

        Texts are cut apart by U+0000, which a text that holds it gets back as it was.
        """
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind_points = points
        if len(ends) != np.count_nonzero(points == 0):
            kind_points = np.where(points == 0, np.uint32(1), points)  # a sign like it
            kind_points[ends] = 0
        starts = begins(kinds(kind_points))
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.cumsum(size) - size
        where = np.flatnonzero(starts)
        return "\0".join([*texts, ""]).encode(), np.append(at[where], at[-1] + 1), np.searchsorted(where, ends).tolist()

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """For each text its ids, little-endian unsigned 32-bit integers, and the pieces' offsets in its bytes."""
        if not texts:
            return []
        data, bounds, upto = self.pieces(texts)
        cut = bounds.tolist()
        slices, known = [data[a:b] for a, b in zip(cut, cut[1:])], self.known
        new = set(slices).difference(known)
        if len(known) + len(new) > MOST_PIECES:
            known.clear()
            new = set(slices)
        self.learn(list(new))
        found, out, begin = [known[s] for s in slices], [], 0
        for s in new:
            if len(s) > LONG:
                del known[s]
        for end in upto:
            out.append((b"".join(found[begin:end]), bounds[begin:end] - bounds[begin]))
            begin = end + 1  # the U+0000 after the text is a piece of its own
        return out

    def learn(self, pieces: list[bytes]) -> None:
        """Merges pieces and puts their ids into self.known.

        In each round every piece has its pair of the lowest rank merged, the first
        of equal ones, until no pair of any piece is a token. Long pieces go one by one.
        """
        none = self.size
        whole = [p for p in pieces if p in self.ranks]
        self.known.update((p, int(self.ranks[p]).to_bytes(4, "little")) for p in whole)
        pieces = [p for p in pieces if p not in self.ranks]
        self.known.update((p, self.merged_long(p)) for p in pieces if len(p) > LONG)
        pieces = [p for p in pieces if len(p) <= LONG]
        if not pieces:
            return
        number = np.arange(len(pieces))
        lengths = np.array([len(p) for p in pieces], np.int64)
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        while len(number):
            first = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(number)), lengths)
            pair = ids * self.size + np.append(ids[1:], 0)
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where(self.keys[at] == pair, self.merged[at], none)
            rank[first + lengths - 1] = none
            least = np.minimum.reduceat(rank, first)
            over = least == none
            if over.any():
                done, flat = over[owner], None
                flat = ids[done].astype("<u4").tobytes()
                ends = (np.cumsum(lengths[over]) * 4).tolist()
                self.known.update((pieces[k], flat[a:b]) for k, a, b in zip(number[over].tolist(), [0, *ends], ends))
                keep = ~done
                ids, rank, owner = ids[keep], rank[keep], (np.cumsum(~over) - 1)[owner[keep]]
                number, lengths, least = number[~over], lengths[~over], least[~over]
                if not len(number):
                    return
            hit = np.flatnonzero(rank == least[owner])
            hit = hit[np.unique(owner[hit], return_index=True)[1]]
            ids[hit] = least
            ids = np.delete(ids, hit + 1)
            lengths = lengths - 1

    def merged_long(self, piece: bytes) -> bytes:
        """The ids of one piece, by a heap of its pairs (rank, place) over a linked list of its tokens.

        A pair that has changed since it was put on the heap is passed over: the
        pair at its place has another rank then.
        """
        size, get, n = self.size, self.pairs.get, len(piece)
        first = self.single[np.frombuffer(piece, np.uint8)]
        pair = first[:-1] * size + first[1:]
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        where = np.flatnonzero(self.keys[at] == pair)
        heap = ((self.merged[at[where]] << 40) | where).tolist()
        heapq.heapify(heap)
        ids, after, before = array("q", first.tobytes()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        place, push, pop = (1 << 40) - 1, heapq.heappush, heapq.heappop
        while heap:
            top = pop(heap)
            i, rank = top & place, top >> 40
            j = after[i]
            if j >= n or ids[i] < 0 or get(ids[i] * size + ids[j]) != rank:
                continue
            k, h = after[j], before[i]
            ids[i], ids[j], after[i] = rank, -1, k
            if k < n:
                before[k] = i
                if (next_rank := get(rank * size + ids[k])) is not None:
                    push(heap, next_rank << 40 | i)
            if h >= 0 and (next_rank := get(ids[h] * size + rank)) is not None:
                push(heap, next_rank << 40 | h)
        found = np.frombuffer(ids, np.int64)
        return found[found >= 0].astype("<u4").tobytes()

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes that ids stand for. offsets: where pieces begin in them; a token must begin at each."""
        n = self.lengths[ids]
        begin = np.cumsum(n) - n
        if offsets is not None and len(offsets):
            at = np.searchsorted(begin, offsets)
            if at[-1] >= len(begin) or (begin[at] != offsets).any():
                raise ValueError("ids do not fit the offsets of their pieces")
        return self.bytes[np.repeat(self.offsets[ids] - begin, n) + np.arange(int(n.sum()))].tobytes()


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """This worker's tables of the file; they are kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > BATCH_CHARS:
            yield begin, k
            begin, size = k, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def _encoded(path: str, offsets: bool, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(at, BATCH_ROWS)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                for begin, end in _parts(texts):
                    found = bpe.encode(texts[begin:end])
                    columns = {"doc_id": rows.column(0).slice(begin, end - begin), "n_tokens": pa.array([len(ids) // 4 for ids, _ in found], pa.int64()), "ids": pa.array([ids for ids, _ in found], pa.binary())}
                    if offsets:
                        columns["offsets"] = pa.array([o.astype("<u8").tobytes() for _, o in found], pa.binary())
                    if decoded:
                        columns["decoded"] = pa.array([bpe.decode(np.frombuffer(ids, "<u4"), o) for ids, o in found], pa.binary())
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def encode(docs: DataFrame, path: str, offsets: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit integers) of each row of docs.

    docs: doc_id, text (null: empty); other columns are not read. offsets: with
    the pieces' offsets in the text's UTF-8 bytes (binary, 64-bit integers).
    decoded: with what the ids decode to, as decode() gives it.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids binary" + ", offsets binary" * offsets + ", decoded binary" * decoded
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(path, offsets, decoded), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded, a table with ids as encode() gives them (null: none), with the column decoded (binary).

    Where it has offsets too, ids that do not fit them raise an error.
    """
    ship(encoded.sparkSession)
    at = encoded.columns.index("ids")
    where = encoded.columns.index("offsets") if "offsets" in encoded.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            pieces = [None] * batch.num_rows if where is None else [None if o is None else np.frombuffer(o, "<u8").astype(np.int64) for o in batch.column(where).to_pylist()]
            out = [bpe.decode(np.frombuffer(ids or b"", "<u4"), o) for ids, o in zip(batch.column(at).to_pylist(), pieces)]
            yield batch.append_column("decoded", pa.array(out, pa.binary()))

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and what they and the pieces' offsets decode to, as digests."""
    import public_tokenizers

    both = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
