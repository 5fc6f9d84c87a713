"""Token ids of whole texts, as the tokenizers library gives them for its files.

The library spends most of its time on offsets and objects that nobody asks for
here. For texts whose code points are all below FAST_BELOW its ids are found
with tiktoken's merge loop, run on the very vocabulary and merges of the file;
every other text, and one that holds the string of an added token, goes through
the library itself. Below FAST_BELOW no text is
changed by NFC, lower-casing needs no context, and all Unicode versions agree on
which characters are letters, numbers and white space, so both ways give the
same ids; tests hold them against each other.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

FAST_BELOW = 0x100
#: White space for Python, but not for the library's patterns.
_ODD = b"\x1c\x1d\x1e\x1f"
_ENCODERS: dict = {}
END = b"\xff"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def fast(text: str, words: bool = False) -> bool:
    """Whether text has only code points below FAST_BELOW and, if words are split by Python, no odd white space."""
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not words or len(plain.translate(None, _ODD)) == len(plain)


def added(strings: set[str]) -> Callable[[str], object]:
    """A search for any of the added tokens' strings, in whichever case."""
    return re.compile("|".join(map(re.escape, sorted(strings))) or r"(?!)", re.IGNORECASE).search


class ByteEncoder:
    """Byte-level vocabularies: white space is part of the pieces (byte_bpe)."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters, file = byte_letters(), json.loads(self.tokenizer.to_str())
        special = {x["content"] for x in file["added_tokens"]}
        self.added = added(special)
        ranks = {bytes(letters[c] for c in w): i for w, i in file["model"]["vocab"].items() if w not in special}
        self.quick = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        quick = self.quick._core_bpe
        return [np.frombuffer(quick.encode_to_tiktoken_buffer(t, set()), "<u4") if fast(t) and not self.added(t) else self.library(t) for t in texts]


class WordEncoder:
    """Vocabularies with word ends and no white space (word_bpe).

    A word's last symbol is another symbol than the same letters inside a word.
    That is written as a last byte END, which no UTF-8 text holds and which
    joins its neighbour before any other merge.
    """

    def __init__(self, path: str, most: int = 300_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.known = most, {}
        letters, file = byte_letters(), json.loads(self.tokenizer.to_str())
        vocab, suffix = file["model"]["vocab"], file["model"]["end_of_word_suffix"]

        def spelt(w: str) -> bytes:
            return bytes(letters[c] for c in w.removesuffix(suffix)) + END * w.endswith(suffix)

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + END: 256 + b for b in range(255)}
        for pair in file["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(spelt(a + b), len(ranks))
        self.ids = np.zeros(len(ranks), "<u4")
        special = {x["content"] for x in file["added_tokens"]}
        self.added = added(special)
        for w, i in vocab.items():
            if w not in special and spelt(w) in ranks:
                self.ids[ranks[spelt(w)]] = i
        self.quick = tiktoken.Encoding("file", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        # among the signs below FAST_BELOW these six are numbers, though no digits
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """Puts the ids of these words, which hold no white space, into self.known."""
        merge, find, ranks, ends = self.quick._core_bpe.encode_single_piece, self.pieces.findall, [], []
        for w in words:
            for piece in find(w.lower()):
                ranks += merge(piece.encode() + END)
            ends.append(len(ranks))
        ids = self.ids[np.array(ranks, "i8")].tobytes() if ranks else b""
        self.known.update(zip(words, [ids[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [t.split() if fast(t, True) and not self.added(t) else None for t in texts]
        new = {w for c in cuts if c for w in c}.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = {w for c in cuts if c for w in c}
        self.learn(list(new))
        get = self.known.__getitem__
        return [self.library(t) if c is None else np.frombuffer(b"".join(map(get, c)), "<u4") for t, c in zip(texts, cuts)]


def encoder(path: str, kind: type = ByteEncoder) -> ByteEncoder | WordEncoder:
    """This worker's encoder of the file; it is kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = kind(path)
    return _ENCODERS[path, kind]
