"""Token ids through a public tokenizer, with a bounded memo of the pieces a text is made of.

A text is cut where no token can span, so that the tokenizer gives the same ids for the pieces
as for the whole; most pieces have been seen before.  A piece that is a word, perhaps with
punctuation behind it, goes straight to the tokenizer's model: there is nothing left to
pre-tokenize.  Any other piece goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

MEMO_PIECES = 200_000  # entries of a worker's memo; it starts afresh when full
# No pre-token has both letters and these, and a run of them is one pre-token.
_MARKS = ".,!?;:*%$#&"


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in a byte-level vocabulary: printable bytes stand
    for themselves, the others for the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER = _byte_letters()


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Memo(dict):
    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, p: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.clear()
        ids = self[p] = self.learn(p)
        return ids


class PieceEncoder:
    """``ids(text)``: the bytes of the text's ids, little-endian unsigned 32-bit."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(file)
        self.memo = _Memo(self.piece)
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return _pack(self.tok.encode(text, add_special_tokens=False).ids)

    def marks(self, run: str) -> bytes:
        """A run of punctuation, empty or not."""
        ids = self.words.get(run)
        if ids is None:
            ids = self.words[run] = self.whole(run)
        return ids

    def word(self, letters: str) -> bytes:
        """A pre-token, through the model alone."""
        ids = self.words.get(letters)
        if ids is None:
            if len(self.words) >= MEMO_PIECES:
                self.words.clear()
            mapped = letters if letters.isascii() and letters[0] != " " else (
                letters.encode().decode("latin-1").translate(_LETTER))
            ids = self.words[letters] = _pack([t.id for t in self.tok.model.tokenize(mapped)])
        return ids

    def piece(self, p: str) -> bytes:
        raise NotImplementedError

    def joined(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.memo.__getitem__, pieces))

    def ids(self, text: str) -> bytes:
        raise NotImplementedError


class WordEncoder(PieceEncoder):
    """For a tokenizer that lower-cases and drops white space (word_bpe_49k): no token spans a
    space or a line feed.  A piece of Latin-1 letters is what normalisation leaves as it is but
    for the case."""

    def piece(self, p: str) -> bytes:
        core = p.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or max(core) < "Ā"):
            return self.word(core.lower()) + self.marks(p[len(core):])
        return self.whole(p)

    def ids(self, text: str) -> bytes:
        return self.joined(text.replace("\n", " ").split(" "))


# White space other than the space and the line feed, to Unicode or to some regex engine.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_PAIRS = ("  ", "\n\n", " \n", "\n ")


class ByteEncoder(PieceEncoder):
    """For a byte-level tokenizer (byte_bpe_50k).  A character that is not white space followed
    by one that is always ends a pre-token, and what follows depends on nothing before it.  The
    pieces of a text whose white space is single spaces and line feeds inside it: a word with the
    line feed before it, or without one, and then a space stands before it.  Another text is
    encoded whole."""

    def piece(self, p: str) -> bytes:
        feed = p[0] == "\n"
        core = p.rstrip(_MARKS)
        letters = core[1:] if feed else core
        if letters.isalpha():
            ids = (self.marks("\n") + self.word(letters)) if feed else self.word(" " + letters)
            return ids + self.marks(p[len(core):])
        return self.whole(p if feed else " " + p)

    def ids(self, text: str) -> bytes:
        if not text or text[0] in " \n" or text[-1] in " \n" or _ODD.search(text) or any(
                x in text for x in _PAIRS):
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.whole(first) + self.joined(rest)


class RankEncoder:
    """For a byte-level vocabulary given as ranks (byte_bpe_50k.tiktoken), with the pattern that
    cuts pre-tokens; strings of special tokens are ordinary text."""

    def __init__(self, file: str):
        import base64
        import public_tokenizers
        import tiktoken
        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={})

    def ids(self, text: str) -> bytes:
        return self.enc.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


_ENCODERS: dict = {}


def encoder(kind: type, file: str):
    """One per worker process, kept between tasks."""
    if (kind, file) not in _ENCODERS:
        _ENCODERS[kind, file] = kind(file)
    return _ENCODERS[kind, file]
