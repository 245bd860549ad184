"""Byte-level BPE by a pair occurrence index, and back to text.

The pre-tokens that an Arrow batch of a partition holds, each distinct one once, are laid out as
one list of symbols linked to their neighbours.  An index maps every pair of neighbours that the
vocabulary merges to all positions where it stands.  A heap holds the ranks that are active; the
lowest is applied to all its positions from left to right, and each merge puts the two pairs it
makes into the lists they belong to.  Positions that a merge has used up are told by their symbols
and skipped.  It ends when no rank is active.

A merge can only make pairs of higher rank where every merged symbol is made before it is used.
``Merges`` checks that of the file, since the order across pre-tokens rests on it.

Texts are cut where no pre-token spans: around special strings, and, where a text's white space is
single spaces and line feeds, in front of each space.  What a worker has seen before comes from a
bounded memo.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_ROWS
from .tokens import _LETTER, _MARKS, _ODD, _PAIRS

VECTOR = 48  # a list of so many places is worked through as a vector
MEMO_WORDS = 400_000  # entries of each of a worker's two memos
TEXT_CHARS = 1_000_000  # of a batch, texts of so many characters are encoded together, or one longer text


def _simple_spacing(text: str) -> bool:
    """Whether white space is single spaces and line feeds, and none at the ends: then a pre-token
    ends in front of every space, and nothing before it matters to what follows."""
    return not (text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _PAIRS) or _ODD.search(text))


def _pieces(text: str) -> list[str]:
    """A simply spaced text, cut in front of its spaces (which are left out) and line feeds; a tab
    marks the first piece, which has nothing before it."""
    pieces = text.replace("\n", " \n").split(" ")
    pieces[0] = "\t" + pieces[0]
    return pieces


class Merges:
    """What a tokenizers file of kind byte-level BPE says: symbols of bytes, merges, special strings."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre, back = spec["pre_tokenizer"] or {}, spec["decoder"] or {}
        if (model["type"] != "BPE" or pre.get("type") != "ByteLevel" or back.get("type") != "ByteLevel"
                or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or spec["post_processor"]
                or model["byte_fallback"] or model["ignore_merges"] or model["dropout"]
                or model["continuing_subword_prefix"] or model["end_of_word_suffix"]):
            raise ValueError("not a plain byte-level BPE file")
        vocab = model["vocab"]
        letter = _LETTER
        self.byte = np.array([vocab[letter[b]] for b in range(256)])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # (left, right) as one number -> (rank, what they become)
        self.pairs: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        made_at: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault(x << 32 | y, rank)
            self.left.append(x)
            self.right.append(y)
            self.made.append(z)
            made_at[z] = max(rank, made_at.get(z, rank))
        self.ordered = all(made_at.get(s, -1) < rank for rank, (x, y) in enumerate(zip(self.left, self.right))
                           for s in (x, y))
        if not self.ordered:
            raise ValueError("the merges use a symbol before the last merge that makes it")
        self.byte_pairs = np.array([[self.pairs.get(x << 32 | y, -1) for y in self.byte.tolist()]
                                    for x in self.byte.tolist()])
        by_key = sorted(self.pairs.items())
        self.keys = np.array([k for k, _ in by_key] or [-1], dtype=np.int64)
        self.key_ranks = np.array([r for _, r in by_key] or [-1], dtype=np.int64)
        byte_of = {v: k for k, v in letter.items()}
        self.bytes = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special strings that take their surroundings")
        self.special = special
        # as the library's decoder reads them: letters of the byte alphabet are bytes
        self.bytes |= {i: bytes(map(byte_of.get, s)) if byte_of.keys() >= set(s) else s.encode()
                       for s, i in special.items()}
        # of special strings that start at the same place, the longest
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")

    def ranks(self, left, right) -> np.ndarray:
        """The rank of each pair, -1 where it is not merged."""
        key = np.asarray(left, dtype=np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], -1)

    def encode_all(self, words: Iterable[bytes]) -> list[bytes]:
        """The ids of each pre-token (not empty), as little-endian unsigned 32-bit numbers."""
        words = list(words)
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(raw)
        ends = np.cumsum([len(w) for w in words])
        last = np.zeros(n, dtype=bool)
        last[ends - 1] = True
        # links to the neighbours in the same pre-token; place n stands for "none".  The arrays are
        # read one by one where a list is short, and as vectors where it is long.
        here = np.arange(n + 1)
        after, before, sym = (array("q", x.tobytes()) for x in (
            np.append(np.where(last, n, here[1:]), n),
            np.concatenate(([n], np.where(last, n, here[:-1])[:-1], [n])), np.append(self.byte[raw], -1)))
        after_v, before_v, sym_v = (np.frombuffer(x, dtype=np.int64) for x in (after, before, sym))
        # the index: rank -> places
        places: dict[int, list[int]] = {}
        active: list[int] = []

        def note(ranks: np.ndarray, at: np.ndarray) -> None:
            """Puts places into the lists of their ranks; rank -1 is none."""
            merged = ranks >= 0
            ranks, at = ranks[merged], at[merged]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order].tolist()
            first = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            for r, i, j in zip(ranks[first[:-1]].tolist(), first, first[1:]):
                held = places.get(r)
                if held is None:
                    places[r] = at[i:j]
                    heappush(active, r)
                else:
                    held += at[i:j]

        if n > 1:
            note(np.where(last[:-1], -1, self.byte_pairs[raw[:-1], raw[1:]]), np.arange(n - 1))
        rank_of, left, right, made = self.pairs.get, self.left, self.right, self.made
        while active:
            low = heappop(active)
            a, b, z = left[low], right[low], made[low]
            at = places.pop(low)
            if a != b and len(at) >= VECTOR:  # places of two different symbols do not overlap
                i = np.array(at)
                j = after_v[i]
                ok = (sym_v[i] == a) & (sym_v[j] == b)
                i, j = i[ok], j[ok]
                sym_v[i], sym_v[j] = z, -2  # the right half is used up
                k, p = after_v[j], before_v[i]
                after_v[i] = k
                before_v[k] = i
                note(self.ranks(sym_v[p], z), p)
                note(self.ranks(z, sym_v[k]), i)
                continue
            at.sort()
            for i in at:
                if sym[i] != a:
                    continue
                j = after[i]
                if sym[j] != b:
                    continue
                sym[i], sym[j] = z, -2
                k = after[i] = after[j]
                before[k] = i
                p = before[i]
                r = rank_of(sym[p] << 32 | z)
                if r is not None:
                    held = places.get(r)
                    if held is None:
                        places[r] = [p]
                        heappush(active, r)
                    else:
                        held.append(p)
                r = rank_of(z << 32 | sym[k])
                if r is not None:
                    held = places.get(r)
                    if held is None:
                        places[r] = [i]
                        heappush(active, r)
                    else:
                        held.append(i)
        left_over = sym_v[:-1]
        alive = left_over >= 0
        ids = left_over[alive].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(alive)[ends - 1]).tolist()]
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]


class _Recent(dict):
    """A bounded memo of two generations: what was not asked for since the last change of
    generations is forgotten at the next."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.old = most // 2, {}

    def known(self, keys: Iterable) -> tuple[dict, list]:
        """What is known of the keys, and the other keys."""
        got, new, old = {}, [], self.old
        for k in keys:
            v = self.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    new.append(k)
                    continue
                self[k] = v
            got[k] = v
        return got, new

    def learn(self, more: dict) -> None:
        if len(self) + len(more) > self.half:
            self.old = dict(self)
            self.clear()
        self.update(list(more.items())[:self.half])


class BatchEncoder:
    """Encodes the texts of a batch together; what was seen before comes from bounded memos."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        self.merges = Merges(file)
        self._pre = Tokenizer.from_file(file).pre_tokenizer.pre_tokenize_str
        self._byte = {c: b for b, c in _LETTER.items()}
        self.words, self.pieces = _Recent(MEMO_WORDS), _Recent(MEMO_WORDS)

    def pre_tokens(self, piece: str) -> list[bytes]:
        """The pre-tokens of a piece (see ``_pieces``), as bytes."""
        lead, body = (piece[0], piece[1:]) if piece[0] in "\t\n" else (" ", piece)
        core = body.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or max(core) < "Ͱ"):
            words = [b" " + core.encode()] if lead == " " else [core.encode()]
            if lead == "\n":
                words.insert(0, b"\n")
            if len(core) < len(body):
                words.append(body[len(core):].encode())
            return words
        return self.any_pre_tokens(body if lead == "\t" else lead + body)

    def any_pre_tokens(self, text: str) -> list[bytes]:
        byte = self._byte
        return [bytes(map(byte.__getitem__, s)) for s, _ in self._pre(text)]

    def _encode_cut(self, cut: dict) -> dict:
        """Key -> pre-tokens to key -> ids; the new pre-tokens go through the index together."""
        known, new = self.words.known({w for ws in cut.values() for w in ws})
        more = dict(zip(new, self.merges.encode_all(new)))
        self.words.learn(more)
        known |= more
        get = known.__getitem__
        return {k: b"".join(map(get, ws)) for k, ws in cut.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        # a text is a list of: the ids of a special string, a list of pieces, or an odd segment
        plan: list[list] = []
        distinct: set[str] = set()
        odd: dict[str, list[bytes]] = {}
        for text in texts:
            parts: list = []
            at = 0
            for m in [*self.merges.cut.finditer(text), None]:
                segment = text[at:m.start() if m else len(text)]
                if segment and _simple_spacing(segment):
                    parts.append(_pieces(segment))
                    distinct.update(parts[-1])
                elif segment:
                    odd[segment] = self.any_pre_tokens(segment)
                    parts.append(segment)
                if m:
                    parts.append(array("I", [self.merges.special[m[0]]]).tobytes())
                    at = m.end()
            plan.append(parts)
        known, new = self.pieces.known(distinct)
        more = self._encode_cut({p: self.pre_tokens(p) for p in new})
        self.pieces.learn(more)
        known |= more
        whole = self._encode_cut(odd)  # a whole segment is not worth keeping
        get = known.__getitem__
        return [b"".join(part if isinstance(part, bytes) else whole[part] if isinstance(part, str)
                         else b"".join(map(get, part)) for part in parts) for parts in plan]


_KEPT: dict = {}


def _kept(kind: type, file: str):
    """One of each per worker process."""
    if (kind, file) not in _KEPT:
        _KEPT[kind, file] = kind(file)
    return _KEPT[kind, file]


def _encode(file: str):
    def run(batches):
        enc = _kept(BatchEncoder, file)
        for b in batches:
            ids: list[bytes] = []
            texts = b.column("text").to_pylist()
            held = 0
            for i, text in enumerate(texts):
                held += len(text)
                if held >= TEXT_CHARS or i == len(texts) - 1:
                    ids += enc.encode(texts[len(ids):i + 1])
                    held = 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])
    return run


def _decode(file: str):
    def run(batches):
        of = _kept(Merges, file).bytes
        for b in batches:
            texts = []
            for ids in b.column("ids").to_pylist():
                known = map(of.get, array("I", ids)) if ids else ()
                texts.append(b"".join(x for x in known if x is not None).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
    return run


def encode_documents(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, ids) per row of ``docs``: ids as little-endian unsigned 32-bit numbers, the ones that
    the tokenizers library gives for ``file`` without added special tokens, truncation and padding.

    Special strings inside a text become their ids, as there.  A null text counts as empty and has no
    ids; so has a text of length 0.  A null doc_id is kept.  Repeated rows and repeated ids each give
    their own row.  An empty table gives no rows; other columns are ignored.  A text of any length is
    encoded whole.  Rows need no shuffle; a batch holds at most ``LONG_ROWS`` texts (the session's
    ``spark.sql.execution.arrow.maxRecordsPerBatch``, where that is less).
    """
    kind = dict(docs.dtypes)["doc_id"]
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(_encode(file), f"doc_id {kind}, ids binary"))


def decode_documents(encoded: DataFrame, file: str) -> DataFrame:
    """(doc_id, ids, text) per row of ``encoded`` (doc_id, ids): the text that the ids stand for, special
    strings included.  Bytes that are no UTF-8 become U+FFFD, ids without a symbol nothing; null or empty
    ids are the empty text.  Other columns are ignored."""
    kind = dict(encoded.dtypes)["doc_id"]
    return (encoded.select("doc_id", "ids")
            .mapInArrow(_decode(file), f"doc_id {kind}, ids binary, text string"))
