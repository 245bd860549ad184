"""Personal data by patterns, and information-theoretic sanitisation of what reveals it.

The patterns find protected entities: mail and IP addresses, payment cards, phone numbers.  A word
that keeps company with an entity reveals it even where the entity itself is masked.  How strongly
is estimated from the corpus: with P the share of the documents holding a word in which it stands
near the entity, reading the word leaves -log2 P bits of doubt about the entity (the entity's own
information content minus the pointwise mutual information of the two).  A word that leaves at
most ``generalise_bits`` is generalised wherever it occurs, one that leaves at most
``remove_bits`` is removed.  A pair counts once it has been seen in ``support`` different contexts,
so that copies of one passage prove nothing, and in as many documents, so that one long document
does not either.
"""

from __future__ import annotations

import re
import string
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_ROWS, free_name, store

KINDS = ("email", "ip", "card", "phone", "term")
NEAR, SUPPORT, GENERALISE_BITS, REMOVE_BITS = 8, 3, 1.0, 0.05
BROADCAST_TERMS = 200_000
FLUSH, MEMO_WORDS = 200_000, 150_000

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_TOKEN = re.compile(r"\S+")
_EDGE = string.punctuation + string.digits + "«»„“”‘’…–—¿¡"


def _emails(text: str):
    """Leftmost matches, found from the at signs: the local part is the run of its letters before
    the sign, so a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points; kind is an index into KINDS."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 or not p.lstrip("0")[3:] for p in m[0].split(".")) and all(
                int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _DIGITS.sub("", m[0])
            if 14 <= len(d) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def word_of(token: str) -> str:
    """The lower-case word inside a token, '' if it has not only letters or fewer than two."""
    w = token.strip(_EDGE).lower()
    return w if len(w) > 1 and w.isalpha() else ""


class _Words(dict):
    def __missing__(self, token: str) -> str:
        if len(self) >= MEMO_WORDS:
            self.clear()
        w = self[token] = word_of(token)
        return w


def _entity(kind: int, value: str) -> int:
    value = value.lower() if kind < 2 else _DIGITS.sub("", value)
    return xxhash.xxh3_64_intdigest(f"{KINDS[kind]}:{value}") - (1 << 63)


def _company(text: str, spans, near: int):
    """(entity, word, context) for each word within ``near`` words of an entity; the context is a
    hash of the words around, whatever the entities."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    masked = [any(s < e1 and s1 < e for s1, _, e1 in spans) for s, e, _ in tokens] if len(spans) < 50 else None
    if masked is None:
        masked, k = [], 0
        for s, e, _ in tokens:
            while k < len(spans) and spans[k][2] <= s:
                k += 1
            masked.append(k < len(spans) and spans[k][0] < e)
    words = ["" if x else word_of(t) for (_, _, t), x in zip(tokens, masked)]
    starts = [s for s, _, _ in tokens]
    from bisect import bisect_left, bisect_right
    out = set()
    for s, kind, e in spans:
        i, j = max(bisect_right(starts, s) - 1, 0), bisect_left(starts, e)
        around = words[max(0, i - near):i] + words[j:j + near]
        context = xxhash.xxh3_64_intdigest(" ".join(around)) - (1 << 63)
        ent = _entity(kind, text[s:e])
        out.update((ent, w, context) for w in around if w)
    return out


def _statistics(near: int):
    """Rows (entity, word, context, n): company of entities, and, with a null entity, in how many
    of the task's documents a word is.  Of a document's contexts of one pair the first has n = 1
    and the others 0, so that the sum of a pair's n is its number of documents."""
    def run(batches):
        memo, df, rows = _Words(), Counter(), []

        def out():
            rows.extend((None, w, None, n) for w, n in df.items())
            cols = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                ["entity", "word", "context", "n"])
        for b in batches:
            for text in b.column("text").to_pylist():
                words = {memo[t] for t in set(text.split())}
                words.discard("")
                df.update(words)
                spans = base_spans(text)
                if spans:
                    seen = set()
                    for e, w, c in _company(text, spans, near):
                        rows.append((e, w, c, int((e, w) not in seen)))
                        seen.add((e, w))
                if len(df) + len(rows) > FLUSH:
                    yield out()
                    df, rows = Counter(), []
        yield out()
    return run


def disclosing_terms(docs: DataFrame, near: int = NEAR, support: int = SUPPORT,
                     generalise_bits: float = GENERALISE_BITS) -> DataFrame:
    """Stored (word, bits): the words that leave at most ``generalise_bits`` of doubt about some
    entity, from counts over all documents."""
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    stats = store(text.mapInArrow(_statistics(near), "entity long, word string, context long, n long"), LONG_ROWS)
    pairs = (stats.filter(F.col("entity").isNotNull()).groupBy("entity", "word", "context")
             .agg(F.sum("n").alias("n"))
             .groupBy("entity", "word").agg(F.sum("n").alias("n"), F.count("*").alias("contexts"))
             .filter((F.col("contexts") >= support) & (F.col("n") >= support))
             .groupBy("word").agg(F.max("n").alias("together")))
    held = stats.filter(F.col("entity").isNull()).groupBy("word").agg(F.sum("n").alias("n"))
    bits = F.log2(F.col("n") / F.col("together"))  # a document of the pair holds the word: not below 0
    return store(pairs.join(held, "word").select("word", bits.alias("bits"))
                 .filter(F.col("bits") <= generalise_bits))


def _term_spans(text: str, spans, words: dict, found) -> list[tuple[int, int, int]]:
    out, k = [], 0
    spans = sorted(spans)
    for m in _TOKEN.finditer(text):
        if found[m[0]] in words:
            core = m[0].strip(_EDGE)
            s = m.start() + m[0].index(core)
            e = s + len(core)
            if not any(s < e1 and s1 < e for s1, _, e1 in spans):
                out.append((s, 4, e))
    return out


def all_spans(text: str, words: dict[str, float], memo: dict | None = None) -> list[tuple[int, int, int]]:
    """Base spans, and the spans of disclosing words outside them."""
    memo = _Words() if memo is None else memo
    spans = base_spans(text)
    if words and any(memo[t] in words for t in set(text.split())):
        spans = sorted(spans + _term_spans(text, spans, words, memo))
    return spans


def sanitise(text: str, spans, words: dict[str, float], remove_bits: float = REMOVE_BITS) -> str:
    """The text with entities and generalised words replaced by their kind and removed words gone;
    overlapping spans are one, of the first's kind."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out.append(text[at:s])
            gone = kind == 4 and words.get(word_of(text[s:e]), 9.0) <= remove_bits
            out.append("" if gone else "[" + ("related" if kind == 4 else KINDS[kind]).upper() + "]")
        at = max(at, e)
    return "".join(out) + text[at:]


def _with_terms(docs: DataFrame, terms: DataFrame, most: int) -> tuple[DataFrame, dict | None]:
    """The documents, and either the terms for a broadcast, behind a check of how many there are,
    or the documents with the terms that each of them holds (by joins) as the last column."""
    if terms.count() <= most:
        return docs, {r["word"]: r["bits"] for r in terms.collect()}

    def held(batches):
        memo = _Words()
        for b in batches:
            row, word = [], []
            for r, text in zip(b.column("_row").to_pylist(), b.column("text").to_pylist()):
                words = {memo[t] for t in set((text or "").split())}
                row += [r] * len(words)
                word += words
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(word, pa.string())],
                                             ["_row", "word"])
    row, own = free_name(docs, "_row"), free_name(docs, "_terms")
    rows = store(docs.withColumn(row, F.monotonically_increasing_id()))
    mine = (rows.select(F.col(row).alias("_row"), "text").mapInArrow(held, "_row long, word string")
            .join(terms, "word").groupBy(F.col("_row").alias(row))
            .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias(own)))
    return rows.join(mine, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], own), None


def _texts(b: pa.RecordBatch, words: dict | None):
    own = b.column(b.num_columns - 1).to_pylist() if words is None else None
    for i, text in enumerate(b.column("text").to_pylist()):
        yield text or "", (words if own is None else dict(own[i] or ()))


def find_personal_data(docs: DataFrame, near: int = NEAR, support: int = SUPPORT,
                       generalise_bits: float = GENERALISE_BITS, most: int = BROADCAST_TERMS,
                       with_text: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_term[, sanitised]) per row; base
    and spans are kind:start:end, comma-joined, in code points with the end exclusive.

    A null text counts as empty and has no spans.  Null ids and repeated rows are kept; an empty
    table gives no rows; other columns are ignored.
    """
    d = docs.select("doc_id", "text")
    d, words = _with_terms(d, disclosing_terms(d, near, support, generalise_bits), most)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        memo = _Words()
        for b in batches:
            rows = []
            for text, mine in _texts(b, shared.value):
                spans = all_spans(text, mine, memo)
                n = Counter(k for _, k, _ in spans)
                show = lambda x: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x)
                rows.append((*(n[k] for k in range(4)), show([x for x in spans if x[1] < 4]), show(spans), n[4],
                             sanitise(text, spans, mine)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            cols = list(zip(*rows)) if rows else [[]] * 8
            names = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_term", "sanitised"]
            keep = len(names) - (not with_text)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols[:keep], kinds))],
                ["doc_id", *names[:keep]])
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, "
                             "n_phone long, base string, spans string, n_term long"
                             + ", sanitised string" * with_text)


def sanitise_documents(docs: DataFrame, near: int = NEAR, support: int = SUPPORT,
                       generalise_bits: float = GENERALISE_BITS, most: int = BROADCAST_TERMS) -> DataFrame:
    """``docs`` with the texts sanitised; other columns stay as they are, whatever they are called.

    A null text stays null, an empty one empty.  Null ids do not matter; repeated rows are changed alike;
    an empty table gives an empty table.
    """
    d, words = _with_terms(docs, disclosing_terms(docs, near, support, generalise_bits), most)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        memo = _Words()
        for b in batches:
            null = b.column("text").is_null().to_pylist()
            out = [None if x else sanitise(t, all_spans(t, mine, memo), mine)
                   for x, (t, mine) in zip(null, _texts(b, shared.value))]
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(out, b.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(cols, names)
    return d.mapInArrow(run, docs.schema)
