"""Benchmark decontamination with a positional inverted index.

A benchmark item is cut into windows of ``n`` consecutive words (an item with fewer words is one
window).  For each window the two words that are rarest in the training documents are its
anchors; a window with a word that no document has cannot occur and is left out.  The postings
(word, document, position) of all anchor words are stored as a table.  The rarest anchor's
postings, moved back by its offset in the window, are possible starts of an occurrence; they are
intersected with the moved postings of the second rarest.  What remains is compared word by word
with the document.  ``proximity_matches`` asks the same index for anchors near each other.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, store

N = 13
BROADCAST_BYTES = 32_000_000  # a side of up to so many bytes, as counted, is sent to every executor


def words(text: Column) -> Column:
    """Runs of digits, letters and everything beyond ASCII, A-Z lower-cased; null has none."""
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(split, "")


def _size(df: DataFrame) -> int:
    """Bytes of the rows: texts as they are, 16 for anything else."""
    each = [F.coalesce(F.octet_length(c), F.lit(0)) + 16 if t == "string" else F.lit(16) for c, t in df.dtypes]
    return df.agg(F.sum(sum(each, F.lit(0)))).first()[0] or 0


def _small(df: DataFrame, size: int) -> DataFrame:
    """Broadcast behind a check of its size; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, h, words): rows of one id and text are told from others by the text's hash."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("words"))


def build_windows(items: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame]:
    """Stored (wid, phrase, len) of the distinct windows, and (item_id, wid)."""
    w = items.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    each = (w.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))),
        lambda s: F.concat_ws(" ", F.slice("words", s, n)))).alias("phrase")).distinct())
    each = store(each)
    windows = store(each.select("phrase").distinct()
                    .select(F.monotonically_increasing_id().alias("wid"), "phrase",
                            F.size(F.split("phrase", " ")).alias("len")))
    return windows, store(each.join(windows, "phrase").select("item_id", "wid"))


def _postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, doc_id, h, pos) of the words that are in ``terms``."""
    at = _documents(docs).select("doc_id", "h", F.posexplode("words").alias("pos", "term"))
    return at.join(_small(terms, n_terms), "term")


def build_index(docs: DataFrame, windows: DataFrame, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """The stored postings of the anchor words, and the anchors (wid, phrase, len, rank, term,
    off): rank 1 is the rarest of the window's words that some document has, rank 2 the next, if there
    are two.  ``whole`` leaves out windows with a word that no document has, which no phrase matches."""
    terms = windows.select("wid", "phrase", "len", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    vocabulary = store(terms.select("term").distinct())
    n_terms = _size(vocabulary)
    counts = (_documents(docs).select(F.explode("words").alias("term"))
              .join(_small(vocabulary, n_terms), "term").groupBy("term").agg(F.count("*").alias("cf")))
    order = W.partitionBy("wid").orderBy("cf", "term", "off")
    anchors = store(terms.join(_small(counts, n_terms), "term")  # at most a row for each word of an item
                    .withColumn("known", F.count("*").over(W.partitionBy("wid")))
                    .filter((F.col("known") == F.col("len")) if whole else F.lit(True))
                    .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2)
                    .select("wid", "phrase", "len", "rank", "term", "off"))
    rare = store(anchors.select("term").distinct())
    return store(_postings(docs, rare, _size(rare))), anchors


def phrase_candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, h, wid, phrase, len, start): where both anchors of a window are in their places."""
    n = _size(anchors)

    def moved(rank: int) -> DataFrame:
        a = _small(anchors.filter(F.col("rank") == rank), n)
        return (index.join(a, "term").select("doc_id", "h", "wid", "phrase", "len",
                                             (F.col("pos") - F.col("off")).alias("start"))
                .filter(F.col("start") >= 0))
    first, second = moved(1), moved(2).select("doc_id", "h", "wid", "start")
    same = (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))
            & (F.col("a.wid") == F.col("b.wid")) & (F.col("a.start") == F.col("b.start")))
    both = first.filter(F.col("len") > 1).alias("a").join(second.alias("b"), same, "left_semi")
    return both.unionByName(first.filter(F.col("len") == 1)).distinct()


def proximity_matches(docs: DataFrame, index: DataFrame, anchors: DataFrame, slop: int, missing: int = 0) -> DataFrame:
    """(doc_id, h, wid, start, distance, missing): where the words of a window stand near their places.

    ``index`` and ``anchors`` are of ``build_index(docs, windows, whole=False)``.  A window stands at
    ``start`` when its rarest known word is in its place there, the next rarest at most ``slop`` places off its
    own, and all but ``missing`` of the window's words at most ``slop`` off theirs; ``distance`` is the
    farthest of those.  A word that no document has is always missing; where an anchor itself is, the
    window is not found at that place.  A window with one known word has that anchor alone.

    Positions are dealt into stretches of ``slop``, so that the anchors' join is by equality; the other words
    are looked up in the document.  A null or empty text has no words.  Null ids are ids like any other;
    repeated rows are one; no documents or windows give no rows.
    """
    n = _size(anchors)

    def moved(rank: int) -> DataFrame:
        a = _small(anchors.filter(F.col("rank") == rank).select("wid", "term", "off"), n)
        return index.join(a, "term").select("doc_id", "h", "wid", (F.col("pos") - F.col("off")).alias("start"))
    step = max(slop, 1)
    cell = lambda c: F.floor(F.col(c) / step)
    x = moved(1).withColumn("cell", cell("start")).alias("x")
    y = moved(2).select("doc_id", "h", "wid", F.col("start").alias("other"),
                        F.explode(F.sequence(cell("start") - 1, cell("start") + 1)).alias("cell")).alias("y")
    on = (F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.h") == F.col("y.h"))
          & (F.col("x.wid") == F.col("y.wid")) & (F.col("x.cell") == F.col("y.cell")))
    near = F.abs(F.col("start") - F.col("other")) <= slop
    two = x.join(y, on).filter(near).select("x.doc_id", "x.h", "x.wid", "start")
    alone = anchors.groupBy("wid").agg(F.max("rank").alias("r")).filter("r = 1").select("wid")
    phrases = anchors.filter("rank = 1").select("wid", "phrase")
    cands = (two.unionByName(moved(1).join(_small(alone, n), "wid", "left_semi")).distinct()
             .join(_small(phrases, n), "wid"))
    per = cands.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "wid", "phrase")).alias("cands")).alias("c")
    d = _documents(docs).dropDuplicates(["doc_id", "h"]).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.h") == F.col("c.h"))
    both = per.join(d, on).select("d.doc_id", "d.h", "words", F.explode("cands").alias("c"))

    def away(w, i):  # how far the nearest such word is from its place; NULL beyond the slop
        at = F.col("c.start") + i
        low, high = F.greatest(at - slop, F.lit(0)), F.least(at + slop, F.size("words") - 1)
        places = F.when(low <= high, F.filter(F.sequence(low, high), lambda p: F.get(F.col("words"), p) == w))
        return F.array_min(F.transform(places, lambda p: F.abs(p - at)))
    offs = F.transform(F.split("c.phrase", " "), away)
    out = both.withColumn("offs", offs).select(
        "doc_id", "h", "c.wid", "c.start", F.array_max("offs").alias("distance"),
        F.size(F.filter("offs", lambda o: o.isNull())).alias("missing"))
    return out.filter(F.col("missing") <= missing)


def contamination(docs: DataFrame, items: DataFrame, n: int = N, share: int = 20) -> DataFrame:
    """(doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs``; h is
    the hash of the text.

    A word inside any occurrence of a window is hit; a document is contaminated when it has hit
    words and they are at least one in ``share``.  A null or empty text has no words.  Null ids
    are kept; a null item_id counts as one item and adds nothing to the digest, and rows of one
    item_id are one item.  Repeated rows each give the same result.  An empty table on either
    side gives no hits; other columns are ignored.
    """
    windows, item_windows = build_windows(items, n)
    index, anchors = build_index(docs, windows)
    found = store(phrase_candidates(index, anchors)
                  .groupBy("doc_id", "h")
                  .agg(F.collect_set(F.struct("start", "len", "wid", "phrase")).alias("cands")))
    each = F.aggregate("cands", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["phrase"]) + 32)
    size = found.agg(F.coalesce(F.sum(each + 32), F.lit(0))).first()[0]
    d, c = _documents(docs).alias("d"), _small(found, size).alias("c")
    on = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.h") == F.col("c.h"))
    there = F.filter(F.coalesce("cands", F.array().cast(found.schema["cands"].dataType)),
                     lambda x: F.concat_ws(" ", F.slice(F.col("words"), x["start"] + 1, x["len"])) == x["phrase"])
    spans = F.array_sort(F.transform("hits", lambda x: F.struct(
        x["start"].alias("s"), (x["start"] + x["len"]).alias("e"))))
    n_hit = F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["e"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["s"]))).alias("n")),
        lambda acc: acc["n"].cast("long"))
    rows = store(d.join(c, on, "left")
                 .select("d.doc_id", "d.h", F.size("words").cast("long").alias("n_words"), there.alias("hits"))
                 .select("doc_id", "h", "n_words", n_hit.alias("n_hit"),
                         F.array_distinct(F.transform("hits", lambda x: x["wid"])).alias("wids")))
    hit = rows.filter(F.col("n_hit") > 0).dropDuplicates(["doc_id", "h"])
    of = (hit.select("doc_id", "h", F.explode("wids").alias("wid"))
          .join(_small(item_windows, _size(item_windows)), "wid")
          .select("doc_id", "h", "item_id").distinct()
          .groupBy("doc_id", "h").agg(F.count("*").alias("n_items"),
                                      F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("ids")))
    r, o = rows.alias("r"), of.alias("o")
    on = F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.h") == F.col("o.h"))
    ids = F.concat_ws(",", F.coalesce("ids", F.array().cast("array<string>")))
    return r.join(o, on, "left").select(
        "r.doc_id", "r.h", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = N, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    A null or empty text has no words and stays.  Null ids are ids like any other; repeated rows stay or
    go alike.  Without items all rows stay; an empty table gives an empty table.
    """
    bad = (contamination(docs, items, n, share).filter("contaminated")
           .select("doc_id", "h").distinct().alias("b"))
    name = free_name(docs, "_h")
    d = docs.withColumn(name, F.xxhash64("text")).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"d.{name}") == F.col("b.h"))
    return d.join(bad, on, "left_anti").drop(name)
