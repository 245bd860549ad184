"""Toxicity by a counterfactual-regularised linear classifier.

Features are the distinct words of a text and their beginnings (3 to 7 letters), so that an
inflected word that the labels never show still has its stem's weight.  The features that tell
toxic labels from others best are chosen by an aggregate over the training rows.  For every
training text with identity terms there are counterfactuals: the same text with each term swapped
for others and for a neutral noun.  Logistic regression is fitted with a penalty on the squared
difference between a text's score and its counterfactuals' scores (as logits), so that a group's mention by
itself neither raises nor lowers a score, however the labels are distributed over the groups.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

TRAINING_ROWS = 20_000  # at most so many labelled rows are fitted on
FEATURES = 8192
MIN_G2 = 10.8  # a chance of one in a thousand for a feature that means nothing
MEMO_WORDS = 150_000
# Identity terms by language and kind.  Groups are set apart by ";", the forms of one
# group by spaces; a term is swapped for a form of every other group of its kind, and for the neutral noun.
NEUTRAL = {"en": "people", "de": "menschen", "fr": "personnes", "es": "personas"}
IDENTITY = {
    "en": {
        "religion": "muslim muslims islam; christian christians; jew jews jewish; hindu hindus; buddhist buddhists; "
                    "sikh sikhs; atheist atheists; catholic catholics",
        "orientation": "gay; lesbian lesbians; bisexual; homosexual; heterosexual straight; queer lgbt lgbtq",
        "gender": "woman women female girl girls; man men male boy boys; transgender trans; nonbinary",
        "origin": "african; african-american; american; arab; asian; black; chinese; european; hispanic; indian; "
                  "latino latina; mexican; white; immigrant immigrants; refugee refugees",
        "ability": "disabled; deaf; blind; paralyzed; autistic", "age": "old elderly; young teenage"},
    "de": {
        "religion": "muslim muslime muslimisch; christ christen christlich; jude juden jüdisch; hindu hindus; buddhist buddhisten; "
                    "atheist atheisten; katholik katholiken",
        "orientation": "schwul schwule; lesbisch lesben; bisexuell; homosexuell; heterosexuell; queer",
        "gender": "frau frauen mädchen; mann männer jungen; transgender; nichtbinär",
        "origin": "afrikaner afrikanisch; araber arabisch; asiate asiatisch; türke türken; europäer europäisch; "
                  "ausländer; flüchtling flüchtlinge; deutscher deutsche",
        "ability": "behindert behinderte; taub taube; blind blinde; autistisch", "age": "alte alt; junge jung"},
    "fr": {
        "religion": "musulman musulmans islam; chrétien chrétiens; juif juifs; hindou hindous; bouddhiste bouddhistes; "
                    "athée athées; catholique catholiques",
        "orientation": "gay; lesbienne lesbiennes; bisexuel; homosexuel; hétérosexuel; queer",
        "gender": "femme femmes fille filles; homme hommes garçon garçons; transgenre; nonbinaire",
        "origin": "africain africains; arabe arabes; asiatique; noir noirs; blanc blancs; européen européens; "
                  "immigré immigrés; réfugié réfugiés",
        "ability": "handicapé; sourd; aveugle; autiste", "age": "vieux âgé; jeune"},
    "es": {
        "religion": "musulmán musulmanes islam; cristiano cristianos; judío judíos; hindú; budista budistas; ateo ateos; "
                    "católico católicos",
        "orientation": "gay; lesbiana lesbianas; bisexual; homosexual; heterosexual; queer",
        "gender": "mujer mujeres chica chicas; hombre hombres chico chicos; transgénero; nobinario",
        "origin": "africano africanos; árabe árabes; asiático; negro negros; blanco blancos; europeo europeos; "
                  "latino latina; inmigrante inmigrantes; refugiado refugiados",
        "ability": "discapacitado; sordo; ciego; autista", "age": "viejo anciano; joven"},
}


def swaps_of(identity: dict, neutral: dict) -> dict[str, tuple[str, ...]]:
    """Term -> what it is swapped for: of every other group of its kind and language the form at the same
    place (or the last), and the neutral noun.  A term of several languages has the swaps of all."""
    out: dict[str, set[str]] = {}
    for language, kinds in identity.items():
        for text in kinds.values():
            groups = [g.split() for g in text.split(";")]
            for g in groups:
                for i, term in enumerate(g):
                    others = {o[min(i, len(o) - 1)] for o in groups if o is not g} | {neutral[language]}
                    out.setdefault(term, set()).update(others - {term})
    return {t: tuple(sorted(o)) for t, o in out.items()}


SWAPS = swaps_of(IDENTITY, NEUTRAL)
_EDGE = string.punctuation + string.digits + "«»„“”‘’…–—¿¡"


def word_of(token: str) -> str:
    """The lower-case word of a token between white space, '' for what has no letters only."""
    w = token.strip(_EDGE).lower()
    return w if w.isalpha() or w in SWAPS else ""


def word_features(word: str) -> list[str]:
    """The word and, marked as beginnings, its first letters."""
    return ["=" + word, *("^" + word[:n] for n in range(3, min(7, len(word)) + 1))] if word else []


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = self[key] = self.make(key)
        return got


def text_words(text: str | None, memo: dict) -> set[str]:
    words = {memo[t] for t in set((text or "").split())}
    words.discard("")
    return words


def _features(words) -> set[str]:
    return {f for w in words for f in word_features(w)}


def training_rows(docs: DataFrame, labels: DataFrame, held_out, limit: int = TRAINING_ROWS) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled rows outside ``held_out(doc_id)``, chosen by a hash
    of the id.  Rows without an id or a label do not count; of several labels of one document the
    largest does; rows of one id and text are one row, and the limit holds for what is left of them."""
    chosen = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
              .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    keys = (rows.select("doc_id", "h").join(F.broadcast(chosen), "doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(limit))
    return (rows.join(F.broadcast(keys), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
            .select("text", "toxic"))


def _feature_counts(batches):
    memo, n = _Memo(word_of), {0: Counter(), 1: Counter()}

    def out():
        keys = list(n[0].keys() | n[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([n[0][k] for k in keys], pa.int64()),
             pa.array([n[1][k] for k in keys], pa.int64())], ["feature", "n0", "n1"])
    for b in batches:
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            n[int(y > 0)].update(_features(text_words(text, memo)))
        if len(n[0]) + len(n[1]) > 200_000:
            yield out()
            n = {0: Counter(), 1: Counter()}
    yield out()


def choose_features(rows: DataFrame, top: int | None = FEATURES) -> list[str]:
    """The ``top`` (None: all that are not by chance) features by the likelihood ratio (G2) of presence against label."""
    size = rows.groupBy((F.col("toxic") > 0).alias("y")).count().collect()
    total = {bool(r["y"]): r["count"] for r in size}
    t0, t1 = float(total.get(False, 0)), float(total.get(True, 0))
    if not t0 or not t1:
        return []
    n = (rows.mapInArrow(_feature_counts, "feature string, n0 long, n1 long")
         .groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
         .filter(F.col("n0") + F.col("n1") >= 3))

    def cell(x, row, column):
        return F.when(x > 0, x * F.log(x * (t0 + t1) / (row * column))).otherwise(0.0)
    has = (F.col("n0") + F.col("n1")).cast("double")
    lacks = F.lit(t0 + t1) - has
    g2 = (cell(F.col("n0"), has, F.lit(t0)) + cell(F.col("n1"), has, F.lit(t1))
          + cell(t0 - F.col("n0"), lacks, F.lit(t0)) + cell(t1 - F.col("n1"), lacks, F.lit(t1)))
    best = n.filter(has < t0 + t1).withColumn("g2", g2).filter(F.col("g2") > MIN_G2).orderBy(F.desc("g2"), "feature")
    best = best if top is None else best.limit(top)
    return [r["feature"] for r in best.select("feature").collect()]


def counterfactuals(words: set[str], swaps: dict = SWAPS) -> list[set[str]]:
    """The word sets with each identity term swapped, for every group of its kind and for a neutral noun."""
    return [(words - {w}) | {other} for w in sorted(words & swaps.keys()) for other in swaps[w]]


def _indexed(index: dict[str, int], swaps: dict = SWAPS):
    def run(batches):
        memo = _Memo(word_of)
        of = lambda words: sorted({index[f] for f in _features(words) if f in index})
        for b in batches:
            y, x, other = [], [], []
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = text_words(text, memo)
                y.append(int(label > 0))
                x.append(of(words))
                other.append([of(c) for c in counterfactuals(words, swaps)])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, ints),
                                              pa.array(other, pa.list_(ints))], ["y", "x", "other"])
    return run


@dataclass(frozen=True)
class ToxicityModel:
    """``bias`` plus the weights of the features that a text has, through the logistic function."""
    bias: float
    weights: dict[str, float]

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(self.weights.get(f, 0.0) for f in _features(words))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


class _Rows:
    """Sets of feature numbers as a sparse matrix."""

    def __init__(self, rows: list[list[int]], n: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], dtype=np.int64)
        self.m, self.n = len(rows), n

    def dot(self, w):
        return np.bincount(self.row, weights=w[self.col], minlength=self.m)

    def back(self, g):
        return np.bincount(self.col, weights=g[self.row], minlength=self.n)


def fit(y, x, other, n: int, swap: float = 1.0, ridge: float = 2e-5, steps: int = 400):
    """(bias, weights): full-batch Adam on the log loss, ``swap`` times the mean squared change
    of the score (before the logistic function) under the counterfactuals and ``ridge`` times the squared weights."""
    y, rows = np.asarray(y, dtype=float), _Rows(x, n)
    owner = np.array([i for i, o in enumerate(other) for _ in o], dtype=np.int64)
    swapped = _Rows([o for each in other for o in each], n)
    w, b = np.zeros(n), np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    for t in range(1, steps + 1):
        z = rows.dot(w) + b
        p = sig(z)
        dz = (p - y) / len(y)
        gw, gb = ridge * w, 0.0
        if len(owner):
            d = 2 * swap * (z[owner] - swapped.dot(w) - b) / len(owner)
            dz = dz + np.bincount(owner, weights=d, minlength=len(y))
            gw, gb = gw - swapped.back(d), -d.sum()
        g = np.append(gw + rows.back(dz), gb + dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return float(b), w


def train(docs: DataFrame, labels: DataFrame, held_out, limit: int = TRAINING_ROWS,
          top: int | None = FEATURES, swaps: dict = SWAPS) -> ToxicityModel:
    """Fit on at most ``limit`` labelled rows outside ``held_out`` (a function from a doc_id column
    to a condition).  The fit's memory on the driver is bounded by ``limit`` rows of at most
    ``top`` feature numbers; ``swaps`` says which terms are swapped for which (``swaps_of``, for terms of
    other languages).  Without rows of both labels every text scores the same."""
    rows = store(training_rows(docs, labels, held_out, limit))
    names = choose_features(rows, top)
    got = rows.mapInArrow(_indexed({f: i for i, f in enumerate(names)}, swaps),
                          "y int, x array<int>, other array<array<int>>").toPandas()
    if not len(got):
        return ToxicityModel(float(np.log(1e-3)), {})
    bias, w = fit(got["y"], [list(r) for r in got["x"]], [[list(o) for o in r] for r in got["other"]], len(names))
    return ToxicityModel(bias, {f: float(x) for f, x in zip(names, w)})


def _scored(shared):
    def run(batches):
        model: ToxicityModel = shared.value
        weight = model.weights

        def known(token):
            return tuple(f for f in word_features(word_of(token)) if f in weight)
        memo = _Memo(known)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                has = set().union(*map(memo.__getitem__, set((text or "").split())))
                z = model.bias + sum(weight[f] for f in sorted(has))
                out.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns)] + [pa.array(out, pa.float64())],
                [*b.schema.names, "score"])
    return run


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3,
                    keep_text: bool = False) -> DataFrame:
    """(doc_id, [text,] score, predicted) per row.  The text alone makes the score.

    A null or empty text scores as a text without any feature.  Null ids and repeated rows are
    kept; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select("doc_id", "text")
    kind = dict(base.dtypes)["doc_id"]
    out = base.mapInArrow(_scored(shared), f"doc_id {kind}, text string, score double")
    return out.select("doc_id", *["text"] * keep_text, "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    A null or empty text scores as a text without any feature, and stays unless that rejects it.  Null
    ids and ties do not matter; repeated rows stay or go alike; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in _scored(shared)(batches):  # the score is the last column, whatever others are called
            ok = np.asarray(b.column(b.num_columns - 1)) < threshold
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(ok))
    return docs.select(*rest, "text").mapInArrow(run, docs.select(*rest, "text").schema).select(*docs.columns)
