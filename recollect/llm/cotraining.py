"""Quality classifier by co-training.

Two views of a document are learned apart: what its text says and how it is written, and what is known of the page
(source, language, length). Each round both views score every unlabelled document; of those that a view is surest of it
draws some, and the *other* view learns its marks as labels. In the end both are calibrated on labelled documents that
neither has seen, and a weighted sum of the calibrated views scores every document.

Features are written once, and every round and the last scoring run over that table on the cluster, thresholds from
quantiles of the whole pool included. The classifiers are fitted on the driver, on the features of about LABELLED labelled
documents and at most about 2 * MARKS a view and round of those it was taught, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import Scratch

#: Labelled documents that the classifiers are fitted on, and marks of each kind that a view teaches in a round, about.
LABELLED = 4_000
MARKS = 600
ROUNDS = 4
#: Share of the pool that a view marks in a round, and how sure it must be.
MARKED, SURE = 0.1, 0.9
#: Stands for a missing id.
_NO_ID = -(1 << 63)
_BITS = 12
_STATS = 8
CONTENT = (1 << _BITS) + _STATS
META = 1 << 8
_CHARS = 1 << 21

Features = tuple[np.ndarray, np.ndarray, np.ndarray]  # row, column, value


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word, 5) >> (32 - _BITS)
        return value


_buckets = _Buckets()
#: Kinds of bytes: lower case, upper case, digit, space, line break, other ASCII, beyond ASCII.
_KIND = np.full(256, 6, np.uint8)
_KIND[:128] = 5
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[32], _KIND[10] = 0, 1, 2, 3, 4


def content_features(texts: list[bytes | None]) -> Features:
    """Shares of hashed words, scaled by the root of their number, and shares of kinds of bytes."""
    rows, cols, values = [], [], []
    for i, text in enumerate(texts):
        text = text or b""
        words = text.lower().split()
        counts = np.bincount(np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words)), minlength=0)
        used = np.flatnonzero(counts)
        v = np.sqrt(counts[used])
        kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7) / max(1, len(text))
        stats = np.r_[4 * kinds, np.log1p(len(words)) / 5]
        rows.append(np.full(len(used) + _STATS, i))
        cols.append(np.r_[used, (1 << _BITS) + np.arange(_STATS)])
        values.append(np.r_[2 * v / max(1e-9, np.sqrt((v * v).sum())), stats])
    return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in (rows, cols, values))


def meta_features(sources: list, langs: list, sizes: list) -> Features:
    rows, cols = [], []
    for i, (s, g, n) in enumerate(zip(sources, langs, sizes, strict=True)):
        size = "none" if n is None else str(max(0, int(n)).bit_length())
        for k, v in enumerate((f"s{s}", f"l{g}", f"n{size}", f"{g}/{size}")):
            rows.append(i)
            cols.append((k << 6) | xxhash.xxh32_intdigest(v, 5) >> 26)
    return np.array(rows, int), np.array(cols, int), np.ones(len(rows))


def _dot(x: Features, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(x[0], x[2] * w[x[1]], n) + w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: Features, y: np.ndarray, weight: np.ndarray, columns: int, decay: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Weights, the last one the constant, by Nesterov's method with scaled columns."""
    n = len(y)
    total = max(1e-9, weight.sum())
    w = np.zeros(columns + 1)
    scale = np.r_[np.bincount(x[1], x[2] * x[2] * weight[x[0]], columns), total] / total
    norm = np.bincount(x[0], x[2] * x[2] / (scale[x[1]] + 1e-2), n).max(initial=0) + 1
    rate = 4 / norm / (scale + 1e-2)
    prev = w.copy()
    for k in range(steps):
        look = w + k / (k + 3) * (w - prev)
        off = (_sigmoid(_dot(x, look, n)) - y) * weight
        grad = np.r_[np.bincount(x[1], x[2] * off[x[0]], columns), off.sum()] / total + decay * np.r_[look[:-1], 0]
        prev, w = w, look - rate * grad
    return w


@dataclass
class Model:
    content: np.ndarray
    meta: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray]
    mix: np.ndarray

    def scores(self, content: Features, meta: Features, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.calibration[0][0] * _dot(content, self.content, n) + self.calibration[0][1]
        b = self.calibration[1][0] * _dot(meta, self.meta, n) + self.calibration[1][1]
        return _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2]), _sigmoid(a), _sigmoid(b)


def _dense(columns: list[np.ndarray]) -> Features:
    n = len(columns[0])
    return np.tile(np.arange(n), len(columns)), np.repeat(np.arange(len(columns)), n), np.concatenate(columns)


@dataclass
class Rows:
    """Features of some documents, as they are written: 16-bit columns and 32-bit values."""

    ci: list[bytes]
    cv: list[bytes]
    mi: list[bytes]

    def __add__(self, other: Rows) -> Rows:
        return Rows(self.ci + other.ci, self.cv + other.cv, self.mi + other.mi)

    def at(self, rows: np.ndarray) -> Rows:
        return Rows(*([x[int(i)] for i in rows] for x in (self.ci, self.cv, self.mi)))

    def content(self) -> Features:
        cols = np.frombuffer(b"".join(self.ci), "<u2").astype(np.int64)
        return np.repeat(np.arange(len(self.ci)), [len(x) // 2 for x in self.ci]), cols, np.frombuffer(b"".join(self.cv), "<f4").astype(float)

    def meta(self) -> Features:
        cols = np.frombuffer(b"".join(self.mi), "<u2").astype(np.int64)
        return np.repeat(np.arange(len(self.mi)), [len(x) // 2 for x in self.mi]), cols, np.ones(len(cols))


_VIEWS = ((Rows.content, CONTENT), (Rows.meta, META))


def featurise(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> DataFrame:
    """The features of each row of ``docs``, written: id, key (the id, or a number for none), d (a hash of them), ci, cv, mi."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.col("source").cast("string").alias("s"), F.col("lang").cast("string").alias("g"), F.char_length(text).alias("n"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                text, source, lang, size = (part.column(i) for i in range(1, 5))
                out = []
                for x, kinds in ((content_features(text.cast(pa.binary()).to_pylist()), ("<u2", "<f4")), (meta_features(source.to_pylist(), lang.to_pylist(), size.to_pylist()), ("<u2",))):
                    edges = np.searchsorted(x[0], np.arange(part.num_rows + 1))
                    out += [[c[a:b].astype(k).tobytes() for a, b in zip(edges, edges[1:], strict=False)] for c, k in zip(x[1:], kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.binary()) for c in out]], ["id", "ci", "cv", "mi"])

    found = rows.mapInArrow(each, "id long, ci binary, cv binary, mi binary")
    return scratch.save(found.withColumn("key", F.coalesce("id", F.lit(_NO_ID))).withColumn("d", F.xxhash64("ci", "cv", "mi")))


def _logits(features: DataFrame, weights: list[np.ndarray]) -> DataFrame:
    """(key, d, a, b): what the two views say of each row."""
    shared = features.sparkSession.sparkContext.broadcast(weights)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows(*(batch.column(c).to_pylist() for c in range(2, 5)))
            z = [pa.array(_dot(view(rows), w, batch.num_rows)) for (view, _), w in zip(_VIEWS, shared.value, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *z], ["key", "d", "a", "b"])

    return features.select("key", "d", "ci", "cv", "mi").mapInArrow(each, "key long, d long, a double, b double")


def _collected(features: DataFrame, wanted: DataFrame, *columns: str) -> tuple[Rows, list[np.ndarray]]:
    """One row of features for each row of ``wanted`` (key or key and d; some thousand rows), with ``columns`` and the key."""
    on = [c for c in ("key", "d") if c in wanted.columns]
    named = list(dict.fromkeys(("key", *columns)))
    one = features.join(F.broadcast(wanted), on).groupBy(*named).agg(F.min(F.struct("ci", "cv", "mi")).alias("x"))
    got = one.select(*named, "x.*").toArrow().sort_by([(c, "ascending") for c in on])
    return Rows(*(got.column(c).to_pylist() for c in ("ci", "cv", "mi"))), [got.column(c).to_numpy() for c in named]


def _fit(v: int, rows: Rows, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    view, columns = _VIEWS[v]
    return fit_logistic(view(rows), y.astype(float), weight, columns)


def marks_of(z: Column, low: float, high: float) -> Column:
    """1 or 0 where a view is sure enough of a document and surer than of most, else null."""
    sure = float(np.log(SURE / (1 - SURE)))
    return F.when(z >= max(high, sure), 1).when(z <= min(low, -sure), 0)


def train(features: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", label_col: str = "quality", labelled: int = LABELLED, marks: int = MARKS, rounds: int = ROUNDS) -> Model:
    """Fit on the written features and ``labels``. An id with several labels has the largest; ids without row don't count."""
    given = labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("y")).filter("key IS NOT NULL AND y IN (0, 1)")
    given = scratch.save(given.groupBy("key").agg(F.max("y").alias("y")))
    drawn = lambda salt, share, *by: F.pmod(F.xxhash64(*by, F.lit(salt)), F.lit(1 << 20)) < F.least(F.lit(1.0), share) * (1 << 20)
    sample = given.filter(drawn("quality", F.lit(labelled / max(1, given.count())), "key"))
    rows, (keys, y) = _collected(features, sample, "y")
    deal = np.array([xxhash.xxh32_intdigest(str(k)) % 4 for k in keys.tolist()], int)  # a quarter calibrates
    held, own = np.flatnonzero(deal == 0), np.flatnonzero(deal != 0)
    if len(set(y[own].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        share = y.mean() if len(y) else 0.5
        flat = np.array([1.0, 0.0])
        odds = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
        return Model(np.zeros(CONTENT + 1), np.zeros(META + 1), (flat, flat), np.array([0.0, 0.0, odds]))
    share = float(y[own].mean())
    taught: list[dict[tuple[int, int], tuple[int, Rows]]] = [{}, {}]  # what each view has learned of the pool
    for turn in range(rounds + 1):
        weights = []
        for v, extra in enumerate(taught):
            more = [extra[k] for k in sorted(extra)]
            known = Rows(*([x for _, r in more for x in getattr(r, c)] for c in ("ci", "cv", "mi")))
            weight = np.r_[np.ones(len(own)), np.full(len(more), 0.5)]
            weights.append(_fit(v, rows.at(own) + known, np.r_[y[own], [m for m, _ in more]], weight))
        if turn == rounds:
            break
        pool = scratch.save(_logits(features, weights).join(given.select("key"), "key", "left_anti").dropDuplicates(["key", "d"]))
        cuts = pool.approxQuantile(["a", "b"], [MARKED * (1 - share), 1 - MARKED * share], 1e-3)
        if not cuts[0]:
            continue
        marked = pool.select("key", "d", *[marks_of(F.col(c), *q).alias(f"m{c}") for c, q in zip("ab", cuts, strict=True)])
        sizes = marked.agg(*[F.count_if(F.col(f"m{c}") == k).alias(f"{c}{k}") for c in "ab" for k in (0, 1)]).first()
        take = lambda c: F.when(drawn(f"{c}{turn}", F.when(F.col(f"m{c}") == 1, marks / max(1, sizes[f"{c}1"])).otherwise(marks / max(1, sizes[f"{c}0"])), "key", "d"), F.col(f"m{c}"))
        chosen = marked.select("key", "d", take("a").alias("ya"), take("b").alias("yb")).filter("ya IS NOT NULL OR yb IS NOT NULL")
        chosen = chosen.select("key", "d", F.coalesce("ya", F.lit(-1)).alias("ya"), F.coalesce("yb", F.lit(-1)).alias("yb"))
        extra, (own_keys, digest, ya, yb) = _collected(features, chosen, "d", "ya", "yb")
        for i, name in enumerate(zip(own_keys.tolist(), digest.tolist(), strict=True)):
            one = extra.at([i])
            for v, m in ((1, ya[i]), (0, yb[i])):
                if m >= 0:
                    taught[v][name] = (int(m), one)
        scratch.drop(pool)
    ones = np.ones(len(held))
    logits = [_dot(view(rows), w, len(y))[held] for (view, _), w in zip(_VIEWS, weights, strict=True)]
    fits = [fit_logistic(_dense([z]), y[held].astype(float), ones, 1, 1e-3) for z in logits]
    ready = [f[0] * z + f[1] for f, z in zip(fits, logits, strict=True)]
    return Model(weights[0], weights[1], (fits[0], fits[1]), fit_logistic(_dense(ready), y[held].astype(float), ones, 2, 1e-3))


def score(features: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of written features: id, score (probability of good quality), quality_pred, content_score, meta_score.

    Null texts count as empty, null metadata as a value of its own; other columns don't matter. With no labels, or
    labels of one kind, every document gets the share of good ones (0.5 of none).
    """
    shared = features.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = Rows(*(batch.column(c).to_pylist() for c in range(1, 4)))
            p, a, b = m.scores(rows.content(), rows.meta(), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(a), pa.array(b)], ["id", "score", "quality_pred", "content_score", "meta_score"])

    out = features.select("id", "ci", "cv", "mi").mapInArrow(each, "id long, score double, quality_pred int, content_score double, meta_score double")
    return out.withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` scored by what their labels and the two views of them teach; see ``train`` and ``score``."""
    scratch = Scratch(docs.sparkSession, "quality")
    features = featurise(docs, scratch, id_col)
    return score(features, train(features, labels, scratch, id_col), id_col)
