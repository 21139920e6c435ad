"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is a distributed sum over a bounded sample of labelled texts; the model is one matrix of log probabilities
(buckets by languages), broadcast to the workers, which score whole texts in batches: n-gram hashes of all characters at
once, one gather of matrix rows, one sum by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import unused

BUCKET_BITS = 16
LONGEST = 3
#: Training texts of a language, about; the sample is drawn by hash and doesn't grow with the table.
PER_LANGUAGE = 3_000
#: Languages that are learnt at most; the matrix has half a megabyte for each.
MOST_LANGUAGES = 200
UNKNOWN = "und"
#: Characters taken at once.
_CHARS = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_letters = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(document, bucket) of every n-gram of lower-cased texts, in pieces, with the number of the text they start at.

    All that isn't a letter counts as one space, and texts begin and end with one. Short texts are taken together; a
    text of more than _CHARS characters stands alone and comes in several pieces, whole. So what is said of a text, sums
    of its n-grams included, never depends on its neighbours.
    """
    start, held = 0, None
    while start < len(texts):
        some, size = [], 0
        while start + len(some) < len(texts):
            nxt = (texts[start + len(some)] or "").lower().replace("\0", " ") if held is None else held
            held = None
            if some and size + len(nxt) > _CHARS:
                held = nxt
                break
            some.append(nxt)
            size += len(nxt)
        code = np.frombuffer(" \0 ".join(["", *some, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)[1:-1]
        code = np.where(_is_letter()[code] | (code == 0), code, 32)
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        code = code[keep].astype(np.uint64)
        doc = np.cumsum(code == 0) - 1
        step = _CHARS if len(some) == 1 else len(code)
        for i in range(0, len(code), step):
            c, d = code[i : i + step + LONGEST - 1], doc[i : i + step + LONGEST - 1]
            docs, buckets = [], []
            gram, inside = np.zeros(min(step, len(code) - i), np.uint64), np.ones(min(step, len(code) - i), bool)
            for n in range(1, LONGEST + 1):
                m = min(len(gram), len(c) - n + 1)
                gram, inside = gram[:m] * _P + c[n - 1 : n - 1 + m], inside[:m] & (c[n - 1 : n - 1 + m] != 0)
                hashed = (gram + np.uint64(n)) * _P
                buckets.append(((hashed ^ (hashed >> np.uint64(29))) * _P >> np.uint64(64 - BUCKET_BITS))[inside].astype(np.int64))
                docs.append(d[:m][inside])
            yield np.concatenate(docs), np.concatenate(buckets), start
        start += len(some)


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([any(map(str.isalpha, t)) if t else False for t in texts], bool)


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # buckets by languages
    log_prior: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Posterior probabilities, texts by languages."""
        out = np.tile(self.log_prior, (len(texts), 1))
        for doc, bucket, start in ngrams(texts):
            rows = doc.max(initial=-1) + 1
            for k in range(len(self.languages)):
                out[start : start + rows, k] += np.bincount(doc, self.log_prob[bucket, k], rows)
        out -= out.max(1, keepdims=True)
        np.exp(out, out)
        return out / out.sum(1, keepdims=True)


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on rows of ``docs`` where ``usable`` holds and text and lang aren't null; about ``per_language`` a language.

    What reaches the driver is bounded by buckets times languages, whatever the table's size: of more than MOST_LANGUAGES values of
    lang, as a dirty column may have, the most common ones are learnt (of equal ones the first in order).
    """
    label = F.col(lang_col).cast("string")
    known = docs.filter(usable & label.isNotNull())
    common = known.groupBy(label.alias("k")).count().orderBy(F.desc("count"), "k").limit(MOST_LANGUAGES)
    sizes = {r[0]: r[1] for r in common.collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    drawn = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < share[label] * (1 << 20)
    at = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(at), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            lang = np.array([at[x] for x in batch.column(1).to_pylist()])
            for doc, bucket, start in ngrams(batch.column(0).to_pylist()):
                np.add.at(total, (lang[doc + start], bucket), 1)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(total[k, b])], ["k", "b", "n"])

    drawn_docs = known.filter(label.isin(languages) & drawn & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("__t"), label.alias("__l"))
    counted = drawn_docs.mapInArrow(count, "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones((1 << BUCKET_BITS, len(languages)))  # one of each bucket more
    counts[counted.column("b").to_numpy(), counted.column("k").to_numpy()] += counted.column("n").to_numpy()
    sizes_ = np.array([sizes[k] for k in languages], float)
    return Model(languages, np.log(counts / counts.sum(0)), np.log(sizes_ / sizes_.sum()))


def training_rows(id_col: str = "doc_id") -> Column:
    """Rows to learn from: those whose id, as text, has a CRC-32 that isn't 2 modulo 4. The others are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2, F.lit(False))


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the most probable language of each whole text and its probability.

    A text that is null or has no letter gets UNKNOWN and 0, as does every text if the model knows no language. Equal
    probabilities go to the language first in order. Other columns, also of these names, must not be in ``docs``.
    """
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).to_pylist()
            known = has_letter(texts) if m.languages else np.zeros(len(texts), bool)
            if m.languages and len(texts):
                p = m.scores(texts)
                best = [m.languages[i] for i in p.argmax(1)]
                score = np.where(known, p.max(1), 0.0)
            else:
                best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            lang = [b if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(each, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, lang_pred, score. A row without an id is held out.

    Learns only from text and lang of the rows that aren't held out. Empty tables, or none with a lang, give no model:
    then every prediction is UNKNOWN.
    """
    model = train(docs, training_rows(id_col), id_col, text_col, lang_col)
    found = predict(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), model, "__text")
    return found.select(F.col("__id").alias(id_col), (~training_rows("__id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least_score: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with their own columns.

    Rejected are texts without a letter, null and empty ones too, and those for which no language reaches ``least_score``. Rows that
    repeat an id or a text are judged each by itself; columns may have any name.
    """
    model = train(docs, training_rows(id_col), id_col, text_col, lang_col)
    names = unused(docs.columns, "__lang_pred"), unused(docs.columns, "__score")
    found = predict(docs, model, text_col, names)
    return found.filter((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least_score)).select(*docs.columns)
