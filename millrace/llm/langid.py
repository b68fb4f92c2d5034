"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are summed by Spark over all labelled training rows; the log-probability matrix
(languages x buckets, bounded by ``MAX_LANGUAGES``) is broadcast, and tasks score batches of texts in numpy through
the n-grams that occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import pieces

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 1000  # bounds the broadcast matrix: 128 kB a language
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Evidence counts as at most this many n-grams when it is turned into a score.
SCORE_NGRAMS = 60.0

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hashed n-grams of all texts, text by text, and how many each text has.

    Texts are lower-cased; every run of other characters than letters becomes one blank, also at both ends. An n-gram
    never spans two texts; a text without letters has none.
    """
    letter = _letters()
    lowered = [(x or "").lower() for x in texts]
    sizes = np.fromiter((len(x) for x in lowered), np.int64, len(lowered))
    # Every text has a separator of its own at both ends, so that its n-grams are the same whatever texts stand beside it.
    chars = np.frombuffer("".join([f"\n{x}\n" for x in lowered]).encode("utf-32-le"), np.uint32)
    is_letter = letter[chars]
    chars = np.where(is_letter, chars, np.uint32(32))
    text_of = np.repeat(np.arange(len(lowered), dtype=np.int32), sizes + 2)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of a run of other characters the first
    keep[(np.cumsum(sizes + 2) - sizes - 2)] = True  # and the separator before the text, where others follow it too
    chars, text_of = chars[keep].astype(np.uint64), text_of[keep]
    if len(chars):
        lettered = np.zeros(len(lowered), bool)
        lettered[text_of[chars != 32]] = True
        if not lettered.all():
            chars, text_of = chars[lettered[text_of]], text_of[lettered[text_of]]
    out = []
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = max(0, len(chars) - n + 1)
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] + np.uint64(n)
        if n not in ORDERS:
            continue
        mixed = h ^ (h >> np.uint64(29))
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed >>= np.uint64(64 - BUCKETS.bit_length() + 1)
        inside = text_of[:m] == text_of[n - 1 :] if n > 1 else chars != 32
        out.append((mixed[inside].astype(np.int32), np.bincount(text_of[:m][inside], minlength=len(lowered))))
    return out


@dataclass(frozen=True)
class Model:
    """Languages in code-point order, their log priors and the log probabilities of the buckets."""

    languages: list[str]
    priors: np.ndarray
    log_p: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language (the first of equals) and a score from 0 to 1; ``und`` and 0 without a letter."""
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        evidence, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for grams, counts in features(texts):
            has = np.flatnonzero(counts)
            if len(has):
                starts = np.concatenate([[0], np.cumsum(counts[has])[:-1]])
                for i, row in enumerate(self.log_p):
                    evidence[has, i] += np.add.reduceat(row[grams], starts)
                sizes += counts
        some = np.flatnonzero(sizes)
        if not self.languages or not len(some):
            return names, scores
        evidence = evidence[some]
        best = (evidence + self.priors).argmax(axis=1)
        weight = np.minimum(1.0, SCORE_NGRAMS / sizes[some])
        tempered = evidence * weight[:, None] + self.priors
        tempered = np.exp(tempered - tempered.max(axis=1, keepdims=True))
        share = tempered / tempered.sum(axis=1, keepdims=True)
        scores[some] = share[np.arange(len(some)), best]
        for i, b in zip(some.tolist(), best.tolist(), strict=True):
            names[i] = self.languages[b]
        return names, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of the partition; bucket -1 counts documents."""
    held: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for piece in pieces(batch, 0):
            langs = piece.column(1).to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            code = np.fromiter((number[x] for x in langs), np.int64, len(langs))
            table = np.zeros(len(names) * BUCKETS, np.int64)
            for grams, sizes in features(piece.column(0).to_pylist()):
                table += np.bincount(np.repeat(code * BUCKETS, sizes) + grams, minlength=len(table))
            for name, row in zip(names, table.reshape(len(names), BUCKETS), strict=True):
                held[name] = held.get(name, 0) + row
                docs[name] = docs.get(name, 0) + langs.count(name)
    for name, row in held.items():
        at = np.flatnonzero(row)
        yield pa.record_batch(
            {
                "lang": pa.array([name] * (len(at) + 1), pa.string()),
                "bucket": pa.array(np.append(at, -1).astype(np.int32)),
                "n": pa.array(np.append(row[at], docs[name]).astype(np.int64)),
            }
        )


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on all rows with a non-null label; null texts count as empty. No rows give a model that knows no language.

    The labels are counted before any text is: with more than ``MAX_LANGUAGES`` this raises, so that what the tasks hold
    (128 kB a language) and what the driver takes in (a row a language and bucket that occurs) are bounded.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).alias("lang")
    )
    known = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if known > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    if not table.num_rows:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS)))
    langs = table["lang"].combine_chunks().dictionary_encode()
    names = langs.dictionary.to_pylist()
    full = np.zeros((len(names), BUCKETS + 1))
    full[langs.indices.to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
    order = np.argsort(np.array(names, object))
    full = full[order]
    docs, grams = full[:, -1], full[:, :-1] + SMOOTHING
    return Model(
        [names[i] for i in order], np.log(docs / docs.sum()), np.log(grams / grams.sum(axis=1, keepdims=True))
    )


def held_out(doc_id: Column) -> Column:
    """True for the fold that training leaves out; rows without an id belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    A null text, an empty one and one without letters get ``und`` and score 0. One row a row; other columns are
    ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                names, scores = shared.value.predict(piece.column(1).to_pylist())
                yield pa.record_batch(
                    {"doc_id": piece.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def predict_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the rows that are not held out, applied to all."""
    model = train(docs.where(~held_out(F.col(doc_id))), text, lang)
    return identify(docs, model, doc_id, text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = 0.5
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is determined with at least ``min_score``.

    Rows with a null, empty or letterless text go, whatever ``min_score``; repeated rows are judged alike, rows without
    an id teach nothing, an empty table stays empty, and no column is added, so no name can clash.
    """
    model = train(docs.where(~held_out(F.col(doc_id))), text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, at):
                _, scores = shared.value.predict(piece.column(at).to_pylist())
                yield piece.filter(pa.array(scores >= max(min_score, 1e-12)))

    return docs.mapInArrow(run, docs.schema)
