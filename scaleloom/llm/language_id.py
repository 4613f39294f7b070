"""Hierarchical language identification: the family first, then machines for the languages within it.

Training takes a bounded, hash-chosen sample (PER_LANGUAGE documents of each label) of the rows that
a condition admits; profiles are computed on the executors and only they reach the driver. Prediction
is one narrow pass over all rows and sees nothing but the text.

Edge cases: a null or letterless text is ``und`` with score 0; if nothing can be learnt all are ``und``;
rows with a null label are not learnt from, nor labels beyond the LANGUAGES most frequent ones; null ids and repeated rows each get their row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import DIM, OneVersusOne, has_letter, profile

UND = "und"
#: Bounds of the training sample: documents expected of each language, and languages (of equally frequent ones those first by name).
PER_LANGUAGE, LANGUAGES = 600, 96
#: Closely related languages; a label that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("an", "ast", "ca", "es", "fr", "gl", "it", "oc", "pt", "rm", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"), "turkic": ("az", "kk", "ky", "tr", "uz"), "baltic": ("lt", "lv"), "celtic": ("br", "cy", "ga", "gd"),
    "iranian": ("fa", "ku", "ps", "tg"), "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"), "semitic": ("am", "ar", "he", "mt"),
}
_FAMILY_OF = {lang: f for f, langs in FAMILIES.items() for lang in langs}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


class Model:
    def __init__(self, x: np.ndarray, labels: np.ndarray):
        families = np.array([family_of(v) for v in labels.tolist()], object)
        self.top = OneVersusOne(x, families)
        self.within = {f: OneVersusOne(x[families == f], labels[families == f]) for f in self.top.classes}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, sure = self.top.predict(x)
        out, score = np.empty(len(x), object), np.zeros(len(x))
        for i, f in enumerate(self.top.classes):
            of = np.flatnonzero(family == i)
            if len(of):
                best, own = self.within[f].predict(x[of])
                out[of] = np.array(self.within[f].classes, object)[best]
                score[of] = sure[of] * own
        return out, score


def _profiles(batches):
    for b in batches:
        keep = [(i, t) for i, t in enumerate(b.column(1).to_pylist()) if has_letter(t)]
        x = [profile(t).astype(np.float16).tobytes() for _, t in keep]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in keep], pa.int64())), pa.array(x, pa.binary())], ["lang", "x"])


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds and lang is not null."""
    rows = docs.where(learn & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("language"))
    chosen = rows.where(F.col("lang").isin(list(counts))).where(F.pmod(key, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    got = chosen.select("lang", "text").mapInArrow(_profiles, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    raw = sorted(zip(got["lang"].to_pylist(), got["x"].to_pylist(), strict=True))  # the order of rows does not matter
    x = np.array([np.frombuffer(v, np.float16) for _, v in raw], np.float32).reshape(-1, DIM)
    return Model(x, np.array([v for v, _ in raw], object))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few vectors of DIM numbers for each pair of languages

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            lang, score = np.full(len(texts), UND, object), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            for at in range(0, len(known), 512):
                part = known[at : at + 512]
                lang[part], score[part] = m.predict(np.array([profile(texts[i]) for i in part]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out() -> Column:
    """Documents that are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    return predict(docs, train(docs, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def drop_unknown(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language cannot be told, that is those without a letter; ``lang`` becomes the prediction of ``identify``.

    A label that the model has not learnt (all its rows are held out) stays, as no prediction could confirm it.
    If nothing can be learnt every row with a letter stays as it is.
    """
    at, lang_at = docs.columns.index("text"), docs.columns.index("lang")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, ~held_out()))

    def run(batches):
        m = shared.value
        learnt = {None} if m is None else {None, *(c for w in m.within.values() for c in w.classes)}
        for b in batches:
            texts, langs = b.column(at).to_pylist(), b.column(lang_at).to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            judged = [i for i in keep if m is not None and langs[i] in learnt]
            for start in range(0, len(judged), 512):
                part = judged[start : start + 512]
                for i, v in zip(part, m.predict(np.array([profile(texts[i]) for i in part]))[0], strict=True):
                    langs[i] = v
            if judged:
                b = b.set_column(lang_at, b.schema.field(lang_at), pa.array(langs, b.schema.field(lang_at).type))
            yield b.take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(run, docs.schema)
