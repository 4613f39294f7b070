"""Quality by co-training two views: the text of a document and its metadata.

The text view sees the text alone, the metadata view the language, the source and n_chars alone. Each
round both classifiers judge all documents outside the labelled sample, on the executors; of those each
is surest of, the other learns the pseudo-labels. The views are then calibrated on labelled documents
that were set aside and combined. Only the labelled documents are a bounded sample (LABELLED, chosen by
hash); documents for which ``held_out`` holds are never learnt from and measure the result.

Edge cases: null text, lang, source or n_chars are values of their own; labels with a null doc_id or
quality are ignored, of several labels of a document the mean counts, a half as bad; without two classes
to learn from all scores are the share of good labels (0.5 without labels); repeated rows each get
their row and are one candidate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .features import DIM, fit_linear, profile, sigmoid
from .language_id import held_out

#: Documents expected in the labelled sample; rounds; pseudo-labels of each class that a view gives the other in a round.
LABELLED, ROUNDS, EXCHANGE = 3000, 3, 60
_CATEGORY, _BINS = 64, 32
META = 3 * _CATEGORY + _BINS
_COLUMNS = ("text", "lang", "source", "n_chars")


def _hot(out: np.ndarray, at: int, size: int, value: float) -> None:
    """Triangular bins over [0, 1]."""
    x = min(max(value, 0.0), 1.0) * (size - 1)
    i = int(x)
    out[at + i] += 1 - (x - i)
    if i + 1 < size:
        out[at + i + 1] += x - i


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Language, source, both together and size."""
    out = np.zeros(META, np.float32)
    for i, v in enumerate((lang, source, (lang, source))):
        out[i * _CATEGORY + zlib.crc32(repr(v).encode()) % _CATEGORY] = 1
    _hot(out, 3 * _CATEGORY, _BINS, float(np.log1p(max(0, n_chars or 0)) / 14))
    return out


def text_view(text: str | None) -> np.ndarray:
    return profile(text, keep_marks=True)


def _both(rows: list[tuple]) -> list[np.ndarray]:
    """The two views of rows (text, lang, source, n_chars)."""
    return [np.array([text_view(r[0]) for r in rows], np.float32).reshape(-1, DIM), np.array([metadata(*r[1:]) for r in rows], np.float32).reshape(-1, META)]


def _features(batches):
    """Whatever stands before the four columns, and the views in half precision."""
    for b in batches:
        n = b.num_columns - 4
        rows = list(zip(*(c.to_pylist() for c in b.columns[n:]), strict=True))
        views = [[v.astype(np.float16).tobytes() for v in (text_view(r[0]), metadata(*r[1:]))] for r in rows]
        yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([v[0] for v in views], pa.binary()), pa.array([v[1] for v in views], pa.binary())], [*b.schema.names[:n], "x", "m"])


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class Views:
    """Weights of the two views, their calibration and their combination."""

    def __init__(self, constant: float):
        self.constant, self.weights, self.calibration, self.top = constant, None, [], None

    def fit(self, views: list[np.ndarray], own: list[np.ndarray]) -> None:
        """From labels of 1 and -1 that each view learns from; 0 is none."""
        self.weights = [fit_linear(x[y != 0], y[y != 0].astype(np.float32), loss="log", steps=120) for x, y in zip(views, own, strict=True)]

    def calibrate(self, views: list[np.ndarray], y: np.ndarray) -> None:
        self.calibration = []
        for x, w in zip(views, self.weights, strict=True):
            m = _margin(x, w)
            scale = float(np.abs(m).mean()) or 1.0
            self.calibration.append((scale, fit_linear((m / scale)[:, None], y, loss="log", reg=1e-3, steps=600)))
        self.top = fit_linear(self._logits(views), y, loss="log", reg=1e-3, steps=600)

    def _logits(self, views: list[np.ndarray]) -> np.ndarray:
        return np.stack([_margin(x, w) / s * c[0] + c[1] for x, w, (s, c) in zip(views, self.weights, self.calibration, strict=True)], 1)

    def predict(self, views: list[np.ndarray]) -> np.ndarray:
        """Columns: text score, metadata score, combined score."""
        if self.weights is None:
            return np.full((len(views[0]), 3), self.constant)
        logits = self._logits(views)
        return sigmoid(np.column_stack([logits, _margin(logits, self.top)]))


def surest(pool: DataFrame, views: Views, up: int, down: int, known: list[set[int]]) -> DataFrame:
    """(view, sign, key, margin): those ``up`` good and ``down`` bad documents of ``pool`` (key, text, lang, source, n_chars) of which each view is surest.

    ``known`` are the keys that the other view has learnt already. Each task keeps its surest rows, the
    cluster the surest of all; ties go by key.
    """
    shared = pool.sparkSession.sparkContext.broadcast((views, known))

    def run(batches):
        v, known = shared.value
        kept: dict[tuple[int, int], list[tuple[float, int]]] = {(i, s): [] for i in (0, 1) for s in (1, -1)}
        for b in batches:
            keys = b.column(0).to_pylist()
            rows = list(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True))
            for at in range(0, len(rows), 512):
                for i, (x, w) in enumerate(zip(_both(rows[at : at + 512]), v.weights, strict=True)):
                    for m, k in zip(_margin(x, w).tolist(), keys[at : at + 512], strict=True):
                        if m and k not in known[1 - i]:
                            kept[i, 1 if m > 0 else -1].append((-abs(m), k))
            for of in kept:
                kept[of] = sorted(set(kept[of]))[: up if of[1] > 0 else down]
        rows = [(i, s, k, m) for (i, s), found in kept.items() for m, k in found]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["view", "sign", "key", "margin"])

    own = stash(pool.mapInArrow(run, "view int, sign int, key bigint, margin double"), "surest")
    best = [own.where(f"view = {i} AND sign = {s}").distinct().orderBy("margin", "key").limit(n) for i in (0, 1) for s, n in ((1, up), (-1, down))]
    return best[0].unionByName(best[1]).unionByName(best[2]).unionByName(best[3])


def _arrays(got: pa.Table) -> list[np.ndarray]:
    return [np.array([np.frombuffer(r, np.float16) for r in got[c].to_pylist()], np.float32).reshape(-1, n) for c, n in (("x", DIM), ("m", META))]


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), *_COLUMNS)


def train(docs: DataFrame, labels: DataFrame) -> Views:
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("label")), F.lit(1 << 30))
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("double").alias("label"))
    chosen = marks.where(key < min(1.0, LABELLED / max(1, marks.count())) * (1 << 30))  # bounded, so small enough to broadcast
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(4)).cast("int").alias("fold")
    got = docs.select("doc_id", *_COLUMNS).join(F.broadcast(chosen), "doc_id").select("label", fold, *_COLUMNS).mapInArrow(_features, "label double, fold int, x binary, m binary").toArrow()
    got = got.take(pa.array(sorted(range(got.num_rows), key=lambda i: tuple(got[c][i].as_py() for c in ("x", "m", "label", "fold"))), pa.int64()))  # the order of rows does not matter
    label, aside = got["label"].to_numpy(), got["fold"].to_numpy() == 0
    views = _arrays(got)
    out = Views(float((label == 1).mean()) if len(label) else 0.5)
    sign = np.where(label == 1, 1.0, -1.0)
    if any(len(set(sign[of].tolist())) < 2 for of in (aside, ~aside)):
        return out
    x, own = views, [np.where(aside, 0.0, sign) for _ in views]
    known: list[set[int]] = [set(), set()]  # by learner
    pool = docs.where(~held_out()).select("doc_id", *_COLUMNS).join(F.broadcast(chosen), "doc_id", "left_anti").select(row_key().alias("key"), *_COLUMNS)
    up, down = (max(1, round(2 * EXCHANGE * share)) for share in (out.constant, 1 - out.constant))
    out.fit(x, own)
    for _ in range(ROUNDS):
        best = [(r.view, r.sign, r.key) for r in surest(pool, out, up, down, known).collect()]  # 4 * EXCHANGE rows
        if not best:
            break
        asked = pool.where(F.col("key").isin(sorted({k for *_, k in best}))).dropDuplicates(["key"]).mapInArrow(_features, "key bigint, x binary, m binary").toArrow()
        at = {k: i for i, k in enumerate(asked["key"].to_pylist())}
        order = sorted(at)
        new = _arrays(asked.take(pa.array([at[k] for k in order], pa.int64())))
        marks_ = [np.zeros(len(order)) for _ in views]
        place = {k: i for i, k in enumerate(order)}
        for teacher, s, k in best:
            if k in place:
                marks_[1 - teacher][place[k]] = s
                known[1 - teacher].add(k)
        x = [np.concatenate((a, b)) for a, b in zip(x, new, strict=True)]
        own = [np.concatenate((a, b)) for a, b in zip(own, marks_, strict=True)]
        out.fit(x, own)
    out.calibrate([v[aside] for v in views], sign[aside].astype(np.float32))
    return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score (0 to 1), good for every row of ``docs`` (doc_id, text, lang, source, n_chars)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = shared.value
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True))
            out = [np.zeros((0, 3))]
            for at in range(0, len(rows), 512):
                out.append(model.predict(_both(rows[at : at + 512])))
            s = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(s[:, i], pa.float64()) for i in range(3)), pa.array(s[:, 2] >= 0.5)], ["doc_id", "held_out", "text_score", "meta_score", "score", "good"])

    return docs.select("doc_id", held_out().alias("held_out"), *_COLUMNS).mapInArrow(run, f"doc_id {kind}, held_out boolean, text_score double, meta_score double, score double, good boolean")
