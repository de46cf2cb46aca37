"""A quality classifier by co-training: one view sees the text, the other the page's metadata.

Both views start from a bounded sample of labelled documents. In each round either view labels those documents of a bounded
unlabelled pool it is confident about, and hands them to the *other* view's training set; then both are fitted
again. At the end each view is calibrated on labelled documents kept out of the fit (a logistic curve over its value), and the
calibrated views are added up as log-odds, weighted by what they explain there. Every whole document is scored. The sample is fitted in a task,
so the driver sees the weights only.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import first_by_hash, map_arrow, sample_per_key
from shoebox.llm.features import frequencies, logistic, mean_weights, sigmoid

LABELLED_PER_CLASS = 1500  # bounds of the fitting sample
POOL = 3000
DIMS, ORDERS = 1 << 12, (1, 2)
ROUNDS, CONFIDENT = 3, 0.97
SOURCES, LANGS, LENGTHS = 256, 32, 24
THRESHOLD = 0.25  # below one half: a doubtful document is kept


@dataclass
class View:
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0


@dataclass
class CoTrained:
    text: View
    page: View
    stats: np.ndarray  # weights of text_stats within the text view
    blend: tuple[float, float, float]


def text_stats(texts: list[str]) -> np.ndarray:
    """Shape of a text: shares of capitals, marks, digits and white space, repeated words, words repeated at once, word length, size."""
    out = np.zeros((len(texts), 8), dtype=np.float32)
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace")
        n = max(1, len(raw))
        kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=5)
        words = raw.split()
        w = max(1, len(words))
        twice = sum(map(eq, words, words[1:]))
        out[i] = (kinds[0] / n, kinds[1] / n, kinds[2] / n, kinds[3] / n, 1 - len(set(words)) / w, twice / w, min(len(raw) / w, 50) / 10, np.log1p(w) / 5)
    return out


def _kinds() -> np.ndarray:
    kind = np.full(256, 4, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        kind[b] = 0 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c.isalpha() or c in ".," else 1
    return kind


_KIND = _kinds()


def page_slots(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Three positions per row into the page view's one-hot features."""
    bucket = lambda value, n: 0 if value is None else 1 + zlib.crc32(str(value).encode("utf-8", "replace")) % (n - 1)
    length = lambda n: 0 if n is None else 1 + min(LENGTHS - 2, max(0, int(n)).bit_length())
    return np.array(
        [(bucket(s, SOURCES), SOURCES + bucket(k, LANGS), SOURCES + LANGS + length(n)) for s, k, n in zip(source, lang, n_chars, strict=True)], dtype=np.int64
    ).reshape(-1, 3)


def _one_hot(at: np.ndarray) -> np.ndarray:
    x = np.zeros((len(at), SOURCES + LANGS + LENGTHS), dtype=np.float32)
    np.put_along_axis(x, at, 1.0, axis=1)
    return x


def co_train(text_x: np.ndarray, page_x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, confident: float = CONFIDENT):
    """(text weights, intercept), (page weights, intercept), calibration and blend. ``y`` is 1, 0, or -1 for the unlabelled pool.

    Every fourth labelled row is kept for calibration.
    """
    labelled, pool = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    kept = labelled[::4]
    train = np.setdiff1d(labelled, kept)
    extra: list[dict[int, int]] = [{}, {}]  # pseudo-labels each view was given by the other
    xs, penalties = (text_x, page_x), (1e-4, 1e-3)
    models = [None, None]
    for step in range(rounds + 1):
        for v, x in enumerate(xs):
            given = np.array(list(extra[v]), dtype=np.int64)
            rows = np.concatenate([train, given])
            target = np.concatenate([y[train], np.array([extra[v][g] for g in given], dtype=float)])
            models[v] = logistic(x[rows], target, penalties[v])
        if step < rounds and len(pool):
            for v, x in enumerate(xs):
                w, b = models[v]
                p = sigmoid(x[pool] @ w.astype(np.float32) + b)
                for label, sure in ((1, p >= confident), (0, p <= 1 - confident)):
                    extra[1 - v].update((int(i), label) for i in pool[sure])
    views = []
    for x, (w, b) in zip(xs, models, strict=True):
        z = (x[kept] @ w.astype(np.float32) + b)[:, None]
        slope, shift = _calibrated(z, y[kept])
        views.append(View(w, b, float(slope[0]), shift))
    z = np.stack([v.slope * (x[kept] @ v.weights.astype(np.float32) + v.intercept) + v.shift for x, v in zip(xs, views, strict=True)], axis=1)
    weights, shift = _calibrated(z, y[kept])
    return views[0], views[1], (float(weights[0]), float(weights[1]), shift)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Non-negative slopes and a shift that turn values into log-odds."""
    w, b = logistic(z.astype(np.float32), y, penalty=1e-3, steps=400, rate=0.2)
    return np.maximum(w, 0.0), b


def _sampled(docs: DataFrame, labels: DataFrame, per_class: int, pool: int) -> DataFrame:
    """At most 2 * per_class labelled and ``pool`` unlabelled documents, each the first by a hash of the id; one row for a doc_id."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    chosen = sample_per_key(known, "quality", ["doc_id"], per_class).groupBy("doc_id").agg(F.min("quality").alias("y"))
    by = [F.col("doc_id"), F.lit(1)]
    some = first_by_hash(docs.filter("doc_id is not null").select("doc_id"), by, F.lit(docs.count()), pool).distinct().orderBy(F.xxhash64(*by), "doc_id").limit(pool)
    seen = known.join(F.broadcast(some), "doc_id", "left_semi").select("doc_id").distinct()
    fresh = some.join(seen, "doc_id", "left_anti").withColumn("y", F.lit(-1))
    keys = chosen.unionByName(fresh)
    fields = [c for c in ("text", "source", "lang", "n_chars") if c in docs.columns]
    return docs.join(F.broadcast(keys), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*fields, "y")).alias("row")).select("doc_id", "row.*")


def fitted(rows: pa.Table) -> CoTrained | None:
    """The model of a sample (doc_id, text, source, lang, n_chars, y), taken by doc_id."""
    rows = rows.sort_by("doc_id")
    y = np.array(rows["y"].to_pylist(), dtype=float)
    if not ((y == 1).sum() >= 4 and (y == 0).sum() >= 4):
        return None
    texts = [t or "" for t in rows["text"].to_pylist()]
    scale = np.float32(len(ORDERS) * 10)
    text_x = np.zeros((len(texts), DIMS + 8), dtype=np.float32)  # filled in place: the task holds it once
    frequencies(texts, DIMS, ORDERS, text_x[:, :DIMS])
    text_x[:, :DIMS] *= scale
    text_x[:, DIMS:] = text_stats(texts)
    page_x = _one_hot(page_slots(*(rows[c].to_pylist() for c in ("source", "lang", "n_chars"))))
    text, page, blend = co_train(text_x, page_x, y)
    all_weights = text.weights
    text.weights = (all_weights[:DIMS] * scale).astype(np.float32)[:, None]
    return CoTrained(text, page, all_weights[DIMS:], blend)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = LABELLED_PER_CLASS, pool: int = POOL) -> CoTrained | None:
    """None unless both classes have labelled documents. Only the bounded sample meets in one task."""

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        parts = list(slices)
        if parts and (model := fitted(pa.concat_tables(parts))):
            yield pa.table({"model": pa.array([pickle.dumps(astuple(model))], "binary")})

    found = map_arrow(_sampled(docs, labels, per_class, pool).repartition(1), run, "model binary").collect()
    if not found:
        return None
    text, page, stats, blend = pickle.loads(found[0]["model"])
    return CoTrained(View(*text), View(*page), stats, blend)


def score_texts(model: CoTrained, texts, source, lang, n_chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chances of being good: by both views, by the text, by the page."""
    z = mean_weights(texts, model.text.weights, ORDERS)[:, 0] + text_stats(texts) @ model.stats + model.text.intercept
    at = page_slots(source, lang, n_chars)
    q = model.page.weights[at].sum(axis=1) + model.page.intercept
    z, q = model.text.slope * z + model.text.shift, model.page.slope * q + model.page.shift
    a, b, c = model.blend
    return sigmoid(a * z + b * q + c), sigmoid(z), sigmoid(q)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, n_chars) with score, text_score, page_score and keep.

    A document is kept if its chance of being good is at least ``threshold``. A null text, or one of white space only, scores 0. Nulls
    in the metadata are values of their own. If the labels do not hold both classes (at least four documents each),
    nothing can be learned: every other document scores 1. Repeated rows score alike, an empty table gives no rows;
    columns of ``docs`` named like a result are replaced.
    """
    names = ("score", "text_score", "page_score", "keep")
    docs = docs.drop(*names)
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    model = learn(base, labels, **bounds)

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            texts = [t or "" for t in rows["text"].to_pylist()]
            filled = np.array([bool(t.strip()) for t in texts])
            if model is None:
                three = (np.ones(len(texts)),) * 3
            else:
                three = score_texts(model, texts, rows["source"].to_pylist(), rows["lang"].to_pylist(), rows["n_chars"].to_pylist())
            three = [np.where(filled, s, 0.0) for s in three]
            for name, column in zip(names, [*three, three[0] >= threshold], strict=True):
                rows = rows.append_column(name, pa.array(column))
            yield rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, text_score double, page_score double, keep boolean"
    return map_arrow(docs, run, schema)
