"""Language identification in two steps: the language family first, then the language within it.

Between families, and between the languages of one family, linear support vector machines decide one versus one over the
frequencies of hashed byte n-grams. They are fitted on a bounded sample (``per_language`` labelled documents of each
language, the first by a hash of their id) and score every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import map_arrow, sample_per_key
from shoebox.llm.features import frequencies, mean_weights, sigmoid, svm

PER_LANGUAGE = 500
DIMS = 1 << 13
ORDERS = (1, 2, 3)
UNKNOWN = "und"
STEEPNESS = 2.0
MAX_LANGUAGES = 200

# Families of common languages by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "semitic": "ar he mt",
    "indic": "bn gu hi mr ne pa si ur",
    "cjk": "ja ko zh",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


@dataclass
class Model:
    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]  # of families, then of languages; each wins its pair where the margin is positive
    weights: np.ndarray
    intercepts: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(texts: list[str], langs: list[str]) -> Model:
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(FAMILY_OF.get(lang, f"only {lang}"), []).append(lang)
    x = frequencies(texts, DIMS, ORDERS)
    scale = 1 / np.maximum(np.sqrt((x**2).mean(axis=0)), 1e-4)
    x *= scale.astype(np.float32)
    norm = float(np.sqrt((x**2).sum(axis=1)).mean()) if len(x) else 1.0
    x /= np.float32(norm)
    lang, pairs, weights, intercepts = np.array(langs), [], [], []
    family = np.array([FAMILY_OF.get(k, f"only {k}") for k in langs])
    for column, groups in [(family, sorted(families)), *((lang, own) for own in families.values())]:
        for a, b in combinations(groups, 2):
            rows = (column == a) | (column == b)
            w, c = svm(x[rows], np.where(column[rows] == a, 1.0, -1.0))
            pairs.append((a, b))
            weights.append(w * scale / norm)
            intercepts.append(c)
    return Model(families, pairs, np.array(weights, dtype=np.float32).T.reshape(DIMS, len(pairs)), np.array(intercepts))


def _winner(groups: list[str], wins: dict[tuple[str, str], np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The group with most pairs won (ties: the greatest sum of chances), and its mean chance."""
    votes, chance = np.zeros((rows, len(groups))), np.zeros((rows, len(groups)))
    for (i, a), (j, b) in combinations(enumerate(groups), 2):
        p = wins[a, b]
        votes[:, i] += p >= 0.5
        votes[:, j] += p < 0.5
        chance[:, i] += p
        chance[:, j] += 1 - p
    best = (votes + chance / (2 * len(groups))).argmax(axis=1)
    others = max(1, len(groups) - 1)
    return best, (chance[np.arange(rows), best] / others if len(groups) > 1 else np.ones(rows))


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, which must hold a letter."""
    wins = {}
    if model.pairs:
        margins = mean_weights(texts, model.weights, ORDERS) + model.intercepts
        wins = {pair: sigmoid(STEEPNESS * margins[:, m]) for m, pair in enumerate(model.pairs)}
    names = sorted(model.families)
    family, score = _winner(names, wins, len(texts))
    langs = np.empty(len(texts), dtype=object)
    for i, name in enumerate(names):
        within, chance = _winner(model.families[name], wins, len(texts))
        rows = family == i
        langs[rows] = np.array(model.families[name], dtype=object)[within[rows]]
        score = np.where(rows, score * chance, score)
    return langs.tolist(), score


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from the labelled documents outside the held-out third; None if there are none. The driver gets at most
    ``per_language`` texts for each of at most ``MAX_LANGUAGES`` languages.
    """
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = sample_per_key(usable.select("doc_id", "lang"), "lang", ["doc_id"], per_language).orderBy("lang", "doc_id").limit(per_language * MAX_LANGUAGES)
    ids = [(r["doc_id"], r["lang"]) for r in chosen.collect()]
    if not ids:
        return None
    keys = docs.sparkSession.createDataFrame(ids, "doc_id bigint, lang string")
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(keys.distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows = sorted((r["lang"], r["doc_id"], r["text"]) for r in rows if r["text"])
    return fit([r[2] for r in rows], [r[0] for r in rows])


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    ``lang_pred`` is ``und`` (score 0) for a null text, a text without a letter, or if nothing could be learned. Only the
    text enters a prediction, so equal texts get equal predictions. A null doc_id is never learned from, nor held out. Rows are
    independent, an empty table gives no rows, other columns are ignored.
    """
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "lang")
    model = learn(docs, per_language)

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            texts = rows["text"].to_pylist()
            known = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                found, scores[known] = predict(model, [texts[i] for i in known])
                for i, lang in zip(known, found, strict=True):
                    langs[i] = lang
            yield pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": langs, "score": scores})

    return map_arrow(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, "doc_id bigint, held_out boolean, lang_pred string, score double")
