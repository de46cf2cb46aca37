"""Learned heads: an online softmax over categories and an online logistic score, one per library.

Training is an ordered fold, defined by (ts, event_id): a library's examples stream through one task
in that order, and all the task holds is the weights. Libraries train in parallel.
Scoring is a join with one model row per library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions import vectors
from shoebox.functions.fixed import LEARNABLE
from shoebox.operators.distributed import shared
from shoebox.session import materialize

# Learning rates, decays, warm-up counts and trust limits of the two heads.
SOFTMAX_RATE, SOFTMAX_DECAY, SOFTMAX_WARM = 0.35, 1e-4, 12
SOFTMAX_TRUST_LIMIT, SOFTMAX_TRUST_SAMPLES = 0.92, 300.0
LOGISTIC_RATE, LOGISTIC_DECAY, LOGISTIC_WARM = 0.25, 2e-4, 8
LOGISTIC_INFLUENCE_LIMIT, LOGISTIC_INFLUENCE_SAMPLES = 0.6, 250.0

SOFTMAX_SCHEMA = "samples bigint, per_class array<bigint>, bias array<double>, weights array<array<double>>"
LOGISTIC_SCHEMA = "positives bigint, negatives bigint, bias double, weights array<double>"


class Softmax:
    """Multinomial logistic regression, one gradient step per example."""

    def __init__(self, dim: int, classes: int = len(LEARNABLE)):
        self.weights, self.bias = np.zeros((classes, dim)), np.zeros(classes)
        self.per_class = np.zeros(classes, dtype=np.int64)

    @classmethod
    def restored(cls, state: np.ndarray, classes: int = len(LEARNABLE)) -> Softmax:
        """From bias, examples per class and weights in one array."""
        head = cls(len(state) // classes - 2, classes)
        head.bias, head.per_class = np.array(state[:classes]), np.array(state[classes : 2 * classes], dtype=np.int64)
        head.weights = np.array(state[2 * classes :]).reshape(classes, -1)
        return head

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.weights @ x + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    def step(self, x: np.ndarray, target: int) -> None:
        if len(x) != self.weights.shape[1] or not 0 <= target < len(self.bias):
            return
        gradient = self.predict(x)
        gradient[target] -= 1
        moved = np.abs(gradient) > 1e-6
        rate = SOFTMAX_RATE * gradient[moved]
        # the decay is per step, not scaled by the rate
        self.weights[moved] -= rate[:, None] * x + SOFTMAX_DECAY * self.weights[moved]
        self.bias[moved] -= rate
        self.per_class[target] += 1

    def row(self) -> dict:
        return {
            "samples": int(self.per_class.sum()), "per_class": self.per_class.tolist(),
            "bias": self.bias.tolist(), "weights": [list(w) for w in self.weights],
        }


class Logistic:
    """Binary logistic regression, one gradient step per example."""

    def __init__(self, dim: int):
        self.weights, self.bias, self.positives, self.negatives = np.zeros(dim), 0.0, 0, 0

    def score(self, x: np.ndarray) -> float:
        return 0.5 if len(x) != len(self.weights) else float(1 / (1 + np.exp(-(self.weights @ x + self.bias))))

    def step(self, x: np.ndarray, target: int) -> None:
        if len(x) != len(self.weights):
            return
        rate = LOGISTIC_RATE * (self.score(x) - target)
        self.weights -= rate * x + LOGISTIC_DECAY * self.weights
        self.bias -= rate
        if target:
            self.positives += 1
        else:
            self.negatives += 1

    def row(self) -> dict:
        return {"positives": self.positives, "negatives": self.negatives, "bias": self.bias, "weights": self.weights.tolist()}


def fold(examples: DataFrame, keys: list[str], order: list[str], model: type, schema: str, start: DataFrame | None = None) -> DataFrame:
    """One trained model row per key from (keys, order, embedding, target).

    The first example fixes the dimension; others are skipped, as a head of another width would. ``start`` (keys, start) holds what
    ``model.restored`` goes on from, for keys that were trained before.
    """
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in examples.select(*keys).schema)
    # loop variables of a nested function are not visible to the worker: bind them by name
    position = [c for c in order if c not in keys]

    def run(key, batches):
        head, last = None, None
        for pdf in batches:
            if head is None and "start" in pdf and pdf["start"].iloc[0] is not None:
                head, pdf = model.restored(pdf["start"].iloc[0]), pdf.iloc[1:]
            steps = list(zip(*[pdf[c] for c in position]))
            if steps and (last is not None and steps[0] < last or any(a > b for a, b in zip(steps, steps[1:]))):
                raise ValueError("examples must arrive in order")
            last = steps[-1] if steps else last
            for x, target in zip(pdf["embedding"], pdf["target"]):
                x = np.asarray(x, dtype=np.float64)
                head = head or model(len(x))
                head.step(x, int(target))
        if head is not None:
            out = pd.DataFrame([head.row()])
            for i, name in enumerate(keys):
                out.insert(i, name, [key[i]])
            yield out

    run.__annotations__ = {"key": tuple, "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    ready = examples.select(*keys, *position, "embedding", "target")
    first = []
    if start is not None:  # one row ahead of the key's examples
        empty = [v.cast(ready.schema[c].dataType).alias(c) for c, v in ((*((c, F.lit(0)) for c in (*position, "target")), ("embedding", F.array())))]
        ready = ready.withColumn("start", F.lit(None).cast("array<double>")).unionByName(start.select(*keys, *empty, "start"))
        first = [F.col("start").isNull()]
    ordered = ready.repartition(*keys).sortWithinPartitions(*keys, *first, *position)
    return ordered.groupBy(*keys).applyInPandas(run, f"{key_schema}, {schema}")


def train_softmax(examples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` is the index of the category among the learnable ones."""
    return fold(examples, keys, order, Softmax, SOFTMAX_SCHEMA)


def train_logistic(examples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` is 1 where the user deleted."""
    return fold(examples, keys, order, Logistic, LOGISTIC_SCHEMA)


def class_index(category: str | Column) -> Column:
    """Position among the learnable categories, -1 for others."""
    return (F.array_position(F.array(*map(F.lit, LEARNABLE)), F.col(category) if isinstance(category, str) else category) - 1).cast("int")


def softmax(weights: str, bias: str, x: str) -> Column:
    """Probabilities of the classes; an empty array when the widths differ."""
    logits = F.zip_with(weights, bias, lambda w, b: vectors.dot(w, x) + b)
    shifted = F.transform(F.zip_with(logits, F.array_repeat(F.array_max(logits), F.size(weights)), lambda z, m: z - m), F.exp)
    total = F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b)
    probabilities = F.zip_with(shifted, F.array_repeat(total, F.size(weights)), lambda e, t: e / t)
    return F.when(F.size(F.col(weights)[0]) == F.size(x), probabilities).otherwise(F.array().cast("array<double>"))


def predict(items: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``probabilities``, ``samples``; libraries without a model get nulls."""
    joined = items.join(models.select(*keys, "weights", "bias", "samples"), keys, "left")
    return joined.withColumn("probabilities", softmax("weights", "bias", "embedding")).drop("weights", "bias")


def is_warm(samples: str = "samples") -> Column:
    return F.col(samples) >= SOFTMAX_WARM


def trust(samples: str = "samples") -> Column:
    return F.least(F.lit(SOFTMAX_TRUST_LIMIT), F.col(samples) / SOFTMAX_TRUST_SAMPLES)


def margin(probabilities: str = "probabilities") -> Column:
    """Share of the top probability among the top two."""
    ranked = F.sort_array(probabilities, asc=False)
    return F.when((F.size(probabilities) >= 2) & (ranked[0] > 0), ranked[0] / (ranked[0] + ranked[1])).otherwise(0.0)


def _argmax(values: Column) -> Column:
    """struct(value, name) of the greatest value; equal values go to the greater name."""
    names = F.array(*map(F.lit, LEARNABLE))
    return F.array_max(F.zip_with(values, names, lambda v, n: F.struct(v.alias("value"), n.alias("name"))))


def fuse(rows: DataFrame, category: str = "category", confidence: str = "confidence") -> DataFrame:
    """Blends the rule verdict with the head by trust: adds ``fused``, ``fused_confidence``, ``used_model``.

    The rule stands when the head is cold or saw nothing comparable.
    """
    names = F.array(*map(F.lit, LEARNABLE))
    rule = F.transform(names, lambda n: F.when(n == F.col(category), F.col(confidence)).otherwise(0.0))
    blended = F.zip_with(rule, "probabilities", lambda r, p: r * (1 - F.col("_trust")) + p * F.col("_trust"))
    usable = F.coalesce(is_warm() & (F.size("probabilities") == len(LEARNABLE)), F.lit(False))
    rows = rows.withColumn("_trust", trust()).withColumn("_best", F.when(usable, _argmax(blended))).withColumn("_top", F.when(usable, _argmax(F.col("probabilities"))))
    used = F.coalesce((F.col("_best.name") == F.col("_top.name")) & (F.col("_best.name") != F.col(category)), F.lit(False))
    return (
        rows.withColumn("fused", F.coalesce("_best.name", category))
        .withColumn("fused_confidence", F.when(F.col("_best").isNotNull(), F.least(F.lit(0.98), "_best.value")).otherwise(F.col(confidence)))
        .withColumn("used_model", used).drop("_trust", "_best", "_top")
    )


def fuse_in_scan(rows: DataFrame) -> DataFrame:
    """Within a scan: an override is taken as it is, otherwise the confidence may only rise to 0.9 of the blend."""
    fused = fuse(rows)
    seen = F.size(F.coalesce("probabilities", F.array().cast("array<double>"))) > 0
    risen = F.when(seen, F.greatest(F.col("confidence"), F.col("fused_confidence") * 0.9)).otherwise(F.col("confidence"))
    return (
        fused.withColumn("confidence", F.when(F.col("used_model"), F.col("fused_confidence")).otherwise(risen))
        .withColumn("category", F.when(F.col("used_model"), F.col("fused")).otherwise(F.col("category")))
        .drop("fused", "fused_confidence")
    )


def reclassify(rows: DataFrame) -> DataFrame:
    """Existing candidates change category only where the warm head overrides."""
    fused = fuse(rows)
    changed = F.col("used_model") & (F.col("fused") != F.col("category"))
    return fused.select(
        *[c for c in rows.columns if c not in ("category", "confidence")],
        F.when(changed, F.col("fused")).otherwise(F.col("category")).alias("category"),
        F.when(changed, F.col("fused_confidence")).otherwise(F.col("confidence")).alias("confidence"), changed.alias("changed"),
    )


def logistic_score(weights: str, bias: str, x: str) -> Column:
    """0.5 when the widths differ."""
    z = vectors.dot(weights, x) + F.col(bias)
    return F.when(F.size(weights) == F.size(x), 1 / (1 + F.exp(-z))).otherwise(0.5)


def influence(positives: Column, negatives: Column) -> Column:
    """How far the learned score moves the queue; 0 until both kinds were seen often enough."""
    warm = (positives >= LOGISTIC_WARM) & (negatives >= LOGISTIC_WARM)
    return F.when(warm, F.least(F.lit(LOGISTIC_INFLUENCE_LIMIT), (positives + negatives) / LOGISTIC_INFLUENCE_SAMPLES)).otherwise(0.0)


def one_pass(members: DataFrame, keys: list[str], number: Column, seed: int = 0) -> DataFrame:
    """Every member in the order of a pass (columns pass, shuffle, item_id)."""
    return members.withColumn("pass", number).withColumn("shuffle", F.xxhash64(F.lit(seed), "pass", *keys, "item_id"))


def repeated_passes(members: DataFrame, keys: list[str], passes: int = 6, seed: int = 0) -> DataFrame:
    """Every member once per pass, each pass in its own seeded order (columns pass, shuffle, item_id)."""
    return one_pass(members, keys, F.explode(F.sequence(F.lit(1), F.lit(passes))), seed)


def train_on_members(members: DataFrame, keys: list[str], passes: int = 6, at_once: int = 1) -> DataFrame:
    """Cluster-supervised training: all members of a named cluster, several shuffled passes, of which ``at_once`` are sorted at once."""
    model = None
    for p in range(1, passes + 1, at_once):  # they go on from the passes before, so a task does not sort its members ``passes`` times
        rows = one_pass(members, keys, F.explode(F.sequence(F.lit(p), F.lit(min(passes, p + at_once - 1)))))
        start = None if model is None else model.select(*keys, F.concat("bias", F.col("per_class").cast("array<double>"), F.flatten("weights")).alias("start"))
        model = materialize(fold(rows, keys, ["pass", "shuffle", "item_id"], Softmax, SOFTMAX_SCHEMA, start), "model-pass")
    return model


def learning_summary(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Swipes learned from, influence percent, and samples still needed, per library."""
    taught = decisions.filter(F.col("action").isin("delete", "keepOnce", "whitelist", "relabel"))
    counts = taught.groupBy(*keys).agg(
        F.count_if(F.col("action") == "delete").alias("positives"),
        F.count_if(F.col("action").isin("keepOnce", "whitelist")).alias("negatives"),
        F.count_if(F.col("action") == "relabel").alias("corrections"),
    )
    pos, neg = F.col("positives"), F.col("negatives")
    return counts.select(
        *keys, (pos + neg).alias("samples"), (influence(pos, neg) * 100).cast("int").alias("influence_percent"),
        F.greatest(F.lit(0).cast("bigint"), LOGISTIC_WARM - F.least(pos, neg)).alias("still_needed"), "corrections",
    )


def apply_corrections(candidates: DataFrame, corrections: DataFrame) -> DataFrame:
    """The latest correction (asset_id, ts, event_id, corrected) replaces a candidate's category, within its library where both know theirs."""
    keys = shared(candidates, corrections, "asset_id")
    last = corrections.groupBy(*keys).agg(F.max_by("corrected", F.struct("ts", "event_id")).alias("corrected"))
    return candidates.join(last, keys, "left").withColumn("category", F.coalesce("corrected", "category")).drop("corrected")
