"""Rule classifier: asset, fingerprint and layout columns to a category with its confidence.

Input columns are those of ``inputs``; nothing here needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions import fixed, scalars

C = F.col


def inputs(assets: DataFrame, fingerprints: DataFrame, layout: DataFrame, labels: DataFrame) -> DataFrame:
    """Assets with their fingerprint, layout and image labels, each of which may be missing."""
    prints = fingerprints.select("asset_id", "sharpness", "saturation", "flatness", "edge_density", "brightness")
    rows = scalars.device_match(scalars.with_derived(assets)).withColumn("aspect", scalars.aspect())
    rows = rows.join(prints, "asset_id", "left").join(layout, "asset_id", "left")
    return rows.join(labels.select("asset_id", "labels"), "asset_id", "left")


def _points(*terms: tuple[Column, Column | float], start: Column | None = None) -> Column:
    """``start`` and the values whose condition holds, added one after another as SQL does; unknown counts as false."""
    total = F.lit(0.0) if start is None else start
    for condition, value in terms:
        total = total + F.when(condition, value).otherwise(0.0)
    return total


def _known(name: str) -> Column:
    return F.coalesce(C(name), F.lit(0.0))


def not_tabular() -> Column:
    return 1 - F.least(F.lit(1.0), C("paired_rows") * 1.5)


def text_evidence() -> Column:
    """Enough text, or a status-bar clock, to corroborate an ambiguous screen size."""
    enough = (C("line_count") >= 4) & (C("text_area") > 0.015)
    return F.coalesce(enough, F.lit(False)) | F.coalesce("has_clock", F.lit(False))


def _gate_ambiguous() -> Column:
    return (C("device_match") == "ambiguous") & ((_known("flatness") > 0.35) | text_evidence())


def _gate_cropped() -> Column:
    text_heavy = F.coalesce((C("line_count") >= 8) & (C("text_area") > 0.04), F.lit(False))
    small = C("pixel_count") < 4_000_000
    return (C("device_match") == "none") & small & text_heavy & (_known("flatness") > 0.40) & ~C("has_location")


def looks_like_screen() -> Column:
    return C("is_screenshot") | (C("device_match") == "phone") | _gate_ambiguous() | _gate_cropped()


# Every weight and threshold of the scores below; results depend on them.


def chat_score() -> Column:
    flush = F.least(F.lit(1.0), C("right_hugging") * 2.5)
    bubbles = C("bimodality") * flush * 1.9 * not_tabular() + C("bimodality") * 0.25 * not_tabular()
    return _points(
        (C("has_clock"), 0.22), (C("line_count") >= 8, 0.35), (C("has_top_bar") & C("has_bottom_bar"), 0.45),
        (C("flatness") > 0.55, 0.35), (C("saturation") < 0.22, 0.25), start=bubbles + C("short_share") * 0.5,
    )


def _busy_without_text() -> Column:
    return (C("text_area") < 0.03) & (_known("edge_density") > 0.25)


def game_score() -> Column:
    wide = C("aspect") > 1.2
    hint = F.arrays_overlap("labels", F.array(*map(F.lit, fixed.GAME_LABELS)))
    return _points(
        (C("flatness") < 0.28, 0.4), (C("has_clock"), -0.85), (~C("has_clock") & wide, 0.35),
        (_busy_without_text(), 0.5), (~_busy_without_text() & (C("text_area") < 0.06), 0.2), (wide, 0.45), (hint, 0.3),
        start=_known("saturation") * 1.3 + _known("edge_density") * 0.9,
    )


def _digits_count() -> Column:
    return (C("line_count") >= 6) & (C("text_area") > 0.012)


def document_score() -> Column:
    dense = C("text_area") > 0.06
    hint = F.arrays_overlap("labels", F.array(*map(F.lit, fixed.DOCUMENT_LABELS)))
    white = (C("brightness") > 0.75) & (C("saturation") < 0.15) & (C("digit_share") > 0.15)
    return _points(
        (_digits_count(), C("digit_share") * 1.5), (dense, C("gap_regularity") * 0.6), (dense & (not_tabular() < 0.5), 0.5),
        (white, 0.4), (hint, 0.45), (C("has_clock"), 0.18), start=C("paired_rows") * 1.1,
    )


def web_score() -> Column:
    return _points(
        ((C("line_count") >= 12) & (C("short_share") < 0.5), 0.7), ((C("text_area") > 0.14) & (C("bimodality") < 0.25), 0.5),
        (C("has_top_bar") & ~C("has_bottom_bar"), 0.25), ((C("flatness") > 0.5) & (C("saturation") < 0.3), 0.2),
    )


def _settings_like() -> Column:
    return C("has_clock") & (C("column_count") <= 1) & (C("gap_regularity") > 0.55) & (C("line_count") >= 6)


def _home_screen_like() -> Column:
    return C("has_clock") & (C("column_count") >= 3) & C("columns_even") & (C("short_share") > 0.7)


def system_score() -> Column:
    one, grid = _settings_like(), _home_screen_like()
    return _points(
        (one, 0.85), (one & (C("text_area") < 0.06), 0.35), (one & (C("flatness") > 0.55) & (C("saturation") < 0.18), 0.45),
        (one & (C("paired_rows") < 0.25), 0.20), (grid, 1.05), (grid & (C("paired_rows") > 0.5), 0.40),
    )


SCORES = {
    "chatScreenshot": chat_score, "gameScreenshot": game_score, "documentShot": document_score, "webShot": web_score,
    "systemScreenshot": system_score,
    # no defensible rule exists for maps: only a learned head can give this category
    "mapScreenshot": lambda: F.lit(0.0),
    "screenshot": lambda: F.lit(0.20),
}


def score_columns() -> dict[str, Column]:
    return {name: make() for name, make in SCORES.items()}


def _ranked() -> Column:
    """Scores in falling order; equal scores go to the greater name."""
    return F.sort_array(F.array(*[F.struct(s.alias("score"), F.lit(n).alias("name")) for n, s in score_columns().items()]), asc=False)


def _screen_reason() -> list[Column]:
    return [
        F.when(C("is_screenshot"), "flagged as a screenshot"),
        F.when(~C("is_screenshot") & (C("device_match") == "phone"), "exact phone screen size"),
        F.when(~C("is_screenshot") & _gate_ambiguous(), "screen size with interface elements"),
        F.when(~C("is_screenshot") & _gate_cropped(), "small, flat and full of text: a cropped screenshot"),
    ]


def _text_reasons() -> list[Column]:
    wide = C("aspect") > 1.2
    return [
        F.when(C("has_top_bar") & C("has_bottom_bar"), "top bar and input field"),
        F.when((C("bimodality") > 0.45) & (not_tabular() > 0.6), "bubbles on both sides"),
        F.when(C("has_clock"), "status bar clock: an app, not a full-screen game"),
        F.when(~C("has_clock") & wide, "landscape without status bar: like a full-screen game"),
        F.when(_busy_without_text(), "busy picture, almost no text"),
        F.when(wide, "landscape capture"),
        F.when(_digits_count() & (C("digit_share") > 0.22), "dense digits: maybe a receipt or ticket"),
        F.when(C("paired_rows") > 0.4, "field and value in two columns"),
        F.when(_settings_like(), "one column of even rows under a status bar"),
        F.when(_home_screen_like(), "labels on a regular grid: like a home screen"),
    ]


def classify(rows: DataFrame) -> DataFrame:
    """Adds ``category``, ``confidence`` and ``reasons``."""
    screen, blurry = looks_like_screen(), ~C("is_screenshot") & (C("sharpness") < 0.16) & (C("edge_density") < 0.12)
    rows = rows.withColumn("_ranked", F.when(C("line_count").isNotNull(), _ranked()))
    best, second = C("_ranked")[0], C("_ranked")[1]
    total = best["score"] + second["score"]
    margin = F.when(total <= 0, 0.4).otherwise(F.least(F.lit(0.97), best["score"] / total))
    unclear = best["score"] < 0.55

    stage = (
        F.when(C("is_screen_recording"), "recording").when(C("is_video"), "video").when(blurry, "blurry")
        .when(~screen, "photo").when(C("line_count").isNull(), "unseen").when(unclear, "unclear").otherwise("scored")
    )
    rows = rows.withColumn("stage", stage)
    at = lambda s: C("stage") == s
    category = (
        F.when(at("recording"), "screenRecording").when(at("video"), "largeVideo").when(at("blurry"), "blurry")
        .when(at("scored"), best["name"]).otherwise("screenshot")
    )
    confidence = (
        F.when(at("recording"), 0.95).when(at("video"), 0.5).when(at("blurry"), 0.55 + (0.16 - C("sharpness")))
        .when(at("photo"), 0.0).when(at("unseen"), 0.45).when(at("unclear"), 0.5).otherwise(F.greatest(F.lit(0.4), margin))
    )
    seen = F.array_compact(F.array(*_screen_reason()))
    evidence = F.when(at("unseen"), seen).otherwise(F.concat(seen, F.array_compact(F.array(*_text_reasons()))))
    reasons = (
        F.when(at("recording"), F.array(F.lit("screen recording"))).when(at("video"), F.array(F.lit("video")))
        .when(at("blurry"), F.array(F.lit("out of focus, little detail"))).when(at("photo"), F.array().cast("array<string>")).otherwise(evidence)
    )
    return rows.select(*[c for c in rows.columns if c not in ("_ranked", "stage")], category.alias("category"), confidence.alias("confidence"), reasons.alias("reasons"))


def eligible_for_triage(
    assets: DataFrame, protected: DataFrame, queued: DataFrame, now: str, *, skip_favorites: bool = True, skip_located: bool = False,
    skip_live: bool = False, skip_edited: bool = True, skip_recent_days: int = 3,
) -> DataFrame:
    """Assets the classifier should look at. Cheap column tests run before the anti joins."""
    rows = scalars.with_derived(assets)
    for active, flag in ((skip_favorites, "is_favorite"), (skip_located, "has_location"), (skip_live, "is_live"), (skip_edited, "has_adjustments")):
        if active:
            rows = rows.filter(~C(flag))
    if skip_recent_days > 0:
        rows = rows.filter(C("creation_ts") <= F.lit(now).cast("timestamp") - F.expr(f"interval {skip_recent_days} days"))
    rows = rows.filter(C("is_screen_recording") | ~(C("is_video") | C("is_panorama") | C("is_portrait")))
    for gone in (protected, queued):
        rows = rows.join(gone.select("asset_id"), "asset_id", "left_anti")
    return rows


def candidates(classified: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Rows worth proposing: confident enough, and of a category that may be proposed at all."""
    return classified.filter((C("confidence") >= threshold) & ~C("category").isin(*fixed.NEVER_PROPOSED))
