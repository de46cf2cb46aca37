"""The whole scan: from a library's assets to the groups it shows and the candidates it proposes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.operators import copies, keepers, moments, rules
from shoebox.operators.distributed import owned, shared
from shoebox.operators.settings import moment_window, with_settings
from shoebox.session import materialize
from shoebox.sources import catalog

DEFAULT_STRICTNESS = 6 / 7  # shots of one moment at most ten seconds apart


def find_groups(
    assets: DataFrame, fingerprints: DataFrame, protected: DataFrame, resources: DataFrame | None = None, settings: DataFrame | None = None,
    include_videos: bool = True, skip_favorites: bool = True,
) -> DataFrame:
    """Every member of every group worth showing, with its group's keeper and its exact size.

    Protected assets take no part. Copies come first, moments among the photographs they leave, videos by metadata; how close the shots of a
    moment must be is each library's strictness in ``settings`` (library_id, strictness). Groups whose spare members are all favourites are left
    out. ``resources`` (asset_id, bytes) then gives the shown members their exact sizes; estimates decide until then, as sizes are read for
    what is shown only.
    """
    pool = materialize(keepers.eligible(assets, protected, include_videos), "scan-eligible")
    images = materialize(copies.images(pool, fingerprints), "scan-images")
    claimed = materialize(copies.find_copies(pool, fingerprints), "scan-copies")
    photos = moments.unclaimed_photos(images, claimed)
    if settings is None:
        photos = photos.withColumn("strictness", F.lit(DEFAULT_STRICTNESS))
    else:
        photos = with_settings(photos, settings, strictness=DEFAULT_STRICTNESS)
    runs = materialize(moments.time_runs(photos.withColumn("window", moment_window()), "window"), "scan-runs")
    shots = moments.moment_members(moments.moment_edges(runs, moments.run_verdicts(runs, "window")))
    members = claimed.unionByName(shots).unionByName(copies.video_members(pool))
    rows = materialize(keepers.member_rows(members, pool, fingerprints), "scan-members")
    shown = materialize(keepers.worthwhile(keepers.with_keepers(keepers.with_scores(rows)), skip_favorites), "scan-grouped")
    return shown if resources is None else catalog.refine_sizes(shown, catalog.exact_sizes(resources, shown))


def find_candidates(
    inputs: DataFrame, assets: DataFrame, grouped: DataFrame, protected: DataFrame, now: str, resources: DataFrame | None = None, threshold: float = 0.35,
    **rule_switches,
) -> DataFrame:
    """(library_id, asset_id, category, confidence, reasons, byte_size) of what the scan proposes beside the groups.

    Looked at is what the protection rules let through (``rules.eligible_for_triage``, which takes ``rule_switches``) and no group already offers;
    ``inputs`` are the classifier's. Proposed is what is sure enough and of a category that may be. Exact sizes are read for the proposed only.
    """
    offered = grouped.filter(keepers.discardable(grouped)).select(*owned(grouped, "asset_id"))
    targets = rules.eligible_for_triage(assets, protected, offered, now, **rule_switches)
    seen = inputs.join(targets.select(*owned(targets, "asset_id")), shared(inputs, targets, "asset_id"), "left_semi")
    proposed = rules.candidates(rules.classify(seen), threshold).select("asset_id", "category", "confidence", "reasons")
    found = materialize(targets.select(*owned(targets, "asset_id"), "byte_size").join(proposed, "asset_id"), "scan-candidates")
    return found if resources is None else catalog.refine_sizes(found, catalog.exact_sizes(resources, found))
