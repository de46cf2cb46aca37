"""The scan: assets and fingerprints to copy, moment and video groups with keepers.

Results other queries build on are written once per ``Library``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.operators import copies, keepers, moments, queue
from shoebox.sources.derived import Library


def image_rows(lib: Library) -> DataFrame:
    return copies.images(lib.assets(), lib.fingerprints())


def signature_rows(lib: Library) -> DataFrame:
    return lib.keep("signatures", lambda: copies.signatures(image_rows(lib)))


def copy_edges(lib: Library) -> DataFrame:
    sigs = signature_rows(lib)
    return lib.keep("copy-edges", lambda: copies.identical_edges(sigs).union(copies.copy_edges(sigs)))


def copy_labels(lib: Library) -> DataFrame:
    return lib.keep("copy-labels", lambda: copies.copy_labels(signature_rows(lib), copy_edges(lib)))


def copy_members(lib: Library) -> DataFrame:
    return lib.keep("copy-members", lambda: copies.copy_members(image_rows(lib), signature_rows(lib), copy_labels(lib)))


def runs(lib: Library) -> DataFrame:
    photos = moments.unclaimed_photos(image_rows(lib), copy_members(lib))
    return lib.keep("moment-runs", lambda: moments.time_runs(photos))


def verdicts(lib: Library) -> DataFrame:
    return lib.keep("run-verdicts", lambda: moments.run_verdicts(runs(lib)))


def moment_edges(lib: Library) -> DataFrame:
    return moments.moment_edges(runs(lib), verdicts(lib))


def moment_members(lib: Library) -> DataFrame:
    return lib.keep("moment-members", lambda: moments.moment_members(moment_edges(lib)))


def members(lib: Library) -> DataFrame:
    return copy_members(lib).unionByName(moment_members(lib)).unionByName(copies.video_members(lib.assets()))


def scored(lib: Library) -> DataFrame:
    return keepers.with_scores(keepers.member_rows(members(lib), lib.assets(), lib.fingerprints()))


def grouped(lib: Library) -> DataFrame:
    """Every group member with its group's keeper."""
    return lib.keep("grouped", lambda: keepers.with_keepers(scored(lib)))


def selected(lib: Library) -> DataFrame:
    """Group members after the user's picks. In these checks, of the groups with an even id the members with id % 3 = 1 are kept."""
    picks = grouped(lib).filter("group_id % 2 = 0").select("group_id", "asset_id", (F.col("asset_id") % 3 == 1).alias("kept"))
    return lib.keep("selected", lambda: keepers.apply_selection(grouped(lib), picks))


def resolved(lib: Library) -> DataFrame:
    """Decisions with the undos that take them back, one undo stack per library."""
    return lib.keep("resolved-decisions", lambda: queue.with_undo(lib.decisions(), ["library_id"]))


def decision_state(lib: Library) -> DataFrame:
    """What is pending and protected now, per library and asset."""
    return lib.keep("decision-state", lambda: queue.current_state(resolved(lib), ["library_id", "asset_id"]))


def protected(lib: Library) -> DataFrame:
    return queue.protected_items(decision_state(lib), ["asset_id"]).distinct()


def flagship(lib: Library) -> DataFrame:
    """Which assets are duplicates, which one to keep, how many bytes come back."""
    return keepers.sorted_groups(keepers.group_table(grouped(lib)))


