import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from shoebox.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lib(spark):
    from shoebox.plans import registry

    return registry.library(spark, SF)


START = datetime(2024, 1, 1)
ASSET_SCHEMA = (
    "library_id bigint, asset_id bigint, creation_ts timestamp, pixel_width int, pixel_height int, byte_size bigint, is_favorite boolean, "
    "has_location boolean, is_video boolean, duration double, burst_id string, subtypes int, filename string, content_hash string"
)
PRINT_SCHEMA = (
    "asset_id bigint, dhash bigint, phash bigint, sharpness double, flatness double, saturation double, edge_density double, brightness double, version int"
)


def asset(asset_id, at=0.0, w=4032, h=3024, size=1000, burst=None, subtypes=0, content=None, **more):
    row = dict(
        library_id=0, asset_id=asset_id, creation_ts=START + timedelta(seconds=at), pixel_width=w, pixel_height=h, byte_size=size,
        is_favorite=False, has_location=False, is_video=False, duration=0.0, burst_id=burst, subtypes=subtypes, filename=f"IMG_{asset_id}",
        content_hash=content or f"c{asset_id}",
    )
    row.update(more)
    return row


def mark(asset_id, dhash=0, phash=0, sharpness=0.5):
    return dict(asset_id=asset_id, dhash=dhash, phash=phash, sharpness=sharpness, flatness=0.5, saturation=0.5, edge_density=0.5, brightness=0.5, version=8)


def tables(spark, assets, prints):
    columns = [c.split()[0] for c in ASSET_SCHEMA.split(", ")]
    names = [c.split()[0] for c in PRINT_SCHEMA.split(", ")]
    return (
        spark.createDataFrame([tuple(a[c] for c in columns) for a in assets], ASSET_SCHEMA),
        spark.createDataFrame([tuple(p[c] for c in names) for p in prints], PRINT_SCHEMA),
    )
