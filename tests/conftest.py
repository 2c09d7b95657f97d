import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from answerloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, **{"spark.sql.shuffle.partitions": "8"})
    yield session
    session.stop()


ACTIONS = ["punch", "kick", "slap", "shove", "hair pull", "headbutt", "tackle", "choke", "hit with an object", "hit"]


def ten_clips():
    """Ten clips with different actions, places and people; the last has only a generic bystander."""
    rows = []
    for i, action in enumerate(ACTIONS):
        by = ["group of people"] if i == 9 else [f"student{i} in cap{i}", f"worker{i} in vest{i}"]
        rows.append((f"v{i + 1}.mp4", action, [f"man{i} in shirt{i}"], [f"woman{i} in coat{i}"], by, f"room {i}"))
    return rows


CLIP_SCHEMA = "clip string, action string, aggressor array<string>, victim array<string>, bystander array<string>, environment string"


@pytest.fixture(scope="session")
def clip_rows(spark):
    return spark.createDataFrame(ten_clips(), CLIP_SCHEMA)
