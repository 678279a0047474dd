from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from periodica.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = f"file://{tmp_path_factory.mktemp('shared')}"
    session = local_session("tests", 4, partitions=4, spark_checkpoint_dir=shared)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
