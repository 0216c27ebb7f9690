import os
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = f"{REPO}:{os.environ.get('PYTHONPATH', '')}"

from tessellon.plans.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    got = session(4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.driver.memory": "3g"})
    got.sparkContext.setLogLevel("ERROR")
    ship(got)
    yield got
    got.stop()
