import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparloom import session

    spark = session.local_session(8, 8, "6g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("shared")))
    session.ship(spark)
    return spark
