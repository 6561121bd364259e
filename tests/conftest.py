import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from featforge.session import local_session

    s = local_session(8, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def skewed(spark):
    """Series of three groups, one holding most rows, with equal times and gaps."""
    import random

    rng = random.Random(7)
    rows, i = [], 0
    for group, n in (("hot", 240), ("small", 9), (None, 60)):
        for _ in range(n):
            rows.append((i, group, rng.randrange(0, 50) if group != "hot" else int(rng.random() ** 3 * 1000),
                         None if rng.random() < 0.3 else round(rng.uniform(-5, 5), 2)))
            i += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, g string, ts long, v double").repartition(4)
