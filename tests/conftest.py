import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test data here")
    return SMALL


def plain(value):
    """A cell in a form that both engines share."""
    if value is None or type(value).__name__ in ("NAType", "NaTType") or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return str([plain(v) for v in value.tolist()])
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, bool) or type(value).__name__ in ("bool_", "bool"):
        return bool(value)
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


def rows_of(frame):
    return sorted((tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.fixture
def agree():
    """Compares a query with its SQL twin on a folder."""
    import duckdb

    def check(spark, query, twin, folder):
        c = duckdb.connect()
        for name in os.listdir(folder):
            c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{name}')")
        ours, theirs = query(spark, folder).toPandas(), c.execute(twin).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows_of(ours) == rows_of(theirs)

    return check


@pytest.fixture
def split_plans(spark):
    """Runs a function with low thresholds for skew, and counts its plans with a join that was split for it."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "50000",
    }

    def run(job):
        store = spark._jsparkSession.sharedState().statusStore()
        known = lambda: [said.apply(i) for said in [store.executionsList()] for i in range(said.size())]
        last = max((e.executionId() for e in known()), default=-1)  # old ones are forgotten: numbers, not places
        job()
        return sum("skew=true" in e.physicalPlanDescription() for e in known() if e.executionId() > last)

    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield run
    for k, v in old.items():
        spark.conf.set(k, v)
