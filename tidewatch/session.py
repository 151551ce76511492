"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_SLICE_KEY = "spark.tidewatch.rowsPerSlice"
DEFAULT_ROWS_PER_SLICE = 5_000_000
FREE_SHUFFLES_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_defining = threading.Lock()


def local_session(app: str = "tidewatch", cores: str = "*", shuffle_partitions: int = 8,
                  memory: str = "16g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_per_slice(spark: SparkSession) -> int:
    """Largest ordered group one task is asked to sort.

    Ordered operators measure their input first. Up to this many rows they use a
    plain window; beyond it the rows are cut into key ranges (see
    ``operators.running``).
    """
    return int(spark.conf.get(ROWS_PER_SLICE_KEY, str(DEFAULT_ROWS_PER_SLICE)))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Needed where two branches must see the very same row placement (range slices).
    The files outlive the executors that wrote them. The folder comes from
    ``spark.checkpoint.dir``; only a local session without one gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def run_once(df: DataFrame) -> DataFrame:
    """``df`` for a single job: its shuffle files go as that job ends, not when the driver happens to collect garbage.

    Spark looks at the setting when a table is defined, so it is on for that moment only.
    """
    conf = df.sparkSession.conf
    with _defining:
        before = conf.get(FREE_SHUFFLES_KEY, "false")
        conf.set(FREE_SHUFFLES_KEY, "true")
        try:
            return df.select("*")
        finally:
            conf.set(FREE_SHUFFLES_KEY, before)
