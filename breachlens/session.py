"""Session settings: what the engine needs, and what a cluster job should start with."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that may be changed on a running session.
RUNTIME_CONF = {
    # Dates are shown in UTC, so results do not depend on the machine.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Split a skewed join side even if that costs one more shuffle afterwards: one
    # run, host or plugin may hold a large share of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# How much a task may be given, so that its sorts and hash tables stay the same size on any input. A session
# that has smaller values keeps them.
MOST_BYTES = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
}
#: Bytes of input files for which a shuffle starts with one more partition; AQE merges small ones.
INPUT_OF_PARTITION = 4 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def configure(spark: SparkSession, inputs: list[str] | None = None) -> SparkSession:
    """Apply the runtime settings to a session somebody else has made. With the paths of the
    inputs, shuffles start from as many partitions as their files ask for."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in MOST_BYTES.items():
        if as_bytes(spark.conf.get(key)) > as_bytes(most):
            spark.conf.set(key, most)
    if inputs is not None:
        fit_shuffles(spark, inputs)
    return spark


def fit_shuffles(spark: SparkSession, inputs: list[str]) -> None:
    """Let shuffles start from a partition for each INPUT_OF_PARTITION bytes of the input files, if
    those are more than the session has. A fixed number would give each task more rows, the larger
    the input. Only sizes of files are asked for; a path that is not there counts for nothing."""
    size = 0
    for path in inputs:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(folder):
            size += files.getContentSummary(folder).getLength()
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size > own * INPUT_OF_PARTITION:
        spark.conf.set(_INITIAL, str(-(-size // INPUT_OF_PARTITION)))
    else:
        spark.conf.unset(_INITIAL)


def build_session(
    app_name: str = "breachlens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Start a session. On a cluster leave `master` out and let spark-submit set it.

    `shuffle_partitions` is the number AQE starts from before it merges small
    partitions; for 100 TB inputs take some 3 times the executor cores, or more.
    """
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        # Streaming state is one row per scan; RocksDB keeps it off the heap.
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        **RUNTIME_CONF,
        **MOST_BYTES,
        **(extra or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a job within shuffles is deleted when the job ends, and not only when the driver collects
    garbage. For jobs whose results are written and read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_made: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether the driver is the only process, so that its folders are everybody's."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and streaming output.

    A cluster names a shared one in spark.checkpoint.dir. Only where that is unset and
    the master is local, as in tests, is a local folder made, one per application.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a folder that the driver and all executors share"
            )
        application = spark.sparkContext.applicationId
        if application not in _made:
            _made[application] = tempfile.mkdtemp(prefix="breachlens-")
        known = _made[application]
    return known.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder unless one is set already."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
