"""Checks of size before anything is broadcast, and reliable cuts of lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.session import ensure_checkpoint_dir


# Results cut to this many rows may be broadcast.
FEW_ROWS = 100_000


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own size estimate of `df` is within the session's broadcast limit.

    The estimate of a scan comes from its file sizes, so no job runs.
    """
    try:
        conf = df.sparkSession._jsparkSession.sessionState().conf()
        stats = df._jdf.queryExecution().optimizedPlan().stats()
    except AttributeError:  # no JVM at hand, as with a remote session
        return False
    return int(str(stats.sizeInBytes())) <= conf.autoBroadcastJoinThreshold()


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Run `df` once and keep its rows in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
