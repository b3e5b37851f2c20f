"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.session import checkpoint_dir

#: A broadcast side may hold at most this many bytes (rows x row width); beyond it the join shuffles.
MAX_BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder of the session."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint if its counted rows, at ``row_bytes`` each, are
    under ``MAX_BROADCAST_BYTES``; otherwise unchanged, and the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= MAX_BROADCAST_BYTES else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out
