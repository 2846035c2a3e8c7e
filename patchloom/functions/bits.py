"""64-bit hashes live in signed longs; their order and display are unsigned."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGN = -(1 << 63)


def unsigned(column: Column | str) -> Column:
    """A sort key that orders the two's-complement bits as unsigned integers."""
    return (F.col(column) if isinstance(column, str) else column).bitwiseXOR(F.lit(SIGN))


def hex16(column: Column | str) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def to_signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def to_unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
