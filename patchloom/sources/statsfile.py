"""The statistics file: a header line and records of exactly 90 bytes."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import checkpoint, shared_folder, to_unsigned, unsigned

RECORD_BYTES = 90


def format_record(hash_: int, n_patches: int, x: float, y: float) -> str:
    """Python's formatting gives the exact digits of a double; the JVM's pads its shortest ones."""
    line = f"{to_unsigned(hash_):016x}\t{n_patches:20d}\t{x:25.17e}\t{y:25.17e}\n"
    if len(line) != RECORD_BYTES:
        raise ValueError(f"a record of {len(line)} bytes")
    return line


def header(k: int) -> str:
    """Names nothing that depends on how the work was split."""
    return f"# hash-stats k={k} (hash, patch count, rep x, rep y)\n"


def write_stats(top: DataFrame, path: str) -> int:
    """Write the rows in order of rank; replaces the file.  Returns the records.

    Executors sort ranges of the rank and format their records into parts in the shared folder; the
    driver only streams the parts, which are in order, into one file.
    """
    spark = top.sparkSession
    ranked = top.select("*", unsigned("hash").alias("_u"), (-F.col("n_patches")).alias("_rank"))
    placed = checkpoint(ranked.repartitionByRange("_rank", "_u").sortWithinPartitions("_rank", "_u").drop("_rank", "_u"))
    n, parts = placed.count(), f"{shared_folder(spark)}/stats-{uuid.uuid4().hex}"
    records(placed).select("record").write.text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    system = folder.getFileSystem(conf)
    target = jvm.org.apache.hadoop.fs.Path(jvm.java.io.File(path).toURI()) if "://" not in path else jvm.org.apache.hadoop.fs.Path(path)
    new = jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.new")
    store = target.getFileSystem(conf)
    store = store.getRawFileSystem() if hasattr(store, "getRawFileSystem") and target.toUri().getScheme() == "file" else store
    out = store.create(new, True)
    out.write(header(n).encode())
    for status in sorted(system.listStatus(folder), key=lambda s: s.getPath().getName()):
        if status.getPath().getName().startswith("part-"):
            part = system.open(status.getPath())
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    out.close()
    store.delete(target, False)
    store.rename(new, target)
    system.delete(folder, True)
    return n


@F.pandas_udf(T.StringType())
def _record(h: pd.Series, n: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([format_record(*row)[:-1] for row in zip(h, n, x, y, strict=True)])


def records(stats: DataFrame) -> DataFrame:
    """hash and its record (without the newline), for any number of rows: formatted by executors."""
    return stats.select("hash", _record("hash", "n_patches", "rep.x", "rep.y").alias("record"))
