"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``; where that is unset on one machine (tests, a laptop), below the temporary folder.

    On a cluster it must be set: what one machine writes in a folder of its own the others never see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/loomspan-{uuid.uuid4().hex}"


_STAGED: list[str] = []  # folders that this process wrote


def discard_staged(spark: SparkSession | None = None) -> int:
    """Delete the tables that this process has staged so far; returns how many. Results that are not written or collected yet need theirs.

    Runs at the end of the process for tables in folders of this machine. For other stores, call it with the session while that lives.
    """
    done = 0
    for path in _STAGED[:]:
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        elif spark is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        else:
            continue
        _STAGED.remove(path)
        done += 1
    return done


atexit.register(discard_staged)


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{(folder := shared_dir(spark))}/table"
    _STAGED.append(folder)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unbounded(df: DataFrame) -> DataFrame:
    """``df``, whose joins are to be sorted and merged.

    For tables whose size Spark guesses too small: staged files are compressed, and a few sources become many rows of facts or
    nodes. Broadcast, they would pass the driver whole. The hint reaches the next join above; a join of joins needs it again.
    """
    return df.hint("merge")


def kept(df: DataFrame) -> DataFrame:
    """``staged``, of a size that grows with the input."""
    return unbounded(staged(df))


#: Narrow rows take a tenth in a shuffle of what they take in a sort, so that parts by Spark's count of bytes hold millions of them.
PART_ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of ``rows`` rows, dealt by ``keys`` into parts of about ``PART_ROWS``: what a task holds does not grow with the table.

    Groupings and joins above, by these keys or these and more, need no other shuffle. Rows of one key stay together.
    """
    return df.repartition(rows // PART_ROWS + 1, *keys)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
