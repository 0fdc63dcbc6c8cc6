"""Reading tables, and cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The column with nulls as empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves in local mode; a cluster
    without the setting is refused, as its machines share no such folder.
    """
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="wakeline-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wakeline-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Later stages restart from the written rows when an executor is lost, and
    Spark knows the table's size when it chooses a join.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group; null where ``groups`` has none.

    Groups of over a thousandth of ``total`` rows, of which there can't be a
    thousand, go to all tasks; the others meet their rows by a shuffle, in which
    none of them is a hot key.  Both sides should be stored tables.
    """
    more = [c for c in groups.columns if c not in keys]
    columns = [*rows.columns, *more]
    large = F.col(size) * 1_000 > total
    marked = rows.join(F.broadcast(groups.where(large)), keys, "left")
    rest = marked.where(F.col(size).isNull()).drop(*more).join(groups.where(~large), keys, "left")
    return marked.where(F.col(size).isNotNull()).select(columns).union(rest.select(columns))

