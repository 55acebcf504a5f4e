"""Shared helpers: reading tables, shared scratch storage, span joining."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, a temporary one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="inkfold-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


_MADE: list[str] = []  # scratch paths not yet discarded, oldest first


def scratch_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/inkfold-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def scratch_mark() -> int:
    """A point to which discard() can go back."""
    return len(_MADE)


def discard(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete scratch tables written since a mark, but those to keep; tables read from them are gone after that."""
    for path in [p for p in _MADE[since:] if p not in keep]:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _MADE.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether a table has at most most_rows rows, found without reading more than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def joined_spans(spans, kinds: list[str]):
    """'kind:start:end,...' by start, then kind in the listed order, from array<struct<kind,start,end>>."""
    order = F.array(*[F.lit(k) for k in kinds])
    ranked = F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return F.array_join(
        F.transform(F.array_sort(ranked), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
