"""What the operators of this package share: reading, written steps, size-checked broadcasts, dropping rows."""

from __future__ import annotations

import pickle
import sys
import types
import uuid
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitus.session import shared_folder, tune

# Rows of a Python batch: whole texts travel, so a batch must stay small even when every text is long.
BATCH_ROWS = 256
# A side with at most this many rows of a few short columns (some 10 MB) may be broadcast; beyond it is shuffled.
BROADCAST_ROWS = 200_000

def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # Steps are written and read back, so no later job reads an earlier one's shuffle files.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return tune(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete written steps that no later step reads."""
    for df in written:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def no_text(text: str) -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(text), F.lit(""))


def text_key(text: str) -> Column:
    """With the id it names a row by its content, so that rows with a repeated id stay apart."""
    return F.xxhash64(no_text(text))


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks `df`, a written table with short rows, for broadcast if it has at most `rows` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def drop_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of `docs` that `decisions` (doc_id, text_key, kept; one row per document) keeps, with all their columns.

    Rows that repeat both id and text are one document: if any of them is kept, one row of them stays.
    """
    fate = stage(
        decisions.groupBy("doc_id", "text_key")
        .agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows"))
        .filter(~F.col("_kept") | (F.col("_rows") > 1)),
        "fate",
    )
    keyed = docs.withColumn("__key", text_key("text"))
    match = lambda side: keyed["doc_id"].eqNullSafe(side["doc_id"]) & (keyed["__key"] == side["text_key"])
    lost = maybe_broadcast(fate)
    rest = keyed.join(lost, match(lost), "left_anti")
    repeated = fate.filter("_kept")
    if not repeated.isEmpty():
        twins = maybe_broadcast(repeated)
        rest = rest.unionByName(keyed.join(twins, match(twins), "left_semi").dropDuplicates(["doc_id", "__key"]))
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


# Where a worker process keeps what outlives a task, and how many objects it keeps.
WORKER, KEPT = "_transitus_worker", 2


class Shipped:
    """A driver object of bounded size, broadcast with its code, so that executors need not have this package.

    With `keep` a worker process holds on to it for later tasks, what it has learnt meanwhile included.
    """

    def __init__(self, spark: SparkSession, value: Any, keep: bool = False) -> None:
        self.held, self.opened = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None
        self.name = uuid.uuid4().hex if keep else None

    def __getstate__(self) -> dict:
        return {"held": self.held, "opened": None, "name": self.name}

    def get(self) -> Any:
        """The object, unpickled once in each task, or once in each worker process."""
        if self.opened is None and self.name is None:
            self.opened = pickle.loads(self.held.value)
        elif self.opened is None:
            kept = sys.modules.setdefault(WORKER, types.ModuleType(WORKER)).__dict__.setdefault("kept", {})
            if self.name not in kept:
                while len(kept) >= KEPT:
                    del kept[next(iter(kept))]
                kept[self.name] = pickle.loads(self.held.value)
            self.opened = kept[self.name]
        return self.opened
