"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, whose executors are the driver, gets one of its
    own if spark.checkpoint.dir is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="impactlens-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back; it survives the loss of executors. As Parquet it is made once (a
    checkpoint makes it twice), takes a fraction of the bytes, and plans know its size."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows of df dealt out evenly, for small rows that much is made of: a scan that fits one or two tasks would leave
    all of that to them. The number is explicit, as small shuffles would be put together again."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


class Pieces:
    """A table that grows piece by piece. Pieces of one rank are put together, as in a binary counter: of k pieces that
    were added, about log k are read, and a row is written anew about log k times."""

    def __init__(self, first: DataFrame):
        self.held = [(0, first)]

    def add(self, piece: DataFrame) -> None:
        rank = 0
        while self.held and self.held[-1][0] == rank:
            _, last = self.held.pop()
            piece, rank = cut(last.unionByName(piece)), rank + 1
        self.held.append((rank, piece))

    def whole(self) -> DataFrame:
        out = self.held[0][1]
        for _, piece in self.held[1:]:
            out = out.unionByName(piece)
        return out
