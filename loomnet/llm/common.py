"""Shared folder, fresh column names and table access for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own, and that on a single machine only."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="loomnet-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later stages reuse it, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/loomnet/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As written(), by hash buckets of key, so that joins on key don't shuffle these rows again. df is in buckets partitions of key already."""
    spark, table = df.sparkSession, f"loomnet_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/loomnet/{table}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    _written.append(path)
    return spark.table(table)


def mark() -> int:
    """A point from which drop_written() counts."""
    return len(_written)


def drop_written(spark: SparkSession, since: int = 0) -> None:
    """Deletes what written() has put into the shared folder since a mark(). Frames over it can't be read any more, so their results have to be stored before."""
    jvm = spark.sparkContext._jvm
    while len(_written) > since:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        if path.getName().startswith("loomnet_"):
            spark.sql(f"DROP TABLE IF EXISTS {path.getName()}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever its extra columns are called (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        x = f"__{n}"
        while x.lower() in taken:
            x += "_"
        taken.add(x.lower())
        out.append(x)
    return out


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id bigint, text string), the two columns that analysis needs; rows without an id are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
