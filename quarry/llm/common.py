"""Pieces the text operators share: shared storage, file names, column checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of these are one separator for words and for equality of texts.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: spark.checkpoint.dir, or, on one machine, one of our own where it is unset (tests). An error on a
    cluster that names none."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, once nothing that is still to run reads them."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._quarry_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500, most_bytes: int = 8 << 20) -> None:
    """Bound the rows and bytes, and so the text, that a Python worker and its JVM hold at once."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        now = int(spark.conf.get(key).removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


#: Row keys sent to all tasks at once, at most: 16 bytes each before the join's own overhead.
BROADCAST_IDS = 1_000_000


def _parquet_scan(df: DataFrame) -> bool:
    """Whether df is a table of Parquet files, at most filtered and projected, so that no row of a file comes twice."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a struct column, and its name, that tells each row from all others, whatever its ids and values: the
    file (by hash) and the row's place in it. Lost tasks and later passes find the same keys. A df that is more than a
    scan of Parquet files is written first."""
    name = "_row"
    while name in df.columns:
        name += "_"
    keyed = df if _parquet_scan(df) else materialize(df, "rows")
    return keyed.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))), name


def without_rows(df: DataFrame, drops: DataFrame, key: str, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """df, which has a row key, without the key and without the rows whose key is in drops' only column. The keys are
    written and counted first: up to broadcast_ids of them go to all tasks, so the rows stay where they are; more are
    met by a shuffle."""
    gone = materialize(drops.toDF("_drop").select("_drop.file", "_drop.at"), "drops").toDF("_drop_file", "_drop_at")
    few = gone.limit(broadcast_ids + 1).count() <= broadcast_ids
    same = (df[key]["file"] == gone["_drop_file"]) & (df[key]["at"] == gone["_drop_at"])
    return df.join(F.broadcast(gone) if few else gone, same, "left_anti").drop(key)


def keep_frames(decide):
    """For mapInArrow over whole rows: those for which decide(batch) is true, all columns untouched."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(decide(b), pa.bool_()))

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def whole_text(df: DataFrame, text: str = "text"):
    """The text column with null read as the empty text."""
    return F.coalesce(df[text].cast("string"), F.lit(""))
