"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a temporary folder, but only if driver
    and executors are one process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="threadloom-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to a new shared folder and read from there, and that folder.

    For large tables with several uses: columns are compressed, and the folder can be discarded as soon as
    what follows from it is settled.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def discard(folder: str) -> None:
    """Delete a folder that ``stored`` or ``corpus_pipeline.run`` wrote."""
    spark = SparkSession.getActiveSession()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it from there.

    A checkpoint keeps the constraints that Spark derives for its rows, and in a loop each round derives
    further ones from them, twice as many each time; so none are derived here.
    """
    spark, name = df.sparkSession, "spark.sql.constraintPropagation.enabled"
    shared_folder(spark)
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts can be long: hand Python workers few rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str | Column = "text") -> Column:
    """Words in a text; none in null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def ordered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Number the rows from 0 in a global order without bringing them into one task.

    Range partitions are sorted and settled; each row's place in its partition plus the rows of the
    partitions before it is its rank. The table of partition sizes has one row per partition.
    """
    place = F.monotonically_increasing_id()
    laid = settle(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return laid.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
