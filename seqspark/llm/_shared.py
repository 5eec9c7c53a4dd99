"""What the operators share: the shared folder, written intermediate tables and joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE hot keys, however large the input.
HOT_SHARE = 1000
#: A key with no more rows than this is never dealt out.
SALT_ROWS = 1000
#: Rows of an Arrow batch at most: a batch of whole texts is held by the task, twice, and by its Python worker.
BATCH_ROWS = 1000
#: Compressed bytes of an intermediate table for each file and task.
FILE_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_of(c: Column | str = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def small_batches(df: DataFrame) -> DataFrame:
    """df; lowers its session's limit of rows in an Arrow batch to BATCH_ROWS where it is larger."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores in front until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, the context's own checkpoint folder.

    Only a session on one machine, as in tests, gets a new folder where neither is set; on a cluster that is an error.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqspark-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def written(df: DataFrame, name: str, of: DataFrame | None = None) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again; cuts the lineage.

    of is a written table of about that size at least: there are then no more tasks and files than its bytes fill
    (FILE_BYTES each), though one for each core, so that small tables of a long chain are not spread over hundreds.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqspark-{name}-{uuid.uuid4().hex}"
    if of is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-_bytes_of(of) // FILE_BYTES)))
    df.write.parquet(path)
    _tidied(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def rows_of(table: DataFrame) -> int:
    """The rows of a written table, counted once."""
    if not hasattr(table, "n_rows"):
        table.n_rows = table.count()
    return table.n_rows


def _path(table: DataFrame):
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _bytes_of(table: DataFrame) -> int:
    path, files = _path(table)
    return files.getContentSummary(path).getLength()


def _tidied(spark: SparkSession) -> None:
    """Asks the driver's collector to look where its heap has grown over half of the limit.

    In a chain of tables what lives is little, but the plans and statuses of past jobs are not collected until the heap is full,
    and the driver holds as much memory as its heap has ever grown to; a full collection gives back what is free.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() * 2 > runtime.maxMemory():
        spark._jvm.System.gc()


def erase(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more; what was derived from them has been written since.

    Executors hold the broadcasts and shuffle files of past jobs until the driver's collector finds their plans gone, which a
    driver with a large heap may leave for half an hour; so it is asked to look.
    """
    for t in tables:
        path, files = _path(t)
        files.delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def join_by_key(left: DataFrame, index: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """left joined with an index that has one row for each key.

    weight names the index column that counts the rows of left with that key, total is their sum. Keys
    with over 1/HOT_SHARE of the rows (so fewer than HOT_SHARE of them) are joined by a broadcast, so
    that their rows stay where they are; the others are dealt out by the key, no more than that share each.
    Index rows must be narrow, a few numbers or a digest; see join_dealt for wide ones.
    """
    hot = F.broadcast(index.where(F.col(weight) * HOT_SHARE > total))
    cold = index.where(F.col(weight) * HOT_SHARE <= total)
    near = left.join(hot, keys, "inner")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return near.unionByName(rest)


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], deal: list[str], counted: DataFrame | None = None, plan: str = "merge", least: int = SALT_ROWS) -> DataFrame:
    """left joined with right, which has few rows for a key but maybe wide ones.

    counted is a written table whose rows have the keys of left's (left itself, unless given); plan is the join's hint, so
    that it is the same at every size: shuffle_hash where the rows of right are narrow.
    The rows of a hot key of left are dealt out by a hash of the deal columns over as many salts as the key has
    thousandths of all rows, or least rows where that is more, and the rows of right with that key are copied to each salt. Hot keys have fewer than 2 *
    HOT_SHARE salts together. Only these keys and their salts are broadcast.
    """
    counted = left if counted is None else counted
    per = max(rows_of(counted) / HOT_SHARE, least)
    counts = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(counts.where(F.col("_n") > per).select(*keys, F.ceil(F.col("_n") / per).cast("int").alias("_salts")))
    many = F.coalesce("_salts", F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*deal), many).cast("int")).drop("_salts")
    copies = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_salts")
    return dealt.join(copies.hint(plan), [*keys, "_salt"]).drop("_salt")
