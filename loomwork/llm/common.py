"""What the operators share: the shared folder, written intermediate tables, column names and sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of the columns that operators add for themselves and remove again.
OWN = "__lw_"

#: A table is broadcast only when it is known to be smaller than this many bytes.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine) a temporary folder is made; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="loomwork-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Lets Spark delete a query's shuffle files when the query ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that tasks exchange with Python at once: texts may be long, and both sides keep the memory of the largest batch.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that from now on exchanges no more than BATCH_ROWS rows at once with Python."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH)) <= BATCH_ROWS:
        conf.set(BATCH, str(BATCH_ROWS))
    return df


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it cuts lineage, survives lost executors, and
    lets the planner know the table's true size, so that it broadcasts small ones by itself."""
    return _write(df, f"{shared_dir(df.sparkSession)}/loomwork/{name}-{uuid.uuid4().hex}")


class Scratch:
    """Intermediate tables of one call, each written to the shared folder and read again. A table that takes the name of
    another replaces it: the old one is deleted when the new one is complete. What the caller needs no more it drops."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/loomwork/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        before, path = self.paths.get(name), f"{self.path}/{name}-{uuid.uuid4().hex}"
        out = _write(df, path)
        self.paths[name] = path
        if before:
            self._delete(before)
        return out

    def drop(self, *names: str) -> None:
        """Deletes the named tables; without names, all of them."""
        for n in names or list(self.paths):
            if n in self.paths:
                self._delete(self.paths.pop(n))

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ddl(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def drop_clashing(df: DataFrame, made: list[str]) -> DataFrame:
    """``df`` without the columns whose names (in any case) an operator is about to make: the operator's value wins."""
    lower = {x.lower() for x in made}
    return df.drop(*[df[c] for c in df.columns if c.lower() in lower])


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt evenly over the cores where a few partitions hold most of its rows: a file of one row group is read by
    one task, however many there are. Rows are only counted for this, which reads no column."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("p")).count()
    most, rows = sizes.agg(F.max("count"), F.sum("count")).first()
    return df.repartition(cores) if rows and rows > cores and most * cores > 2 * rows else df


def bounded_sample(df: DataFrame, most: int) -> list:
    """Different rows of ``df``, ``most`` of them where it has so many, by the smallest hashes of the whole row, brought to
    the driver. Tasks send only rows whose hash is below a bound set by an estimate of how many different rows there are,
    so what reaches the driver doesn't grow with the table; copies of a row count once, and no row's key matters."""
    h = f"{OWN}hash"
    rows = df.withColumn(h, F.pmod(F.xxhash64(*df.columns, F.lit(17)), F.lit(1 << 30)))
    total = rows.agg(F.approx_count_distinct(F.xxhash64(*df.columns))).first()[0]
    if total > most:
        rows = rows.where(F.col(h) < int((1 << 30) * min(1.0, 1.5 * most / total)))
    return rows.distinct().orderBy(h, *df.columns).limit(most).collect()


def null_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join by columns of the same names in which null equals null; the left columns stay, each key once."""
    right = right.withColumnsRenamed({k: f"{OWN}r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{OWN}r_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"{OWN}r_{k}" for k in keys])
