"""Shared pieces of the corpus operators: white space, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that separate words everywhere in this subpackage.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master (one process, one disk) may run without the setting; it then gets
    a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="lexmill-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexmill/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}-{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is cut, and a lost
    executor costs only the tasks that it was running."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = shared_dir(spark)
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lexmill/" in d and top.split("://")[-1].strip("/") in d:
            p = jvm.org.apache.hadoop.fs.Path(d)
            p.getFileSystem(conf).delete(p, True)


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array (native)."""
    return F.array_remove(F.split(text, WS_CLASS + "+"), "")


def tie_hash(df: DataFrame, *but: str) -> Column:
    """A hash of a row's other columns, to order rows that are equal in all that matters."""
    from pyspark.sql import types as T

    names = [f.name for f in df.schema.fields if f.name not in but and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[df[n] for n in names]) if names else F.lit(0).cast("long")


def spread_join(rows: DataFrame, small: DataFrame, key: str, by: str, salts: int = 32) -> DataFrame:
    """``rows`` with the columns of ``small`` (one row for each value of its column ``key``), inner.  The rows of a value are dealt out by a hash of
    their column ``by`` over ``salts`` keys, and ``small`` goes to those that occur, so that a hot value is not one task's work.  Both
    tables' other columns have names of their own."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    small = small.withColumnRenamed(key, "__small")
    places = salted.select(F.col(key).alias("__key"), F.col("__salt").alias("__place")).distinct()
    places = places.join(small, F.col("__key") == F.col("__small")).drop("__small")
    return salted.join(places, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__place"))).drop("__salt", "__key", "__place")
