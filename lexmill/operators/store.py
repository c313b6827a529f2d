"""Observation stores, the vector codec and encryption."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATIONS = "seq long, label string, indices array<int>, values array<float>"


class FeatureStore(Protocol):
    """What an engine needs of a store; ``seq`` orders the observations."""

    def add_all(self, observations: DataFrame) -> None: ...
    def all(self) -> DataFrame: ...
    def labels(self) -> DataFrame: ...
    def size(self) -> int: ...
    def clear(self) -> None: ...


def distinct_observations(df: DataFrame) -> DataFrame:
    """Each (label, vector) once, with its least ``seq``; exact, and partially aggregated before its shuffle."""
    return df.groupBy("label", "indices", "values").agg(F.min("seq").alias("seq")).select("seq", "label", "indices", "values")


class MemoryStore:
    """A session's observations; repeated ones are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.clear()

    def add_all(self, observations: DataFrame) -> None:
        new = observations.select("seq", "label", "indices", "values")
        self._rows = distinct_observations(self._rows.unionByName(new)).persist()

    def all(self) -> DataFrame:
        return self._rows

    def labels(self) -> DataFrame:
        return self._rows.select("label").distinct()

    def size(self) -> int:
        return self._rows.count()

    def clear(self) -> None:
        self._rows = self.spark.createDataFrame([], OBSERVATIONS)


# -- encryption --------------------------------------------------------------------------------
class NoEncryption:
    def encrypt(self, c: Column) -> Column:
        return c

    def decrypt(self, c: Column) -> Column:
        return c


class AesGcm:
    """AES-256 in GCM mode: 12 bytes of a random vector, the text, a tag of 16 bytes.  Tampering raises an error."""

    def __init__(self, key: bytes):
        if len(key) != 32:
            raise ValueError("AES-256 needs a key of 32 bytes")
        self.key = key

    def encrypt(self, c: Column) -> Column:
        return F.aes_encrypt(c, F.lit(self.key), F.lit("GCM"))

    def decrypt(self, c: Column) -> Column:
        return F.aes_decrypt(c, F.lit(self.key), F.lit("GCM"))


# -- codec -------------------------------------------------------------------------------------
def encode_vector(indices: Column, values: Column) -> Column:
    """Big-endian binary: the number of entries, the indices, the values."""

    @F.arrow_udf("binary")
    def packed(i, v):
        import pyarrow as pa

        rows = zip(i.to_pylist(), v.to_pylist())
        return pa.array([None if a is None else len(a).to_bytes(4, "big") + np.array(a, ">i4").tobytes() + np.array(b, ">f4").tobytes() for a, b in rows], pa.binary())

    return packed(indices, values)


def decode_vector(data: Column) -> Column:
    @F.arrow_udf("struct<indices:array<int>,values:array<float>>")
    def unpacked(rows):
        import pyarrow as pa

        out = []
        for x in rows.to_pylist():
            if x is None:
                out.append(None)
                continue
            n = int.from_bytes(x[:4], "big")
            if len(x) != 4 + 8 * n:
                raise ValueError("a damaged vector")
            out.append({"indices": np.frombuffer(x, ">i4", n, 4).tolist(), "values": np.frombuffer(x, ">f4", n, 4 + 4 * n).tolist()})
        return pa.array(out, pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))]))

    return unpacked(data)


class TableStore:
    """Encrypted vectors in a Parquet folder (id, label, features); nothing is deduplicated."""

    def __init__(self, spark: SparkSession, path: str, encryption=None):
        self.spark, self.path, self.encryption = spark, path, encryption or NoEncryption()
        self.migrate()

    def migrate(self) -> None:
        """Makes the empty table if there is none."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            self.spark.createDataFrame([], "id long, label string, features binary").write.parquet(self.path)

    def _packed(self, observations: DataFrame) -> DataFrame:
        return observations.select(F.col("seq").alias("id"), "label", self.encryption.encrypt(encode_vector(F.col("indices"), F.col("values"))).alias("features"))

    def add_all(self, observations: DataFrame) -> None:
        self._packed(observations).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        rows = self.spark.read.schema("id long, label string, features binary").parquet(self.path)
        return rows.select(F.col("id").alias("seq"), "label", decode_vector(self.encryption.decrypt(F.col("features"))).alias("v")).select("seq", "label", "v.indices", "v.values")

    def labels(self) -> DataFrame:
        return self.spark.read.parquet(self.path).select("label").distinct()

    def size(self) -> int:
        return self.spark.read.parquet(self.path).count()

    def clear(self) -> None:
        self.spark.createDataFrame([], "id long, label string, features binary").write.mode("overwrite").parquet(self.path)


class JdbcStore(TableStore):
    """The same over JDBC; rows go in batches, one transaction for each partition.  Needs the database's driver
    on the class path.  ``options`` has at least url and dbtable."""

    def __init__(self, spark: SparkSession, options: dict[str, str], encryption=None, batch: int = 1000):
        self.spark, self.options, self.encryption, self.batch = spark, options, encryption or NoEncryption(), batch

    def migrate(self) -> None:
        self.spark.createDataFrame([], "id long, label string, features binary").write.format("jdbc").options(**self.options).mode("ignore").save()

    def _read(self) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options).load()

    def add_all(self, observations: DataFrame) -> None:
        self._packed(observations).write.format("jdbc").options(**self.options, batchsize=self.batch).mode("append").save()

    def all(self) -> DataFrame:
        return self._read().select(F.col("id").alias("seq"), "label", decode_vector(self.encryption.decrypt(F.col("features"))).alias("v")).select("seq", "label", "v.indices", "v.values").orderBy("seq")

    def labels(self) -> DataFrame:
        return self._read().select("label").distinct()

    def size(self) -> int:
        return self._read().count()

    def clear(self) -> None:
        self.spark.createDataFrame([], "id long, label string, features binary").write.format("jdbc").options(**self.options, truncate="true").mode("overwrite").save()
