"""A library that a stream of opened and deleted items keeps up to date.

The library is a table of versions: each batch reads the newest version of the buckets of users that it touches, lays its changes over
them and writes these buckets anew as the version of its number.  A batch that runs again reads only older versions and replaces its own, so
it changes nothing; buckets that no change touches are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.exchange import upserted
from lectern.operators.library import deleted
from lectern.streaming.live import LATE

BUCKETS = 64
ITEM = "user_id long, id string, title string, author string, type string, url string, file_hash string, word_count long, created timestamp, last_opened timestamp"
STONE = "user_id long, key string, deleted_at timestamp"


def _bucket():
    return F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int")


def _heads(spark: SparkSession, folder: str, before: int | None) -> DataFrame:
    """The newest version of each bucket, of those before a number."""
    heads = spark.read.schema("bucket int, version int").parquet(f"{folder}/heads")
    return (heads if before is None else heads.where(F.col("version") < before)).groupBy("bucket").agg(F.max("version").alias("version"))


def items(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The library as of the last batch, or of the last one before a number."""
    rows = spark.read.schema(f"{ITEM}, bucket int, version int").parquet(f"{folder}/items")
    return rows.join(_heads(spark, folder, before), ["bucket", "version"], "left_semi").drop("bucket", "version")


def tombstones(spark: SparkSession, folder: str) -> DataFrame:
    """The newest deletion of each key."""
    return spark.read.schema(f"{STONE}, version int").parquet(f"{folder}/stones").groupBy("user_id", "key").agg(F.max("deleted_at").alias("deleted_at"))


def apply_changes(batch: DataFrame, folder: str, number: int, spark: SparkSession | None = None) -> None:
    """One batch of changes (event_id, ts, user_id, kind, id, title, author, type, url, file_hash, word_count): ``open`` by G9, then
    ``delete`` of an id by H16, unless the item has been opened since.  Tables are read by ``spark``, as the session of a stream's batch does
    not adapt its plans."""
    spark = spark or batch.sparkSession

    def held(df: DataFrame, name: str) -> DataFrame:
        """The frame as a table that the next batch replaces: the batch's state, joins and groups are worked out once, whatever reads them."""
        df.write.mode("overwrite").parquet(f"{folder}/held/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/held/{name}")

    changes = held(batch, "changes")
    at = changes.agg(F.max("ts")).first()[0]
    if at is None and changes.isEmpty():
        return
    touched = changes.select(_bucket().alias("bucket")).distinct()
    known = items(spark, folder, number).withColumn("bucket", _bucket()).join(touched, "bucket", "left_semi").drop("bucket")
    opened = changes.where("kind = 'open'").withColumnRenamed("ts", "opened").drop("id")
    now = held(upserted(known, opened, hold=held).select(*(c.split(" ")[0] for c in ITEM.split(", "))), "now")
    wanted = changes.where("kind = 'delete'").groupBy("user_id", "id").agg(F.max("ts").alias("ts"))
    gone = held(now.select("user_id", "id", "last_opened").join(wanted, ["user_id", "id"]).where("ts >= last_opened").select("user_id", "id"), "gone")
    kept, stones = deleted(now, gone, None)
    stones.select("user_id", "key", F.lit(at).cast("timestamp").alias("deleted_at")).write.mode("overwrite").parquet(f"{folder}/stones/version={number}")
    kept.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/items/version={number}")
    touched.select("bucket", F.lit(number).alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/heads/batch={number}")  # last: readers see whole versions


def kept_up(changes: DataFrame, folder: str) -> DataFrame:
    """The library after all that a stream of changes has given.  A change that comes twice within ``LATE`` counts once."""
    spark = changes.sparkSession
    for name, schema in (("items/version=-1/bucket=-1", ITEM), ("heads/batch=-1", "bucket int, version int"), ("stones/version=-1", STONE)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")
    once = changes.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])
    query = once.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(lambda batch, number: apply_changes(batch, folder, number, spark)).start()
    query.awaitTermination()
    return items(spark, folder)
