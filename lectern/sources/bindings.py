"""Domain tables of the reading library, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.common import round_half_up

AS_OF, AS_OF_LONG = "2024-01-30", "2001-08-01"
LEAST_SESSION_MS = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_read(duration_ms, wpm):
    return round_half_up(duration_ms.cast("double") / F.lit(60000.0) * wpm)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading sessions of 5 s and more, of a document: event_id, user_id, ts, day, duration_ms, document_id, completed, wpm, words."""
    return sessions_of(table(spark, sf_dir, "events"))


def sessions_of(rows: DataFrame) -> DataFrame:
    """The sessions among events, of a table or a stream."""
    events = rows.where(F.col("event_type").isin("view", "click", "purchase"))
    out = events.select(
        "event_id", "user_id", "ts", F.to_date("ts").alias("day"), F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("document_id"), (F.col("event_type") == "purchase").alias("completed"), (F.lit(150) + F.col("event_id") % 250).alias("wpm"),
    ).where((F.col("duration_ms") >= LEAST_SESSION_MS) & F.col("document_id").isNotNull())
    return out.withColumn("words", words_read(F.col("duration_ms"), F.col("wpm")))


def sessions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over several years, from orders."""
    out = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.to_date("o_orderdate").alias("day"), F.floor("o_totalprice").cast("long").alias("duration_ms"),
        (F.col("o_orderkey") % 500).alias("document_id"), (F.col("o_orderstatus") == "F").alias("completed"), (F.lit(150) + F.col("o_orderkey") % 250).alias("wpm"),
    ).where(F.col("duration_ms") >= LEAST_SESSION_MS)
    return out.withColumn("words", words_read(F.col("duration_ms"), F.col("wpm")))


def annotation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.to_date("ts").alias("day"))


def archive_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library items, from orders with their customer and part."""
    o, c, p = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("web", "pdf", "docx", "epub", "mobi", "paste"))), (key % 6 + 1).cast("int"))
    few = F.broadcast(p.where(F.abs("p_partkey") < 2000).select("p_partkey", "p_name", "p_brand"))  # no other part has an order, however many there are
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(few, key % 2000 == F.col("p_partkey"))
    return joined.select(
        key.alias("id"), F.col("o_custkey").alias("user_id"), F.col("p_name").alias("title"), F.when(key % 5 != 0, F.col("c_name")).alias("author"), kind.alias("type"), F.col("p_brand").alias("source_label"),
        F.to_date("o_orderdate").alias("created"), F.date_add(F.to_date("o_orderdate"), (key % 90).cast("int")).alias("last_opened"), (key % 101).alias("percent"), F.when(key % 3 != 0, key % 7).alias("chapter"), (key % 40).alias("block"),
        F.floor(F.col("o_totalprice") / 10).cast("long").alias("word_count"), F.when((key % 6 > 0) & (key % 6 < 5), F.concat(F.lit("h"), (key % 97).cast("string"))).alias("file_hash"),
        F.when(key % 6 == 0, F.concat(F.lit("https://www.site"), (key % 50).cast("string"), F.lit(".example/p/"), (key % 31).cast("string"), F.lit("/?utm_source=x&id="), (key % 7).cast("string"))).alias("url"),
        F.when(key % 3 == 0, F.array(F.col("c_mktsegment"), F.col("o_orderpriority"))).alias("collection_ids"),
    )


#: The phrases that searches are asked for, from the documents' languages.
PHRASES = ("of the", "the", "and in", "réel", "que", "und", "the th", "as", "ción", "is in")


PALETTE = ("yellow", "green", "blue", "pink", "purple")


def annotations(spark: SparkSession, sf_dir: str, by_document: bool = False) -> DataFrame:
    """Highlights and notes, from distinct line items; ids are made of all that a row is made of, so none repeats.  ``by_document`` deals
    line items over tasks by document before ids are made, which joins, windows and groups of documents need: rows are then shuffled once,
    without ids, and not again to be made distinct and once more by document."""
    n = table(spark, sf_dir, "lineitem")
    return _annotations(_bare(n).repartition("l_orderkey") if by_document else n).distinct()


def annotations_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with a row for each block that they cover, dealt over tasks by document and block before ids are made."""
    n = _bare(table(spark, sf_dir, "lineitem"))
    covered = F.sequence(F.col("l_linenumber").cast("long"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("long"))
    return _annotations(n.withColumn("block", F.explode(covered)).repartition("l_orderkey", "block"), "block").distinct()


def _bare(n: DataFrame) -> DataFrame:
    """What annotations are made of."""
    return n.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("l_shipdate"))


def _annotations(n: DataFrame, *more: str) -> DataFrame:
    color = F.element_at(F.array(*map(F.lit, PALETTE)), (F.col("l_partkey") % 5 + 1).cast("int"))
    start = F.col("l_suppkey") % 30
    return n.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), "l_returnflag", "l_linestatus", F.to_date("l_shipdate")).alias("id"), F.col("l_orderkey").alias("doc_key"), color.alias("color"), F.col("l_linenumber").cast("long").alias("start_block"), start.alias("start_word"),
        (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("long").alias("end_block"), (start + F.col("l_quantity").cast("int")).alias("end_word"), F.when(F.col("l_returnflag") == "R", F.lit("note")).alias("note"), (F.col("l_linestatus") == "F").alias("favorite"),
        F.when(F.col("l_partkey") % 4 == 0, F.array("l_returnflag", "l_linestatus")).alias("tags"), F.to_date("l_shipdate").alias("created"), *more,
    )
