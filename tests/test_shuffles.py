"""Queries read and shuffle their input as often as they need to, and no more."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def _scans(plan, table):
    return sum("FileScan" in line and f"{table}.parquet" in line for line in plan.splitlines())


def test_exported_files_in_one_pass(spark):
    """annotations are made, joined, ordered and counted once for the four formats, after one shuffle by document."""
    plan = _plan(spark, "a08_export_files")
    assert (_scans(plan, "lineitem"), plan.count("Window ["), plan.count("REPARTITION_BY_COL")) == (1, 2, 1)
    assert plan.count("Exchange hashpartitioning") <= 2


def test_quoted_text(spark):
    """brackets, quotes and nulls come through as JSON."""
    from pyspark.sql import functions as F

    from lectern.operators.annotations import quoted

    rows = spark.createDataFrame([("[]",), ("]",), ('a "b" [c]',), ("",), (None,), ("null",)], "t string").select(quoted(F.col("t")).alias("q")).collect()
    assert [r.q for r in rows] == ['"[]"', '"]"', '"a \\"b\\" [c]"', '""', "null", '"null"']


def test_words_and_annotations_shuffled_once(spark):
    """each side is shuffled once, by document and block, before ids are made."""
    plan = _plan(spark, "j07_at_words")
    assert plan.count("Exchange hashpartitioning") == 2


def test_library_is_merged_once(spark):
    """the merged library is a table when its keys and its rows are read; orders are left for the deletions alone."""
    assert _scans(_plan(spark, "m07_merged_library"), "orders") <= 2
