"""O3: ``search_blocks``, a table function of SQL that finds phrases in texts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lectern.operators.text import PhraseFinder


class SearchBlocks:
    """Rows (doc_id, block, phrase, start_word, end_word) of the places in a table's texts (doc_id, block, text) where consecutive words
    contain the words of a phrase (F2, F3): ``select * from search_blocks(table(t) partition by (doc_id), array('of the'))``.  A text is
    one row of the table, so partitions only deal rows to tasks; null texts and phrases without letters give none."""

    def __init__(self) -> None:
        self.finders: dict[tuple, PhraseFinder] = {}

    def eval(self, row, phrases):
        wanted = tuple(phrases or ())
        if (finder := self.finders.get(wanted)) is None:
            finder = self.finders[wanted] = PhraseFinder(wanted)
        for phrase, first, last in finder.find(row["text"]):
            yield row["doc_id"], row["block"], phrase, first, last


def register(spark: SparkSession) -> None:
    """Make ``search_blocks`` known to a session."""
    spark.udtf.register("search_blocks", udtf(SearchBlocks, returnType="doc_id long, block long, phrase string, start_word long, end_word long"))
