"""Operator 2: token counts by a map-side two-tier lookup.

Tier one is a table of frequent pre-tokens and their numbers of tokens, fitted once and broadcast; tier two is a cache
in each Python worker that the misses fill.  Every count is exact: the tiers only decide how it is found.  No pre-token
is shuffled over the corpus.

A pre-token is a text's stretch from one space up to the next.  Counts add up over pre-tokens because no piece of the
vocabulary has a space mark after another character; where a vocabulary has such a piece, whole texts are encoded.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and repeated ids stay as they are; an empty
table gives an empty result; other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slices

MARK = "▁"
#: Bounds of tier one: documents that it is fitted on, bytes of such a document, entries, bytes of an entry. It takes about
#: 3 MB at most.
FIT_DOCS, FIT_BYTES, TABLE_ENTRIES, ENTRY_BYTES = 2000, 16_384, 32_768, 32
#: Bound of tier two in a worker. Longer pre-tokens are encoded each time.
CACHE_ENTRIES, CACHED_CHARS = 300_000, 64

_workers: dict = {}


class Counts:
    """Numbers of tokens of texts; one for each worker and model."""

    def __init__(self, model: str, table: dict[str, int]) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.additive = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.lone_space = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.table, self.seen = table, dict(table)

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []

    def plain(self, text: str) -> bool:
        """Whether each pre-token starts with one space and has no space mark of its own."""
        return self.additive and "  " not in text and MARK not in text and text[:1] != " " and text[-1:] != " "

    def spaced(self, text: str) -> int:
        """The count of a text with runs of spaces: a run leads the pre-token that follows it."""
        n, keys = 0, []
        for run in re.findall(r" +[^ ]*", f" {text}"):
            if run == " ":
                n += self.lone_space
            else:
                keys.append(run[1:])
        return n + sum(self.lengths(keys))

    def lengths(self, keys: list[str]) -> list[int]:
        found = list(map(self.seen.get, keys))
        if None in found:
            missing = list({k for k, v in zip(keys, found, strict=True) if v is None})
            new = dict(zip(missing, self.whole(missing), strict=True))
            found = [new[k] if v is None else v for k, v in zip(keys, found, strict=True)]
            if len(self.seen) + len(new) > CACHE_ENTRIES:
                self.seen = dict(self.table)
            self.seen.update((k, v) for k, v in new.items() if len(k) <= CACHED_CHARS)
        return found

    def count(self, texts: list[str]) -> list[int]:
        parts = [t.split(" ") if t and self.plain(t) else None for t in texts]
        missing = set()
        for p in parts:
            if p:
                missing.update(p)
        self.lengths(list(missing))
        out = []
        for text, part in zip(texts, parts, strict=True):
            if not text:
                out.append(0)
            elif part:
                found = list(map(self.seen.get, part))
                out.append(sum(self.lengths(part)) if None in found else sum(found))
            elif not self.additive or MARK in text:
                out.append(self.whole([text])[0])
            else:
                out.append(self.spaced(text))
        return out


def frequent_pretokens(docs: DataFrame, model: str, text_col: str = "text", fit_docs: int = FIT_DOCS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Tier one: the most frequent pre-tokens of a bounded sample. Spark reads partitions until it has the sample."""
    text = F.col(text_col).cast("string")
    sample = docs.where(F.octet_length(text) <= FIT_BYTES).select(text.alias("text")).limit(fit_docs).collect()
    seen: Counter = Counter()
    for row in sample:
        seen.update(w for w in row.text.split(" ") if w and MARK not in w)
    top = [w for w, _ in seen.most_common(entries) if len(w.encode()) <= ENTRY_BYTES]
    return dict(zip(top, Counts(model, {}).whole(top), strict=True))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per document: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``)."""
    spark = docs.sparkSession
    table, key = spark.sparkContext.broadcast(frequent_pretokens(docs, model, text_col)), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = Counts(model, table.value)
        counts = _workers[key]
        for batch in batches:
            for part in slices(batch):
                text = part.column(1)
                n = pa.array(counts.count(text.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(pc.binary_length(text), pa.int64()), n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return read.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
