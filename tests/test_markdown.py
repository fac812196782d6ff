"""Markdown and pasted texts; fingerprints of files; dictionaries of syllables."""

import hashlib

from pyspark.sql import functions as F

from lectern.operators import exchange as X
from lectern.operators import language as E
from lectern.operators import markdown as M

TEXT = """# Title *here* #

First **bold** line
and its second [link](x) line.
Under
=====
- one
- two `code`
  more of two
  - inner one

  second paragraph of two
* other list

1. first
2) not of that list
3) third

> quoted _text_
> ~~gone~~
lazy line
>
> - listed
> ## Small

```python
def f():
    return "# no heading"

~~~
```
~~~
open fence `x`
"""


def rows_of(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.type, r.level, r.ordered, r["content"], r["items"], r.language) for r in M.markdown_blocks(docs).orderBy("block").collect()]


def test_markdown_blocks(spark):
    assert rows_of(spark, TEXT) == [
        ("heading", 1, None, "Title here", None, None),
        ("heading", 1, None, "First bold line\nand its second link line.\nUnder", None, None),
        ("list", None, False, None, ["one", "two code\nmore of two\n- inner one\n\nsecond paragraph of two"], None),
        ("list", None, False, None, ["other list"], None),
        ("list", None, True, None, ["first"], None),
        ("list", None, True, None, ["not of that list", "third"], None),
        ("quote", None, None, "quoted text\ngone\nlazy line Small", None, None),
        ("code", None, None, 'def f():\n    return "# no heading"\n\n~~~', None, "python"),
        ("code", None, None, "open fence `x`", None, None),
    ]


def test_markdown_lines(spark):
    assert rows_of(spark, "para\r\n***\r\n    no code\n\n    code *x*\n\n      more\n\nText\n---\n####### seven\n#none\n#\n## Two ##\n[a]: http://x\n| a | b |\n|---|---|\n| 1 | 2 |\n\nEnd") == [
        ("paragraph", None, None, "para", None, None), ("code", None, None, "no code\n\ncode *x*\n\n  more", None, None), ("heading", 2, None, "Text", None, None), ("paragraph", None, None, "####### seven\n#none", None, None),
        ("heading", 1, None, "", None, None), ("heading", 2, None, "Two", None, None), ("paragraph", None, None, "End", None, None),
    ]
    assert rows_of(spark, None) == rows_of(spark, "") == rows_of(spark, " \n\n ") == []
    assert rows_of(spark, "- \n- a\n\n\n- b") == [("list", None, False, None, ["", "a", "b"], None)]
    assert len(M.line_blocks("> " * 3 + "deep")) == 1


def test_long_markdown_takes_linear_time():
    import time

    for text in ("- item\n" * 50_000, "word\n" * 50_000, "> quote\n" * 50_000, "```\n" * 50_000, "- item\n\n" * 30_000, "#" * 200_000, "*" * 200_000, " * " * 60_000, "# x" + " #" * 60_000):
        began = time.time()
        M.line_blocks(text)
        assert time.time() - began < 10, text[:8]


def test_pasted_documents(spark):
    texts = {1: "# A *title*\n\nText.\n\n- x", 2: "Plain words of the first paragraph.\n\nShow more\n\nSecond.", 3: None, 4: "", 5: "## Two\n\n**b** and `c` - [l](x)"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in M.pasted_documents(docs).collect()}
    assert {k: r.title for k, r in rows.items()} == {1: "A title", 2: "Pasted Text", 3: "Pasted Text", 4: "Pasted Text", 5: "Pasted Text"}
    shown = lambda k: [(b.type, b["content"], b["items"]) for b in rows[k].blocks]
    assert shown(1) == [("heading", "A title", None), ("paragraph", "Text.", None), ("list", None, ["x"])]
    assert shown(2) == [("paragraph", "Plain words of the first paragraph.", None), ("paragraph", "Second.", None)]
    assert shown(3) == shown(4) == [] and rows[3].file_hash == rows[4].file_hash and len(rows[1].file_hash) == 16
    assert [r.title for r in M.titles(docs).collect()] == ["A title"]


def test_file_fingerprints(spark, tmp_path):
    want = {}
    for size in (1, 65_536, 131_071, 131_072, 131_073, 200_000, 1_000_003):
        raw = bytes(i * 7 % 251 for i in range(size))
        (tmp_path / f"f{size}.bin").write_bytes(raw)
        whole = raw if size <= 131_072 else raw[:65_536] + raw[-65_536:] + size.to_bytes(8, "little")
        want[size] = hashlib.sha256(whole).hexdigest()[:16]
    assert {r.length: r.file_hash for r in X.file_fingerprints(spark, f"file://{tmp_path}").collect()} == want


def test_extended_dictionary(spark):
    words = E.spelled(spark.createDataFrame([(w, "en") for w in ("Queue", "table,", "ab", "table", "other", "")] + [("table", "no")], "word string, language string"))
    plain = {(r.word, r.language): r.syllables for r in words.collect()}
    entries = spark.createDataFrame([("en", "queue", 9), ("en", "Table", 7), ("en", "table", 5), ("en", "ab", 4), ("en", "unseen", 3), ("en", "other", None)], "language string, word string, syllables int")
    found = E.with_dictionary(words, entries)
    assert found.columns == words.columns
    assert {(r.word, r.language): r.syllables for r in found.collect()} == plain | {("table,", "en"): 7, ("table", "en"): 7}
    assert sorted(map(tuple, E.with_dictionary(words, entries.where("false")).collect())) == sorted(map(tuple, words.collect()))
