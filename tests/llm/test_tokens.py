"""Operators 2, 6 and 9 against the libraries on whole texts."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm.packing import Corpus, Index, corpus_of, encoded, even_tail, fill, ordered, pack, piece_digests, shards, tree_of
from lectern.llm.token_count import Counts, token_counts
from lectern.llm.token_files import read_tokens, token_digests, token_index, write_token_files
from lectern.llm.word_ids import WordIds

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")

MODEL, TOKENIZER, ENCODER, COUNTS = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS), WordIds(WORDS), Counts(PIECES, {})


def whole_ids(texts):
    t = TOKENIZER
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts_match_library(spark, odd_docs, small_docs):
    for docs in (odd_docs, small_docs):
        texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
        rows = token_counts(docs, PIECES).collect()
        assert len(rows) == len(texts)
        for r in rows:
            n = len(MODEL.encode(texts[r.doc_id]))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096), repr(texts[r.doc_id][:80])


def test_counts_of_empty_table(empty_docs):
    assert token_counts(empty_docs, PIECES).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab e\n\t ▁é.😀 1")), max_size=30), max_size=5))
def test_counts_of_any_text(texts):
    assert COUNTS.count(texts) == [len(MODEL.encode(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aB é\n\t'slve.😀́\x1c1<|", "<|endoftext|>"]), max_size=30).map("".join), max_size=5))
def test_word_ids_of_any_text(texts):
    for end in (None, 7):
        first, ids = ENCODER.encode(texts, end)
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [x + ([] if end is None else [end]) for x in whole_ids(texts)]


def test_token_files(spark, odd_docs, small_docs, tmp_path):
    for k, docs in enumerate((odd_docs, small_docs)):
        path = str(tmp_path / f"files{k}")
        write_token_files(docs.repartition(3), WORDS, path, end_id=1)
        texts = dict(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
        want, start = {}, 0
        for i, ids in zip(texts, whole_ids(texts.values()), strict=True):
            want[i] = (start, [*ids, 1])
            start += len(ids) + 1
        got = {r.doc_id: r for r in token_digests(spark, path).collect()}
        assert {i: (r.start, r.n_tokens, r.ids_crc32) for i, r in got.items()} == {i: (s, len(x), crc(x)) for i, (s, x) in want.items()}
        one = read_tokens(spark, path).where("doc_id = 7").first()
        assert (one.start, one.ids) == want[7]
        assert "ids" not in token_index(spark, path).columns
        meta = pq.ParquetFile(next((tmp_path / f"files{k}").glob("*.parquet"))).metadata.row_group(0)
        by = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
        assert any("DICTIONARY" in e for e in by["ids.list.element"].encodings)
        assert "DELTA_BINARY_PACKED" in by["start_in_shard"].encodings and by["doc_id"].has_offset_index


def test_token_files_of_empty_table(spark, empty_docs, tmp_path):
    write_token_files(empty_docs, WORDS, str(tmp_path / "none"), end_id=1)
    assert token_digests(spark, str(tmp_path / "none")).collect() == []


def check_packed(rows, texts, window=4096):
    want = {i: [*ids, 2] for i, ids in zip(texts, whole_ids(texts.values()), strict=True)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id]) and r.length > 0
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0


def test_packing(odd_docs, small_docs):
    for docs in (odd_docs, small_docs):
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        check_packed(piece_digests(pack(docs, WORDS, 2, shard_docs=60)).collect(), texts)


def test_packing_of_empty_table(empty_docs):
    assert pack(empty_docs, WORDS, 2).collect() == []


def index_of(docs):
    """An index over these documents as the whole corpus."""
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]))
    lengths = np.array([len(d) for d in docs])
    return Index(np.concatenate(docs).astype("<u4"), lengths, Corpus(len(docs), lengths.mean(), df))


def test_neighbours_share_terms():
    """A seed's window is filled with the documents of its own topic."""
    rng = np.random.default_rng(1)
    docs = [rng.integers(1000 * (i % 4), 1000 * (i % 4) + 200, 100) for i in range(40)]
    pieces = fill(np.full(40, 100), index_of(docs), 1000)
    for s in range(4):
        assert len({p[0] % 4 for p in pieces if p[3] == s}) == 1


def test_scores_are_bm25():
    """Against the formula written out for each pair."""
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 70_000, rng.integers(1, 40)) // 1000 * 1000 for _ in range(30)]
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = Counter(t for d in docs for t in set(d.tolist()))
    index = index_of(docs)
    for seed in range(n):
        want = []
        for d in docs:
            tf = Counter(d.tolist())
            want.append(sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(docs[seed].tolist()) if tf[t]))
        assert np.allclose(index.scores(seed), want, rtol=1e-4)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 900), min_size=1, max_size=40))
def test_fill_covers(lengths):
    docs = [np.arange(n) % 50 for n in lengths]
    pieces = even_tail(fill(np.array(lengths), index_of(docs), 256), 256)
    assert sum(p[2] for p in pieces) == sum(lengths)
    total = defaultdict(int)
    for p in pieces:
        assert p[4] == total[p[3]]
        total[p[3]] += p[2]
    assert all(n & (n - 1) == 0 and n <= 256 for n in total.values())


def test_shards_are_bounded():
    """Leaves stay together where they can, and no shard has more rows than the limit, however the batches fall."""
    leaves = [0] * 30 + [1] * 5 + [2] * 25 + [3] * 200
    for step in (7, 64, 500):
        rows = [pa.record_batch([pa.array(leaves[i : i + step]), pa.array(range(len(leaves)))[i : i + step], pa.array([b"abcd"] * len(leaves))[i : i + step]], ["leaf", "id", "ids4"]) for i in range(0, len(leaves), step)]
        found = [ids.to_pylist() for ids, _ in shards(iter(rows), 50)]
        assert sum(found, []) == list(range(len(leaves))) and [len(f) for f in found] == [30, 30, 50, 50, 50, 50]


def test_neighbours_meet_in_shards(spark, empty_docs):
    """Documents of one topic, far apart in the table, are dealt to one shard, with frequencies of the whole corpus."""
    rng = np.random.default_rng(5)
    words = [[f"{chr(97 + t)}{chr(97 + k % 26)}{chr(97 + k // 26)}{'oeaiu'[k % 5]}{chr(97 + t)}" for k in range(60)] for t in range(16)]
    rows = [(i, " ".join(rng.choice(words[i % 16], 40)), None, None, None) for i in range(960)]
    docs = encoded(spark.createDataFrame(rows, empty_docs.schema).repartition(4), WORDS, 2)
    corpus = corpus_of(docs)
    assert corpus.n == 960 and corpus.idf[2] == np.float32(np.log1p(0.5 / 960.5)) and abs(corpus.mean - sum(len(x) + 1 for x in whole_ids([r[1] for r in rows])) / 960) < 1e-9
    topics = []

    def sizes(batches):
        for ids, _ in shards(batches, 70):
            yield pa.record_batch([pa.array([ids.to_pylist()])], ["ids"])

    for r in ordered(docs, corpus, tree_of(docs, corpus, 70)).select("leaf", "id", "ids2").mapInArrow(sizes, "ids array<long>").collect():
        topics.append(Counter(i % 16 for i in r.ids))
    assert max(sum(c.values()) for c in topics) <= 70 and sum(sum(c.values()) for c in topics) == 960
    assert sum(c.most_common(1)[0][1] for c in topics) >= 0.9 * 960
