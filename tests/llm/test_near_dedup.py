"""Operator 7 against all pairs."""

import random
import re

from lectern.llm.near_dedup import components, near_duplicates

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def varied(n, seed):
    """Families of near copies at all distances around the threshold, chains, short texts and exact copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append(" ".join(text))
            if rng.random() < 0.3:
                base = text
            if rng.random() < 0.2:
                out.append(" ".join(text).upper())
    return dict(enumerate(out[:n]))


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_against_all_pairs(spark):
    for seed in (1, 2):
        texts = varied(400, seed)
        order = list(texts.items())
        random.Random(seed).shuffle(order)
        assert result(near_duplicates(spark.createDataFrame(order, "doc_id long, text string"))) == brute(texts)


def test_crowd_without_common_member(spark):
    """Many copies of a base, each within the threshold of the base but not of one another."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    texts = {}
    for i in range(120):
        t = list(base)
        for at in rng.sample(range(3, 97), 2):
            t[at] = f"x{i}_{at}"
        texts[i] = " ".join(t)
    texts[500] = " ".join(base)
    assert result(near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))) == brute(texts)


def test_odd_texts(odd_docs, odd_texts):
    assert result(near_duplicates(odd_docs)) == brute(dict(enumerate(odd_texts)))


def test_null_ids_and_empty_table(spark, empty_docs):
    assert near_duplicates(empty_docs).collect() == []
    rows = [(None, "one two three four five six"), (None, None), (3, "one two three four five six"), (2, "One two three four five six"), (2, "One two three four five six")]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("2", "2", True), ("2", "2", True), ("3", "2", False), ("None", "None", True), ("None", "None", True)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {**dict.fromkeys(range(1, 61), 0), 101: 100}
