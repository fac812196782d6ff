"""Operator 5 learns from all texts."""

import numpy as np

from lectern.llm import pii


def test_all_examples_count(spark, monkeypatch):
    """More texts than any sample held, and among them few of some kinds: the trees get each example."""
    texts = [f"note {i} of 20{i % 90 + 10}" if i % 50 else f"write to a{i}@mail{i % 7}.example.com or +1 555 {i % 900 + 100} {i:04}" for i in range(6000)]
    docs = spark.createDataFrame([*((t,) for t in texts), (None,)], "text string").repartition(7)
    seen, fit, calibrate = [], pii.Trees.fit, pii.Trees.calibrate
    monkeypatch.setattr(pii.Trees, "fit", lambda self, b, y, times: (seen.append((times.sum(), (times * y).sum())), fit(self, b, y, times)))
    monkeypatch.setattr(pii.Trees, "calibrate", lambda self, b, y, kind, times: (seen.append((times.sum(), (times * y).sum())), calibrate(self, b, y, kind, times)))
    trees = pii.fit(docs)
    labels = [y for t in texts for _, _, y in pii.examples(t)]
    assert np.sum(seen, axis=0).tolist() == [len(labels), sum(labels)] and len(labels) > 5000
    again = pii.fit(docs.repartition(3))
    assert trees.threshold == again.threshold and all((a[1] == b[1]).all() for a, b in zip(trees.trees, again.trees, strict=True))
