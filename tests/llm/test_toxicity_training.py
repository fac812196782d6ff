"""Operator 4 trains in a task."""

import pickle

import numpy as np

from lectern.llm import toxicity


def test_driver_does_not_train(spark, monkeypatch):
    """The driver gets the network and never runs the training, whose memory is the task's."""

    def train(*_):
        raise AssertionError("trained in the driver")

    rows = [(i, f"{'vile' if i % 2 else 'kind'} words number {i} in a row", i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity.Network, "train", train)
    found = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert found == {r[0]: r[2] for r in rows}
    assert toxicity.fit(docs, labels.where("toxic = 1")) is None


def test_driver_gets_what_training_changed():
    """A trained network travels as the rows of its tables that training has changed, and is the same where it is read."""
    network = toxicity.Network()
    network.train([f"{'vile' if i % 2 else 'kind'} words number {i} in a row" for i in range(120)], np.arange(120, dtype=np.float32) % 2, rounds=1)
    sent = pickle.dumps(network)
    read = pickle.loads(sent)
    assert len(sent) < 1 << 18  # whole tables are 16 MB
    assert (read.shift, read.slope, read.p.keys()) == (network.shift, network.slope, network.p.keys())
    assert all(np.array_equal(read.p[k], network.p[k]) for k in network.p)
    assert np.array_equal(pickle.loads(pickle.dumps(toxicity.Network())).p["word"], toxicity.Network().p["word"])
