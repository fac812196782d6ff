"""Operator 4: toxicity by a bidirectional gated recurrent network with attention pooling.

Input of a step is a word: an embedding of the word (by hash) beside the mean embedding of its character trigrams and those of its
first ``PREFIXES`` bytes, so that words never seen are read by their characters.  The first number of a word's or prefix's
embedding starts as its smoothed log odds among the labelled texts; training goes on from there.  Two gated recurrent layers read a window in both directions, attention
pools their states, and a logistic unit gives the window's logit.  A text is cut into overlapping windows over its whole
length, and its score is that of its highest window.

Training is in numpy, in a task (the driver gets the network alone), on a bounded sample of labelled rows: ``FIT_ROWS`` of each label and ``FIT_BYTES`` of text at most, in the
order of a hash of their ids, texts of all lengths.  A toxic text trains by its highest window, a clean one by a window at
random or its highest.  One part in eight of the sample, held back and scored as whole texts, sets the logit that becomes
score 0.5.  Labels are read only where crc32(id as text) mod 5 is not 0; language, source and id are no inputs.

Edge cases: null and empty texts and texts without a word score 0; unlabelled rows are scored alike; without labels of both
kinds all scores are 0; repeated rows score the same; null ids are never held out nor learnt from; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import slices, tidy
from lectern.llm.hashing import U, text_bytes, word_hashes

WINDOW, STRIDE = 16, 12
WORDS, TRIGRAMS, EMBED, HIDDEN = 1 << 18, 1 << 13, 8, 8
#: Numbers of leading bytes that have an embedding of their own, its size and the size of its table.
PREFIXES, PREFIX_EMBED, PREFIX_TABLE = (4, 5, 6, 7, 8), 3, 1 << 17
INPUT = 2 * EMBED + PREFIX_EMBED * len(PREFIXES)
FIT_ROWS, FIT_BYTES, BATCH, RATE, DROP = 3000, 8 << 20, 64, 0.003, 0.3
#: Rounds over the sample, and the least number of steps: small samples take more rounds.
ROUNDS, STEPS = 6, 400
#: Texts that the log odds of a word or prefix are smoothed by, and their weight in its embedding; the least number of texts
#: that it is in, as the odds of what few texts have are those texts' labels.
SMOOTH, ODDS, SEEN = 4.0, 2.0, 5
SLICE_BYTES = 1 << 20
#: Parameters with a row for each word, trigram or prefix.
TABLES = ("word", "tri", *(f"prefix{k}" for k in PREFIXES))
_workers: dict = {}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Windows:
    """The windows of some texts: for each, places in the list of distinct words; and the inputs of these words."""

    def __init__(self, texts: pa.Array) -> None:
        hashes, start, end, first = word_hashes(texts, ascii_words=True)
        data, at = text_bytes(texts)
        distinct, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        owner = np.searchsorted(first, place, "right") - 1
        begin = at[owner] + start[place] if len(place) else place
        size = (end - start)[place] if len(place) else place
        self.word = (distinct % U(WORDS)).astype(np.int64)
        #: Trigrams of each distinct word between marks: the bytes one before to one after, A-Z as a-z.
        which = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        edge = np.zeros(len(which), bool)
        if len(which):
            self.cut = np.cumsum(size) - size
            edge[self.cut] = True
            before = np.where(edge, 94, low[np.maximum(which - 1, 0)])
            last = np.zeros(len(which), bool)
            last[np.cumsum(size) - 1] = True
            after = np.where(last, 36, low[np.minimum(which + 1, len(low) - 1)])
            self.trigram = (((before.astype(np.int64) * 961 + low[which]) * 977 + after) * 40503 % 65_521 % TRIGRAMS).astype(np.int32)
        else:
            self.cut, self.trigram = np.empty(0, np.int64), np.empty(0, np.int64)
        self.size = np.maximum(size, 1)
        self.prefix, h = [], np.zeros(len(place), np.int64)
        for j in range(max(PREFIXES)):
            h = (h * 263 + np.where(j < size, low[np.minimum(begin + j, len(low) - 1)], 0)) % 1_000_000_007 if len(place) else h
            if j + 1 in PREFIXES:
                self.prefix.append(h % PREFIX_TABLE)
        n = np.diff(first)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        self.owner = np.repeat(np.arange(len(n)), count)
        self.first = np.cumsum(count) - count
        self.count = count
        begin = first[:-1][self.owner] + STRIDE * (np.arange(len(self.owner)) - self.first[self.owner])
        steps = begin[:, None] + np.arange(WINDOW)
        self.mask = steps < first[1:][self.owner][:, None]
        self.steps = inverse.astype(np.int32)[np.where(self.mask, steps, 0)] if len(hashes) else np.empty((0, WINDOW), np.int32)


class Network:
    def __init__(self, seed: int = 7) -> None:
        self.seed, self.started = seed, False
        r = np.random.default_rng(seed)
        h, e = HIDDEN, INPUT

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": draw(WORDS, EMBED, scale=0.1), "tri": draw(TRIGRAMS, EMBED, scale=0.3), "wx": draw(e, 6 * h, scale=e**-0.5), "bx": np.zeros(6 * h, np.float32), "uf": draw(h, 3 * h, scale=h**-0.5), "ub": draw(h, 3 * h, scale=h**-0.5)}
        self.p |= {f"prefix{k}": draw(PREFIX_TABLE, PREFIX_EMBED, scale=0.1) for k in PREFIXES}
        self.p |= {"wa": draw(2 * h, h, scale=(2 * h) ** -0.5), "va": draw(h, scale=0.5), "wo": draw(2 * h, scale=0.3), "bo": np.zeros(1, np.float32)}
        self.shift, self.slope = 0.0, 1.0

    def __getstate__(self) -> dict:
        """Of the tables of embeddings the rows that training has changed: most are as the seed drew them, and are drawn again where the network is read."""
        state, drawn = self.__dict__ | {"p": dict(self.p)}, Network(self.seed)._drawn(self.started)
        for name in TABLES:
            rows = np.flatnonzero((self.p[name] != drawn[name]).any(axis=1)).astype(np.int32)
            state["p"][name] = rows, self.p[name][rows]
        return state

    def __setstate__(self, state: dict) -> None:
        drawn = Network(state["seed"])._drawn(state["started"])
        for name in TABLES:
            rows, values = state["p"][name]
            drawn[name][rows] = values
        self.__dict__ = state | {"p": state["p"] | {name: drawn[name] for name in TABLES}}

    def _drawn(self, started: bool) -> dict[str, np.ndarray]:
        """The parameters as drawn; where training has started, without the first numbers that it gives to what few texts have."""
        for name in (n for n in TABLES if started and n != "tri"):
            self.p[name][:, 0] = 0
        return self.p

    def inputs(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of the distinct words, and their products with the input weights."""
        tri = np.add.reduceat(self.p["tri"][w.trigram], w.cut, axis=0) / w.size[:, None] if len(w.cut) else np.empty((0, EMBED))
        x = np.concatenate([self.p["word"][w.word], tri, *(self.p[f"prefix{k}"][own] for k, own in zip(PREFIXES, w.prefix, strict=True))], axis=1).astype(np.float32)
        return x, x @ self.p["wx"] + self.p["bx"]

    def run(self, steps: np.ndarray, mask: np.ndarray, px: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Logits of windows."""
        n, h = len(steps), HIDDEN
        states = np.empty((WINDOW, n, 2 * h), np.float32)
        on = mask.astype(np.float32)
        for d, name in enumerate(("uf", "ub")):
            s, u = np.zeros((n, h), np.float32), self.p[name]
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                x, y = px[steps[:, t], d * 3 * h : (d + 1) * 3 * h], s @ u
                zr = 1 / (1 + np.exp(-(x[:, : 2 * h] + y[:, : 2 * h])))
                new = np.tanh(x[:, 2 * h :] + zr[:, h:] * y[:, 2 * h :])
                m = on[:, t : t + 1]
                z = 1 - (1 - zr[:, :h]) * m
                if trace is not None:
                    trace.append((d, t, s, y[:, 2 * h :], z, zr[:, h:], new, m))
                s = new + z * (s - new)
                states[t, :, d * h : (d + 1) * h] = s
        a = np.tanh(states @ self.p["wa"])
        weight = np.where(mask.T, a @ self.p["va"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if trace is not None:
            trace.append((states, a, weight, pooled))
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gradient(self, w: Windows, rows: np.ndarray, target: np.ndarray, drop: np.random.Generator | None = None) -> dict[str, np.ndarray]:
        """Of the mean log loss of the windows in ``rows``."""
        h, p = HIDDEN, self.p
        used, place = np.unique(w.steps[rows], return_inverse=True)
        steps, mask, trace = place.reshape(len(rows), WINDOW), w.mask[rows], []
        part = _Part(w, used)
        x, px = self.inputs(part)
        if drop is not None:  # words without their own embedding are read by their characters
            x[drop.random(len(x)) < DROP, :EMBED] = 0
            px = x @ p["wx"] + p["bx"]
        logit = self.run(steps, mask, px, trace)
        states, a, weight, pooled = trace.pop()
        d = ((_sigmoid(logit) - target) / len(rows)).astype(np.float32)
        g = {"wo": pooled.T @ d, "bo": np.array([d.sum()])}
        dp = d[:, None] * p["wo"]
        dstates = weight[:, :, None] * dp
        dw = (states * dp).sum(-1)
        dw = weight * (dw - (weight * dw).sum(axis=0))
        g["va"] = (dw[:, :, None] * a).sum((0, 1))
        da = dw[:, :, None] * p["va"] * (1 - a * a)
        g["wa"] = np.tensordot(states, da, ((0, 1), (0, 1)))
        dstates = dstates + da @ p["wa"].T
        dpx = np.zeros_like(px)
        g["uf"], g["ub"] = np.zeros_like(p["uf"]), np.zeros_like(p["ub"])
        carry = [np.zeros((len(rows), h), np.float32) for _ in range(2)]
        for k, t, s, yn, z, r, new, m in reversed(trace):
            ds = dstates[t, :, k * h : (k + 1) * h] + carry[k]
            dn = ds * (1 - z) * (1 - new * new)
            dz = ds * (s - new) * m  # z = 1 - (1 - gate) * m
            gate = np.where(m > 0, z, 0.5)
            dz = dz * gate * (1 - gate)
            dr = dn * yn * r * (1 - r)
            dy = np.concatenate([dz, dr, dn * r], axis=1)
            name = "uf" if k == 0 else "ub"
            g[name] += s.T @ dy
            carry[k] = ds * z + dy @ p[name].T
            np.add.at(dpx, (steps[:, t], slice(k * 3 * h, (k + 1) * 3 * h)), np.concatenate([dz, dr, dn], axis=1))
        g["wx"], g["bx"] = x.T @ dpx, dpx.sum(axis=0)
        dx = dpx @ p["wx"].T
        dx[~x[:, :EMBED].any(axis=1), :EMBED] = 0
        g["word"] = _rows(part.word, dx[:, :EMBED])
        g["tri"] = _rows(part.trigram, np.repeat(dx[:, EMBED : 2 * EMBED] / part.size[:, None], part.length, axis=0))
        for i, (k, own) in enumerate(zip(PREFIXES, part.prefix, strict=True)):
            g[f"prefix{k}"] = _rows(own, dx[:, 2 * EMBED + i * PREFIX_EMBED : 2 * EMBED + (i + 1) * PREFIX_EMBED])
        return g

    def logits(self, w: Windows, rows: np.ndarray | None = None) -> np.ndarray:
        """Of all windows, or of some with -inf for the others."""
        _, px = self.inputs(w)
        rows = np.arange(len(w.steps)) if rows is None else rows
        out = np.full(len(w.steps), -np.inf)
        for some in (rows[i : i + 2048] for i in range(0, len(rows), 2048)):
            out[some] = self.run(w.steps[some], w.mask[some], px)
        return out

    def best(self, w: Windows, logits: np.ndarray) -> np.ndarray:
        """Place of the highest window of each text; -1 for a text without words."""
        out = np.full(len(w.count), -1)
        order = np.lexsort((logits, w.owner))
        out[w.owner[order]] = order
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        w = Windows(texts)
        logits = self.logits(w)
        top = self.best(w, logits)
        return np.where(top >= 0, _sigmoid(self.slope * ((logits[top] if len(logits) else np.zeros(len(top))) - self.shift)), 0.0)

    def _start(self, w: Windows, docs: np.ndarray, toxic: np.ndarray) -> None:
        """The first number of each word's and prefix's embedding starts as its smoothed log odds among the texts to learn from."""
        doc, step = np.broadcast_to(w.owner[:, None], w.steps.shape)[w.mask], w.steps[w.mask]
        learnt = np.zeros(len(toxic), bool)
        learnt[docs] = True
        pair = np.unique(doc[learnt[doc]] * len(w.word) + step[learnt[doc]].astype(np.int64))
        doc, step = pair // max(1, len(w.word)), pair % max(1, len(w.word))
        share = toxic[docs].mean() if len(docs) else 0.0
        if not 0 < share < 1:
            return
        self.started = True
        for name, own in (("word", w.word), *((f"prefix{k}", x) for k, x in zip(PREFIXES, w.prefix, strict=True))):
            table = len(self.p[name])
            both = np.unique(doc * table + own[step])
            bad, n = np.bincount(both % table, toxic[both // table], table), np.bincount(both % table, minlength=table)
            odds = np.log((bad + SMOOTH * share) / (n - bad + SMOOTH * (1 - share))) - np.log(share / (1 - share))
            self.p[name][:, 0] = np.where(n >= SEEN, ODDS * odds, 0)

    def train(self, texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS) -> None:
        r = np.random.default_rng(3)
        w = Windows(pa.array(texts, pa.large_string()))
        own = np.flatnonzero(w.count > 0)
        own = own[r.permutation(len(own))]
        check, own = own[: len(own) // 8], own[len(own) // 8 :]
        self._start(w, own, toxic)
        rounds = max(rounds, min(10 * rounds, -(-STEPS * BATCH // max(1, len(own)))))
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        tick = 0
        for k in range(rounds):
            hard = (r.random(len(toxic)) < 0.5) | (toxic == 1)  # these train by their highest window
            hard &= k > 0
            some = w.first + (r.random(len(w.count)) * w.count).astype(np.int64)
            row = np.where(hard, self.best(w, self.logits(w, np.flatnonzero(hard[w.owner]))), some)
            good, bad = own[toxic[own] == 0], own[toxic[own] == 1]
            order = r.permutation(np.concatenate([good, np.resize(bad, max(len(bad), len(good) // 2))]))
            for at in range(0, len(order), BATCH):
                docs = order[at : at + BATCH]
                tick += 1
                rate = RATE * (1 - ((1 - min(1, tick / 20)) if tick < 20 else 0)) * (0.3 if 3 * k >= 2 * rounds else 1)
                for name, grad in self.gradient(w, row[docs], toxic[docs], r).items():
                    rows, grad = grad if isinstance(grad, tuple) else (slice(None), grad)
                    m, v = (x[rows] for x in moment[name])
                    grad = np.clip(grad, -1, 1)
                    m = m + 0.1 * (grad - m)
                    v = v + 0.01 * (grad * grad - v)
                    moment[name][0][rows], moment[name][1][rows] = m, v
                    self.p[name][rows] -= (rate * m / (1 - 0.9**tick) / (np.sqrt(v / (1 - 0.99**tick)) + 1e-6)).astype(np.float32)
        logits = self.logits(w)
        value, truth = logits[self.best(w, logits)][check], toxic[check]
        if 0 < truth.sum() < len(truth):  # in the widest gap among the cuts with the fewest errors, nearer to the toxic side: long texts have more windows
            order = np.argsort(value)
            v, y = value[order], truth[order]
            wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
            edges = np.concatenate([[v[0] - 1], v, [v[-1] + 1]])
            gap = np.where(wrong == wrong.min(), edges[1:] - edges[:-1], -1)
            k = int(np.argmax(gap))
            self.shift = float(edges[k] + 0.8 * (edges[k + 1] - edges[k]))


def _rows(own: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of some rows of a table: each row once."""
    rows, place = np.unique(own, return_inverse=True)
    out = np.zeros((len(rows), grad.shape[1]), np.float32)
    np.add.at(out, place, grad)
    return rows, out


class _Part:
    """The inputs of some of the distinct words."""

    def __init__(self, w: Windows, used: np.ndarray) -> None:
        length = np.diff(np.append(w.cut, len(w.trigram)))[used]
        self.word, self.size, self.length, self.prefix = w.word[used], w.size[used], length, [x[used] for x in w.prefix]
        self.cut = np.cumsum(length) - length
        self.trigram = w.trigram[np.repeat(w.cut[used] - self.cut, length) + np.arange(int(length.sum()))]


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The network that a sample (key, text, toxic), all of it in one task, trains; none without both labels."""
    read = list(batches)
    if not read:
        return
    sample = pa.Table.from_batches(read).to_pandas().sort_values("key", ignore_index=True)
    toxic = sample["toxic"].to_numpy().astype(np.float32)
    if 0 < toxic.sum() < len(toxic):
        network = Network()
        network.train(sample["text"].tolist(), toxic)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], ["network"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> bytes | None:
    """A network, pickled, trained on a bounded sample of the labelled rows that are not held out; None without both labels. The driver passes it
    on unread."""
    known = labels.select(F.col(id_col).alias("key"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("key").isNotNull() & ~F.coalesce(held_out(F.col("key")), F.lit(True)))
    order = (F.xxhash64("key"), "key")
    rows = known.where("toxic = 1").distinct().orderBy(*order).limit(fit_rows).union(known.where("toxic = 0").distinct().orderBy(*order).limit(fit_rows))
    rows = rows.groupBy("key").agg(F.min("toxic").alias("toxic"), F.count("*").alias("n")).where("n = 1").drop("n")
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(rows), "key")
    sizes = texts.select("key", F.octet_length("text").alias("size"), F.xxhash64("key").alias("h")).orderBy("h", "key").limit(2 * fit_rows).toPandas()
    taken = sizes["key"][sizes["size"].cumsum() <= FIT_BYTES].drop_duplicates()
    if not len(taken):
        return None
    some = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in taken.tolist()], T.StructType([T.StructField("key", docs.schema[id_col].dataType)])))
    sample = texts.join(some, "key", "left_semi").dropDuplicates(["key"]).select("key", "text", "toxic")
    found = sample.repartition(1).mapInArrow(tidy(_trained), "network binary").collect()
    return bytes(found[0].network) if found else None


def _network(key: str, model: Broadcast) -> Network | None:
    """The network of a query, read once by a worker."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = pickle.loads(model.value) if model.value else None
    return _workers[key]


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score (0 to 1) and predicted (1 from score 0.5 on)."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    model, key = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col)), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = _network(key, model)
        for batch in batches:
            for part in slices(batch, 1000, SLICE_BYTES):
                found = network.scores(part.column(1)).astype(float) if network else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = read.mapInArrow(tidy(score), f"id {kind}, score double, predicted int")
    return scored.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, as they are."""
    model, key = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col)), uuid.uuid4().hex
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = _network(key, model)
        for batch in batches:
            for part in slices(batch, 1000, SLICE_BYTES):
                yield part.filter(pa.array(network.scores(part.column(place)) < 0.5)) if network else part

    return docs.mapInArrow(tidy(keep), docs.schema)
