"""Toxicity by a bidirectional gated recurrent network over characters and words.

Each word's vector joins a hashed word embedding with what a recurrent layer with attention pooling
makes of the word's characters, so unseen forms of known stems are recognised. A second such layer
reads windows of words. All windows of a text, overlapping by a third, are scored; the text's score
is its highest window's, calibrated on the training rows. Training, in numpy on the driver, sees a
bounded sample of labelled rows (``SAMPLE`` of each class, texts of at most ``LONGEST`` code points;
both are parameters); a label holds for a text, so each round trains on the windows that the network
itself finds most telling. Scoring runs in tasks; the weights, of fixed size, are broadcast.

Defined cases: a null, empty or blank text has one empty window and gets that window's score; very
long words are read in pieces of ``WORD`` code points; null labels are not used; repeated label rows
count once; without both classes the score is the share of toxic labels (0.05 without any labels);
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.gru import Adam, Pooled, sigmoid
from emberlake.llm.hashing import span_hashes
from emberlake.llm.workers import held, release, slices, small_batches, tidy

SAMPLE, LONGEST = 1200, 20_000
WORD, WINDOW, STRIDE = 16, 48, 32
CHARS, CHAR_DIM, CHAR_HIDDEN = 256, 8, 8
BUCKETS, WORD_DIM, HIDDEN = 4096, 6, 8
ROUNDS, BATCH, RATE = 8, 24, 0.01  # the same number of rounds for any number of rows
THRESHOLD = 0.3
KNOWN = 150_000  # distinct words whose projections a worker remembers
STEP = 1024  # windows scored at once
CHUNK = 1 << 19  # bytes of text handled at once


def split_words(texts: list):
    """(keys, starts, ends, code points, words of each text): word pieces of a batch of texts."""
    low = [(t or "").lower() for t in texts]
    joined = " ".join(low) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (cp == 32) | ((cp >= 9) & (cp <= 13))
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    size = ends - starts
    if len(size) and size.max() > WORD:
        n = -(-size // WORD)
        first = np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(starts, n) + (np.arange(n.sum()) - first) * WORD
        ends = np.minimum(starts + WORD, np.repeat(ends, n))
    keys = span_hashes(cp, starts, ends)
    bounds = np.cumsum([len(t) + 1 for t in low])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return keys, starts, ends, cp, counts


def letters_of(starts, ends, cp):
    """(n, WORD) character ids, 0 where a word has ended."""
    at = starts[:, None] + np.arange(WORD)
    inside = at < ends[:, None]
    c = cp[np.minimum(at, len(cp) - 1)]
    c = np.where(c < 128, c, 128 + c % 128)
    return np.where(inside, c, 0).astype(np.int16)


def windows_of(counts):
    """Word positions (n, WINDOW), -1 beyond a text's end, and each window's text."""
    first = np.cumsum(counts) - counts
    n = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = nth[:, None] * STRIDE + np.arange(WINDOW)
    return np.where(at < counts[owner, None], first[owner, None] + at, -1), owner


class Network:
    def __init__(self, weights: dict | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = weights if weights is not None else {}
        new = None if weights is not None else rng
        self.chars = Pooled(self.w, "chars", CHAR_DIM, CHAR_HIDDEN, new)
        self.words = Pooled(self.w, "words", 2 * CHAR_HIDDEN + WORD_DIM, HIDDEN, new)
        if new is not None:
            self.w["letters"] = rng.normal(0, 0.5, (CHARS, CHAR_DIM)).astype(np.float32)
            self.w["lexicon"] = rng.normal(0, 0.1, (BUCKETS, WORD_DIM)).astype(np.float32)
            self.w["out"], self.w["bias"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)

    def vectors(self, keys, letters, keep: bool = False, drop=None):
        emb = self.w["letters"][letters]
        x = self.chars.project(emb.reshape(-1, CHAR_DIM)).reshape(*letters.shape, -1)
        pooled = self.chars.forward(x, letters > 0, keep)
        bucket = (keys % np.uint64(BUCKETS)).astype(np.int64)
        known = self.w["lexicon"][bucket]
        if drop is not None:
            known = known * drop
        if keep:
            self.saved = (emb, letters, bucket)
        return np.concatenate([pooled, known], 1)

    def projections(self, keys, letters):
        """Projected inputs of distinct words; by length, so that short words cost few steps."""
        out = np.zeros((len(keys), 6 * HIDDEN), np.float32)
        size = (letters > 0).sum(1)
        for lo, hi in ((0, 4), (4, 7), (7, 10), (10, WORD)):
            some = np.flatnonzero((size > lo) & (size <= hi))
            if len(some):
                out[some] = self.words.project(self.vectors(keys[some], letters[some][:, :hi]))
        return out

    def logits(self, projected, windows, keep: bool = False):
        valid = windows >= 0
        pooled = self.words.forward(projected[np.maximum(windows, 0)], valid, keep)
        if keep:
            self.pooled = pooled
        return pooled @ self.w["out"] + self.w["bias"][0]

    def train_step(self, keys, letters, windows, labels, weights, adam: Adam, rng) -> float:
        """One step; half of the word embeddings are left out, so that spelling has to carry the meaning."""
        used, local = np.unique(np.append(windows.ravel(), -1), return_inverse=True)
        local = local[:-1].reshape(windows.shape) - 1  # -1 stays -1
        used = used[1:]
        if not len(used):
            return 0.0
        drop = (rng.random((len(used), 1)) < 0.5).astype(np.float32)
        vec = self.vectors(keys[used], letters[used], True, drop)
        projected = self.words.project(vec)
        p = sigmoid(self.logits(projected, local, True))
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        d = ((p - labels) * weights / len(labels)).astype(np.float32)
        g["out"] += self.pooled.T @ d
        g["bias"] += d.sum()
        dx = self.words.backward(d[:, None] * self.w["out"], g)
        valid = local >= 0
        dproj = np.zeros_like(projected)
        np.add.at(dproj, local[valid], dx[valid])
        dvec = self.words.project_back(vec, dproj, g)
        emb, chars, bucket = self.saved
        np.add.at(g["lexicon"], bucket, dvec[:, 2 * CHAR_HIDDEN :] * drop)
        dc = self.chars.backward(dvec[:, : 2 * CHAR_HIDDEN], g).reshape(-1, 6 * CHAR_HIDDEN)
        de = self.chars.project_back(emb.reshape(-1, CHAR_DIM), dc, g)
        np.add.at(g["letters"], chars.ravel(), de)
        adam.step(g)
        return float(-(np.log(np.where(labels > 0, p, 1 - p) + 1e-9)).mean())


def fit(texts: list, labels, prior: float, *, rounds: int = ROUNDS, seed: int = 7) -> dict:
    """Weights and calibration from sampled texts with 0/1 labels; ``prior`` is the share of toxic labels."""
    labels = np.asarray(labels, np.float64)
    net = Network(seed=seed)
    if len(set(labels.tolist())) < 2:
        p = min(0.99, max(0.001, prior))
        return {"w": net.w, "slope": [0.0, 0.0], "shift": float(np.log(p / (1 - p)))}
    parts = []
    for i in range(0, len(texts), 200):  # the driver holds the code points of few texts at a time
        k, starts, ends, cp, n = split_words(texts[i : i + 200])
        u, at = np.unique(k, return_index=True)
        parts.append((k, n, u, letters_of(starts[at], ends[at], cp)))
    keys, at = np.unique(np.concatenate([p[2] for p in parts]), return_index=True)
    letters = np.concatenate([p[3] for p in parts])[at]
    windows, owner = windows_of(np.concatenate([p[1] for p in parts]))
    code = np.searchsorted(keys, np.concatenate([p[0] for p in parts]))
    windows = np.where(windows >= 0, code[np.maximum(windows, 0)], -1)  # by distinct word from here on
    del parts, code
    rng = np.random.default_rng(seed)
    weight = _telling(keys, letters, windows, owner, labels)
    adam = Adam(net.w, RATE)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    apart = rng.random(len(labels)) < 0.25  # texts for calibration, never trained on
    if len(set(labels[apart].tolist())) < 2 or len(set(labels[~apart].tolist())) < 2:
        apart[:] = False
    for k in range(rounds):
        # the highest window of each text, and for texts without toxicity another one at random
        order = np.lexsort((-weight, owner))
        top = order[first]
        n = np.diff(np.append(first, len(owner)))
        clean = np.flatnonzero(labels == 0)
        other = first[clean] + rng.integers(0, n[clean])
        picked = np.concatenate([top, other])
        picked = rng.permutation(picked[~apart[owner[picked]]])
        y = labels[owner[picked]]
        w = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        if k == rounds - 1:
            adam.rate = RATE / 4
        for i in range(0, len(picked), BATCH):
            s = slice(i, i + BATCH)
            net.train_step(keys, letters, windows[picked[s]], y[s], w[s], adam, rng)
        weight = _all_logits(net, keys, letters, windows)
    judged = apart if apart.any() else ~apart
    slope, shift = _platt(_features(weight, first)[judged], labels[judged])
    share = labels[judged].mean()
    shift += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share))) if 0 < prior < 1 else 0.0
    return {"w": net.w, "slope": slope, "shift": shift}


def _telling(keys, letters, windows, owner, labels):
    """A first guess at each window's weight: the most one-sided word or word beginning in it."""
    stem = letters[:, :4].astype(np.int64) @ np.array([1, 257, 66049, 16974593])
    out = np.zeros(windows.shape)
    valid = windows >= 0
    doc = np.broadcast_to(owner[:, None], windows.shape)[valid]
    for key in (np.arange(len(keys)), np.unique(stem, return_inverse=True)[1]):
        code = key[windows[valid]]
        seen = np.unique(code * np.int64(len(labels)) + doc)
        where, d = seen // len(labels), seen % len(labels)
        pos = np.bincount(where, labels[d], key.max() + 1)
        neg = np.bincount(where, 1 - labels[d], key.max() + 1)
        odds = np.log((pos + 0.2) / (neg + 0.2)) * np.minimum(1, pos / 3)
        out[valid] = np.maximum(out[valid], odds[code])
    return out.max(1)


def _all_logits(net: Network, keys, letters, windows, step: int = STEP):
    projected = np.concatenate([net.projections(keys[i : i + 20000], letters[i : i + 20000]) for i in range(0, max(1, len(keys)), 20000)])
    if not len(projected):
        projected = np.zeros((1, 6 * HIDDEN), np.float32)
    return np.concatenate([net.logits(projected, windows[i : i + step]) for i in range(0, len(windows), step)])


def _features(logits, first):
    """A text's highest window, and how many windows are toxic."""
    x = np.clip(np.asarray(logits, np.float64), -20, 20)
    return np.stack([np.maximum.reduceat(x, first), np.log1p(np.add.reduceat(sigmoid(x), first))], 1)


def _platt(x, y, steps: int = 100):
    """Slopes and shift of a slightly damped logistic fit with smoothed targets (Newton steps)."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, damp = np.zeros(3), np.diag([0.1, 0.1, 0.01])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = np.maximum(p * (1 - p), 1e-4)
        w = w - np.linalg.solve((x * h[:, None]).T @ x + damp, x.T @ (p - target) + damp @ w)
    return [max(0.0, float(w[0])), max(0.0, float(w[1]))], float(w[2])


class Scorer:
    """A worker's network, with the projections of words that it has met."""

    def __init__(self, model: dict):
        self.net, self.slope, self.shift = Network(model["w"]), model["slope"], model["shift"]
        self._forget()

    def _forget(self):
        self.known: dict[int, int] = {}
        self.rows = np.zeros((1 << 12, 6 * HIDDEN), np.float32)

    def score(self, texts: list):
        import pandas as pd

        keys, starts, ends, cp, counts = split_words(texts)
        windows, owner = windows_of(counts)
        codes, unique = pd.factorize(keys)
        if len(self.known) + len(unique) > KNOWN:
            self._forget()
        names = unique.tolist()
        lacking = np.array([i for i, k in enumerate(names) if k not in self.known], np.int64)
        if len(lacking):
            at = np.zeros(len(unique), np.int64)
            at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            have = len(self.known)
            while have + len(lacking) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for i in range(0, len(lacking), 8192):
                some = lacking[i : i + 8192]
                self.rows[have + i : have + i + len(some)] = self.net.projections(unique[some].astype(np.uint64), letters_of(starts[at[some]], ends[at[some]], cp))
            self.known.update(zip([names[i] for i in lacking.tolist()], range(have, have + len(lacking))))
        row = np.append(np.array([self.known[k] for k in names], np.int64)[codes], 0) if len(names) else np.zeros(1, np.int64)
        windows = np.where(windows >= 0, row[np.maximum(windows, 0)], -1)
        logits = np.concatenate([self.net.logits(self.rows, windows[i : i + STEP]) for i in range(0, len(windows), STEP)])
        x = _features(logits, np.flatnonzero(np.diff(owner, prepend=-1)))
        return sigmoid(x @ np.array(self.slope) + self.shift)


def _with_scores(docs: DataFrame, model: dict, text: str, schema: str, result):
    """``result(batch, scores)`` of each Arrow batch of ``docs``."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    place = docs.columns.index(text)

    small_batches(docs.sparkSession)

    def run(batches):
        scorer = held(key, lambda: Scorer(shared.value))
        for batch in batches:
            texts = batch.column(place)
            out = [scorer.score(texts.slice(at, n).to_pylist()) for at, n in slices(texts, CHUNK)]
            yield result(batch, np.concatenate(out) if out else np.zeros(0))

    return docs.mapInArrow(tidy(run, True), schema)


def score(docs: DataFrame, model: dict, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for each row."""

    def result(batch, scores):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    kind = dict(docs.dtypes)[doc]
    return _with_scores(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), model, "text", f"doc_id {kind}, score double", result)


def held_out(doc: str) -> Column:
    return F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, longest: int = LONGEST) -> dict:
    """Fit on labelled rows that are not held out: at most ``sample`` of each class, least hashes first."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    prior = share.get(1, 0) / max(1, sum(share.values())) if share else 0.05
    picks = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    ids = F.broadcast(picks[0].unionByName(picks[1]))  # 2 * sample rows at most
    rows = docs.where(F.length("text") <= longest).select("doc_id", "text").join(ids, "doc_id").dropDuplicates(["doc_id"]).toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    model = fit([r["text"] for r in rows], [r["toxic"] for r in rows], prior)
    release()
    return model


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score all documents with a network trained on the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score(docs, model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents scored as toxic; all columns stay, each row goes by its own text, whatever its id."""
    threshold = THRESHOLD

    def result(batch, scores):
        import pyarrow as pa

        return batch.filter(pa.array(scores < threshold))

    return _with_scores(docs, train(docs, labels), "text", docs.schema, result)
