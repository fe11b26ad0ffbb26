"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes run over the whole document.  Activations are max-pooled over chunks of two blocks
that overlap by one, so every byte lies in two chunks; mean, maximum and minimum over the chunks go through one
logistic unit.  The first layer is kept as one table per place in the filter, so a convolution is a lookup and a sum.

Defined results: null texts are empty; an empty text is scored like a text of padding bytes; without labels of both
kinds every score is the share of label 1, or 0.5 where there is none.  Labels with a null are ignored; a document
with several equal label rows is learned from once.  At most about ``PER_LABEL`` documents of each label are learned from, picked
by a hash of their id, and of these as many as have ``LEARN_BYTES`` together, in the order of that hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_arrow, steps

#: Labelled documents learned from, for each label, and the bytes of all of them.
PER_LABEL, LEARN_BYTES = 600, 8_000_000
FILTERS, WIDTH, BLOCK = 16, 5, 128
EPOCHS, RATE, PENALTY = 24, 0.02, 1e-4
_PIECE = 512 * BLOCK


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


@dataclass
class ByteNet:
    tables: np.ndarray  # WIDTH, 256, FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 3 * FILTERS
    out_bias: float

    @classmethod
    def new(cls, seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 3 * FILTERS), 0.0)

    def blocks(self, raw: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Greatest activation of each filter in each block of ``BLOCK`` places, and its place."""
        padded = np.concatenate([raw, np.zeros(WIDTH, np.uint8)])
        n = len(padded) - WIDTH + 1
        best, at = [], []
        for lo in range(0, n, _PIECE):
            hi = min(n, lo + _PIECE)
            x = np.take(self.tables[0], padded[lo:hi], axis=0)
            for w in range(1, WIDTH):
                x += np.take(self.tables[w], padded[lo + w : hi + w], axis=0)
            full = (hi - lo) // BLOCK
            if full:
                cube = x[: full * BLOCK].reshape(full, BLOCK, FILTERS)
                if where:
                    k = cube.argmax(axis=1)
                    at.append(k + lo + BLOCK * np.arange(full)[:, None])
                best.append(cube.max(axis=1))
            if full * BLOCK < hi - lo:
                rest = x[full * BLOCK :]
                if where:
                    at.append(rest.argmax(axis=0)[None] + lo + full * BLOCK)
                best.append(rest.max(axis=0)[None])
        return np.concatenate(best), np.concatenate(at) if where else None

    def pooled(self, raw: np.ndarray) -> tuple[np.ndarray, list]:
        best, at = self.blocks(raw, True)
        chunk = np.maximum(best[:-1], best[1:]) if len(best) > 1 else best
        first = np.where(best[:-1] >= best[1:], at[:-1], at[1:]) if len(best) > 1 else at
        act = np.maximum(chunk + self.bias, 0)
        return np.concatenate([act.mean(0), act.max(0), act.min(0)]), [act, first]

    def vector(self, raw: np.ndarray) -> np.ndarray:
        best, _ = self.blocks(raw)
        act = np.maximum((np.maximum(best[:-1], best[1:]) if len(best) > 1 else best) + self.bias, 0)
        return np.concatenate([act.mean(0), act.max(0), act.min(0)])

    def score(self, text: str | None) -> float:
        z = float(self.vector(_bytes(text)) @ self.out) + self.out_bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def train(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> ByteNet:
        """Adam over batches of documents; the gradient reaches a filter at the places that its maxima come from."""
        rng = np.random.default_rng(seed)
        raws = [_bytes(t) for t in texts]
        y = np.array(labels, float)
        share = y.mean()
        weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        self.out_bias = 0.0
        state = [[np.zeros_like(p, dtype=np.float64), np.zeros_like(p, dtype=np.float64)] for p in (self.tables, self.bias, self.out, np.zeros(1))]
        t = 0
        places = np.arange(FILTERS)
        for epoch in range(epochs):
            order = rng.permutation(len(raws))
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for lo in range(0, len(order), 32):
                part = order[lo : lo + 32]
                grads = [np.zeros(self.tables.shape), np.zeros(FILTERS), PENALTY * self.out, np.zeros(1)]
                for i in part:
                    vector, (act, first) = self.pooled(raws[i])
                    z = float(vector @ self.out) + self.out_bias
                    d = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(part)
                    grads[2] += d * vector
                    grads[3] += d
                    back = np.zeros_like(act, dtype=np.float64)
                    back += d * self.out[:FILTERS] / len(act)
                    back[act.argmax(0), places] += d * self.out[FILTERS : 2 * FILTERS]
                    back[act.argmin(0), places] += d * self.out[2 * FILTERS :]
                    back *= act > 0
                    grads[1] += back.sum(0)
                    padded = np.concatenate([raws[i], np.zeros(WIDTH, np.uint8)])
                    for w in range(WIDTH):
                        np.add.at(grads[0][w], (padded[first + w], np.broadcast_to(places, first.shape)), back)
                t += 1
                steps_ = []
                for g, s in zip(grads, state):
                    s[0] = 0.9 * s[0] + 0.1 * g
                    s[1] = 0.999 * s[1] + 0.001 * g * g
                    steps_.append(rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8))
                self.tables = (self.tables - steps_[0]).astype(np.float32)
                self.bias = (self.bias - steps_[1]).astype(np.float32)
                self.out = self.out - steps_[2]
                self.out_bias -= float(steps_[3][0])
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> ByteNet | float:
    """Learn from docs (doc_id, text) and labels (doc_id, quality), without the rows that are held out.

    Returns the net, or a constant score where the labels are of one kind or there are none.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").where(~held_out())
    known = known.distinct()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    wanted = {q: int(1e6 * min(1.0, per_label / n)) + 1 for q, n in counts.items()}
    number = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1_000_000))
    picked = known.where(number < F.when(F.col("quality") == 1, wanted[1]).otherwise(wanted[0]))
    # About 2 * per_label rows of two numbers, whatever the corpus: they are broadcast, and no text is shuffled.
    order = Window.orderBy(number, "doc_id", "quality", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(F.broadcast(picked), "doc_id").withColumn("bytes", F.sum(F.octet_length("text")).over(order))
    got = joined.where(F.col("bytes") <= LEARN_BYTES).drop("bytes").collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"], r["quality"]))
    if len({r["quality"] for r in got}) < 2:
        return counts.get(1, 0) / sum(counts.values())
    return ByteNet.new().train([r["text"] for r in got], [r["quality"] for r in got])


def _scores(net: ByteNet | float):
    def run(batches):
        for batch in batches:
            out = []
            for _, texts in steps(batch, "text"):
                out += [net if isinstance(net, float) else net.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, net: ByteNet | float) -> DataFrame:
    """doc_id and score of every row of (doc_id, text)."""
    return map_arrow(docs.select("doc_id", "text"), _scores(net), "doc_id long, score double")
