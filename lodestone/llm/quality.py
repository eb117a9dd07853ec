"""Document quality by a byte-level convolutional network, trained and run in numpy.

A text is cut into overlapping chunks that cover all of its bytes. Filters over windows of
eight byte embeddings are max-pooled within each chunk; a small layer turns the pooled
responses into a chunk logit, and the mean logit of the chunks gives one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, hand_back, raw_bytes

CHUNK, STEP = 512, 448  # bytes of a chunk, and from one chunk to the next
_PAD = 256  # stands after texts shorter than a chunk
_STRIDE, _EMBED, _FILTERS, _HIDDEN = 4, 8, 32, 16
_AT_ONCE = 512  # chunks held as float arrays at a time


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(byte values [chunks, CHUNK], first chunk of each text). The last chunk ends with
    its text, so only texts shorter than a chunk are padded."""
    starts, firsts, pieces, at = [], [], [], 0
    for text in texts:
        firsts.append(len(starts))
        size = len(text)
        if size <= CHUNK:
            starts.append(at)
        else:
            starts += [at + s for s in range(0, size - CHUNK, STEP)] + [at + size - CHUNK]
        held = np.full(max(size, CHUNK), _PAD, dtype=np.uint16)
        held[:size] = np.frombuffer(text, dtype=np.uint8)
        pieces.append(held)
        at += len(held)
    flat = np.concatenate(pieces)
    windows = np.lib.stride_tricks.sliding_window_view(flat, CHUNK)
    return windows[np.array(starts)], np.array(firsts)


class ByteNetwork:
    """The weights, the forward pass and the training steps."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        width = _STRIDE * _EMBED

        def normal(*shape, scale):
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        self.w = {
            "embed": normal(257, _EMBED, scale=0.5),
            "left": normal(width, _FILTERS, scale=width**-0.5),
            "right": normal(width, _FILTERS, scale=width**-0.5),
            "bias": np.zeros(_FILTERS, np.float32),
            "mix": normal(_FILTERS, _HIDDEN, scale=_FILTERS**-0.5),
            "shift": np.zeros(_HIDDEN, np.float32),
            "out": normal(_HIDDEN, scale=_HIDDEN**-0.5),
            "level": np.zeros(1, np.float32),
        }

    def _pool(self, values: np.ndarray):
        w = self.w
        steps = w["embed"][values].reshape(len(values), CHUNK // _STRIDE, -1)
        response = steps[:, :-1] @ w["left"] + steps[:, 1:] @ w["right"]
        return steps, response

    def _head(self, pooled: np.ndarray):
        hidden = np.maximum(pooled @ self.w["mix"] + self.w["shift"], 0)
        return hidden, hidden @ self.w["out"] + self.w["level"]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        values, firsts = chunks(texts)
        parts = []
        for at in range(0, len(values), _AT_ONCE):
            _, response = self._pool(values[at : at + _AT_ONCE])
            parts.append(self._head(np.maximum(response.max(axis=1) + self.w["bias"], 0))[1])
        each = np.concatenate(parts)
        counts = np.diff(np.append(firsts, len(each)))
        return np.add.reduceat(each.astype(np.float64), firsts) / counts

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))

    def _gradients(self, texts: list[bytes], labels: np.ndarray):
        w = self.w
        values, firsts = chunks(texts)
        counts = np.diff(np.append(firsts, len(values)))
        steps, response = self._pool(values)
        best = response.argmax(axis=1)  # [chunks, filters]
        top = np.take_along_axis(response, best[:, None], axis=1)[:, 0] + w["bias"]
        pooled = np.maximum(top, 0)
        hidden, each = self._head(pooled)
        logit = np.add.reduceat(each, firsts) / counts
        chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = -np.mean(np.log(np.where(labels == 1, chance, 1 - chance) + 1e-7))
        each_g = np.repeat((chance - labels) / (len(labels) * counts), counts).astype(np.float32)
        hidden_g = each_g[:, None] * w["out"] * (hidden > 0)
        pooled_g = (hidden_g @ w["mix"].T) * (top > 0)
        rows = np.arange(len(values))[:, None]
        g = {
            "out": hidden.T @ each_g, "level": each_g.sum(keepdims=True),
            "mix": pooled.T @ hidden_g, "shift": hidden_g.sum(axis=0), "bias": pooled_g.sum(axis=0),
            "left": np.einsum("nf,nfd->df", pooled_g, steps[rows, best]),
            "right": np.einsum("nf,nfd->df", pooled_g, steps[rows, best + 1]),
        }
        embed_g = np.zeros_like(w["embed"])
        by_step = values.reshape(len(values), -1, _STRIDE)
        for name, at in (("left", best), ("right", best + 1)):
            spread = pooled_g[:, :, None] * w[name].T
            np.add.at(embed_g, by_step[rows, at].reshape(-1), spread.reshape(-1, _EMBED))
        g["embed"] = embed_g
        return loss, g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int, rate: float, seed: int = 7):
        """Adam over shuffled batches of 32 texts; stops early once the loss is small."""
        draw = np.random.default_rng(seed)
        slow = {k: np.zeros_like(v) for k, v in self.w.items()}
        fast = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            order, losses = draw.permutation(len(texts)), []
            for at in range(0, len(order), 32):
                pick = order[at : at + 32]
                loss, g = self._gradients([texts[i] for i in pick], labels[pick])
                losses.append(loss)
                step += 1
                for k, v in g.items():
                    slow[k] = 0.9 * slow[k] + 0.1 * v
                    fast[k] = 0.999 * fast[k] + 0.001 * v * v
                    self.w[k] -= rate * (slow[k] / (1 - 0.9**step)) / (
                        np.sqrt(fast[k] / (1 - 0.999**step)) + 1e-8)
            if np.mean(losses) < 0.004:
                break
        return self


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, longest: int) -> DataFrame:
    """At most ``per_class`` labelled texts of each class, picked by a digest of the id.

    Rows whose crc32 of the id leaves 2 modulo 4 are held out. Ids with conflicting or null
    labels, and texts over ``longest`` bytes, teach nothing.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").alias("__q"))
        .where("__id is not null and __q in (0, 1)")
        .where(F.crc32(F.col("__id").cast("string")) % 4 != 2)
        .groupBy("__id").agg(F.min("__q").alias("__q"), F.max("__q").alias("__top"))
        .where("__q = __top").drop("__top")
    )
    picked = [
        known.where(F.col("__q") == c).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        for c in (0, 1)
    ]
    found = docs.select(column("doc_id").alias("__id"), column("text").alias("__text")).join(
        F.broadcast(picked[0].union(picked[1])), "__id"  # bounded: 2 * per_class pairs of numbers
    )
    return found.where(F.octet_length("__text") <= longest).orderBy(
        F.xxhash64("__id"), "__id", F.xxhash64("__text")
    ).limit(2 * per_class)


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 32_768,
    epochs: int = 20, rate: float = 0.004,
) -> ByteNetwork:
    """The network fitted on a bounded sample: 2 * per_class texts of at most ``longest`` bytes.

    Classes weigh alike. Without a label of either class every score is about one half.
    """
    rows = training_rows(docs, labels, per_class, longest).collect()
    network = ByteNetwork()
    if rows:
        texts = [(r["__text"] or "").encode() for r in rows]
        marks = np.array([r["__q"] for r in rows])
        few = max(1, min((marks == 0).sum(), (marks == 1).sum()))
        rare = 0 if (marks == 0).sum() < (marks == 1).sum() else 1
        copies = min(8, len(marks) // few - 1) if 0 < (marks == rare).sum() < len(marks) else 1
        pick = np.concatenate([np.arange(len(marks))] + [np.flatnonzero(marks == rare)] * (copies - 1))
        network.fit([texts[i] for i in pick], marks[pick], epochs, rate)
    return network


def with_score(docs: DataFrame, network: ByteNetwork, text_col: str = "text", name: str = "score"):
    """Adds the probability of quality 1, from the whole text alone.

    Null and empty texts are one chunk of padding and get its score. A column called
    ``name`` is replaced; all other columns and rows pass unchanged.
    """
    budget = 4 << 20

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        held, size, out = [], 0, []
        for x in raw_bytes(text):
            held.append(x)
            size += len(x)
            if size >= budget:
                out.append(network.probabilities(held))
                held, size = [], 0
        if held:
            out.append(network.probabilities(held))
        hand_back()
        return pa.array(np.concatenate(out) if out else [], type=pa.float64())

    return docs.withColumn(name, score(column(text_col).cast("string")))
