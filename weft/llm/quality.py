"""Quality classifier: multiple-instance learning with gated attention over a text's passages."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, held_out, labelled_sample, lean, slices, small_batches

#: Bound on the labelled rows that the classifier is fitted on.
TRAIN_ROWS = 2000
#: Bytes of UTF-8 in a passage; a text's last passage may be shorter.
PASSAGE_BYTES = 512
THRESHOLD = 0.3
HIDDEN = 16
EPOCHS = 60
BATCH = 128

CLASSES = 13
#: Distances at which a repeated run of characters is looked for.
LAGS = range(2, 14)


def _byte_classes() -> np.ndarray:
    table = np.full(256, 12, np.uint8)  # bytes of characters outside ASCII
    groups = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "|",
              "*#$%&@^~_+=<>/\\`", "()[]{}", "'\"", "-")
    table[:128] = 11
    for k, group in enumerate(groups):
        table[list(group.encode())] = k
    return table


BYTE_CLASS = _byte_classes()
FEATURES = CLASSES + len(LAGS) + 4


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every whole text, and the text each belongs to.

    A passage's features are the shares of character classes, how often a character recurs at
    each lag, the shares of doubled marks and of words that repeat the word before, the mean
    word length and the passage's length. No feature looks past its text, so a text's passages
    are the same alone and in any batch. A text without characters has one passage of zeros.
    """
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) for b in blobs], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    lengths = np.full(int(counts.sum()), PASSAGE_BYTES, np.int64)
    lengths[first + counts - 1] = sizes - (counts - 1) * PASSAGE_BYTES
    out = np.zeros((len(lengths), FEATURES))
    buf = np.frombuffer(b"".join(blobs), np.uint8)
    if not len(buf):
        return out, owner
    where = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    kind = BYTE_CLASS[buf]
    size = np.maximum(lengths, 1)[:, None]
    out[:, :CLASSES] = np.bincount(where * CLASSES + kind, minlength=len(lengths) * CLASSES).reshape(-1, CLASSES) / size
    full = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[full]
    # bytes of the same text before each byte, counted up to the longest lag
    begun = np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.minimum(np.arange(len(buf)) - begun, max(LAGS)).astype(np.uint8)
    shared = np.empty(len(buf), np.uint8)
    for k, lag in enumerate(LAGS):
        shared[:] = 0
        if len(buf) > lag:
            np.equal(buf[lag:], buf[:-lag], out=shared[lag:].view(bool))
            shared &= before >= lag
        out[full, CLASSES + k] = np.add.reduceat(shared, starts, dtype=np.int32) / size[full, 0]
    mark = (kind >= 6) & (kind <= 9)
    twice = np.zeros(len(buf), np.uint8)
    twice[1:] = mark[1:] & (buf[1:] == buf[:-1]) & (before[1:] > 0)
    at = CLASSES + len(LAGS)
    out[full, at] = np.add.reduceat(twice, starts, dtype=np.int32) / size[full, 0]
    # words: runs of bytes that are no white space
    white = (kind == 3) | (kind == 4)
    begins = np.flatnonzero(~white & (np.r_[True, white[:-1]] | (before == 0)))
    if len(begins):
        ends = np.r_[begins[1:], len(buf)]
        place = np.zeros(len(buf), np.uint64)  # from 1 in each word
        place[begins[0] :] = np.arange(begins[0], len(buf)) - np.repeat(begins, ends - begins) + 1
        value = (buf.astype(np.uint64) + np.uint64(1)) * (place * place + np.uint64(0x9E3779B1))
        value[white] = 0
        word = np.add.reduceat(value, begins)
        holder = where[begins]
        again = np.zeros(len(begins), np.uint8)
        again[1:] = (word[1:] == word[:-1]) & (owner[holder[1:]] == owner[holder[:-1]])
        words = np.bincount(holder, minlength=len(lengths))
        out[:, at + 1] = np.bincount(holder, again, minlength=len(lengths)) / np.maximum(words, 1)
        ends = np.minimum(ends, np.cumsum(sizes)[owner[holder]])
        letters = np.bincount(holder, np.minimum(ends - begins, 40), minlength=len(lengths))
        out[:, at + 2] = letters / np.maximum(words, 1) / 10
    out[:, at + 3] = np.log1p(lengths) / math.log(PASSAGE_BYTES)
    return out, owner


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, texts: list[str]) -> np.ndarray:
        x, owner = passages(texts)
        return _sigmoid(forward(self.weights, (x - self.mean) / self.scale, owner, len(texts))["logit"])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def forward(w: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray, bags: int) -> dict[str, np.ndarray]:
    """Encode each passage, weigh it by gated attention within its text, score the weighted sum.

    ``owner`` ascends and every bag has a passage.
    """
    starts = np.searchsorted(owner, np.arange(bags))
    h = np.tanh(x @ w["encode"] + w["encode_bias"])
    a, g = np.tanh(h @ w["content"]), _sigmoid(h @ w["gate"])
    e = (a * g) @ w["attend"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
    share = e / np.add.reduceat(e, starts)[owner]
    z = np.add.reduceat(share[:, None] * h, starts, axis=0)
    return {"starts": starts, "h": h, "a": a, "g": g, "share": share, "z": z, "logit": z @ w["out"] + w["bias"][0]}


def gradients(
    w: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray
) -> dict[str, np.ndarray]:
    f = forward(w, x, owner, len(y))
    h, a, g, share = f["h"], f["a"], f["g"], f["share"]
    dl = (_sigmoid(f["logit"]) - y) * weight / len(y)
    dz = dl[:, None] * w["out"]
    to_h = dz[owner]
    da = (h * to_h).sum(1)
    de = share * (da - np.add.reduceat(share * da, f["starts"])[owner])
    through = de[:, None] * w["attend"]
    d_content, d_gate = through * g * (1 - a * a), through * a * g * (1 - g)
    dh = share[:, None] * to_h + d_content @ w["content"].T + d_gate @ w["gate"].T
    dpre = dh * (1 - h * h)
    return {
        "encode": x.T @ dpre,
        "encode_bias": dpre.sum(0),
        "content": h.T @ d_content,
        "gate": h.T @ d_gate,
        "attend": ((a * g) * de[:, None]).sum(0),
        "out": f["z"].T @ dl,
        "bias": np.array([dl.sum()]),
    }


def learn(rows: list[tuple[str, int]], seed: int = 7) -> Model:
    """Fit by Adam on whole texts; rows of one label only, or none, give a constant score."""
    rng = np.random.default_rng(seed)
    w = {
        "encode": rng.normal(0, 0.3, (FEATURES, HIDDEN)),
        "encode_bias": np.zeros(HIDDEN),
        "content": rng.normal(0, 0.3, (HIDDEN, HIDDEN)),
        "gate": rng.normal(0, 0.3, (HIDDEN, HIDDEN)),
        "attend": rng.normal(0, 0.3, HIDDEN),
        "out": rng.normal(0, 0.3, HIDDEN),
        "bias": np.zeros(1),
    }
    y = np.array([v for _, v in rows], float)
    if len(set(y.tolist())) < 2:
        w["out"][:] = 0
        w["bias"][0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return Model(np.zeros(FEATURES), np.ones(FEATURES), w)
    x, owner = passages([t for t, _ in rows])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    begins = np.searchsorted(owner, np.arange(len(rows) + 1))
    moment = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    step, steps = 0, EPOCHS * max(1, math.ceil(len(rows) / BATCH))
    epochs = max(EPOCHS, math.ceil(300 / max(1, math.ceil(len(rows) / BATCH)))) if steps < 300 else EPOCHS
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = np.sort(order[at : at + BATCH])
            index = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in pick])
            own = np.repeat(np.arange(len(pick)), begins[pick + 1] - begins[pick])
            grad = gradients(w, x[index], own, y[pick], np.ones(len(pick)))
            step += 1
            for k in w:
                g = grad[k] + 1e-4 * w[k]
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                w[k] -= 0.01 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """``learn`` on at most ``max_rows`` labelled rows that aren't held out."""
    model = learn(labelled_sample(docs, labels, "quality", max_rows))
    give_back()
    return model


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Score every whole text: id, held_out, score (0 to 1), predicted (score >= threshold).

    Defined cases: null and empty texts are one passage of zeros; repeated rows and ties are
    scored alike, up to the last bits of a sum; an empty table gives no rows; extra columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), held_out(docs[id_col]).alias("held_out"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            scores = np.round(model.score([t or "" for t in part.column(1).to_pylist()]), 9)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= threshold).astype(np.int32), pa.int32()),
                ],
                names=["id", "held_out", "score", "predicted"],
            )

    out = source.mapInArrow(lean(run), f"id {id_type}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, all columns, in one pass."""
    small_batches(docs.sparkSession)
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, place):
            scores = np.round(model.score([t or "" for t in part.column(place).to_pylist()]), 9)
            yield part.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)
