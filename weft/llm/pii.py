"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind

#: Bound on the texts that the model is trained on, and on the windows made of them.
TRAIN_TEXTS = 400
TRAIN_WINDOWS = 1600
WINDOW, STRIDE = 96, 48
EMBED, HIDDEN = 10, 16
EPOCHS, BATCH = 6, 64
DECODE_WINDOWS = 512

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a digit run is entered at its start only: no match begins within one
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: A span that the model adds holds one of these, so a window without any decodes to no span.
TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(number: list[int]) -> bool:
    doubled = [2 * d - 9 if d > 4 else 2 * d for d in number[-2::-2]]
    return (sum(number[-1::-2]) + sum(doubled)) % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in re.findall("[0-9]+", text))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping within a kind, by start and kind."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                last = m.end()
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m[0])]
        out += [
            (m.start(), 2, m.end())
            for m in CARD.finditer(text)
            if m.end() - m.start() >= 12 and 12 <= len(d := digits(m[0])) <= 19 and luhn(d)
        ]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


# --- characters and training windows

CHARS = 100


def _character_table() -> np.ndarray:
    table = np.full(0x250, 97, np.int64)  # letters of Latin scripts outside ASCII
    table[:128] = 98
    table[32:127] = np.arange(1, 96)
    table[[9, 10, 11, 12, 13]] = 96
    return table


CHARACTER = _character_table()


def character_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(CHARACTER), CHARACTER[np.minimum(points, len(CHARACTER) - 1)], 99)


def _luhn_number(rng: random.Random, n: int) -> list[int]:
    body = [rng.randint(1, 9), *(rng.randint(0, 9) for _ in range(n - 2))]
    return body + [next(d for d in range(10) if luhn([*body, d]))]


def _example(rng: random.Random) -> tuple[str, int]:
    """A made-up item and the kind that labels it, or -1 for something that is no personal data."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    kind = rng.randrange(-3, len(KINDS))
    if kind == 0:
        user = word(2, 8) + rng.choice(["", "." + word(2, 6), number(2), "_" + word(1, 4), "-" + number(1)])
        host = word(3, 9) + rng.choice(["", number(1)]) + "." + rng.choice(["com", "org", "net", "de", "example.com"])
        at, dot = rng.choice([("@", "."), ("@", "."), (" [at] ", "."), ("(at)", "."), ("[at]", "[dot]"), (" @ ", ".")])
        return user + at + host.replace(".", dot), 0
    if kind == 1:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice([".", ".", ".", "[.]", " . "]).join(parts), 1
    if kind == 2:
        d = "".join(map(str, _luhn_number(rng, rng.choice([15, 16, 16, 16]))))
        gap = rng.choice(["", "", " ", "-", ".", "/", "  "])
        return gap.join(d[i : i + 4] for i in range(0, len(d), 4)), 2
    if kind == 3:
        a, b, c = number(3), number(3), number(4)
        return rng.choice(
            [f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}",
             f"+{rng.randint(1, 99)}{a}{b}{c}", f"00{rng.randint(1, 99)} {a} {b}{c}", f"+1.{a}.{b}.{c}"]
        ), 3
    return rng.choice(
        [number(rng.randint(1, 9)), f"{rng.randint(1900, 2100)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
         f"{number(1)}.{number(1)}.{number(2)}", f"{number(3)},{number(3)}", f"${number(3)}.{number(2)}",
         "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 16, 32, 40]))),
         f"token = \"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\"", f"@{word(3, 8)}",
         f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{number(2)}:{number(2)}:{number(2)}",
         f"https://{word(3, 8)}.com/{number(4)}", f"{number(3)}-{number(2)}", f"({number(2)})"]
    ), -1


def training_windows(texts: list[str], seed: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: those around base spans of the texts, and texts with made-up items put in."""
    rng = random.Random(seed)
    xs, ys = [], []

    def add(text: str, spans: list[Span], centre: int) -> None:
        start = max(0, min(centre - rng.randrange(WINDOW), len(text) - WINDOW))
        tags = np.zeros(len(text), np.int64)
        for a, kind, b in spans:
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
        x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        piece = character_ids(text[start : start + WINDOW])
        x[: len(piece)] = piece
        y[: len(piece)] = tags[start : start + WINDOW]
        xs.append(x)
        ys.append(y)

    for text in texts:
        spans = base_spans(text)
        for a, _, _ in spans[:4]:
            if len(xs) < count // 4:
                add(text, spans, a)
    plain = [t for t in texts if t] or ["lorem ipsum dolor sit amet, consectetur. "]
    while len(xs) < count:
        text = rng.choice(plain)
        at = rng.randrange(len(text))
        left, right = text[max(0, at - WINDOW) : at], text[at : at + WINDOW]
        item, kind = _example(rng)
        border = rng.choice([" ", " ", " ", "\n", ""] if kind == 0 and "@" in item else [" ", " ", " ", "\n"])
        left += border
        whole = left + item + rng.choice([" ", " ", ".", ", ", "\n", ""]) + right
        span = (len(left), kind, len(left) + len(item))
        found = base_spans(whole)
        if kind >= 0 and not any(s < span[2] and span[0] < e for s, _, e in found):
            found.append(span)
        add(whole, found, len(left))
    return np.array(xs), np.array(ys)


# --- the network


@dataclass
class Model:
    """Weights; the first axis of the LSTM's is the direction."""

    weights: dict[str, np.ndarray]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window."""
        emissions, _ = forward(self.weights, x)
        return viterbi(emissions, self.weights["step"], self.weights["begin"])


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *s, by: rng.normal(0, by, s).astype(np.float32)
    bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
    bias[:, :, HIDDEN : 2 * HIDDEN] = 1
    return {
        "embed": f(CHARS, EMBED, by=0.5),
        "input": f(2, EMBED, 4 * HIDDEN, by=0.3),
        "recur": f(2, HIDDEN, 4 * HIDDEN, by=0.25),
        "bias": bias,
        "out": f(2 * HIDDEN, TAGS, by=0.3),
        "out_bias": np.zeros(TAGS, np.float32),
        "step": f(TAGS, TAGS, by=0.1),
        "begin": np.zeros(TAGS, np.float32),
    }


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * v) + 0.5


def forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, dict]:
    """Emission scores (window, place, tag), and what the backward pass needs."""
    n, t = x.shape
    e = w["embed"][x]
    both = np.stack([e, e[:, ::-1]])
    gates_in = both.reshape(2, n * t, EMBED) @ w["input"] + w["bias"]
    gates_in = gates_in.reshape(2, n, t, 4 * HIDDEN).transpose(2, 0, 1, 3)
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    hs, cs, gs = [], [], []
    for k in range(t):
        z = gates_in[k] + h @ w["recur"]
        g = np.empty_like(z)
        g[..., : 3 * HIDDEN] = _sigmoid(z[..., : 3 * HIDDEN])
        g[..., 3 * HIDDEN :] = np.tanh(z[..., 3 * HIDDEN :])
        c = g[..., HIDDEN : 2 * HIDDEN] * c + g[..., :HIDDEN] * g[..., 3 * HIDDEN :]
        h = g[..., 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c)
        hs.append(h)
        cs.append(c)
        gs.append(g)
    hidden = np.stack(hs, 2)  # direction, window, place, unit
    top = np.concatenate([hidden[0], hidden[1][:, ::-1]], -1)
    return top @ w["out"] + w["out_bias"], {"both": both, "hidden": hidden, "cs": cs, "gs": gs, "top": top}


def backward(w: dict[str, np.ndarray], x: np.ndarray, kept: dict, d: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of all weights below the emissions, by backpropagation through time."""
    n, t = x.shape
    top, hidden = kept["top"], kept["hidden"]
    grad = {"out": top.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, TAGS), "out_bias": d.sum((0, 1))}
    d_top = d @ w["out"].T
    d_hidden = np.stack([d_top[..., :HIDDEN], d_top[..., HIDDEN:][:, ::-1]])
    dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    recur_t = w["recur"].transpose(0, 2, 1)
    dz_all = np.empty((t, 2, n, 4 * HIDDEN), np.float32)
    for k in range(t - 1, -1, -1):
        g, c = kept["gs"][k], kept["cs"][k]
        before = kept["cs"][k - 1] if k else np.zeros_like(c)
        i, f, o, u = (g[..., j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
        tc = np.tanh(c)
        dh = dh + d_hidden[:, :, k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[k]
        dz[..., :HIDDEN] = dc * u * i * (1 - i)
        dz[..., HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
        dz[..., 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
        dz[..., 3 * HIDDEN :] = dc * i * (1 - u * u)
        dc = dc * f
        dh = dz @ recur_t
    dz_all = dz_all.transpose(1, 2, 0, 3)  # direction, window, place, gate
    flat = dz_all.reshape(2, n * t, 4 * HIDDEN)
    earlier = np.zeros_like(hidden)
    earlier[:, :, 1:] = hidden[:, :, :-1]
    grad["recur"] = earlier.reshape(2, n * t, HIDDEN).transpose(0, 2, 1) @ flat
    grad["input"] = kept["both"].reshape(2, n * t, EMBED).transpose(0, 2, 1) @ flat
    grad["bias"] = flat.sum(1, keepdims=True)
    d_both = (flat @ w["input"].transpose(0, 2, 1)).reshape(2, n, t, EMBED)
    grad["embed"] = np.zeros_like(w["embed"])
    np.add.at(grad["embed"], x, d_both[0] + d_both[1][:, ::-1])
    return grad


def _log_sum(v: np.ndarray, axis: int) -> np.ndarray:
    top = v.max(axis, keepdims=True)
    return np.log(np.exp(v - top).sum(axis)) + top.squeeze(axis)


def crf(emissions: np.ndarray, step: np.ndarray, begin: np.ndarray, y: np.ndarray):
    """Mean negative log-likelihood of the tags, and its gradients, by forward and backward sums."""
    n, t, _ = emissions.shape
    ahead, back = np.empty_like(emissions), np.zeros_like(emissions)
    ahead[:, 0] = begin + emissions[:, 0]
    for k in range(1, t):
        ahead[:, k] = emissions[:, k] + _log_sum(ahead[:, k - 1, :, None] + step, 1)
    for k in range(t - 2, -1, -1):
        back[:, k] = _log_sum(step + (emissions[:, k + 1] + back[:, k + 1])[:, None, :], 2)
    total = _log_sum(ahead[:, -1], 1)
    rows, places = np.arange(n)[:, None], np.arange(t)
    gold = emissions[rows, places, y].sum(1) + begin[y[:, 0]] + step[y[:, :-1], y[:, 1:]].sum(1)
    d_emissions = np.exp(ahead + back - total[:, None, None])
    d_begin = d_emissions[:, 0].sum(0)
    d_emissions[rows, places, y] -= 1
    pair = ahead[:, :-1, :, None] + step + (emissions[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
    d_step = np.exp(pair).sum((0, 1))
    np.add.at(d_step, (y[:, :-1], y[:, 1:]), -1)
    np.add.at(d_begin, y[:, 0], -1)
    return float((total - gold).mean()), d_emissions / n, d_step / n, d_begin / n


def viterbi(emissions: np.ndarray, step: np.ndarray, begin: np.ndarray) -> np.ndarray:
    n, t, _ = emissions.shape
    best, came = begin + emissions[:, 0], np.empty((n, t, TAGS), np.int8)
    for k in range(1, t):
        every = best[:, :, None] + step
        came[:, k] = every.argmax(1)
        best = every.max(1) + emissions[:, k]
    tags = np.empty((n, t), np.int8)
    tags[:, -1] = best.argmax(1)
    for k in range(t - 1, 0, -1):
        tags[:, k - 1] = came[np.arange(n), k, tags[:, k]]
    return tags


def learn(texts: list[str], windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS, seed: int = 11) -> Model:
    x, y = training_windows(texts, seed, windows)
    w = initial(seed)
    rng = np.random.default_rng(seed)
    moment = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    step, steps = 0, epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            pick = order[at : at + BATCH]
            emissions, kept = forward(w, x[pick])
            _, d, d_step, d_begin = crf(emissions, w["step"], w["begin"], y[pick])
            grad = backward(w, x[pick], kept, d) | {"step": d_step, "begin": d_begin}
            norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
            shrink = min(1.0, 5.0 / (norm + 1e-9))
            step += 1
            rate = 0.02 * (1 - 0.9 * step / steps)
            for k in w:
                g = grad[k] * shrink
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                w[k] = (w[k] - rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(w)


def train(docs: DataFrame, max_texts: int = TRAIN_TEXTS, text_col: str = "text") -> Model:
    """``learn`` on at most ``max_texts`` texts that have digits or an at sign, and on made-up items.

    Texts are taken by the smallest hash of the whole text.
    """
    text = F.col(text_col)
    hashed = docs.where(text.rlike("[0-9@]")).select(F.xxhash64(text).alias("h"), text.alias("t"))
    chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(max_texts).collect()]
    if not chosen:
        return learn([])
    # hashes first: ordering the texts themselves would send the driver so many from every task
    rows = hashed.where(F.col("h") <= chosen[-1]).groupBy("h").agg(F.first("t").alias("t")).orderBy("h").collect()
    model = learn([r["t"] for r in rows])
    give_back()
    return model


# --- decoding whole texts


def needed_windows(text: str) -> list[int]:
    """Numbers of the windows that hold a trigger; window k begins at k * STRIDE."""
    out: set[int] = set()
    for m in TRIGGER.finditer(text):
        out.update((m.start() // STRIDE, max(0, m.start() // STRIDE - 1)))
    return sorted(out)


def reconcile(found: list[Span]) -> list[Span]:
    """One set of spans from those of overlapping windows: overlapping pieces of a kind are joined,
    and where kinds contend the longer span stays, then the earlier."""
    joined: list[Span] = []
    for kind in range(len(KINDS)):
        for start, _, end in sorted(s for s in found if s[1] == kind):
            if joined and joined[-1][1] == kind and start < joined[-1][2]:
                joined[-1] = (joined[-1][0], kind, max(end, joined[-1][2]))
            else:
                joined.append((start, kind, end))
    kept: list[Span] = []
    for s in sorted(joined, key=lambda s: (s[0] - s[2], s)):
        if not any(s[0] < k[2] and k[0] < s[2] for k in kept):
            kept.append(s)
    return sorted(kept)


def plausible(kind: int, text: str) -> bool:
    """What a span that the model adds must satisfy, as the base patterns ask of theirs."""
    d = digits(text)
    if kind == 0:
        return bool(re.search(r"\w\s?(@|[\[(]at[\])])\s?\w", text, re.I) and re.search(r"\.\w|[\[(]dot[\])]", text, re.I))
    if kind == 1:
        return len(re.findall("[0-9]+", text)) == 4 and is_ip(text)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and bool(re.search(r"[0-9][ ().-]+[0-9]", text))


def spans_of_tags(tags: np.ndarray, offset: int, limit: int) -> list[Span]:
    out, k = [], 0
    while k < len(tags):
        if tags[k] == 0:
            k += 1
            continue
        kind, start = (int(tags[k]) - 1) // 2, k
        k += 1
        while k < len(tags) and tags[k] == 2 + 2 * kind:
            k += 1
        if offset + start < limit:
            out.append((offset + start, kind, min(offset + k, limit)))
    return out


def find(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each whole text."""
    base = [base_spans(t) for t in texts]
    jobs: list[tuple[int, int]] = []
    ids: dict[int, np.ndarray] = {}
    for i, t in enumerate(texts):
        windows = needed_windows(t)
        if windows:
            ids[i] = np.r_[character_ids(t), np.zeros(WINDOW, np.int64)]
            jobs += [(i, k) for k in windows]
    found: dict[int, list[Span]] = {}
    for at in range(0, len(jobs), DECODE_WINDOWS):
        some = jobs[at : at + DECODE_WINDOWS]
        tags = model.decode(np.stack([ids[i][k * STRIDE : k * STRIDE + WINDOW] for i, k in some]))
        for (i, k), row in zip(some, tags, strict=True):
            if row.any():
                found.setdefault(i, []).extend(spans_of_tags(row, k * STRIDE, len(texts[i])))
    out = []
    for i, t in enumerate(texts):
        added = []
        for start, kind, end in reconcile(found.get(i, [])):
            while start < end and t[start] in " \n\t,;:\"'":
                start += 1
            while end > start and t[end - 1] in " \n\t,;:.\"'-([":
                end -= 1
            clear = not any(start < e and s < end for s, _, e in base[i])
            edges = (start == 0 or not t[start - 1].isdigit()) and (end == len(t) or not t[end].isdigit())
            if end > start and clear and edges and TRIGGER.search(t, start, end) and plausible(kind, t[start:end]):
                added.append((start, kind, end))
        out.append((base[i], sorted(base[i] + added)))
    return out


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find personal data in every whole text.

    One row per input row: id, n_email, n_ip, n_card, n_phone (base spans), base_spans and spans
    (base and added) as kind:start:end in code points, base_sha256, n_added.

    Defined cases: null and empty texts have no spans; windows cover texts of any length;
    repeated rows and ties are treated alike; an empty table gives no rows; extra columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            results = find([t or "" for t in part.column(1).to_pylist()], model)
            base = [written(b) for b, _ in results]
            columns = [part.column(0)]
            for k in range(len(KINDS)):
                columns.append(pa.array([sum(s[1] == k for s in b) for b, _ in results], pa.int64()))
            columns += [
                pa.array(base, pa.string()),
                pa.array([written(a) for _, a in results], pa.string()),
                pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                pa.array([len(a) - len(b) for b, a in results], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *counts, "base_spans", "spans", "base_sha256", "n_added"])

    schema = f"id {id_type}, {', '.join(f'{c} long' for c in counts)}, base_spans string, spans string, base_sha256 string, n_added long"
    return source.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)
