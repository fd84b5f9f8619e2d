"""Toxicity: Levenshtein automata met with a lexicon trie, and context windows around each hit."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, held_out, labelled_sample, lean, slices, small_batches

#: Bound on the labelled rows that the lexicon and the weights are learned from.
TRAIN_ROWS = 4000
#: Words to either side of a hit that make its context.
CONTEXT = 6
#: Words that a worker remembers as harmless; the memory this takes is fixed.
KNOWN_WORDS = 400_000

# Signs that a term is spoken about rather than spoken.
REPORTING = frozenset(
    "said says say called calls call calling wrote writes word words term terms insult insults slur slurs quote quotes "
    "quoted quoting cited citing meaning means definition defined translated sagte sagt wort zitat nannte dijo palabra "
    "insulto cita llamó dit mot insulte citation appelé".split()
)
OPENING, CLOSING, EITHER = "“«„‹", "”»›", "\"'‘’`"
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class Trie:
    """Lexicon entries: whole words, and stems that stand for every word that begins with them."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.reach: list[int] = [0]  # the most edits that any entry below allows
        for entry in words:
            self._add(entry, self.word, allowed_edits(entry))
        for entry in stems:
            self._add(entry, self.stem, 0)

    def _add(self, entry: str, kind: list[str | None], edits: int) -> None:
        node = 0
        for c in entry:
            self.reach[node] = max(self.reach[node], edits)
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.word.append(None)
                self.stem.append(None)
                self.reach.append(0)
            node = self.children[node][c]
        self.reach[node] = max(self.reach[node], edits)
        kind[node] = entry


def allowed_edits(entry: str) -> int:
    """Short words have too many neighbours; long ones may be two edits off."""
    return 0 if len(entry) < 5 else 1 if len(entry) < 9 else 2


class Matcher:
    """The Levenshtein automata of all entries, met with the trie and made deterministic as needed.

    A state is a set of (trie node, edits so far); a character takes it over a match, a
    substitution, an insertion, or a match after deletions. States are built once and kept.
    """

    MOST_STATES = 50_000

    def __init__(self, trie: Trie):
        self.trie = trie
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, found: set[tuple[int, int]]) -> int:
        trie, todo = self.trie, list(found)
        while todo:  # a missing character costs an edit and no input
            node, edits = todo.pop()
            for child in trie.children[node].values():
                if edits < trie.reach[child] and (child, edits + 1) not in found:
                    found.add((child, edits + 1))
                    todo.append((child, edits + 1))
        least: dict[int, int] = {}
        for node, edits in found:
            least[node] = min(edits, least.get(node, 99))
        key = frozenset(least.items())
        if key not in self.ids:
            self.ids[key] = len(self.states) if key else -1
            if key:
                self.states.append(key)
                self.steps.append({})
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        trie, out = self.trie, set()
        for node, edits in self.states[state]:
            if c in trie.children[node]:
                out.add((trie.children[node][c], edits))
            if edits < trie.reach[node]:
                out.add((node, edits + 1))
            for child in trie.children[node].values():
                if edits < trie.reach[child]:
                    out.add((child, edits + 1))
        nxt = self.steps[state][c] = self._state(out)
        return nxt

    def match(self, word: str) -> tuple[str, int] | None:
        """The entry nearest to ``word`` and its distance, or None."""
        if len(self.states) > self.MOST_STATES:
            self._reset()
        trie, state, stem = self.trie, self.start, None
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return (stem, 0) if stem else None
            for node, edits in self.states[state]:
                if edits == 0 and trie.stem[node]:
                    stem = trie.stem[node]
        hits = [
            (edits, trie.word[node])
            for node, edits in self.states[state]
            if trie.word[node] and edits <= allowed_edits(trie.word[node])
        ]
        if stem and not any(e == 0 for e, _ in hits):
            return stem, 0
        return min(hits)[::-1] if hits else None


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: Log-odds of a hit by entry and distance.
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    #: Bias, abusive hits, quoted hits.
    line: tuple[float, float, float] = (-3.0, 2.0, 0.5)


def tokens(text: str) -> list[str]:
    return text.lower().split()


def quotation(words: list[str], at: int) -> float:
    """How far the context speaks of quoting the word at ``at``: 0 (used) to 1 (mentioned)."""
    raw = words[at]
    before, after = words[max(0, at - CONTEXT) : at], words[at + 1 : at + 1 + CONTEXT]
    opened = any(w[:1] in EITHER + OPENING for w in [*before, raw] if w)
    bare = raw.rstrip(".,;:!?)")
    closed = any(w.rstrip(".,;:!?)")[-1:] in EITHER + CLOSING for w in [bare, *after] if w.rstrip(".,;:!?)"))
    reported = any(EDGE.sub("", w) in REPORTING for w in before)
    return min(1.0, 0.7 * (opened and closed) + 0.4 * reported)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.matcher = Matcher(Trie(model.words, model.stems))
        self.harmless: set[str] = set()

    def hits(self, text: str) -> list[tuple[str, int, float]]:
        """(entry, distance, quotation) of each hit in the whole text."""
        words = tokens(text)
        found: dict[str, tuple[str, int]] = {}
        for w in set(words) - self.harmless:
            hit = self.matcher.match(EDGE.sub("", w))
            if hit:
                found[w] = hit
            else:
                if len(self.harmless) >= KNOWN_WORDS:
                    self.harmless.clear()
                self.harmless.add(w)
        if not found:
            return []
        return [(*found[w], quotation(words, i)) for i, w in enumerate(words) if w in found]

    def evidence(self, text: str) -> tuple[float, float]:
        """Log-odds carried by terms in use and by terms in quotation, each entry counted once for either."""
        used: dict[str, float] = {}
        mentioned: dict[str, float] = {}
        for entry, distance, quoted in self.hits(text):
            weight = self.model.weights.get((entry, distance), 0.0)
            used[entry] = max(used.get(entry, 0.0), weight * (1 - quoted))
            mentioned[entry] = max(mentioned.get(entry, 0.0), weight * quoted)
        return math.log1p(sum(used.values())), math.log1p(sum(mentioned.values()))

    def score(self, text: str) -> float:
        a, b = self.evidence(text)
        bias, use, mention = self.model.line
        return 1 / (1 + math.exp(-(bias + use * a + mention * b)))


def _lift(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def learn(rows: list[tuple[str, int]]) -> Model:
    """Lexicon, weights and the final line from labelled texts.

    Near copies count once: of rows with one label and the same smallest hash over runs of
    three words only the first is used.
    """
    distinct: dict[tuple, tuple[str, int]] = {}
    for text, y in rows:
        w = tokens(text)
        runs = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
        distinct.setdefault((y, min(runs, key=_stable)), (text, y))
    rows = list(distinct.values())
    n = Counter(y for _, y in rows)
    if not n[1] or not n[0]:
        return Model(line=(_logit(n[1], n[0]), 0.0, 0.0))
    least = max(3, math.ceil(0.004 * n[1]))
    df: dict[int, Counter] = {0: Counter(), 1: Counter()}
    stem_df: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for side in (1, 0):
        for text, y in rows:
            if y != side:
                continue
            bare = {b for b in (EDGE.sub("", w) for w in set(tokens(text))) if len(b) >= 3 and b.isalpha()}
            stems_of = {b[:k] for b in bare for k in range(4, min(len(b), 10))}
            if side == 0:  # only what toxic texts have often is counted in the others
                bare, stems_of = bare & often, stems_of & often_stems
            df[side].update(bare)
            stem_df[side].update(stems_of)
        if side:
            often = {w for w, c in df[1].items() if c >= least}
            often_stems = {s for s, c in stem_df[1].items() if c >= least}
    share = n[1] / (n[0] + n[1])

    def keep(counts: dict[int, Counter], entry: str) -> bool:
        """Far likelier in toxic texts, and no accident among as many candidates as there are."""
        a, b = counts[1][entry], counts[0][entry]
        if a < least or a / n[1] < 20 * (b / n[0]) or a < 4 * b:
            return False
        return a > 60 or _tail(a, a + b, share) <= 0.01 / len(counts[1])

    words = {w: _lift(df[1][w], df[0][w], n[1], n[0]) for w in df[1] if keep(df, w)}
    extends: dict[str, set[str]] = defaultdict(set)
    for w in df[1]:
        for k in range(4, min(len(w), 10)):
            extends[w[:k]].add(w)
    good = {s for s in stem_df[1] if keep(stem_df, s) and len(extends[s]) >= 3}
    stems: dict[str, float] = {}
    for s in sorted(good, key=lambda s: (len(s), s)):
        if any(s.startswith(t) or t.startswith(s) for t in stems):
            continue
        while longer := [t for t in good if t[:-1] == s and stem_df[1][t] >= 0.95 * stem_df[1][s]]:
            s = longer[0]  # the longest stem that explains as much
        stems[s] = _lift(stem_df[1][s], stem_df[0][s], n[1], n[0])
    model = Model(words, stems)
    scorer = Scorer(model)
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    found = [(scorer.hits(text), y) for text, y in rows]
    for hits, y in found:
        seen[y].update({(e, d) for e, d, _ in hits})
    for entry in {**words, **stems}:
        own = _lift(seen[1][entry, 0], seen[0][entry, 0], n[1], n[0])
        model.weights[entry, 0] = max(0.0, own)
        for d in range(1, allowed_edits(entry) + 1):
            a, b = seen[1][entry, d], seen[0][entry, d]
            # without evidence a misspelling is worth half the term; with it, what it has shown
            model.weights[entry, d] = max(0.0, _lift(a, b, n[1], n[0]) if a + b else own / 2)
    x = np.array([scorer.evidence(text) for text, _ in rows])
    y = np.array([y for _, y in rows], float)
    model.line = _fit_line(x, y)
    return model


def _stable(run: str) -> int:
    return zlib.crc32(run.encode("utf-8", "surrogatepass"))


def _tail(a: int, n: int, share: float) -> float:
    """Chance of ``a`` or more of ``n`` draws at ``share`` each."""
    return sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(a, n + 1))


def _logit(a: float, b: float) -> float:
    return math.log((a + 0.5) / (b + 0.5))


def _fit_line(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, float, float]:
    """Logistic regression; the coefficient of quoted hits is held near a quarter of the other's,
    because few labelled texts quote."""
    w = np.array([_logit(y.sum(), len(y) - y.sum()), 1.0, 0.25])
    moment, scale = np.zeros(3), np.zeros(3)
    design = np.column_stack([np.ones(len(x)), x])
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-design @ w))
        grad = design.T @ (p - y) / len(y) + np.array([0, 1e-3 * w[1], 0.05 * (w[2] - 0.25 * w[1])])
        moment = 0.9 * moment + 0.1 * grad
        scale = 0.999 * scale + 0.001 * grad**2
        w -= 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.999**step)) + 1e-9)
        w[1:] = np.maximum(w[1:], 0)
    return float(w[0]), float(w[1]), float(w[2])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """``learn`` on at most ``max_rows`` labelled rows that aren't held out."""
    model = learn(labelled_sample(docs, labels, "toxic", max_rows))
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: id, held_out, score (0 to 1), predicted (score >= 0.5), n_hits.

    Defined cases: null and empty texts have no hit and get the score of a text without hits;
    repeated rows and ties are scored alike; an empty table gives no rows; extra columns are
    ignored. A model learned from rows of one label only, or none, gives each text one score.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), held_out(docs[id_col]).alias("held_out"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(model)
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scores = [own.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                ],
                names=["id", "held_out", "score", "predicted"],
            )

    out = source.mapInArrow(lean(run), f"id {id_type}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
