"""Benchmark decontamination: BM25 over test items, block-max WAND, then a check of both parts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, lean, row_key, slices, small_batches

K1, B = 1.2, 0.75
#: A passage is retrieved for an item when its score reaches this share of the item's own score.
MIN_SCORE = 0.5
#: Shares of the question's and of the answer's word runs that the passage must hold.
MIN_OVERLAP = 0.5
RUN = 3
BLOCK = 16
#: Characters of test items in one index; more items are taken in several rounds over the texts.
INDEX_CHARS = 2_000_000
#: Columns of the table of block maxima that passages are held against first.
BLOCKS = 64

_SPACED = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_ANSWER = re.compile(r"(?<=\?)\s+|\b(?:answer|antwort|respuesta|réponse|a)\s*:\s*", re.I)


def words(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of question and answer. Without a question mark or an answer label an item's first
    half counts as the question."""
    m = next((m for m in _ANSWER.finditer(text) if words(text[: m.start()]) and words(text[m.end() :])), None)
    if m:
        return words(text[: m.start()]), words(text[m.end() :])
    w = words(text)
    return w[: len(w) // 2], w[len(w) // 2 :]


def runs(w: list[bytes], n: int = RUN) -> set[bytes]:
    n = max(1, min(n, len(w)))
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


class Totals:
    """Number of items, words and longest item, and each word's number of items, over all test items."""

    def __init__(self):
        self.items, self.words, self.longest, self.df = 0, 0, 0, Counter()

    def add(self, texts: list[str]) -> Totals:
        for t in texts:
            q, a = parts(t or "")
            if q or a:
                self.items += 1
                self.words += len(q) + len(a)
                self.longest = max(self.longest, len(q) + len(a))
                self.df.update(set(q + a))
        return self


class Index:
    """Inverted index of test items with impacts as shares of each item's own score, in blocks.

    ``totals`` are those of all items where ``items`` are only some of them.
    """

    def __init__(self, items: list[tuple[int | None, str]], totals: Totals | None = None):
        totals = totals or Totals().add([t for _, t in items])
        split = [(i, parts(t or "")) for i, t in items]
        split = [(i, qa) for i, qa in split if qa[0] or qa[1]]
        self.items = [i for i, _ in split]
        self.questions = [runs(q) if q else set() for _, (q, _) in split]
        self.answers = [runs(a) if a else set() for _, (_, a) in split]
        self.run_sizes = [(min(RUN, len(q)) or 1, min(RUN, len(a)) or 1) for _, (q, a) in split]
        bags = [Counter(q + a) for _, (q, a) in split]
        lengths = [sum(b.values()) for b in bags]
        self.longest = totals.longest or 1
        mean = totals.words / max(1, totals.items)
        df = dict.fromkeys(w for b in bags for w in b)
        idf = {w: math.log(1 + (totals.items - (n := totals.df[w]) + 0.5) / (n + 0.5)) for w in df}
        self.terms = {w: i for i, w in enumerate(df)}
        lists: list[list[tuple[int, float]]] = [[] for _ in df]
        for item, (bag, n) in enumerate(zip(bags, lengths, strict=True)):
            raw = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean)) for w, f in bag.items()}
            own = sum(raw.values())
            for w, impact in raw.items():
                lists[self.terms[w]].append((item, impact / own))
        self.lists = lists
        self.best = np.array([max(x for _, x in p) for p in lists] + [0.0])  # the last: no term
        self.wide = np.zeros((len(lists) + 1, BLOCKS), np.float32)
        per = max(1, -(-len(split) // BLOCKS))
        for t, p in enumerate(lists):
            for item, x in p:
                self.wide[t, item // per] = max(self.wide[t, item // per], x)
        self.block_ends = [[p[min(i + BLOCK, len(p)) - 1][0] for i in range(0, len(p), BLOCK)] for p in lists]
        self.block_best = [[max(x for _, x in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in lists]

    def above(self, terms: list[int], bar: float) -> list[tuple[int, float]]:
        """All items whose score for a passage with these distinct terms is at least ``bar``: block-max WAND.

        Cursors are kept by their item. The pivot is the first at which the sum of list maxima
        reaches the bar; if the maxima of the blocks there don't, the cursors jump past the nearest
        block end without scoring anything.
        """
        cursors = [[self.lists[t][0][0], t, 0] for t in terms]
        out = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, None
            for at, (_, t, _) in enumerate(cursors):
                total += self.best[t]
                if total >= bar - 1e-12:
                    pivot = at
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            if cursors[0][0] < item:
                bound, nearest = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
                for _, t, p in cursors[: pivot + 1]:
                    b = p // BLOCK
                    while b < len(self.block_ends[t]) and self.block_ends[t][b] < item:
                        b += 1
                    if b < len(self.block_ends[t]):
                        bound += self.block_best[t][b]
                        nearest = min(nearest, self.block_ends[t][b] + 1)
                goal = item if bound >= bar - 1e-12 else max(item + 1, nearest)
                cursors = self._forward(cursors, goal, pivot)
                continue
            score = sum(self.lists[t][p][1] for i, t, p in cursors if i == item)
            if score >= bar - 1e-12:
                out.append((item, score))
            cursors = self._forward(cursors, item + 1, pivot)
        return out

    def _forward(self, cursors: list[list], goal: float, pivot: int) -> list[list]:
        left = []
        for at, (item, t, p) in enumerate(cursors):
            if at <= pivot and item < goal:
                entries, ends = self.lists[t], self.block_ends[t]
                b = p // BLOCK
                while b < len(ends) and ends[b] < goal:
                    b += 1
                p = max(p, b * BLOCK)
                while p < len(entries) and entries[p][0] < goal:
                    p += 1
                if p >= len(entries):
                    continue
                item = entries[p][0]
            left.append([item, t, p])
        return left

    def _passages(self, halves: np.ndarray, none: int) -> Iterator[int]:
        """Numbers of the passages, two halves each, that some block of items may answer: the sum over
        distinct words of the block's largest impacts reaches the bar."""
        last = len(halves) - 1
        for at in range(0, max(1, last) if len(halves) else 0, 256):
            some = halves[at : at + 257]
            rows = np.sort(np.hstack([some[:-1], some[1:]]) if last else some, axis=1)
            rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none
            bound = np.array([self.wide[r[r < none]].sum(0).max(initial=0.0) for r in rows])
            yield from (at + np.flatnonzero(bound >= MIN_SCORE - 1e-4)).tolist()

    def search(self, text: str) -> dict[int, tuple[float, float, float, int]]:
        """Verified items of a whole text: score, question's and answer's overlap, passages that hold it."""
        w = words(text)
        get, none = self.terms.get, len(self.best) - 1
        ids = np.fromiter((get(x, none) for x in w), np.int64, len(w))
        stride = max(32, self.longest)
        count = -(-len(w) // stride)
        padded = np.full(count * stride, none, np.int64)
        padded[: len(w)] = ids
        found: dict[int, tuple[float, float, float, int]] = {}
        for k in self._passages(padded.reshape(count, stride), none):
            a, b = k * stride, min(len(w), (k + 2) * stride)
            terms = [int(t) for t in np.unique(ids[a:b]) if t != none]
            seen: dict[int, set[bytes]] = {}
            for item, score in self.above(terms, MIN_SCORE):
                shares = []
                for want, n in zip((self.questions[item], self.answers[item]), self.run_sizes[item], strict=True):
                    if n not in seen:
                        seen[n] = runs(w[a:b], n)
                    shares.append(len(want & seen[n]) / len(want) if want else 1.0)
                if min(shares) >= MIN_OVERLAP:
                    old = found.get(item, (0.0, 0.0, 0.0, 0))
                    found[item] = (max(old[0], score), max(old[1], shares[0]), max(old[2], shares[1]), old[3] + 1)
        return found


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[Index]:
    """Indexes of at most about INDEX_CHARS characters each; together they hold every item.

    Counts, lengths and document frequencies are those of the whole benchmark in each of them.
    """
    items = benchmark.select(F.col(item_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    rounds = max(1, math.ceil(chars / INDEX_CHARS))

    def part(r: int) -> list[tuple[int | None, str]]:
        own = items.where(F.pmod(F.xxhash64("t"), F.lit(rounds)) == r) if rounds > 1 else items
        return sorted(((x["i"], x["t"]) for x in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))

    totals = Totals()
    if rounds == 1:
        whole = part(0)
        return [Index(whole, totals.add([t for _, t in whole]))]
    for r in range(rounds):
        totals.add([t for _, t in part(r)])
    return [Index(part(r), totals) for r in range(rounds)]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of a text and a test item that it contains.

    Every whole text is cut into overlapping passages, twice as long as the longest item and
    beginning every such length, so an item lies whole in one of them. Each passage queries the
    index; what is retrieved must hold at least MIN_OVERLAP of the word runs of the question and
    of the answer. Columns: id, item_id, score, question_overlap, answer_overlap, n_passages.

    Defined cases: null and empty texts and items match nothing; rows and items without an
    id are searched and keep the null; repeated rows each give their matches, repeated items are items of their
    own; an empty benchmark or table gives no rows; extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, item_id long, score double, question_overlap double, answer_overlap double, n_passages long"
    names = [part.split()[0] for part in schema.split(", ")]
    arrow_id = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]

    def searcher(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                out = []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if text:
                        out += [(i, index.items[item], *v) for item, v in sorted(index.search(text).items())]
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                types = [arrow_id, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        return run

    out = None
    for index in indexes(benchmark):
        one = source.mapInArrow(lean(searcher(index)), schema)
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without texts that contain a test item; all columns stay. Rows are told apart by id and text."""
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return drop_rows(docs, matches(keyed, benchmark, "key", "text").select("key"), id_col, text_col)
