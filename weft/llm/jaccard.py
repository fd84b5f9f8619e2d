"""N-gram Jaccard join that uses relations between sets.

Texts become sets of hashed word shingles; equal sets are one node. Links of Jaccard similarity at
least num/den are found exactly (up to collisions of 64-bit hashes) by prefix filtering in a global
order, with two savings from set relations:

* index lists are skipped by position: the entries of a list lie in blocks by component and size,
  each with the best position in it, and a pair of blocks that cannot hold a link is skipped whole;
* answers are derived: a set near a leader is known as the leader and a difference. What the leader
  has in common with another set gives what the member has, by adding and taking away the few
  shingles of the difference; whole sets are read for leaders alone.

The steps: (1) sets that share a minimum hash form families; in each, every set is held against a
few leaders, which is linear in the family, and large families are dealt out in parts whose leaders
meet on the next level. (2) Verified links give stars (a leader and its members) and components.
(3) The lists leave pairs of stars of two components that may hold a link; leaders are compared.
(4) For pairs of stars that may link though their leaders don't, members' answers are derived.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_rows, durable, lean, release, row_key, slices, small_batches
from .components import components

#: Shingles put last in the order because many sets hold them: at most so many, 8 bytes each.
#: Others may be frequent too; that costs time, not links.
HEAVY_SHINGLES = 250_000
HEAVY_LEAST = 8
#: Minimum hashes of a set, each naming a family.
KEYS = 6
#: Sets of a family that meet in one place; a larger family is dealt out, and the leaders of its parts meet next.
FAMILY_SETS = 512
#: Leaders sought in a part of a family, each near the middle of what is left.
STAR_ROUNDS = 6
#: Entries of an index list that meet in one place; the parts of a longer list meet pair by pair.
LIST_ENTRIES = 8192
#: Members of either star that meet in one place.
STAR_PART = 256
#: Bits of the filter that keeps rows from being sent which no pair needs.
NEED_BITS = 1 << 22
BLOCK = 32

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWER = _U(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> _U(27))) * _U(0x94D049BB133111EB)
    return v ^ (v >> _U(31))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``k`` words, A-Z lower-cased.

    Words are runs of anything but space and the controls 9 to 13. A text with fewer words is one
    shingle, one without words has none.
    """
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(blobs).lower() + b"\n"
    buf = np.frombuffer(data, np.uint8)
    white = _WHITE[buf]
    begins = np.flatnonzero(~white & np.r_[True, white[:-1]])
    empty = np.zeros(0, np.uint64)
    if not len(begins):
        return [empty] * len(texts)
    ends = np.flatnonzero(~white & np.r_[white[1:], True]) + 1
    sizes = ends - begins
    code = _BYTE[buf]
    code[white] = 0
    powers = np.full(int(sizes.max()), _POWER, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    offset = np.zeros(len(buf), np.int64)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    offset[np.flatnonzero(~white)] = inner
    words = _mix(np.add.reduceat(code * powers[offset], begins) + sizes.astype(np.uint64))
    edges = np.searchsorted(begins, np.cumsum([0, *(len(b) + 1 for b in blobs)]))
    runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k if len(runs) else 0):
        runs += _mix(words[j : j + len(runs)] * _PLACE[j])
    runs = _mix(runs)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            short = _mix((words[a:b] * _PLACE[: b - a]) + _U(b - a)).sum(dtype=np.uint64)
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(empty)
    return out


def prefix_length(n: int, num: int, den: int) -> int:
    """Two sets that link share one of the first so many of their elements in any common order."""
    return n - -(-num * n // den) + 1


def bitmap_bits(n: int) -> int:
    return max(256, 1 << int(2 * n - 1).bit_length())


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the elements that fall on each bit. Sets that differ in d elements have bitmaps
    that differ in at most d bits; folding one in half gives the bitmap of half the bits."""
    bits = bitmap_bits(len(s))
    ones = np.bincount((_mix(s ^ _U(0xA5A5)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def set_node(s: np.ndarray) -> int:
    """The number of a set: equal sets have one number."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(part: pa.RecordBatch, column: int) -> list[str]:
    return [t or "" for t in part.column(column).to_pylist()]


def heavy_shingles(docs: DataFrame, k: int, most: int = HEAVY_SHINGLES) -> np.ndarray:
    """Frequent shingles, sorted; at most ``most``. Each task sends what it has seen often."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= HEAVY_LEAST
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["shingle", "n"]
            )

        for part in slices(rows, 0):
            for s in shingle_sets(_texts(part, 0), k):
                held.append(s)
                size += len(s)
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    found = (
        docs.select("text")
        .mapInArrow(lean(run), "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "shingle")
        .limit(most)
        .select("shingle")
        .toArrow()
    )
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def describe(docs: DataFrame, k: int, num: int, den: int, heavy: np.ndarray) -> DataFrame:
    """The other columns and, of each text, the set's size, number, family keys, prefix and bitmap."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(rows, 0):
            n, node, keys, prefixes, maps = [], [], [], [], []
            for s in shingle_sets(_texts(part, 0), k):
                n.append(len(s))
                if not len(s):
                    for column in (node, keys, prefixes, maps):
                        column.append(None)
                    continue
                node.append(set_node(s))
                at = np.minimum(np.searchsorted(heavy, s), max(len(heavy) - 1, 0))
                common = heavy[at] == s if len(heavy) else np.zeros(len(s), bool)
                rare = s[~common]
                ordered = np.concatenate([rare, s[common]])
                prefixes.append(ordered[: prefix_length(len(s), num, den)].view(np.int64))
                own = rare if len(rare) > len(s) // 2 else s
                keys.append([int(_mix(own + _U(77 + seed)).min().view(np.int64)) for seed in range(KEYS)])
                maps.append(bitmap(s))
            found = [
                pa.array(n, pa.int64()),
                pa.array(node, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(prefixes, pa.list_(pa.int64())),
                pa.array(maps, pa.binary()),
            ]
            names = [*part.schema.names[1:], "n", "node", "keys", "prefix", "bits"]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *found], names=names)

    rest = [c for c in docs.columns if c != "text"]
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    made = (("n", long), ("node", long), ("keys", longs), ("prefix", longs), ("bits", T.BinaryType()))
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(*field) for field in made])
    return docs.select("text", *rest).mapInArrow(lean(run), schema)


def _groups(rows: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Whole groups from rows sorted by their first ``keys`` columns, many to a table.

    With ``most``, a group of more rows comes alone and in pieces, marked False.
    """
    held: list[pa.RecordBatch] = []  # rows of one group, which may go on
    key, pieces = None, False

    def key_at(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(c)[at].as_py() for c in range(keys))

    for batch in rows:
        if not batch.num_rows:
            continue
        edges = _edges(*(np.asarray(batch.column(c)) for c in range(keys))).tolist()
        at = 0
        if pieces:
            if key_at(batch, 0) == key:
                yield pa.Table.from_batches([batch.slice(0, edges[1])]), False
                at = edges[1]
                if at == batch.num_rows:
                    continue
            pieces = False
        last = edges[-2]
        if last > at or (held and key_at(batch, at) != key):
            yield pa.Table.from_batches([*held, batch.slice(at, last - at)]), True
            held = []
        key = key_at(batch, last)
        held.append(batch.slice(last))
        if most and sum(b.num_rows for b in held) > most:
            yield pa.Table.from_batches(held), False
            held, pieces = [], True
    if held:
        yield pa.Table.from_batches(held), True


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    if not len(columns[0]):
        return np.zeros(1, np.int64)
    new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(np.r_[True, new, True])


class Bitmaps:
    """The bitmaps of some sets; one matrix for each length."""

    def __init__(self, maps: list[bytes]):
        self.words = np.array([len(m) // 8 for m in maps])
        self.rows = np.zeros(len(maps), np.int64)
        self.full: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.rows[at] = np.arange(len(at))
            self.full[w] = np.frombuffer(b"".join([maps[i] for i in at]), np.uint64).reshape(len(at), w)

    def least(self, i: int, others: np.ndarray) -> np.ndarray:
        """Lower bounds of the differences between set i and others."""
        out = np.zeros(len(others), np.int64)
        for w in np.unique(self.words[others]).tolist():
            at = np.flatnonzero(self.words[others] == w)
            mine = self.full[int(self.words[i])][self.rows[i]]
            theirs = self.full[w][self.rows[others[at]]]
            while len(mine) > theirs.shape[1]:
                mine = mine[: len(mine) // 2] ^ mine[len(mine) // 2 :]
            while len(mine) < theirs.shape[1]:
                half = theirs.shape[1] // 2
                theirs = theirs[:, :half] ^ theirs[:, half:]
            out[at] = np.bitwise_count(theirs ^ mine).sum(1)
        return out

    def middle(self, some: np.ndarray) -> int:
        """The set nearest to the majority of each bit, among those with the most common length."""
        values, counts = np.unique(self.words[some], return_counts=True)
        at = some[self.words[some] == values[counts.argmax()]]
        rows = self.full[int(values[counts.argmax()])][self.rows[at]]
        ones = np.zeros(rows.shape[1] * 64, np.int64)
        for k in range(0, len(rows), 1000):
            ones += np.unpackbits(rows[k : k + 1000].view(np.uint8), axis=1).sum(0, dtype=np.int64)
        most = np.packbits((ones * 2 > len(rows)).astype(np.uint8)).view(np.uint64)
        return int(at[np.bitwise_count(rows ^ most).sum(1).argmin()])


def star_candidates(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a leader of a family and a set that may link with it by their bitmaps.

    Each set is held against at most STAR_ROUNDS leaders of a part of a family and goes with one, so
    there are at most KEYS rows for each set on a level. The leaders of a family in several parts
    meet again until one part is left; each level is STAR_ROUNDS / FAMILY_SETS of the last.
    """

    def stars(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _groups(rows, 3):
            at, key, part, node, n = (np.asarray(table.column(c)) for c in range(5))
            edges = _edges(at, key, part)
            found = []
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                maps = Bitmaps(table.column(5).slice(x, y - x).to_pylist())
                size, left = n[x:y], np.arange(y - x)
                for _ in range(STAR_ROUNDS):
                    if len(left) < 2:
                        break
                    head = maps.middle(left)
                    others = left[left != head]
                    near = others[maps.least(head, others) * (num + den) <= (size[others] + size[head]) * (den - num)]
                    found.append(np.column_stack([np.full(len(near) + 1, x + head), np.r_[x + head, x + near]]))
                    left = left[~np.isin(left, near) & (left != head)]
            if found:
                a, b = np.concatenate(found).T
                columns = [pa.array(v) for v in (at[a], key[a], node[a], node[b])]
                yield pa.RecordBatch.from_arrays(columns, names=["at", "key", "a", "b"])

    each = sets.select("node", F.posexplode("keys").alias("at", "key"))
    out, level, written = None, 0, []
    while True:
        sizes = each.groupBy("at", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        parts = F.ceil(F.col("c") / FAMILY_SETS).cast("long")
        own = each.join(sizes, ["at", "key"]).select(
            "at", "key", F.pmod(F.xxhash64("node", F.lit(level)), parts).alias("part"), "node", (parts > 1).alias("split")
        )
        own = durable(own, "jaccard-families")
        by_set = own.groupBy("node").agg(F.collect_list(F.struct("at", "key", "part")).alias("families"))
        found = (
            sets.select("node", "n", "bits")
            .join(by_set, "node")
            .select(F.explode("families").alias("f"), "node", "n", "bits")
            .select("f.at", "f.key", "f.part", "node", "n", "bits")
            .repartition("at", "key", "part")
            .sortWithinPartitions("at", "key", "part")
            .mapInArrow(lean(stars), "at int, key long, a long, b long")
        )
        found = durable(found, "jaccard-star-candidates")
        written += [own, found]
        out = out.unionByName(found) if out else found
        split = own.where("split").select("at", "key").distinct()
        each = found.where("a = b").select(F.col("a").alias("node"), "at", "key").join(split, ["at", "key"], "left_semi")
        level += 1
        if split.isEmpty():
            done = durable(out.where("a <> b").select("a", "b").distinct(), "jaccard-star-pairs")
            release(*written)
            return done


def choose_stars(links: DataFrame) -> DataFrame:
    """Of verified links (a leads b) one leader for each member; no leader has a leader.

    A set that some leader of more links leads is a member; it goes with the leader of most links
    among those that are not members, and stays alone if there is none.
    """
    count = links.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    ranked = links.join(count, "a").join(count.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b", "left")
    strong = ranked.where("c > coalesce(cb, 0) OR c = cb AND a > b")
    led = strong.select(F.col("b").alias("a")).distinct()
    best = F.max_by(F.struct("a", "d", "less", "more"), F.struct("c", "a"))
    return strong.join(led, "a", "left_anti").groupBy("b").agg(best.alias("s")).select("b", "s.*")


def list_pairs(
    token: np.ndarray, leader: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray, num: int, den: int
) -> np.ndarray:
    """Pairs of leaders of two groups from the lists of one or more tokens, as rows (smaller, larger).

    The arguments are the entries of whole lists in any order: token, star, the star's component,
    bounds of the set size and the token's position in the set's prefix.
    """
    order = np.lexsort((leader, group, token))
    token, leader, group, low, high, place = (v[order] for v in (token, leader, group, low, high, place))
    first = _edges(token, leader)[:-1]
    low, high, place = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.minimum.reduceat(place, first)
    token, leader, group = token[first], leader[first], group[first]
    # entries of a group that fills a block in a list keep to their own blocks; the others share mixed ones
    edges = _edges(token, group)
    large = np.repeat(np.diff(edges) >= BLOCK, np.diff(edges))
    order = np.lexsort((low, np.where(large, group, 0), large, token))
    token, leader, group, low, high, place, large = (v[order] for v in (token, leader, group, low, high, place, large))
    left = high - place  # elements from the shared one on
    # blocks with bounds of their sizes and of what follows the shared element
    run = _edges(token, large, np.where(large, group, 0))[:-1]
    lengths = np.diff(np.r_[run, len(token)])
    pieces = -(-lengths // BLOCK)
    inner = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(run, pieces) + inner * BLOCK
    sizes = np.minimum(np.repeat(run + lengths, pieces) - starts, BLOCK)
    lowest, highest = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
    most = np.maximum.reduceat(left, starts)
    order = np.lexsort((lowest, token[starts]))
    starts, sizes, lowest, highest, most = (v[order] for v in (starts, sizes, lowest, highest, most))
    owner, mixed, lists = group[starts], ~large[starts], token[starts]
    edge = _edges(lists)
    stop = np.repeat(edge[1:], np.diff(edge))
    found: list[np.ndarray] = []

    def expand(x: np.ndarray, y: np.ndarray) -> None:
        cells = sizes[x] * sizes[y]
        x, y = np.repeat(x, cells), np.repeat(y, cells)
        cell = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
        i, j = starts[x] + cell // sizes[y], starts[y] + cell % sizes[y]
        good = (group[i] != group[j]) & (high[i] * den >= low[j] * num) & (high[j] * den >= low[i] * num)
        good &= np.minimum(left[i], left[j]) * (num + den) >= num * (low[i] + low[j])
        if good.any():
            a, b = leader[i[good]], leader[j[good]]
            found.append(np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0))

    alive, step = np.arange(len(starts)), 0
    while len(alive):
        alive = alive[alive + step < stop[alive]]
        alive = alive[lowest[alive + step] * num <= highest[alive] * den]  # blocks ascend: later ones are out too
        x, y = alive, alive + step
        may = (mixed[x] | mixed[y] | (owner[x] != owner[y])) & (highest[y] * den >= lowest[x] * num)
        may &= np.minimum(most[x], most[y]) * (num + den) >= num * (lowest[x] + lowest[y])
        x, y = x[may], y[may]
        for at in range(0, len(x), 256):
            expand(x[at : at + 256], y[at : at + 256])
        if sum(map(len, found)) > 200_000:
            found = [np.unique(np.concatenate(found), axis=0)]
        step += 1
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


NAMES = ("token", "leader", "component", "low", "high", "place", "a", "b")
ENTRIES = ", ".join(f"{name} long" for name in NAMES)


def _pairs_batch(held: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(held), axis=0)
    nothing = pa.nulls(len(pairs), pa.int64())
    return pa.RecordBatch.from_arrays([*[nothing] * 6, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=NAMES)


def _run_numbers(*columns: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(columns[0]) and len(_edges(*columns)) - 1), np.diff(_edges(*columns)))


def _meet(rows: Iterator[pa.RecordBatch], keys: int, num: int, den: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs (with no token) from the lists that the first ``keys`` columns tell apart, the rest being
    leader, component, low, high and place; and the entries of lists too long to meet here."""
    held, size = [], 0
    for table, whole in _groups(rows, keys, most):
        columns = [np.asarray(c).astype(np.int64) for c in table.columns]
        if not whole:
            nothing = pa.nulls(table.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), nothing, nothing], names=NAMES)
            continue
        held.append(list_pairs(_run_numbers(*columns[:keys]), *columns[keys:], num, den))
        size += len(held[-1])
        if size > 200_000:  # a pair comes up in many lists
            yield _pairs_batch(held)
            held, size = [], 0
    if size:
        yield _pairs_batch(held)


def list_candidates(sets: DataFrame, num: int, den: int, most: int = LIST_ENTRIES) -> DataFrame:
    """Distinct pairs of leaders (a < b), of two components, that the index lists leave.

    A list of over ``most`` entries is handed back by its task and dealt out: each entry goes to
    the pairs of parts that its own part is in, so no task holds a long list.
    """
    found = durable(
        sets.select("leader", "component", F.col("n").cast("int").alias("low"), F.posexplode("prefix").alias("place", "token"))
        .select("token", "leader", "component", "low", F.col("low").alias("high"), "place")
        .repartition("token")
        .sortWithinPartitions("token")
        .mapInArrow(lean(lambda rows: _meet(rows, 1, num, den, most)), ENTRIES),
        "jaccard-lists",
    )
    pairs, long = found.where("token IS NULL").select("a", "b"), found.where("token IS NOT NULL")
    if not long.isEmpty():
        entries = long.groupBy("token", "leader", "component").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.min("place").alias("place")
        )
        entries = durable(entries, "jaccard-long-lists")
        parts = entries.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / (most // 2)).cast("long").alias("parts"))
        own = F.pmod(F.xxhash64("leader", F.lit("part")), F.col("parts"))
        dealt = (
            entries.join(parts, "token")
            .select("*", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
            .select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                    "leader", "component", "low", "high", "place")
            .repartition("token", "x", "y")
            .sortWithinPartitions("token", "x", "y")
        )
        more = dealt.mapInArrow(lean(lambda rows: _meet(rows, 3, num, den)), ENTRIES)
        pairs = pairs.unionByName(more.select("a", "b"))
    return pairs.distinct()


def needed_bits(ids: DataFrame) -> bytes:
    """A filter of NEED_BITS bits over the ids: what reaches the driver has one size at any scale."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(NEED_BITS, np.uint8)
        for batch in rows:
            bits[np.asarray(batch.column(0))] = 1
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    parts = ids.select(_need("id").alias("at")).coalesce(4).mapInArrow(lean(run), "bits binary").toArrow()
    out = np.zeros(NEED_BITS // 8, np.uint8)
    for value in parts.column(0).to_pylist():
        out |= np.frombuffer(value, np.uint8)
    return out.tobytes()


def _need(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(NEED_BITS)).cast("int")


class Corpus:
    """Reads whole sets again from the texts: only those that a pair needs are made and sent."""

    def __init__(self, docs: DataFrame, sets: DataFrame, k: int):
        self.docs, self.sets, self.k = docs, sets, k  # docs: text, key; sets: node and the key of one row that has it

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, set) for the ``id`` column of ``nodes``; a filter of one size drops other rows where they are read."""
        k = self.k
        wanted = nodes.select("id").distinct()
        rows = needed_bits(wanted.join(self.sets, F.col("id") == F.col("node")).select(F.col("key").alias("id")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.unpackbits(np.frombuffer(rows, np.uint8)).astype(bool)
            for batch in batches:
                batch = batch.filter(pa.array(bits[np.asarray(batch.column(1))]))
                for part in slices([batch], 0):
                    found = [s for s in shingle_sets(_texts(part, 0), k) if len(s)]
                    columns = [pa.array([set_node(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "set"])

        known = self.docs.select("text", _need("key").alias("at")).mapInArrow(lean(run), "node long, set binary")
        return known.dropDuplicates(["node"])


def differences(corpus: Corpus, pairs: DataFrame, deltas: bool = False) -> DataFrame:
    """``pairs`` (a, b) with the exact size of the symmetric difference, d, and both sizes, na and nb.

    With ``deltas`` also what b lacks of a, and has more than a, as bytes of sorted shingles.
    """

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            d, na, nb, less, more = [], [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                d.append(len(x) + len(y) - 2 * shared)
                na.append(len(x))
                nb.append(len(y))
                if deltas:
                    less.append(np.setdiff1d(x, y, assume_unique=True).tobytes())
                    more.append(np.setdiff1d(y, x, assume_unique=True).tobytes())
            columns = [batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (d, na, nb))]
            names = ["a", "b", "d", "na", "nb"]
            if deltas:
                columns += [pa.array(less, pa.binary()), pa.array(more, pa.binary())]
                names += ["less", "more"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    known = corpus.of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    left = known.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = known.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    schema = "a long, b long, d long, na long, nb long" + (", less binary, more binary" if deltas else "")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(lean(compare), schema)


def _bitmap_filter(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that can hold a link by their bitmaps, radii and largest sizes (bits, radius, most)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            room = np.asarray(batch.column(4))
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [least_difference(p, q) * (num + den) <= r for p, q, r in zip(x, y, room, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    a, b = (
        info.select(F.col("leader").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("bits", "most", "radius"))) for s in "ab"
    )
    room = (F.col("radius_a") + F.col("radius_b")) * (num + den) + (F.col("most_a") + F.col("most_b")) * (den - num)
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "bits_a", "bits_b", room.alias("room"))
    return both.mapInArrow(lean(run), "a long, b long")


def derive_links(
    first: np.ndarray, second: np.ndarray, left: list[tuple], right: list[tuple], num: int, den: int
) -> tuple[int, int] | None:
    """A link between a member of one star and one of another, if there is any.

    ``first`` and ``second`` are the leaders' sets; a member is (node, less, more), what it lacks
    of its leader and has besides. With signed differences D, what x and y have in common is
    |A & B| + Dx.B + A.Dy + Dx.Dy: the leaders' answer, two terms from one member each, and one
    that is no more than the smaller difference and is only worked out where it can matter.
    """

    def held(small: np.ndarray, large: np.ndarray) -> int:
        if not len(small) or not len(large):
            return 0
        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
        return int((large[at] == small).sum())

    base = held(first, second)
    x_term = np.array([held(more, second) - held(less, second) for _, less, more in left], np.int64)
    y_term = np.array([held(more, first) - held(less, first) for _, less, more in right], np.int64)
    nx = np.array([len(first) - len(less) + len(more) for _, less, more in left], np.int64)
    ny = np.array([len(second) - len(less) + len(more) for _, less, more in right], np.int64)
    dx = np.array([len(less) + len(more) for _, less, more in left], np.int64)
    dy = np.array([len(less) + len(more) for _, less, more in right], np.int64)
    for i, (x, less_x, more_x) in enumerate(left):
        known = base + x_term[i] + y_term
        for j in np.flatnonzero((known + np.minimum(dx[i], dy)) * (num + den) >= (nx[i] + ny) * num):
            y, less_y, more_y = right[j]
            cross = held(less_x, less_y) + held(more_x, more_y) - held(less_x, more_y) - held(more_x, less_y)
            if (known[j] + cross) * (num + den) >= (nx[i] + ny[j]) * num:
                return x, y
    return None


def member_links(corpus: Corpus, open_pairs: DataFrame, led: DataFrame, num: int, den: int) -> DataFrame:
    """For each pair of stars (a, b, d, radius_a, radius_b, most_a, most_b) a link between members, if there is any.

    Members that the leaders' difference and their own settle are left out before anything is sent.
    Each pair is worked out in parts of at most about STAR_PART members of either star.
    """
    sides = []
    for side, (own, other) in enumerate((("a", "b"), ("b", "a"))):
        may = (F.col("d") - F.col("dm") - F.col(f"radius_{other}")) * (num + den) <= (F.col("nm") + F.col(f"most_{other}")) * (den - num)
        members = led.select(F.col("leader").alias(own), F.col("node"), F.col("d").alias("dm"), F.col("n").alias("nm"), "less", "more")
        sides.append(open_pairs.join(members, own).where(may).select("a", "b", F.lit(side).alias("side"), "node", "less", "more"))
    rows = durable(sides[0].unionByName(sides[1]), "jaccard-open-members")
    count = lambda side: F.ceil(F.sum(F.when(F.col("side") == side, 1).otherwise(0)) / STAR_PART).cast("int")
    parts = rows.groupBy("a", "b").agg(count(0).alias("p0"), count(1).alias("p1")).where("p0 > 0 AND p1 > 0")
    mine = F.when(F.col("side") == 0, F.col("p0")).otherwise(F.col("p1"))
    theirs = F.when(F.col("side") == 0, F.col("p1")).otherwise(F.col("p0"))
    places = rows.join(parts, ["a", "b"]).select(
        "*", F.pmod(F.xxhash64("node", F.lit("part")), mine).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), theirs - 1)).alias("other")
    )
    x = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    y = F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    no_set = F.lit(None).cast("binary").alias("set")
    places = places.select("a", "b", x.alias("x"), y.alias("y"), "side", "node", "less", "more", no_set)
    grid = parts.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("p0") - 1)).alias("x"), "p1").select(
        "a", "b", "x", F.explode(F.sequence(F.lit(0), F.col("p1") - 1)).alias("y")
    )
    known = corpus.of(parts.select(F.explode(F.array("a", "b")).alias("id")))
    none = F.lit(None).cast("binary")
    leaders = grid.withColumn("node", F.explode(F.array("a", "b"))).join(known, "node")
    leaders = leaders.select(
        "a", "b", "x", "y", F.when(F.col("node") == F.col("a"), -2).otherwise(-1).alias("side"), "node", none.alias("less"), none.alias("more"), "set"
    )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _groups(rows, 4):
            keys = [np.asarray(table.column(c)) for c in range(4)]
            edges = _edges(*keys)
            found = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = table.slice(lo, hi - lo)
                side = np.asarray(part.column(4))
                node, less, more, sets = (part.column(c).to_pylist() for c in range(5, 9))
                numbers = lambda v: np.frombuffer(v or b"", np.uint64)
                stars = [[(node[i], numbers(less[i]), numbers(more[i])) for i in np.flatnonzero(side == s)] for s in (0, 1)]
                link = derive_links(numbers(sets[0]), numbers(sets[1]), *stars, num, den)
                if link:
                    found.append(link)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = places.unionByName(leaders).repartition("a", "b", "x", "y").sortWithinPartitions("a", "b", "x", "y", "side")
    return dealt.mapInArrow(lean(run), "a long, b long")


def _components(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes) for docs (doc_id, key, text): the rows with n and node; and for each node its component,
    the smallest id with it (class_id) and in the component (component_id)."""
    if not 0 < num <= den:
        raise ValueError("num/den must be over 0 and at most 1")
    small_batches(docs.sparkSession)
    link = F.col("d") * (num + den) <= (F.col("na") + F.col("nb")) * (den - num)
    heavy = heavy_shingles(docs, k)
    rows = durable(describe(docs, k, num, den, heavy).withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
    classes = rows.where("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"))
    classes = durable(classes, "jaccard-classes")
    reps = rows.join(classes.select("row"), "row", "left_semi").select("node", "key", "n", "keys", "prefix", "bits")
    reps = durable(reps, "jaccard-reps")
    corpus = Corpus(docs, reps.select("node", "key"), k)

    stars = durable(differences(corpus, star_candidates(reps, num, den), deltas=True).where(link), "jaccard-stars")
    found = components(stars.select("a", "b"))
    led = durable(
        reps.join(choose_stars(stars).withColumnRenamed("b", "node"), "node", "left")
        .join(found, "node", "left")
        .select(
            "node",
            F.coalesce("a", "node").alias("leader"),
            F.coalesce("component", "node").alias("component"),
            F.coalesce("d", F.lit(0)).alias("d"),
            "n", "less", "more", "prefix", "bits",
        ),
        "jaccard-led",
    )
    reach = led.groupBy("leader").agg(F.max("d").alias("radius"), F.max("n").alias("most"))
    info = led.where("node = leader").select("leader", "bits").join(reach, "leader")
    near = durable(_bitmap_filter(list_candidates(led, num, den), info, num, den), "jaccard-near")
    checked = durable(differences(corpus, near), "jaccard-checked")
    joined = lambda more: components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    links = checked.where(link).select("a", "b")
    if not links.isEmpty():
        found = joined(links)
    open_pairs = durable(_open_pairs(checked.where(~link), reach, found, led, num, den), "jaccard-open")
    if not open_pairs.isEmpty():
        more = durable(member_links(corpus, open_pairs, led, num, den), "jaccard-member-links")
        if not more.isEmpty():
            found = joined(more)
    nodes = classes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = durable(nodes.join(smallest, "component").select("node", "component", F.col("least").alias("class_id"), "component_id"), "jaccard-nodes")
    rows = rows.select("doc_id", "key", "n", "node")
    release(stars, led, near, checked, open_pairs, reps, classes)
    return rows, nodes


def _open_pairs(apart: DataFrame, reach: DataFrame, found: DataFrame, led: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of leaders of two components that don't link while members of their stars may."""
    open_pairs = apart.select("a", "b", "d")
    for side in "ab":
        star = reach.select(F.col("leader").alias(side), F.col("radius").alias(f"radius_{side}"), F.col("most").alias(f"most_{side}"))
        where = found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        open_pairs = open_pairs.join(star, side).join(where, side, "left")
    radii = F.col("radius_a") + F.col("radius_b")
    may = (F.col("d") - radii) * (num + den) <= (F.col("most_a") + F.col("most_b")) * (den - num)
    two = F.coalesce("c_a", "a") != F.coalesce("c_b", "b")
    return open_pairs.where(may & two & (radii > 0)).drop("c_a", "c_b")


def jaccard_components(
    docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Components of the texts under links of Jaccard similarity at least num/den over k-word shingles.

    One row per input row: id, n_shingles, component_id (the smallest id reachable, its own if
    nothing links), class_id (the smallest id with the same set).

    Defined cases: null and empty texts have an empty set and link with nothing, not with each
    other either; equal sets always link; ids of any type that has an order; a row with a null id
    takes part, but gets a null component and class itself; rows that share an id have each the
    component of its own text; an empty table gives no rows; extra columns are ignored. No pair or
    candidate is dropped: filters only pass over pairs that cannot link.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    rows, nodes = _components(own, k, num, den)
    known = F.col("doc_id").isNotNull()
    return rows.join(nodes, "node", "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"),
    )


def keep_one(
    docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns stay.

    A row with a null id gives way to one with an id; where a component has none, or its smallest
    id has several texts, the text with the smallest hash stays. Rows that repeat both id and text
    are one document and stay together.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    rows, nodes = _components(own, k, num, den)
    grouped = rows.join(nodes.select("node", "component"), "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))
    keep = grouped.groupBy("component").agg(first.alias("first")).select("component", F.col("first.key").alias("kept"))
    return drop_rows(docs, grouped.join(keep, "component").where("key <> kept").select("key"), id_col, text_col)
