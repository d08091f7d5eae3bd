"""N-gram Jaccard join, size-aware: heavy sets scan inverted lists, light sets enumerate subsets.

A document's set is its distinct five-word shingles (A-Z in lower case), 64-bit hashes of them. Two documents link
when 100 * intersection >= 75 * union. Equal sets are one class, and only classes are joined.

* Light sets (up to a boundary size) are met by subsets: two linked sets share their intersection, which is at
  least three quarters of either, so each enumerates its subsets of each such size.
* Heavy sets are met by inverted lists over prefixes: under one order of all shingles, linked sets share one among
  the first quarter (and one) of each. Frequent shingles come last in that order, so long lists are not scanned.
  The order comes from a hashed table of fixed size; any order gives the same links.
* The boundary is chosen by cost: subsets of a size against prefix entries times the mean list they meet.

A list of up to ``PAIRS`` classes gives its pairs. A longer one gives stars (classes with a pivot) first, by chunks
of ``CHUNK`` members; the pivots of a list's chunks are a list of their own, until one chunk is left. When the links of
all stars are known, members outside a list's largest component are compared with those of other components. So a
group of many near copies costs its size, not its square, and no link between different components is left out.
Candidates whose parity maps (two to four bits for each shingle) show more differences than linked sets may have are
dropped; the rest are checked on the whole sets: their texts travel once for each star, split by ``SALT``.

Scale: what moves is 20 bytes for each prefix entry (about a quarter of a text's words) in packed blocks, the texts
of candidates, and small rows. The frequency table (4 MB) and a filter of candidate texts (2 MB) are all that is
shipped; both have a fixed size. A key that may have more than ``LIST`` entries, by the frequency table, is salted by
class, so no task holds more of it than its share; no task holds more than a chunk of a list with maps. Members
outside the largest component visit each chunk of their list. Components are found by minimum labels with pointer
jumping, cut at each round. Rows get their class's component, and classes their component's lowest id, with hot keys
by broadcast.

Defined results: null and empty texts, and such without words, have an empty set, no links and themselves as
component; texts of fewer than five words have one shingle, their whole sequence; ties in ids and repeated rows are
one class; a null id is never the smallest unless it is alone; extra columns are dropped; an empty table gives an
empty result. Hashes of shingles and classes have 64 bits: two different classes among n coincide with a
probability of about n * n / 2**65.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import sketch
from quarry.llm.common import as_text, carried, cut, in_filter, lower_ascii, mix64, read_table, shingle_sets, spread_join, trimmed

WORDS = 5
#: Linked: DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: The largest boundary between light and heavy sets that is considered.
MOST_LIGHT = 12
#: A list of up to so many classes gives all its pairs.
PAIRS = 8
#: Texts that are checked against one copy of a pivot's text.
SALT = 256
#: Bytes of entries in a block's partition, entries held by a task before it hands blocks on.
PART_BYTES, HELD = 32 << 20, 2_000_000
#: Entries of a key that a task holds, and members of a list that are compared at once.
LIST, CHUNK = 1 << 18, 1 << 12
#: Bits of the filter for candidate texts.
FILTER_BITS = 24

_LIGHT = np.uint64(0xA24BAED4963EE407)


def sets_of(texts: list[object]) -> list[np.ndarray]:
    return shingle_sets([lower_ascii(as_text(t)) for t in texts], WORDS)


def least(size: int) -> int:
    """The smallest intersection of a set of this size with any that links to it."""
    return -(-NUM * size // DEN)


def class_id(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if DEN * len(a) < NUM * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return DEN * common >= NUM * (len(a) + len(b) - common)


def width(size: int) -> int:
    """Bits of a set's parity map: the power of two from twice its size on, 64 at least."""
    return max(64, 1 << (2 * size - 1).bit_length())


def parity_map(members: np.ndarray) -> bytes:
    """Bit k: whether an odd number of members fall on k. Two maps differ in no more bits than their sets in members,
    so a pair whose maps differ in more than linked sets may is out for certain."""
    if not len(members):
        return b""
    bits = np.bincount((members & np.uint64(width(len(members)) - 1)).astype(np.int64), minlength=width(len(members))) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def most_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members that linked sets of these sizes may differ in."""
    total = a.astype(np.int64) + b.astype(np.int64)
    return total - 2 * (-(-NUM * total // (NUM + DEN)))


class Maps:
    """Parity maps of several sets, compared at the narrower width of a pair."""

    def __init__(self, maps: list[bytes], sizes: np.ndarray):
        self.sizes = sizes
        self.widths = np.array([8 * len(m) for m in maps], dtype=np.int64)
        self.at = np.zeros(len(maps), dtype=np.int64)
        self.own: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        for w in np.unique(self.widths):
            which = np.flatnonzero(self.widths == w)
            m = np.frombuffer(b"".join(maps[k] for k in which), dtype=np.uint64).reshape(len(which), w // 64)
            self.at[which] = np.arange(len(which))
            self.own[int(w)] = m
            if w > 64:
                self.half[int(w)] = m[:, : w // 128] ^ m[:, w // 128 :]

    def may_link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether pairs (x[k], y[k]) of indices may be linked, by sizes and maps."""
        ok = _fits(self.sizes[x], self.sizes[y])
        most = most_apart(self.sizes[x], self.sizes[y])
        wx, wy = self.widths[x], self.widths[y]
        for a in np.unique(wx[ok]).tolist():
            for b in (a // 2, a, 2 * a):
                k = np.flatnonzero(ok & (wx == a) & (wy == b))
                if len(k):
                    m = (self.half if a > b else self.own)[a][self.at[x[k]]]
                    n = (self.half if b > a else self.own)[b][self.at[y[k]]]
                    ok[k] = np.bitwise_count(m ^ n).sum(axis=1, dtype=np.int64) <= most[k]
        return ok


def subsets(size: int) -> list[np.ndarray]:
    """Index matrices of the subsets that a light set of this size enumerates, by subset size."""
    return [np.array(list(itertools.combinations(range(size), c)), dtype=np.int64) for c in range(least(size), size + 1)]


def boundary(sizes: dict[int, int], mean_list: float) -> int:
    """The largest size up to which subsets cost less than scanning lists. sizes: sets of each small size."""
    best = 0
    for s in range(1, MOST_LIGHT + 1):
        light = sum(math.comb(s, c) for c in range(least(s), s + 1))
        heavy = (s - least(s) + 1) * (1 + mean_list)
        if light * max(1, sizes.get(s, 0)) > heavy * max(1, sizes.get(s, 0)):
            break
        best = s
    return best


def usual_load(counts: np.ndarray) -> float:
    """What chance puts into a slot of the hashed table, nearly always."""
    mean = counts.sum() / len(counts)
    return float(mean + 3 * math.sqrt(mean) + 2)


def frequency_ranks(counts: np.ndarray) -> np.ndarray:
    """Classes of the hashed table's slots: 0 up to the usual load, then two for each doubling."""
    usual = usual_load(counts)
    return np.where(counts > usual, 1 + np.floor(2 * np.log2(np.maximum(counts / usual, 1))), 0).astype(np.uint8)


def salts_by_rank(usual: float, held: int = LIST) -> np.ndarray:
    """In how many parts the list of a key is dealt whose shingles are all of this rank or a higher one: a list isn't
    longer than the load of any of its shingles' slots."""
    return np.maximum(1, np.ceil(usual * 2.0 ** (np.arange(64) / 2) / held)).astype(np.int64)


def light_keys(members: np.ndarray, rank: np.ndarray, tables: dict[int, list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a light set's subsets, and the lowest rank among each one's shingles."""
    value, r = mix64(members ^ _LIGHT), rank[sketch.slots(members)]
    keys, low = [], []
    for m in tables[len(members)]:
        keys.append(mix64(value[m].sum(axis=1, dtype=np.uint64) + np.uint64(m.shape[1] * int(_LIGHT) % (1 << 64))))
        low.append(r[m].min(axis=1))
    return np.concatenate(keys), np.concatenate(low)


def heavy_keys(members: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the common order, by frequency class, then hash, and their ranks."""
    n = len(members) - least(len(members)) + 1
    r = rank[sketch.slots(members)]
    if not r.any():
        return members[:n], r[:n]
    order = np.lexsort((members, r))[:n]
    return members[order], r[order]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets = sets_of(list(b["t"]))
        yield pd.DataFrame({"i": b["i"], "th": b["th"], "n": pd.Series([len(s) for s in sets], dtype="int64"), "c": pd.Series([class_id(s) for s in sets], dtype="int64"), "map": [parity_map(s) for s in sets]})


_ENTRIES = "block int, salted boolean, k binary, p binary, c binary, s binary"


def _entries(docs: DataFrame, rank, salts: np.ndarray, light: int, blocks: int) -> DataFrame:
    """Packed entries (key, part, class, size) by block. Only salted keys have parts."""
    reach = NUM * (light + 1) / DEN  # smaller sets link to light ones only

    def packed(k: np.ndarray, p: np.ndarray, c: np.ndarray, s: np.ndarray, salted: bool) -> Iterator[pd.DataFrame]:
        block = (mix64(k ^ mix64(p.astype(np.uint64)) if salted else k) % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        k, p, c, s, block = k[order], p[order], c[order], s[order], block[order]
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        ends = [*cuts[1:], len(k)]
        cell = lambda x: [x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
        yield pd.DataFrame({"block": block[cuts], "salted": salted, "k": cell(k), "p": cell(p) if salted else [None] * len(cuts), "c": cell(c), "s": cell(s)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.frombuffer(rank.value, dtype=np.uint8)
        tables = {s: subsets(s) for s in range(1, light + 1)}
        seen: set[int] = set()
        keys, ranks, classes, sizes, held = [], [], [], [], 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal held
            k, n = np.concatenate(keys), [len(x) for x in keys]
            c, s = np.repeat(np.array(classes, dtype=np.int64), n), np.repeat(np.array(sizes, dtype=np.uint32), n)
            parts = salts[np.concatenate(ranks)]
            p = (mix64(c.view(np.uint64) ^ _LIGHT) % parts.astype(np.uint64)).astype(np.int32)
            for x in keys, ranks, classes, sizes:
                x.clear()
            held = 0
            for salted in (False, True):
                w = (parts > 1) == salted
                if w.any():
                    yield from packed(k[w], p[w], c[w], s[w], salted)

        for b in batches:
            for members in sets_of(list(b["t"])):
                n = len(members)
                if not n or (cid := class_id(members)) in seen:
                    continue
                seen.add(cid)
                mine = ([light_keys(members, table, tables)] if n <= light else []) + ([heavy_keys(members, table)] if n >= reach else [])
                for k, r in mine:
                    keys.append(k), ranks.append(r), classes.append(cid), sizes.append(n)
                    held += len(k)
                if held >= HELD:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(docs["t"]).mapInPandas(trimmed(run), _ENTRIES)


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return DEN * np.minimum(a, b).astype(np.int64) >= NUM * np.maximum(a, b).astype(np.int64)


def _unique_pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


_LISTS = "run long, part int, a binary, b binary"


def _sorted_lists(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Entries (key, part, class, size) in order, each once, and where the lists begin."""
    k, p, c, s = (np.concatenate([np.frombuffer(r[j], dtype=t) for r in rows]) for j, t in enumerate((np.uint64, np.int32, np.int64, np.uint32)))
    order = np.lexsort((c, p, k))
    k, p, c, s = k[order], p[order], c[order], s[order]
    other = np.ones(len(k), dtype=bool)
    other[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    keep = other.copy()
    keep[1:] |= c[1:] != c[:-1]
    k, p, c, s = k[keep], p[keep], c[keep], s[keep]
    return k, p, c, s, np.flatnonzero(other[keep])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lists of a partition's keys: pairs of short ones (run null), and the members of long ones and of salted keys'
    parts. Equal long lists have one name; parts of a salted key are named by it."""
    plain, salted = [], []
    for b in batches:
        for hot, k, p, c, s in zip(b["salted"], b["k"], b["p"], b["c"], b["s"], strict=True):
            (salted if hot else plain).append((k, p if hot else bytes(len(k) // 2), c, s))
    for rows in (plain, salted):
        if rows:
            yield from _named_lists(*_sorted_lists(rows), rows is salted)


def _named_lists(k: np.ndarray, p: np.ndarray, c: np.ndarray, s: np.ndarray, starts: np.ndarray, salted: bool) -> Iterator[pd.DataFrame]:
    sizes = np.diff(np.append(starts, len(k)))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for m in range(2, 0 if salted else PAIRS + 1):
        at = starts[sizes == m]
        for x, y in itertools.combinations(range(m), 2):
            ok = _fits(s[at + x], s[at + y])
            pairs.append((c[at + x][ok], c[at + y][ok]))
    runs: dict[tuple[int, int], tuple[bytes, bytes]] = {}
    long = np.ones(len(starts), dtype=bool) if salted else sizes > PAIRS
    for a, m in zip(starts[long], sizes[long], strict=True):
        cs = c[a : a + m].tobytes()
        name = k[a].tobytes() if salted else hashlib.blake2b(cs, digest_size=8).digest()
        runs[int.from_bytes(name, "little", signed=True), int(p[a])] = (cs, s[a : a + m].tobytes())
    if pairs:
        a, b = _unique_pairs(pairs)
        for lo in range(0, len(a), 1 << 20):
            yield pd.DataFrame({"run": pd.Series([None], dtype="Int64"), "part": pd.Series([-1], dtype="int32"), "a": [a[lo : lo + (1 << 20)].tobytes()], "b": [b[lo : lo + (1 << 20)].tobytes()]})
    names = list(runs)
    for lo in range(0, len(names), 1000):
        part = names[lo : lo + 1000]
        yield pd.DataFrame({"run": pd.Series([r for r, _ in part], dtype="Int64"), "part": pd.Series([x if salted else -1 for _, x in part], dtype="int32"), "a": [runs[r][0] for r in part], "b": [runs[r][1] for r in part]})


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        for a, b in zip(d["a"], d["b"], strict=True):
            yield pd.DataFrame({"a": np.frombuffer(a, dtype=np.int64), "b": np.frombuffer(b, dtype=np.int64)})


def _members(chunk: int, held: int):
    """(run, chunk, many, c, s) of long lists. Chunks have up to ``chunk`` members of near sizes; the numbers of chunks
    of a salted key's parts lie apart. many: whether the list has other chunks."""
    stride = 2 + 4 * held // chunk

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for r, p, a, b in zip(d["run"], d["part"], d["a"], d["b"], strict=True):
                c, s = np.frombuffer(a, dtype=np.int64), np.frombuffer(b, dtype=np.uint32).astype(np.int64)
                order = np.lexsort((c, s))
                at = max(0, int(p)) * stride + np.arange(len(c)) // chunk
                yield pd.DataFrame({"run": np.full(len(c), r, dtype=np.int64), "chunk": at, "many": np.full(len(c), p >= 0 or len(c) > chunk), "c": c[order], "s": s[order]})

    return run


def pivot_of(maps: Maps, among: np.ndarray) -> int:
    """A member in the middle of those given: of the commonest width, the nearest to the majority of (up to 256 of)
    their maps. Copies of one text choose their original or its nearest copy, in each of their lists the same."""
    widths, n = np.unique(maps.widths[among], return_counts=True)
    w = int(widths[np.argmax(n)])
    mine = among[maps.widths[among] == w]
    own = maps.own[w][maps.at[mine]]
    some = own[:: max(1, len(own) // 256)][:256]
    votes = np.unpackbits(some.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    middle = np.packbits((2 * votes > len(some)).astype(np.uint8), bitorder="little").view(np.uint64)
    return int(mine[np.argmin(np.bitwise_count(own ^ middle).sum(axis=1, dtype=np.int64))])


#: Stars that a long list gives at most before its other members wait for the comparison of components.
STARS = 8
#: Members up to which all pairs of a list are looked at on their maps (not handed on).
LOOK = 64


_STARS = "kind int, run long, chunk long, a long, b long"
_PAIR, _ALIVE, _PIVOT = range(3)


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of chunks of long lists: pairs of pivots with the members that may be linked to them; the runs that may hold
    other links (those of several chunks or over LOOK, and those with such a pair besides the stars); and, for lists
    of several chunks, the pivots with their sizes."""
    for d in batches:
        alive, low, high = [], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        pivots: list[tuple[int, int, int, int]] = []
        for run, chunk, many, cs, ss, ms in zip(d["run"], d["chunk"], d["many"], d["cs"], d["ss"], d["ms"], strict=True):
            order = np.argsort(cs, kind="stable")
            c = np.asarray(cs)[order]
            maps = Maps([ms[k] for k in order], np.asarray(ss, dtype=np.int64)[order])
            some = None
            if len(c) <= LOOK and not many:
                x, y = np.triu_indices(len(c), 1)
                some = int(maps.may_link(x, y).sum())
                if not some:
                    continue
            left, starred = np.arange(len(c)), 0
            for _ in range(STARS):
                if len(left) < (1 if many else 2):
                    break
                pivot = pivot_of(maps, left)
                left = left[left != pivot]
                near = maps.may_link(np.full(len(left), pivot), left)
                low.append(np.full(int(near.sum()), c[pivot]))
                high.append(c[left[near]])
                starred += int(near.sum())
                left = left[~near]
                if many:
                    pivots.append((run, chunk, int(c[pivot]), int(maps.sizes[pivot])))
            if some is None or some > starred:
                alive.append(run)
        a, b = _unique_pairs([(np.concatenate(low), np.concatenate(high))])
        yield _star_rows(_PAIR, [0] * len(a), [0] * len(a), a, b)
        yield _star_rows(_ALIVE, alive, [0] * len(alive), [0] * len(alive), [0] * len(alive))
        yield _star_rows(_PIVOT, *(zip(*pivots, strict=True) if pivots else ([], [], [], [])))


def _star_rows(kind: int, run, chunk, a, b) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(run), kind, dtype=np.int32), **{n: np.asarray(x, dtype=np.int64) for n, x in (("run", run), ("chunk", chunk), ("a", a), ("b", b))}})


#: Visitors that are compared with a chunk's residents at a time.
VISITORS = 256


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of different components that may be linked, of sorted rows (run, chunk, visitor, c, s, l, major, map):
    the members of a chunk, then members outside the list's largest component, which visit it. Two such members
    meet once."""
    group, home, guests = None, [], []
    for d in batches:
        for run, chunk, visitor, *row in zip(*(d[n] for n in ("run", "chunk", "visitor", "c", "s", "l", "major", "map")), strict=True):
            if group != (run, chunk):
                yield _met(home, guests)
                group, home, guests = (run, chunk), [], []
            (guests if visitor else home).append(row)
            if len(guests) >= VISITORS:
                yield _met(home, guests)
                guests = []
    yield _met(home, guests)


def _met(home: list[list], guests: list[list]) -> pd.DataFrame:
    low, high = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    if home and guests:
        c, s, l, major = (np.array([r[k] for r in (*home, *guests)]) for k in range(4))
        maps, n = Maps([r[4] for r in (*home, *guests)], s.astype(np.int64)), len(home)
        for x in range(n, len(c)):
            y = np.flatnonzero((l[:n] != l[x]) & (major[:n] | (c[:n] > c[x])))
            y = y[maps.may_link(np.full(len(y), x), y)]
            low.append(np.minimum(c[y], c[x]))
            high.append(np.maximum(c[y], c[x]))
    a, b = _unique_pairs([(np.concatenate(low), np.concatenate(high))])
    return pd.DataFrame({"a": a, "b": b})


def _plausible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of candidate pairs with sizes and maps those that may be linked."""
    for d in batches:
        n = len(d)
        maps = Maps([*d["ma"], *d["mb"]], np.concatenate([d["na"].to_numpy(), d["nb"].to_numpy()]))
        yield d.loc[maps.may_link(np.arange(n), np.arange(n) + n), ["a", "b"]]


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Linked pairs of sorted rows (a, salt, role, b, text): role 0 is the pivot's own text."""
    owner, members = None, np.empty(0, dtype=np.uint64)
    for d in batches:
        out = []
        for a, salt, role, b, u in zip(d["a"], d["salt"], d["role"], d["b"], sets_of(list(d["text"])), strict=True):
            if role == 0:
                owner, members = (a, salt), u
            elif owner == (a, salt) and linked(members, u):
                out.append((a, b))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


def _verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked, on the whole texts of one document of each class."""
    spark = docs.sparkSession
    left, right = (reps.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("map").alias(f"m{x}")) for x in "ab")
    degrees = pairs.groupBy("a").agg(F.count("*").alias("k"))
    both = spread_join(pairs, degrees.join(left, "a"), "a", "k", pairs.count()).join(right, "b")
    pairs = cut(both.select("a", "b", "na", "nb", "ma", "mb").mapInPandas(_plausible, "a long, b long"))
    degrees = pairs.groupBy("a").agg(F.count("*").alias("k")).withColumn("parts", F.ceil(F.col("k") / F.lit(SALT)))
    salted = spread_join(pairs, degrees, "a", "k", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"))
    places = salted.select("a", "salt", F.lit(1).alias("role"), "b").unionByName(salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b")))
    placed = cut(places.join(reps, places.b == reps.c).select("a", "salt", "role", "b", "i", "th"))
    wanted = in_filter(placed, "th", FILTER_BITS)
    found = docs.where(wanted(F.col("th"))).alias("d").join(placed.alias("p"), (F.col("d.th") == F.col("p.th")) & F.col("d.i").eqNullSafe(F.col("p.i")))
    dealt = found.select("p.a", "p.salt", "p.role", "p.b", F.col("d.t").alias("text"))
    return dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInPandas(trimmed(_check), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of the edges (a, b) reaches."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        lower = labels.join(near, "u").select("u", F.col("l").alias("was"), F.least("l", "m").alias("x"))
        jumped = cut(lower.join(labels.select(F.col("u").alias("x"), F.col("l").alias("y")), "x").select("u", "was", F.least("x", "y").alias("l")))
        if jumped.where("l < was").isEmpty():
            return jumped.select(F.col("u").alias("node"), F.col("l").alias("comp"))
        labels = jumped.select("u", "l")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = LIST, chunk: int = CHUNK) -> DataFrame:
    """(id, n_shingles, class id, component label, component_id), one row for each row of ``docs``. held, chunk: entries
    of a key and members of a list that a task holds; the links are the same for any."""
    if chunk <= STARS:
        raise ValueError(f"chunk must be over {STARS}")
    spark = docs.sparkSession
    flat = docs.select(carried(docs, id_col), docs[text_col].alias("t"), F.xxhash64(docs[text_col]).alias("th"))
    kind = docs.schema[id_col].dataType
    ids = cut(flat.mapInPandas(trimmed(_measure), "i string, th long, n long, c long, map binary"))
    rows, counts = sketch.collected(sketch.frequencies(docs, text_col, sets_of))
    total = float(counts.sum())
    rank = frequency_ranks(counts)
    mean_list = float((counts.astype(float) ** 2).sum() / total) if total else 0.0
    small = {r.n: r["count"] for r in ids.where((F.col("n") > 0) & (F.col("n") <= MOST_LIGHT)).groupBy("n").count().collect()}
    light = boundary(small, mean_list)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((total / 4 + rows) * 20 / PART_BYTES))
    ranks = spark.sparkContext.broadcast(rank.tobytes())
    entries = _entries(flat, ranks, salts_by_rank(usual_load(counts), held), light, 8 * parts)
    scanned = cut(entries.repartition(parts, "block").mapInPandas(trimmed(_scan), _LISTS))
    best = F.min(F.struct("i", "th")).alias("r")
    reps = cut(ids.where("n > 0").groupBy("c").agg(best, F.first("n").alias("n"), F.first("map").alias("map")).select("c", "r.i", "r.th", "n", "map"))
    short = scanned.where("run is null").mapInPandas(_unpack, "a long, b long")
    runs = scanned.where("run is not null").groupBy("run", "part").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    members = cut(runs.mapInPandas(_members(chunk, held), "run long, chunk long, many boolean, c long, s long"))
    maps = reps.select("c", "map")
    starred, level = [], members
    while True:
        m = level.join(maps, "c").groupBy("run", "chunk", "many").agg(F.collect_list(F.struct("c", "s", "map")).alias("m"))
        lists = m.select("run", "chunk", "many", F.col("m.c").alias("cs"), F.col("m.s").alias("ss"), F.col("m.map").alias("ms"))
        stars = cut(lists.mapInPandas(trimmed(_stars), _STARS))
        starred.append(stars)
        # The pivots of neighbouring chunks are a chunk of the next level.
        up = stars.where(F.col("kind") == _PIVOT).withColumn("chunk", F.floor(F.col("chunk") * STARS / F.lit(chunk)))
        several = up.groupBy("run").agg(F.max("chunk").alias("last"))
        up = up.join(several, "run").select("run", "chunk", (F.col("last") > 0).alias("many"), F.col("a").alias("c"), F.col("b").alias("s"))
        if up.isEmpty():
            break
        level = cut(up)
    stars = functools.reduce(DataFrame.unionByName, starred)
    candidates = short.unionByName(stars.where(F.col("kind") == _PAIR).select("a", "b")).distinct()
    first = cut(_verify(flat, reps, cut(candidates)).distinct())
    labels = components(first)
    entries = members.count()
    sizes = members.groupBy("run").agg(F.count("*").alias("k"))
    alive = spread_join(members, sizes.join(stars.where(F.col("kind") == _ALIVE).select("run").distinct(), "run"), "run", "k", entries)
    labelled = alive.join(labels.withColumnRenamed("node", "c"), "c", "left").select("run", "chunk", "c", "s", F.coalesce("comp", "c").alias("l"))
    # Most long lists lie within one component by now; only the others are looked at again.
    by_part = labelled.groupBy("run", "l").agg(F.count("*").alias("k"))
    major = by_part.groupBy("run").agg(F.max_by("l", F.struct("k", "l")).alias("top"), F.count("*").alias("comps"), F.sum("k").alias("k"))
    major = major.where("comps > 1").select("run", "top", "k")
    mixed = cut(spread_join(labelled, major, "run", "k", entries).withColumn("major", F.col("l") == F.col("top")).join(maps, "c").drop("top"))
    visits = mixed.where("not major").drop("chunk").join(mixed.select("run", "chunk").distinct(), "run")
    meeting = mixed.withColumn("visitor", F.lit(False)).unionByName(visits.withColumn("visitor", F.lit(True)))
    dealt = meeting.repartition("run", "chunk").sortWithinPartitions("run", "chunk", "visitor")
    rest = cut(dealt.mapInPandas(trimmed(_across), "a long, b long").distinct())
    if not rest.isEmpty():
        second = _verify(flat, reps, rest)
        up = labels.withColumnRenamed("node", "a").withColumnRenamed("comp", "ca")
        over = second.join(up, "a", "left").join(up.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
        higher = components(over)
        nodes = labels.unionByName(higher.select("node", F.col("node").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))
        labels = cut(nodes.join(higher.toDF("comp", "top"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))
    typed = ids.select(F.col("i").cast(kind).alias("i"), "th", "n", "c")
    classes = typed.where("n > 0").groupBy("c").agg(F.min("i").alias("least"), F.count("*").alias("copies"))
    classes = cut(classes.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c")))
    lowest = classes.groupBy("comp").agg(F.min("least").alias("low"), F.count("*").alias("k"))
    placed = spread_join(classes.select("c", "comp", "copies"), lowest, "comp", "k", classes.count())
    named = spread_join(typed.where("n > 0"), placed, "c", "copies", rows)
    empty = typed.where("n = 0").select("*", F.lit(None).cast("long").alias("comp"), F.col("i").alias("low"))
    out = named.unionByName(empty)
    return out.select(
        F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("class_id"), F.col("comp").alias("component"),
        F.col("low").alias("component_id"), "th",
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "n_shingles", "component_id", "class_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k+4], ' ')) END) AS sh FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT DISTINCT x AS root, x AS node FROM links
  UNION
  SELECT reach.root, links.y FROM reach JOIN links ON links.x = reach.node
), comp AS (
  SELECT root, min(node) AS component_id FROM reach GROUP BY root
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(comp.component_id, w.doc_id) AS BIGINT) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.root = w.doc_id
"""
