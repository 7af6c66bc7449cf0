"""N-gram Jaccard join: candidate clusters without loss, then signature trees inside each cluster."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm import arrays as A
from lumigraph.llm.text import free_name
from lumigraph.operators.components import connected_components
from lumigraph.sources.tables import stash, table

#: Sets link if 5 * common >= 4 * all, which is 9 * common >= 4 * (one + other): at most (one + other) / 9 shingles are not common.
SHINGLE, RATIO = 5, 1.5
#: Shingles and sets of a chunk: larger clusters are joined chunk by chunk.  Children of a tree's node.
TASK_SHINGLES, TASK_SETS, FAN = 500_000, 400, 8
#: Prints that a task remembers, to emit copies once; keys that it combines before the shuffle.
SEEN, COMBINE = 200_000, 300_000
#: Frequent shingles, as far as they are known: those of LEAST documents or more in a window of WINDOW shingles; the first HOT are broadcast (8 bytes each).
WINDOW, LEAST, HOT = 2_000_000, 3, 200_000


@lru_cache(maxsize=None)
def band_of(n: int) -> int:
    return int(math.log(n + 0.5) / math.log(RATIO))


@lru_cache(maxsize=None)
def parts_of(band: int) -> tuple[int, int]:
    """(parts, least) for pairs whose smaller set is in `band`.

    Sets of such a pair differ in at most least - 1 shingles, so with shingles
    dealt into parts by hash, a set with `least` parts that are not empty has
    one that is the same in both and not empty.  0 parts: too few shingles.
    """
    top = math.ceil(RATIO ** (band + 1) - 0.5)
    low, least = max(1.0, RATIO**band - 0.5), top // 4 + 1
    for parts in range(least, 4 * top + 2):
        empty = parts * math.exp(-low / parts)
        if parts - empty - 3 * math.sqrt(empty) >= least:
            return parts, least
    return 0, least


def roles_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band, band below if the set can be the larger one of a pair with the smaller there): -1 for none."""
    own = np.array([band_of(int(n)) if n else -1 for n in sizes], np.int64)
    low = np.array([band_of(int(-(-4 * n // 5))) if n else -1 for n in sizes], np.int64)
    return own, np.where((own > 0) & (low < own), own - 1, -1)


def node_of(prints: np.ndarray, role: np.ndarray) -> np.ndarray:
    """A set in its role for one band: bands are apart in the graph of candidates."""
    with np.errstate(over="ignore"):
        return A.mix(prints.view(np.uint64) + role.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)


def keys_of(h: np.ndarray, sizes: np.ndarray, hot: np.ndarray, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, role): two documents that link have a key in common in one role.

    In each of its roles a document's shingles are dealt into parts, and it
    emits the hashes of `least` of them.  Sets that link have all but `least`
    - 1 parts in common, so that, with both taking the first `least` in one
    order of parts, one of these is the same: parts with most shingles that are
    not `hot` come first, for few documents have those in common by chance.
    Sets with too few parts emit also, as all such sets do, their first
    shingles: of two that link, the first n - ceil(0.8 n) + 1 have one in common
    in any one order of all shingles.  Here that is by rank (`ranks` of the hot
    ones, which ascend with the documents that have them; others come before
    all of these), then by hash.
    """
    starts = np.cumsum(sizes) - sizes
    rank_of = np.zeros(len(h), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        rank_of = np.where(hot[at] == h, (np.zeros(len(hot), np.int64) if ranks is None else ranks)[at] + 1, 0)
    cold = rank_of == 0
    order = np.lexsort((h, rank_of, np.repeat(np.arange(len(sizes)), sizes)))
    h, cold = h[order], cold[order]
    out_keys, out_docs, out_roles = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for role in roles_of(sizes):
        docs = np.flatnonzero((sizes > 0) & (role >= 0))
        if not len(docs):
            continue
        info = {b: parts_of(int(b)) for b in np.unique(role[docs]).tolist()}
        parts = np.array([info[b][0] for b in role[docs].tolist()], np.int64)
        least = np.array([info[b][1] for b in role[docs].tolist()], np.int64)
        n = sizes[docs]
        which = np.repeat(np.arange(len(docs)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        token = starts[docs][which] + inside
        room = np.maximum(parts, 1)
        base = np.cumsum(room) - room
        part = base[which] + (h[token] % room.astype(np.uint64)[which]).astype(np.int64)
        sums = np.zeros(int(room.sum()), np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(sums, part, A.mix(h[token]))
            filled = np.bincount(part, minlength=len(sums))
            weight = np.bincount(part, cold[token], minlength=len(sums)).astype(np.int64)
            of = np.repeat(np.arange(len(docs)), room)
            place = (np.arange(len(sums)) - base[of]).astype(np.uint64)
            space = role[docs][of].astype(np.uint64)
            key = A.mix(sums + place * np.uint64(0x9E3779B97F4A7C15) + space * np.uint64(0xD1B54A32D192ED03))
            at = np.flatnonzero((filled > 0) & (parts[of] > 0))
            at = at[np.lexsort((key[at], -weight[at], of[at]))]
            rank = np.arange(len(at)) - np.searchsorted(of[at], of[at])
            at = at[rank < least[of[at]]]
            out_keys.append(key[at])
            out_docs.append(docs[of[at]])
            few = (parts == 0) | (np.bincount(of[filled > 0], minlength=len(docs)) < least)
            prefix = n - -(-4 * n // 5) + 1
            take = few[which] & (inside < prefix[which])
            out_keys.append(A.mix(h[token][take] ^ A.mix(role[docs][which[take]].astype(np.uint64) + np.uint64(1))))
            out_docs.append(docs[which[take]])
        out_roles += [role[x] for x in out_docs[-2:]]
    return np.concatenate(out_keys), np.concatenate(out_docs), np.concatenate(out_roles)


def prints_of(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        with np.errstate(over="ignore"):
            run = np.append(np.uint64(0), np.cumsum(A.mix(h ^ np.uint64(salt)), dtype=np.uint64))
            end = np.cumsum(sizes)
            out.append(A.mix(run[end] - run[end - sizes] + sizes.astype(np.uint64) * np.uint64(salt)).view(np.int64))
    return out[0], out[1]


NAMES = ["doc_id", "print", "n", "f1", "f2", "own", "below"]


def _frequent(h: list[np.ndarray]) -> pa.RecordBatch:
    """Rows with n -1: f1 is a shingle of LEAST documents or more of the window, f2 of how many."""
    h = np.sort(np.concatenate(h)) if h else np.zeros(0, np.uint64)
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(h)))
    at, n = at[n >= LEAST], n[n >= LEAST]
    none = pa.nulls(len(at), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(at), -1)), pa.array(h[at].view(np.int64)), pa.array(n), none, none], NAMES)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    window, held = [], 0
    for batch in batches:
        for t in A.texts(batch.column(2)):
            h, sizes = A.shingle_sets(t, SHINGLE)
            one, two = prints_of(h, sizes)
            nodes = [pa.array(node_of(one, r), mask=r < 0) for r in roles_of(sizes)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(t.first, t.n) for c in (0, 1)], pa.array(sizes.astype(np.int64)), pa.array(one), pa.array(two), *nodes], NAMES)
            window.append(h)
            held += len(h)
            if held >= WINDOW:
                yield _frequent(window)
                window, held = [], 0
    yield _frequent(window)


def combined(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that tie the same nodes together with each key once.

    A key keeps its least node; each other node of it is tied to that one by
    two rows under a key of their own, once for all keys that they share.  So a
    key that very many documents have is one row for each COMBINE rows.
    """
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    least = node[new][np.cumsum(new) - 1]
    other = node != least
    with np.errstate(over="ignore"):
        tie = A.mix(A.mix(least[other].view(np.uint64)) + node[other].view(np.uint64))
    tie, at = np.unique(tie, return_index=True)
    key, node = np.concatenate([key[new], tie, tie]), np.concatenate([node[new], least[other][at], node[other][at]])
    order = np.argsort(node, kind="stable")  # a run of one node compresses
    return key[order], node[order]


def _keys(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            key, node = combined(*[np.concatenate(x) for x in zip(*held, strict=True)])
            held.clear()
            for i in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000].view(np.int64)), pa.array(node[i : i + 100_000])], ["key", "node"])

        for batch in batches:
            for t in A.texts(batch.column(0)):
                h, sizes = A.shingle_sets(t, SHINGLE)
                one, _ = prints_of(h, sizes)
                new = np.zeros(t.n, bool)
                for i, f in enumerate(one.tolist()):
                    if sizes[i] and f not in seen:
                        new[i] = True
                        seen.add(f)
                if len(seen) > SEEN:
                    seen.clear()
                key, doc, role = keys_of(h[np.repeat(new, sizes)], sizes[new], *hot.value)
                held.append((key, node_of(one[new][doc], role)))
                if sum(len(k) for k, _ in held) >= COMBINE:
                    yield from out()
        if held:
            yield from out()

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours under one key, from rows sorted by key."""
    last = None
    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is not None:
            key, node = np.append(last[0], key), np.append(last[1], node)
        if not len(key):
            continue
        last = key[-1:], node[-1:]
        same = (key[1:] == key[:-1]) & (node[1:] != node[:-1])
        pairs = np.unique(np.stack([np.minimum(node[1:], node[:-1])[same], np.maximum(node[1:], node[:-1])[same]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


class SignatureTree:
    """Levels of nodes over sets: each holds the OR of its children's token bitmaps and the range of their sizes.

    `slack` is the most by which a set below has more tokens than bits, so that
    common bits plus slack bound the overlap of any two sets below two nodes.
    Sets are ordered by size and least tokens, which puts near copies together.
    """

    def __init__(self, sets: list[np.ndarray], at: np.ndarray, width: int):
        """Over the sets numbered `at`, with bitmaps of `width` bits."""
        size = np.array([len(sets[i]) for i in at])
        order = np.lexsort((size, np.array([sets[i][0] for i in at], np.uint64)))
        self.order, size = at[order].tolist(), size[order]
        bits = np.zeros((len(at), width // 64), np.uint64)
        for i, s in enumerate(self.order):
            place = sets[s] & np.uint64(width - 1)
            np.bitwise_or.at(bits[i], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        slack = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, slack)]
        self.uniform: set[tuple[int, int]] = {(0, i) for i in range(len(at))}
        while len(self.levels[-1][0]) > 1:
            bits, low, high, slack = self.levels[-1]
            first = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, first, axis=0), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.maximum.reduceat(slack, first)))

    def below(self, level: int, node: int) -> tuple[int, np.ndarray]:
        """(level, nodes) one level down; a set stays what it is."""
        if not level:
            return 0, np.array([node])
        return level - 1, np.arange(node * FAN, min(len(self.levels[level - 1][0]), (node + 1) * FAN))

    def component(self, level: int, node: int, find) -> int:
        """The component of all sets below a node; -1 if there are several."""
        step = FAN**level
        if (level, node) not in self.uniform:
            if len({find(i) for i in self.order[node * step : (node + 1) * step]}) > 1:
                return -1
            self.uniform.add((level, node))
        return find(self.order[node * step])


def may_link(one: tuple, other: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of nodes of two levels: can the largest overlap below them be enough for the smallest sets there?"""
    (bits, low, high, slack), (bits2, low2, high2, slack2) = one, other
    fits = (5 * high[a] >= 4 * low2[b]) & (5 * high2[b] >= 4 * low[a])
    at = np.flatnonzero(fits)
    step = max(1, (1 << 21) // bits.shape[1])
    for i in range(0, len(at), step):
        x, y = a[at[i : i + step]], b[at[i : i + step]]
        most = np.bitwise_count(bits[x] & bits2[y]).sum(1, dtype=np.int64) + np.minimum(slack[x], slack2[y])
        most = np.minimum(most, np.minimum(high[x], high2[y]))
        fits[at[i : i + step]] = 9 * most >= 4 * (low[x] + low2[y])
    return fits


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, ascending, have a similarity of 0.8 or more."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 5 * common >= 4 * (len(x) + len(y) - common)


def tree_links(sets: list[np.ndarray], known: list | None = None, side: np.ndarray | None = None, looked: list[int] | None = None) -> np.ndarray:
    """For each set the number of a set of its component, by dual traversal of a signature tree against itself.

    With `side` (of each set, false or true) there are two trees, one
    traversed against the other, and links within a side are not looked for.
    Sets of equal `known` are in one component from the start.  Pairs of nodes
    whose sets are in one component already are passed over: they could add no
    reachability, and a group of near copies costs about as many comparisons as
    it has sets.  `looked` gets the number of pairs of sets compared.
    """
    n = len(sets)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if known is not None:
        first: dict = {}
        root = [first.setdefault(k, i) for i, k in enumerate(known)]
    width, most, compared = 64, max(len(s) for s in sets), 0
    while width < 8 * most and width < 1 << 20:
        width *= 2
    sides = [np.arange(n)] if side is None else [x for x in (np.flatnonzero(~side), np.flatnonzero(side)) if len(x)]
    trees = [SignatureTree(sets, at, width) for at in sides]
    same, (one, other) = len(trees) == 1, (trees[0], trees[-1])
    stack = [] if same and side is not None else [(len(one.levels) - 1, 0, len(other.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        own = same and (la, a) == (lb, b)
        r = one.component(la, a, find)
        if r >= 0 and (own or r == other.component(lb, b, find)):
            continue
        if not la and not lb:
            compared += 1
            if linked(sets[one.order[a]], sets[other.order[b]]):
                p, q = sorted((find(one.order[a]), find(other.order[b])))
                root[q] = p
            continue
        la, xs = one.below(la, a)
        lb, ys = other.below(lb, b)
        x, y = np.repeat(xs, len(ys)), np.tile(ys, len(xs))
        if own:
            x, y = x[x <= y], y[x <= y]
        ok = may_link(one.levels[la], other.levels[lb], x, y) | (own & (x == y))
        pairs = sorted(zip(x[ok].tolist(), y[ok].tolist(), strict=True), key=lambda p: (p[0] != p[1], abs(p[1] - p[0])), reverse=True)
        stack += [(la, p, lb, q) for p, q in pairs]  # a node with itself is looked at first
    if looked is not None:
        looked.append(compared)
    return np.array([find(i) for i in range(n)])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, f1, f2, …) with the sets in place of the texts; rows whose text has other prints go."""
    for batch in batches:
        rest = pa.Table.from_batches([batch.select(range(1, batch.num_columns))])
        for t in A.texts(batch.column(0)):
            h, sizes = A.shingle_sets(t, SHINGLE)
            one, two = prints_of(h, sizes)
            own = rest.slice(t.first, t.n)
            ok = (own["f1"].to_numpy() == one) & (own["f2"].to_numpy() == two) & (sizes > 0)
            data, ends = h.tobytes(), 8 * np.append(0, np.cumsum(sizes))
            blobs = pa.array([data[ends[i] : ends[i + 1]] for i in np.flatnonzero(ok)], pa.binary())
            own = own.drop_columns(["f1", "f2"]).filter(pa.array(ok)).append_column("set", blobs)
            yield from own.combine_chunks().to_batches()


TASK = "`group` long, i long, j long, chunk long, id binary, known binary, `set` binary"


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from rows of TASK sorted by group, i, j, id: each set's id, and the least one of its component there.

    With i = j the sets of a chunk are joined with each other, otherwise those
    of chunk i with those of chunk j.
    """

    def done(task: tuple, rows: list[tuple]) -> pa.RecordBatch:
        chunk, ids, known, sets = zip(*rows, strict=True)
        side = None if task[1] == task[2] else np.array(chunk) == task[2]
        least: dict[int, bytes] = {}
        first = tree_links(list(sets), known, side).tolist()
        for i, r in zip(ids, first, strict=True):
            least[r] = min(i, least.get(r, i))
        pairs = [(i, least[r]) for i, r in zip(ids, first, strict=True) if i != least[r]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])

    at, rows = None, []
    for batch in batches:
        _, ends, data = batch.column(6).buffers()
        ends = np.frombuffer(ends, np.int32)[batch.column(6).offset :][: len(batch) + 1] // 8
        data = np.frombuffer(data, np.uint64, int(ends[-1])) if len(batch) and ends[-1] else np.zeros(0, np.uint64)
        sets = (data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False))  # where Arrow has them, no copies
        for group, i, j, *row in zip(*[batch.column(c).to_pylist() for c in range(6)], sets, strict=True):
            if at != (group, i, j):
                if len(rows) > 1:
                    yield done(at, rows)
                at, rows = (group, i, j), []
            if not rows or rows[-1][1] != row[1]:  # a repeated row of a document
                rows.append(tuple(row))
    if len(rows) > 1:
        yield done(at, rows)


def _found(tasks: DataFrame) -> DataFrame:
    """(a, b): what the trees of the tasks link."""
    columns = [F.col(x.strip().split()[0]) for x in TASK.split(",")]
    return stash(tasks.select(*columns).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "id").mapInArrow(_trees, "a binary, b binary"))


def _within(sets: DataFrame, task_sets: int) -> DataFrame:
    """(id, component) of the sets that link with others, from (id, set, places) with the (group, chunk, chunks) of each.

    First each chunk is joined by itself.  Of clusters with several chunks, one
    set of each component of each chunk then meets those of the other chunks,
    chunk by chunk again: a cluster of near copies is one component after that.
    What is left is dealt anew, sets of one component together, and all chunks
    that are not one component in whole meet each other, with what is known
    passed in.
    """
    placed = sets.select("id", "set", F.inline("places"))
    links = _found(placed.select("*", F.col("chunk").alias("i"), F.col("chunk").alias("j"), F.col("id").alias("known")))
    found = connected_components(links, "a", "b")
    wide = sets.where(F.exists("places", lambda p: p["chunks"] > 1))
    if wide.isEmpty():
        return found
    places = wide.select("id", F.inline("places")).where("chunks > 1")
    now = lambda: stash(places.join(found, "id", "left").select("id", "group", "chunk", F.coalesce("component", "id").alias("known")))
    heads = now().groupBy("group", "chunk", "known").agg(F.min("id").alias("id")).select("group", "id", "known")
    n = heads.groupBy("group").agg(F.ceil(F.count("*") / task_sets).cast("int").alias("n"))
    heads = heads.join(n, "group").withColumn("i", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("n"))).select("group", "id", "known", "i")
    links = links.unionByName(_found(wide.select("id", "set").join(heads, "id").withColumn("j", F.col("i")).withColumn("chunk", F.col("i"))))
    found = connected_components(links, "a", "b")

    state = now().drop("chunk")
    sizes = state.groupBy("group", "known").agg(F.count("*").alias("n"))
    few = F.sum(F.when(F.col("n") * 2 < task_sets, F.col("n")).otherwise(0))
    split = sizes.groupBy("group").agg(F.greatest(F.ceil(few / task_sets), F.lit(1)).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    own = F.xxhash64("known", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / task_sets)))
    chunk = F.when(F.col("n") * 2 < task_sets, F.pmod(F.xxhash64("known"), F.col("m"))).otherwise(own)
    state = stash(state.join(sizes, ["group", "known"]).join(split, "group").select("group", "id", "known", chunk.alias("chunk")))
    chunks = state.groupBy("group", "chunk").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    whole = F.when(F.col("low") == F.col("high"), F.col("low"))
    one, two = (chunks.select("group", F.col("chunk").alias(x), whole.alias(f"whole_{x}")) for x in "ij")
    pairs = one.join(two, "group").where("i <= j AND NOT coalesce(whole_i = whole_j, false)").select("group", "i", "j")
    asked = pairs.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    tasks = state.join(asked, ["group", "chunk"]).join(wide.select("id", "set"), "id")
    return connected_components(links.unionByName(_found(tasks)), "a", "b")


def _joined(docs: DataFrame, task_shingles: int, task_sets: int) -> DataFrame:
    """(doc_id, print, n_shingles, component_id) of every row; print is a hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text")
    rows = stash(docs.mapInArrow(_prints, ", ".join(f"{x} long" for x in NAMES)))
    hot = rows.where("n = -1").groupBy("f1").agg(F.sum("f2").alias("docs")).orderBy(F.desc("docs"), "f1").limit(HOT).select("f1").toArrow()
    hot = hot["f1"].to_numpy().view(np.uint64)  # those of most documents first
    order = np.argsort(hot)
    hot = hot[order], len(order) - 1 - order
    prints = rows.where("n >= 0")
    # A class of equal sets is named by its smallest doc_id and both hashes, in bytes that sort like the doc_id.
    sign = F.lit(-(1 << 63))
    name = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (F.col("rep").bitwiseXOR(sign), F.col("f1"), F.col("f2"))]))
    classes = prints.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n", "own", "below").agg(F.min("doc_id").alias("rep"))
    classes = stash(classes.withColumn("id", name))
    known = docs.where("doc_id IS NOT NULL").select("text")
    keys = known.mapInArrow(_keys(docs.sparkSession.sparkContext.broadcast(hot)), "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    clusters = connected_components(keys.mapInArrow(_chain, "a long, b long"), "a", "b")

    members = classes.select("id", "f1", "f2", "n", "rep", F.explode(F.array("own", "below")).alias("node")).where("node IS NOT NULL")
    members = stash(members.join(clusters.select(F.col("id").alias("node"), F.col("component").alias("group")), "node").drop("node"))
    chunks = members.groupBy("group").agg(F.ceil(F.greatest(F.sum("n") / task_shingles, F.count("*") / task_sets)).cast("int").alias("chunks"))
    members = members.join(chunks, "group").withColumn("chunk", F.pmod(F.xxhash64("f1", "f2"), F.col("chunks")).cast("int"))
    places = members.groupBy("rep", "f1", "f2", "id").agg(F.collect_list(F.struct("group", "chunk", "chunks")).alias("places"))  # two at most
    sets = docs.join(places.withColumnRenamed("rep", "doc_id"), "doc_id").select("text", "f1", "f2", "id", "places")
    sets = stash(sets.mapInArrow(_sets, "id binary, places array<struct<group: long, chunk: int, chunks: int>>, `set` binary"))
    found = _within(sets, task_sets)

    least = F.conv(F.hex(F.substring("component", 1, 8)), 16, -10).cast("long").bitwiseXOR(sign)
    found = found.withColumn("least", least).select("id", "least")
    classes = classes.join(found, "id", "left").select("f1", "f2", F.coalesce("least", "rep").alias("component"))
    named = prints.where("n > 0 AND doc_id IS NOT NULL").join(classes, ["f1", "f2"]).select("doc_id", "print", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = prints.where("n = 0 OR doc_id IS NULL").select("doc_id", "print", "n", "doc_id")
    return named.union(alone)


def join(docs: DataFrame, task_shingles: int = TASK_SHINGLES, task_sets: int = TASK_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text).

    Documents are sets of distinct runs of five words and link at a Jaccard
    similarity of 0.8 or more; component_id is the smallest doc_id reachable.

    1. Equal sets collapse to one class, by two hashes of them.
    2. Sets that share a key (`keys_of`) are chained; the connected components
       of these chains, band by band of sizes, are clusters: no link leaves
       all of them.  Which shingles count as frequent has no part in that; it
       only keeps passages that many documents share from tying clusters together.
    3. Each cluster's sets meet in one task, which builds a signature tree and
       traverses it against itself.  Clusters of more than `task_shingles`
       shingles or `task_sets` sets are dealt into chunks and joined in rounds
       (`_within`), so that memory is bounded and nothing is left out.
    4. What the tasks found is joined by connected components.

    Null or empty texts have empty sets and link with nothing; rows with a null
    doc_id link with nothing and have a null component.  Repeated rows give a
    row each; rows of one doc_id with different texts are each looked at, and
    each has its own component, whatever their order.  Pairs at exactly 0.8
    link.  A very long text is one set, held by one task at a time, eight bytes
    for each of its shingles.  An empty table gives no rows.  Extra columns are
    not looked at.
    """
    return _joined(docs, task_shingles, task_sets).drop("print")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component, that of the smallest doc_id.

    Rows with a null doc_id, and repeated rows of the document that stays, stay;
    of rows with one doc_id and different texts each goes or stays by its own
    component.  All columns are as they were.
    """
    names = [free_name(docs.columns, x) for x in ("lg_dropped", "lg_print")]
    gone = _joined(docs, TASK_SHINGLES, TASK_SETS).where("doc_id <> component_id").select(F.col("doc_id").alias(names[0]), F.col("print").alias(names[1])).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(names[0])) & (F.xxhash64("text") == F.col(names[1])), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
