"""N-gram Jaccard join over prefix trees, exact for any threshold.

A document is its set of distinct word shingles. All sets follow one global order: rarer classes of n-grams first (by
counts of all n-grams of all documents, hashed to a fixed number of bins), hashes within a class. Two sets that reach
the threshold share n-grams early in that order, so only these beginnings meet; sets that share enough of them are candidates.

Sets that may link are brought together in cells of bounded size, and two cells are joined as a whole: the sets of one
form a trie, each from its commonest n-gram on (the global order read backwards), so that copies share long paths.
All sets of the other cell walk it at once, level by level: a path that several sets share is counted once, and a
subtree is left as soon as the n-grams that remain cannot reach the overlap that is needed, or if all of its
sets already hang together with the walker. No pair of documents is ever a row, but for the links found.

Components need no pairs inside a group that already hangs together. So documents are first compared with one star
centre each, the one with which they share most early n-grams. Then cells are made of what hangs together, and of what
is left around a centre, and every two cells that have candidates of different components are joined. So the components are exact.
Copies of a text are one node. Nodes are told apart by two hashes of 96 bits together.

Defined cases: a null text counts as empty; texts without words link with nothing, not even with each other; fewer
words than a shingle make one shingle; repeated rows are copies and link if they have words; a row with a null doc_id
takes part and gets the component's least doc_id (null if there is none); rows with one doc_id and other texts are
documents of their own; an empty table gives no rows. doc_ids are below 2**62.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import components
from sparkloom.llm.shared import SPACE_CLASS, TEXT_ROWS, boxed, byte_view, few, mixed, ragged, small_batches, staged, text_or_empty, unzipped, zipped
from sparkloom.llm.shingles import SHINGLE, shingle_sets

#: n-grams are counted in this many bins, whatever the size of the corpus; tasks hand their counts on in so many slices.
BIN_BITS, SLICES = 22, 64
#: n-grams that a task holds before it counts them.
COUNTED = 1 << 20
#: Bounds of a cell: sets, and n-grams of all of its sets (a longer set is a cell of its own, more or less).
CHUNK, CHUNK_GRAMS = 64, 100_000
#: Most cells of one n-gram in a list; sets in whose prefixes an n-gram is common, and that belong to no component, share cells.
LIST, COMMON = 256, 256
#: Small joins of cells are done together up to so many n-grams; so many sets walk a trie at once.
BATCH_GRAMS, WALKERS = 100_000, 32
#: Segments of a trie are counted in pieces of at most so many n-grams.
PIECE_GRAMS = 2_000_000
THRESHOLD = 80
#: Candidates share at least so many n-grams, and one more for every STEP of the smaller set, of prefixes that are longer by as
#: many less one (or all, where fewer are needed). Long texts share a few n-grams by chance, with ever more others as a corpus grows.
SHARED, STEP = 4, 32
#: Pairs of cells are joined in rounds that send at most so many times the n-grams of all sets that have candidates.
ROUND = 2
#: Pairs of cells are found in rounds of about so many meetings for each n-gram of these sets, or of so many meetings.
MEETINGS, FEW_MEETINGS = 0.25, 10_000_000
#: Texts that a task remembers, so that a copy's n-grams are not sent again.
KNOWN_TEXTS = 100_000
NO_ID = 1 << 62


def _key() -> list[Column]:
    return [F.xxhash64("_t").alias("ka"), F.hash("_t").cast("long").alias("kb")]


def _bins(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def _facts(docs: DataFrame, size: int) -> DataFrame:
    """Rows of two kinds from one pass: (ka, kb, n, least doc_id) of each text, and (slice, total, each task's packed counts) of the bins of all n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, held, n_held = np.zeros(1 << BIN_BITS, np.uint32), [np.zeros(0, np.int64)], 0
        for batch in batches:
            counts = []
            for _, _, sets, bounds in shingle_sets(*byte_view(batch.column("_t")), size):
                held.append(_bins(sets))
                n_held += len(sets)
                if n_held > COUNTED:
                    totals += np.bincount(np.concatenate(held), minlength=1 << BIN_BITS).astype(np.uint32)
                    held, n_held = [], 0
                counts.append(np.diff(bounds))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            none = [pa.nulls(len(batch), kind) for kind in (pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ka", "kb")), none[0], batch.column("doc_id"), pa.array(n, pa.int64()), none[1]], names)
        if held:
            totals += np.bincount(np.concatenate(held), minlength=1 << BIN_BITS).astype(np.uint32)
        slices = totals.reshape(SLICES, -1)
        none = pa.nulls(SLICES, pa.int64())
        packed = pa.array([_packed(x) for x in slices], pa.binary())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(np.arange(SLICES)), none, pa.array(slices.sum(axis=1, dtype=np.int64)), packed], names)

    names = ["ka", "kb", "slice", "doc_id", "n", "counts"]
    each = docs.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'counts' else 'long'}" for c in names)).groupBy("ka", "kb", "slice")
    sums = each.agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.sum("n").alias("total"), F.collect_list("counts").alias("counts"))
    return sums.select(F.monotonically_increasing_id().alias("node"), "ka", "kb", "n", "least", "slice", "total", "counts")


def _packed(counts: np.ndarray) -> bytes:
    """Counts by their bytes' places, the lowest ones first: most are small."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _classes(facts: DataFrame) -> np.ndarray:
    """The class of each bin: 0 unless its count stands out from chance, then higher with the excess."""
    slices = facts.where("slice is not null")
    mean = (slices.agg(F.sum("total")).first()[0] or 0) / (1 << BIN_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.column("counts")):
                totals = np.zeros((1 << BIN_BITS) // SLICES)
                for packed in row:
                    totals += _unpacked(packed.as_py())
                excess = np.maximum(0, totals - mean - 6 * np.sqrt(mean) - 1)
                classes = np.where(excess > 0, np.floor(np.log2(np.maximum(excess, 1))) + 1, 0).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column("slice").slice(k, 1), pa.array([zlib.compress(classes, 1)], pa.binary())], ["slice", "classes"])

    out = np.zeros((SLICES, (1 << BIN_BITS) // SLICES), np.int8)
    for r in slices.select("slice", "counts").mapInArrow(run, "slice long, classes binary").collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["classes"]), np.int8)
    return out.ravel()


def _lists(docs: DataFrame, classes: np.ndarray, size: int, threshold: int) -> DataFrame:
    """(ka, l): of each text, the n-grams in its prefix that another text has in its own, with their places in the global order.

    An n-gram that several texts of a batch have is known to be shared: the first of them meets the other batches, the rest
    travel under keys of their own. So a common n-gram is brought together once for each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ka = batch.column("ka").to_numpy(zero_copy_only=False)
            fresh = np.zeros(len(ka), bool)
            fresh[np.unique(ka, return_index=True)[1]] = True
            fresh &= np.array([k not in seen for k in ka.tolist()], bool)
            if len(seen) < KNOWN_TEXTS:
                seen.update(ka.tolist())
            for low, high, sets, bounds in shingle_sets(*byte_view(batch.column("_t")), size):
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((sets, classes[_bins(sets)], doc))
                at = np.arange(len(sets)) - bounds[:-1][doc]
                keep = (at < (n + (-threshold * n) // 100 + SHARED + n // STEP)[doc]) & fresh[doc + low]
                token, who = sets[order][keep], ka[doc[keep] + low]
                by = np.argsort(token, kind="stable")
                same = token[by][1:] == token[by][:-1]
                salt = np.zeros(len(token), np.int64)
                salt[by[:-1][same]] = 1
                salt[by[1:][same]] = 2 + (mixed(who[by[1:][same]].view(np.uint64)) & np.uint64(0x3FF)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (token.view(np.int64), who, at[keep], salt)], names)

    names = ["token", "ka", "at", "salt"]
    dealt = docs.mapInArrow(run, ", ".join(f"{c} long" for c in names)).repartition("token", F.greatest("salt", F.lit(1))).sortWithinPartitions("token", "ka")
    shared = dealt.mapInArrow(_shared, "token long, ka long, at long")
    return shared.groupBy("ka").agg(F.collect_set(F.struct("token", "at")).alias("l"))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by token and key: those whose token another key has too, or is known to have. Streams; holds one row back."""
    names = ["token", "ka", "at"]
    held: np.ndarray | None = None
    told = True
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if held is not None:
            rows = np.vstack([held, rows])
        if not len(rows):
            continue
        same = rows[1:, 0] == rows[:-1, 0]
        other = same & (rows[1:, 1] != rows[:-1, 1])
        wanted = rows[:, 3] > 0
        # Rows of one token and key stand together; the run's last row is marked by the next key, the next key's first by the one before.
        wanted[1:] |= other
        wanted[:-1] |= other
        out = wanted.copy()
        if held is not None and told:
            out[0] = False
        last_told = bool(out[-1]) or (len(rows) == 1 and held is not None and told)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows[out][:, :3].T], names)
        held, told = rows[-1:], last_told


def need_sql(a: str, b: str, threshold: int) -> str:
    """SQL: the least overlap of sets of these sizes that reaches the threshold."""
    return f"(({threshold} * ({a} + {b}) + {99 + threshold}) div {100 + threshold})"


def shared_sql(n: str) -> str:
    """SQL: how many n-grams of prefixes candidates share if the smaller set has this size."""
    return f"({SHARED} + {n} div {STEP})"


def needed(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    return (threshold * (a + b) + 99 + threshold) // (100 + threshold)


def can_link(a: str, b: str, threshold: int) -> str:
    """SQL: the token at these places may be among the first that two linked sets share, as many as candidates must."""
    need, first = need_sql(f"{a}.n", f"{b}.n", threshold), shared_sql(f"least({a}.n, {b}.n)")
    return f"({a}.at + {need} < {a}.n + {first} and {b}.at + {need} < {b}.n + {first})"


class Forest:
    """One path-compressed prefix tree for each group of ordered sets (ascending token numbers), built by sorting.

    Nodes below ``len(sets)`` are leaves, one for each set; the others are the places where paths part. A node's segment
    is what its path has beyond its parent's. ``order`` tells which set a leaf stands for.
    """

    def __init__(self, sets: list[np.ndarray], groups: list[int]) -> None:
        m = len(sets)
        self.order = sorted(range(m), key=lambda k: (groups[k], sets[k].astype(">i4").tobytes()))
        own = [sets[k] for k in self.order]
        low, high, depth, parent = list(range(m)), list(range(1, m + 1)), [len(s) for s in own], [-1] * m
        self.roots: dict[int, int] = {}
        open_nodes: list[int] = []
        for k, (a, b) in enumerate(pairwise([*self.order, -1])):
            part = -1
            if b >= 0 and groups[a] == groups[b]:
                least = min(len(own[k]), len(own[k + 1]))
                differ = own[k][:least] != own[k + 1][:least]
                part = int(differ.argmax()) if differ.any() else least
            last = k
            while open_nodes and depth[open_nodes[-1]] > part:
                parent[last] = last = open_nodes.pop()
                high[last] = k + 1
            if part < 0:
                self.roots[groups[a]] = last
            elif open_nodes and depth[open_nodes[-1]] == part:
                parent[last] = open_nodes[-1]
            else:
                open_nodes.append(len(depth))
                parent[last] = len(depth)
                low.append(low[last])
                high.append(0)
                depth.append(part)
                parent.append(-1)
        self.low, self.high, self.depth, self.parent = (np.array(x, np.int64) for x in (low, high, depth, parent))
        start = np.where(self.parent < 0, 0, self.depth[self.parent])
        self.size = self.depth - start
        self.tokens = np.concatenate([own[a][s:d] for a, s, d in zip(low, start.tolist(), depth, strict=True)])
        self.head = np.cumsum(self.size) - self.size
        self.last = np.array([own[a][d - 1] if d else -1 for a, d in zip(low, depth, strict=True)], np.int64)
        length = self.depth[:m]
        self.least, self.most = self.over(np.minimum, length), self.over(np.maximum, length)
        self.children = np.argsort(self.parent, kind="stable")
        self.first_child = np.searchsorted(self.parent[self.children], np.arange(len(depth)))
        self.n_children = np.bincount(self.parent[self.parent >= 0], minlength=len(depth))

    def over(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        """For each node, ``how`` over the values of its leaves (in their order)."""
        return how.reduceat(np.append(values, values[-1:]), np.column_stack([self.low, self.high]).ravel())[::2]

    def walked(self, walkers: list[np.ndarray], roots: list[int], comp: np.ndarray, leaf_comp: np.ndarray, n_tokens: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(walker, leaf) of all that reach the threshold and have different ``comp``; all walkers go down together, level by level."""
        sizes = np.array([len(w) for w in walkers], np.int64)
        keys = np.concatenate([w + k * n_tokens for k, w in enumerate(walkers)])
        begin = np.cumsum(sizes) - sizes
        inside = np.zeros(len(walkers) * n_tokens, bool)
        inside[keys] = True
        low, high = self.over(np.minimum, leaf_comp), self.over(np.maximum, leaf_comp)
        who, node, overlap = np.arange(len(walkers)), np.array(roots, np.int64), np.zeros(len(walkers), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            go = (low[node] != comp[who]) | (high[node] != comp[who])
            who, node, overlap = who[go], node[go], overlap[go]
            size = self.size[node]
            for a, b in _pieces(size):
                owner, at = ragged(self.head[node[a:b]], size[a:b])
                overlap[a:b] += np.bincount(owner[inside[who[a:b][owner] * n_tokens + self.tokens[at]]], minlength=b - a)
            passed = np.searchsorted(keys, who * n_tokens + self.last[node], side="right") - begin[who]
            left = np.minimum(sizes[who] - passed, self.most[node] - self.depth[node])
            go = overlap + left >= needed(sizes[who], self.least[node], threshold)
            who, node, overlap = who[go], node[go], overlap[go]
            leaf = node < len(self.order)
            found.append((who[leaf], node[leaf]))
            who, node, overlap = who[~leaf], node[~leaf], overlap[~leaf]
            owner, at = ragged(self.first_child[node], self.n_children[node])
            who, node, overlap = who[owner], self.children[at], overlap[owner]
        return np.concatenate([f[0] for f in found] or [who]), np.concatenate([f[1] for f in found] or [node])


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges whose sizes add up to PIECE_GRAMS at most, or of one element."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE_GRAMS, side="right")))
        yield first, last
        first = last


Member = tuple[int, int, int, np.ndarray]


def tied(members: list[Member], classes: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between components that hang together through sets of one group; enough of them, not all.

    ``members`` are (group, side, component, set of hashes); sets of side 0 walk those of side 1, sets of side 2 are both.
    """
    tokens, number = np.unique(np.concatenate([m[3] for m in members]), return_inverse=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, classes[_bins(tokens)]))[::-1]] = np.arange(len(tokens))
    number = rank[number]
    bounds = np.cumsum([0, *(len(m[3]) for m in members)])
    sets = [np.sort(number[a:b]) for a, b in pairwise(bounds)]
    leaves = [k for k, m in enumerate(members) if m[1]]
    groups = {m[0] for k, m in enumerate(members) if m[1]}
    walkers = [k for k, m in enumerate(members) if m[1] != 1 and m[0] in groups]
    if not walkers:
        return []
    forest = Forest([sets[k] for k in leaves], [members[k][0] for k in leaves])
    _, comp = np.unique(np.array([m[2] for m in members], np.int64), return_inverse=True)
    name = {c: m[2] for c, m in zip(comp.tolist(), members, strict=True)}
    at_leaf = np.array([leaves[k] for k in forest.order])
    links = []
    for a in range(0, len(walkers), WALKERS):
        some = walkers[a : a + WALKERS]
        who, leaf = forest.walked([sets[k] for k in some], [forest.roots[members[k][0]] for k in some], comp[some], comp[at_leaf], len(tokens), threshold)
        into = np.arange(len(name))
        for x, y in np.unique(np.column_stack([comp[some][who], comp[at_leaf][leaf]]), axis=0).tolist():
            while into[x] != x:
                x = into[x]
            while into[y] != y:
                y = into[y]
            if x != y:
                into[max(x, y)] = min(x, y)
                links.append((name[x], name[y]))
        while (into[into] != into).any():
            into = into[into]
        comp = into[comp]
    return links


def _joined(uses: DataFrame, texts: DataFrame, classes: np.ndarray, size: int, threshold: int) -> DataFrame:
    """(a, b): links between components within groups. ``uses``: ga and gb name a group; node, side and comp; ``texts``: node, _z."""
    found = texts.join(uses, "node").select("ga", "gb", "side", "comp", "_z").repartition("ga", "gb").sortWithinPartitions("ga", "gb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Member] = []
        now, group, grams = None, 0, 0

        def close() -> pa.RecordBatch:
            columns = list(zip(*tied(held, classes, threshold), strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            ga, gb, side, comp = (batch.column(c).to_pylist() for c in ("ga", "gb", "side", "comp"))
            for first, last, sets, bounds in shingle_sets(*byte_view(pa.array(unzipped(batch.column("_z")), pa.binary())), size):
                for k in range(first, last):
                    if now != (ga[k], gb[k]):
                        if grams > BATCH_GRAMS:
                            yield close()
                            held, grams = [], 0
                        now, group = (ga[k], gb[k]), group + 1
                    held.append((group, side[k], comp[k], sets[bounds[k - first] : bounds[k - first + 1]].copy()))
                    grams += len(held[-1][3])
        if held:
            yield close()

    return found.mapInArrow(run, "a long, b long")


def _chunked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, n) with chunk: a hash of node modulo as many chunks as keep each within the bounds of a cell."""
    n_chunks = rows.groupBy(key).agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_GRAMS)).alias("chunks"))
    return rows.join(n_chunks, key).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).drop("chunks")


def _stars(entries: DataFrame, threshold: int) -> DataFrame:
    """(node, n, a, home): the star centre with which a node shares most of its early tokens, and where it belongs otherwise.

    Every token has one centre. ``a`` is null where no centre may link; ``home`` is the centre of the node's commonest
    token, null where none is common.
    """
    lead = entries.groupBy("token").agg(F.min_by(F.struct("node", "n", "at"), F.xxhash64("node")).alias("c"), F.count("*").alias("often"))
    met = entries.alias("e").join(lead.select("token", "often", "c.*").alias("c"), "token")
    may = f"(c.node <> e.node and {can_link('c', 'e', threshold)})"
    met = met.where(f"{may} or often >= {COMMON}").select(F.col("c.node").alias("a"), "e.node", F.col("c.n").alias("na"), "e.n", F.expr(may).alias("may"), "often")
    each = met.groupBy("a", "node").agg(F.count_if("may").alias("k"), F.max("often").alias("often"), F.first("na").alias("na"), F.first("n").alias("n"))
    enough = F.expr(f"k >= least({shared_sql('least(na, n)')}, {need_sql('na', 'n', threshold)})")
    best = F.max_by(F.when(enough, F.col("a")), F.when(enough, F.struct("k", F.expr("-a"))))
    home = F.max_by("a", F.when(F.col("often") >= COMMON, F.struct("often", "a")))
    return each.groupBy("node").agg(F.first("n").alias("n"), best.alias("a"), home.alias("home")).where("a is not null or home is not null")


def _meetings(entries: DataFrame, threshold: int) -> DataFrame:
    """(token, chunk, chunks, k, l): the cells that have a token, in lists of bounded length; k of them in all. ``entries``: token, cell, comp, n, at.

    In a cell's row for a token, ``least`` is the size of its smallest set, and ``most`` bounds the sizes of the sets that any
    of its sets may link with on account of this token. Tokens of one component are left out.
    """
    reach = f"({100 + threshold} * (n + {shared_sql('n')} - 1 - at)) div {threshold} - n"
    each = entries.groupBy("token", "cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max(F.expr(reach)).alias("most"))
    mixed_tokens = each.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("k")).where("low < high").select("token", "k", F.ceil(F.col("k") / LIST).alias("chunks"))
    dealt = each.join(mixed_tokens, "token").withColumn("chunk", F.pmod(F.col("cell"), F.col("chunks")))
    lists = dealt.groupBy("token", "chunk").agg(F.first("chunks").alias("chunks"), F.first("k").alias("k"), F.sort_array(F.collect_list(F.struct("cell", "low", "high", "least", "most"))).alias("l"))
    return lists


def _cell_pairs(lists: DataFrame, threshold: int, rounds: int = 1, k: int = 0) -> DataFrame:
    """(ga, gb): cells with sets of different components that may link, a cell with itself too; in round ``k`` those whose lesser cell falls to it."""
    may = "(x.low <> y.low or x.high <> y.high or x.low <> x.high) and x.least <= y.most and y.least <= x.most"
    want = f"least({shared_sql('least(x.least, y.least)')}, {need_sql('x.least', 'y.least', threshold)})"
    pair = f"struct(x.cell as ga, y.cell as gb, {want} as want)"
    turn = f"pmod(xxhash64(x.cell), {rounds}) = {k}" if rounds > 1 else "true"

    def met(some: str, others: str) -> Column:
        return F.explode(F.expr(f"flatten(transform({some}, (x, i) -> if({turn}, transform(filter({others}, y -> {may}), y -> {pair}), array())))")).alias("h")

    within = lists.select(met("l", "slice(l, i + 1, size(l))"))
    long = lists.where("chunks > 1")
    one, two = (long.select("token", F.col("chunk").alias(f"c{s}"), F.col("l").alias(f"l{s}")) for s in "ab")
    between = one.join(two, "token").where("ca <> cb").select(met("la", "filter(lb, y -> y.cell > x.cell)"))
    return within.unionAll(between).groupBy("h.ga", "h.gb").agg(F.count("*").alias("k"), F.min("h.want").alias("want")).where("k >= want").select("ga", "gb")


def _pairs_in_rounds(entries: DataFrame, placed: DataFrame, n_sets: int, threshold: int) -> DataFrame:
    """All pairs of cells, staged. A token's cells all meet, so meetings may grow faster than the input; the rounds bound how many lie on disk at once."""
    lists = staged(_meetings(entries, threshold), "meetings", n_sets)
    met = lists.agg(F.sum(F.expr("size(l) * (k + 1) / 2"))).first()[0] or 0
    own = placed.agg(F.sum("n")).first()[0] or 0
    rounds = max(1, -(-int(met) // max(1, int(MEETINGS * own), FEW_MEETINGS)))
    return reduce(DataFrame.unionAll, [staged(_cell_pairs(lists, threshold, rounds, k), "pairs", n_sets) for k in range(rounds)])


def _joined_in_rounds(pairs: DataFrame, placed: DataFrame, texts: DataFrame, classes: np.ndarray, size: int, threshold: int) -> DataFrame:
    """(a, b): links between components within ``pairs`` of cells. The rounds bound what lies on disk at once, however many pairs there are."""
    both = "if(ga = gb, array(struct(ga as cell, 2 as side)), array(struct(ga as cell, 0 as side), struct(gb as cell, 1 as side)))"
    uses = pairs.select("ga", "gb", F.inline(F.expr(both)))
    grams = placed.groupBy("cell").agg(F.sum("n").alias("n"))
    sent, own = uses.join(grams, "cell").agg(F.sum("n")).first()[0] or 0, placed.agg(F.sum("n")).first()[0] or 0
    rounds = max(1, -(-sent // max(1, int(ROUND * own))))
    found = []
    for k in range(rounds):
        some = uses.where(F.pmod(F.xxhash64("ga", "gb"), F.lit(rounds)) == k) if rounds > 1 else uses
        links = _joined(some.join(placed, "cell").select("ga", "gb", "side", "node", "comp"), texts, classes, size, threshold)
        found.append(staged(links, "found", -(-sent // (rounds * BATCH_GRAMS))) if rounds > 1 else links)
    return reduce(DataFrame.unionAll, found)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, ka, kb, n_shingles, component and component_id of every row.

    A component is what links of the threshold tie together; component_id is its least doc_id. ka and kb are hashes of the
    row's text, and component is the number of one of its texts (null without words). Copies of a text have one component.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_t")).select("doc_id", "_t", *_key())
    n_docs = docs.count()
    facts = staged(_facts(own, size), "shingle-facts", n_docs + (1 << 17))
    classes = _classes(facts)
    texts_of = facts.where("slice is null").drop("slice", "total", "counts")
    nodes = texts_of.where("n > 0").withColumn("pick", F.coalesce("least", F.lit(-1)))
    # A node with a partner shares as many tokens as the least partner's size asks for, or all that it must share. Two texts with one ka would get both texts' tokens, which only adds candidates.
    small = f"(({threshold} * n + 99) div 100)"
    lists = _lists(own.select("_t", "ka"), classes, size, threshold).join(nodes, "ka").where(f"size(l) >= least({shared_sql(small)}, {small})")
    lists = staged(lists.select("node", "n", "ka", "kb", "pick", "l"), "prefixes", n_docs)
    many = lists.count()
    copies = zipped(own.select("_t", "ka", "kb", F.coalesce("doc_id", F.lit(-1)).alias("pick")).where("_t <> ''"))
    texts = staged(copies.join(lists.select("node", "ka", "kb", "pick"), ["ka", "kb", "pick"]).dropDuplicates(["ka", "kb", "pick"]).select("node", "_z"), "texts", many, TEXT_ROWS)

    stars = staged(_stars(lists.select("node", "n", F.inline("l")), threshold), "stars", many)
    arms = _chunked(stars.where("a is not null"), "a").select(F.col("a").alias("ga"), F.col("chunk").alias("gb"), "node", F.lit(1).alias("side"))
    centres = arms.select("ga", "gb", F.col("ga").alias("node"), F.lit(0).alias("side")).distinct()
    first = components(_joined(arms.unionAll(centres).withColumn("comp", F.col("node")), texts, classes, size, threshold), many)

    placed = lists.select("node", "n").join(first, "node", "left").join(stars.drop("n"), "node", "left")
    base = F.when(F.col("component").isNotNull(), F.col("component") * 2).otherwise(F.coalesce("home", "a", "node") * 2 + 1)
    placed = _chunked(placed.select("node", "n", F.coalesce("component", "node").alias("comp"), base.alias("base")), "base")
    placed = staged(placed.select("node", "n", "comp", F.xxhash64("base", "chunk").alias("cell")), "cells", many)
    entries = lists.select("node", "l").join(placed, "node").select("n", "comp", "cell", F.inline("l"))
    pairs = _pairs_in_rounds(entries, placed, many, threshold)
    last = components(_joined_in_rounds(pairs, placed, texts, classes, size, threshold), many).select(F.col("node").alias("comp"), "component")

    held = placed.select("node", "comp").join(last, "comp", "left").select("node", F.coalesce("component", "comp").alias("component"))
    ids = staged(texts_of.join(held, "node", "left").select("ka", "kb", "n", "least", F.coalesce("component", "node").alias("component")), "components", n_docs)
    least = ids.where("n > 0").groupBy("component").agg(F.min("least").alias("least"))
    ids = ids.drop("least").join(least, "component", "left")
    out = few(own.drop("_t").join(ids, ["ka", "kb"]), n_docs)
    some = F.col("n") > 0
    return out.select("doc_id", "ka", "kb", F.col("n").alias("n_shingles"), F.when(some, F.col("component")).alias("component"), F.when(some, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the least doc_id (a null one last).

    Rows that are equal in doc_id and text count as one. Texts without words are all kept. Only the row's keys are
    shuffled, texts not, unless the table of kept keys is too large to send around.
    """
    found = near_duplicates(docs, size, threshold).select("doc_id", "ka", "kb", "n_shingles", "component")
    some = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "ka", "kb")).alias("best"))
    kept = some.select(F.coalesce("best.doc_id", F.lit(NO_ID)).alias("_d"), F.col("best.ka").alias("_ka"), F.col("best.kb").alias("_kb"))
    rows = docs.select(boxed(docs.columns), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"), text_or_empty().alias("_t"))
    rows = rows.select("_row", "_d", F.xxhash64("_t").alias("_ka"), F.hash("_t").cast("long").alias("_kb"), F.col("_t").rlike(f"[^{SPACE_CLASS[1:-1]}]").alias("_some"))
    best = rows.where("_some").join(kept, ["_d", "_ka", "_kb"], "left_semi").dropDuplicates(["_d", "_ka", "_kb"])
    return best.select("_row.*").unionByName(rows.where("not _some").select("_row.*"))


def op10_jaccard_join(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def op10_sql() -> str:
    """Brute force: shingles of all documents, joined on equal shingles, and reachability by recursion."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 80 * (x.n + y.n - p.k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = w.doc_id"""
