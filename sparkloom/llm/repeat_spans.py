"""Suffix-array dedup: removes every byte covered by a string of WIDTH bytes that also starts elsewhere.

Every window of WIDTH bytes belongs to an anchor: the k-gram inside it with the least hash, leftmost among equals.
Equal windows have equal anchors at equal places, so only windows of anchors whose k-gram occurs again can repeat; and
neighbouring windows of one anchor make one run, whose bytes are its context. Runs with an equal context repeat as a
whole. The other runs of shared anchors, one for each distinct context, go to shards. A shard builds the suffix array
of its contexts by Larsson-Sadakane refinement (only groups that are still tied are sorted again, by the rank that
lies as far ahead as is already sorted), the common prefixes by Kasai's rule (all contexts step in parallel), and
finds windows that share WIDTH bytes with a neighbour.

An anchor's runs go to one shard, unless there are too many; then they are split over several. Each of these shards gives a
sorted run of digests of its windows, and the runs are merged two by two, the digests of one looked up in the other by binary
search, in shares of the digests of bounded size. So no task holds an unbounded group.

Defined cases: a null text is empty; texts shorter than WIDTH bytes are left alone; repeated rows are copies of one
another, so all of their windows repeat; an empty table gives no rows; bytes are UTF-8, and kept text
for later stages drops the remains of characters that a removed span cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.shared import TEXT_ROWS, boxed, byte_view, few, mixed, prefix_sums, small_batches, span_hash, staged, steps, text_or_empty, unzipped, zipped

WIDTH = 200
GRAM = 64
BASE = 0xA24BAED4963EE407
#: Bytes of contexts in a shard, and contexts of one anchor beyond which it is split over shards.
SHARD_BYTES = 1_000_000
MOST_RUNS = 2_000
SEPARATOR = 0xFF

_KEY_BITS = 0xFFFFFF


def _key() -> list[Column]:
    """Two hashes that name a row: of doc_id and text, and 24 bits of another."""
    return [F.xxhash64("doc_id", "_t").alias("ka"), F.hash("_t", "doc_id").bitwiseAND(_KEY_BITS).cast("long").alias("kb")]


def anchor_runs(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (string, first start in it, number of starts, hash of the k-gram, hash of the context)."""
    n = len(data)
    count = width - gram + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(data.astype(np.uint64) + np.uint64(1), BASE)
    at = np.arange(n - gram + 1)
    best = (span_hash(sums, at, at + gram, BASE) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    reach = 1
    while reach * 2 <= count:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if count > reach:
        best = np.minimum(best[: len(best) - (count - reach)], best[count - reach :])
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    valid = np.arange(len(anchor)) + width <= offsets[1:][owner]
    edge = np.ones(len(anchor) + 1, bool)
    edge[1:-1] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(edge)
    size = np.diff(first)
    first = first[:-1]
    keep = valid[first]
    first, size = first[keep], size[keep]
    a = anchor[first]
    return owner[first], first - offsets[owner[first]], size, span_hash(sums, a, a + gram, BASE), span_hash(sums, first, first + size - 1 + width, BASE)


def _runs(docs: DataFrame, width: int) -> DataFrame:
    """(kh, ch, ka, p, known): runs of all documents; p packs 24 bits of the row's key, the first start and the number of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, kb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ka", "kb"))
            data, offsets = byte_view(batch.column("_t"))
            for low, high in steps(offsets):
                doc, start, size, kh, ch = anchor_runs(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], width)
                known = twins_here(kh, ch)
                places = packed(kb[doc + low], start, size)
                kh = np.where(known == 2, mixed(ka[doc + low].view(np.uint64) ^ mixed(places.view(np.uint64))), kh)
                columns = [kh.view(np.int64), ch.view(np.int64), ka[doc + low], places, known]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["kh", "ch", "ka", "p", "known"])

    return docs.mapInArrow(run, "kh long, ch long, ka long, p long, known long")


def twins_here(kh: np.ndarray, ch: np.ndarray) -> np.ndarray:
    """Of the runs at hand: 0 for those without an equal one, 1 for the first of equal ones, 2 for the others.

    Only the first needs to meet the runs of other places. The others are settled: they travel under keys of their own, so
    that a passage repeated everywhere is brought together once for each place.
    """
    known = np.zeros(len(kh), np.int64)
    order = np.lexsort((ch, kh))
    same = np.zeros(len(kh) + 1, bool)
    same[1:-1] = (kh[order][1:] == kh[order][:-1]) & (ch[order][1:] == ch[order][:-1])
    known[order] = np.where(same[:-1], 2, np.where(same[1:], 1, 0))
    return known


def packed(kb: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (kb << 40) | (start << 8) | (size - 1)


def unpacked(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First starts and numbers of starts."""
    return (p >> 8) & 0xFFFFFFFF, (p & 0xFF) + 1


def _shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by kh and ch: those whose kh occurs again or whose twin is known, with twin: ch occurs again.

    Streams; holds one row back, with two more columns: it shares kh, and ch, with the row before.
    """
    held: np.ndarray | None = None
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns] + [np.zeros((batch.num_rows, 2), np.int64)])
        rows = rows if held is None else np.vstack([held, rows])
        if not len(rows):
            continue
        same = rows[1:, 0] == rows[:-1, 0]
        twin = same & (rows[1:, 1] == rows[:-1, 1])
        rows[1:, 5] |= same
        rows[1:, 6] |= twin
        held = rows[-1:].copy()
        rows = rows[:-1]
        wanted = (rows[:, 4] > 0) | (rows[:, 5] == 1) | same
        yield _twins(rows[wanted], ((rows[:, 4] > 0) | (rows[:, 6] == 1) | twin)[wanted])
    if held is not None:
        rows = held[(held[:, 4] > 0) | (held[:, 5] == 1)]
        yield _twins(rows, (rows[:, 4] > 0) | (rows[:, 6] == 1))


def _twins(rows: np.ndarray, twin: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:, :4].T), pa.array(twin, pa.bool_())], ["kh", "ch", "ka", "p", "twin"])


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``text`` (uint8), ordered by at least the first ``depth`` bytes, and the ranks.

    Larsson-Sadakane refinement from ranks of 8 bytes on: a tied group is sorted by the ranks ``h`` places ahead.
    A rank is the place of the group's last member.
    """
    n = len(text)
    words = eight_bytes(text)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)

    def number(places: np.ndarray, members: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks members, which stand at ascending ``places``; ``new`` marks where a group begins. Returns which are tied."""
        last = np.append(np.flatnonzero(new)[1:] - 1, len(members) - 1)
        size = np.diff(np.append(np.flatnonzero(new), len(members)))
        rank[members] = np.repeat(places[last], size)
        return np.repeat(size > 1, size)

    new = np.ones(n, bool)
    new[1:] = words[order][1:] != words[order][:-1]
    places = np.arange(n)
    places = places[number(places, order, new)]
    h = 8
    while h < depth and len(places):
        members = order[places]
        ahead = members + h
        key = rank[members] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[places] = members
        new = np.ones(len(members), bool)
        new[1:] = key[1:] != key[:-1]
        places = places[number(places, members, new)]
        h *= 2
    final = np.empty(n, np.int64)
    final[order] = np.arange(n)
    return order, final


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The big-endian number of the 8 bytes from each place on (zeros after the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(text), np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(text)]
    return words


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """For each place in the suffix array, the bytes (``most`` at most) shared with the suffix before it.

    Kasai's rule: one place on in the text, at most one byte is lost. It holds below ``most``, the depth to which the
    suffixes are sorted; beyond it ties are in any order and the next place starts anew. Each of the texts at
    ``starts`` is a chain of its own, and all chains take a step together.
    """
    words = np.concatenate([eight_bytes(text), np.zeros(most + 8, np.uint64)])
    lcp = np.zeros(len(text), np.int64)
    length = np.zeros(len(starts), np.int64)
    by = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by], sizes[by]
    for step in range(int(sizes.max(initial=0))):
        lanes = int(np.searchsorted(-sizes, -step, side="left"))
        at = starts[:lanes] + step
        place = rank[at]
        before = order[place - 1]
        now = np.where(length[:lanes] < most, np.maximum(length[:lanes] - 1, 0), 0)
        now[place == 0] = 0
        go = np.flatnonzero((now < most) & (place > 0))
        while len(go):
            differ = words[at[go] + now[go]] ^ words[before[go] + now[go]]
            equal = differ == 0
            now[go[equal]] += 8
            rest = go[~equal]
            high = differ[~equal]
            shared = np.zeros(len(rest), np.int64)
            for k in range(1, 8):
                shared += high < np.uint64(1) << np.uint64(64 - 8 * k)
            now[rest] += shared
            go = go[equal]
            go = go[now[go] < most]
        length[:lanes] = np.minimum(now, most)
        lcp[place] = length[:lanes]
    return lcp


def repeated_starts(contexts: list[bytes], width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each context (its windows are its runs' windows): which windows repeat in this shard, and the windows' classes."""
    sizes = np.array([len(c) + 1 for c in contexts])
    text = np.frombuffer(bytes([SEPARATOR]).join(contexts) + bytes([SEPARATOR]), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    depth = max(8, 1 << (width - 1).bit_length())
    order, rank = suffix_array(text, depth)
    lcp = common_prefixes(text, order, rank, starts, sizes, depth)
    label = np.empty(len(text), np.int64)
    label[order] = np.cumsum(lcp < width)
    counts = sizes - 1 - width + 1
    places = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
    labels = label[places]
    often = np.bincount(labels)[labels] > 1
    cuts = np.cumsum(counts)[:-1]
    return np.split(often, cuts), np.split(labels, cuts)


def _pieces(often: np.ndarray, p: int) -> list[int]:
    """The packed runs of the repeated windows of a run."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], often.astype(np.int8), [0]])))
    start = (p >> 8) & 0xFFFFFFFF
    return [(p >> 40 << 40) | (int(start + a) << 8) | int(b - a - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _contexts(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """Adds the bytes of each run's context: one row for each of ``reps`` (kh, ch, ka, p, twin, runs)."""
    lists = reps.groupBy("ka", F.shiftrightunsigned("p", 40).alias("kb")).agg(F.collect_list(F.struct("kh", "ch", "p", "twin", "runs")).alias("l"))
    # Copies of one row (same doc_id and text) share their key; one of them serves.
    found = zipped(docs.select("ka", "kb", "_t")).join(lists, ["ka", "kb"]).select("ka", "_z", "l")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for ka, data, some in zip(batch.column("ka").to_pylist(), unzipped(batch.column("_z")), batch.column("l"), strict=True):
                for r in some.as_py():
                    start, size = (r["p"] >> 8) & 0xFFFFFFFF, (r["p"] & 0xFF) + 1
                    rows.append((r["kh"], r["ch"], ka, r["p"], r["twin"], r["runs"], data[start : start + size - 1 + width]))
                    held += size + width
                if held > 4_000_000:
                    yield _context_batch(rows)
                    rows, held = [], 0
            yield _context_batch(rows)

    return found.mapInArrow(run, "kh long, ch long, ka long, p long, twin boolean, runs long, context binary")


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kh", "ch", "ka", "p", "twin", "runs", "context"])


def _sharded(contexts: DataFrame, n_shards: int, width: int) -> DataFrame:
    """(ka, p) of repeated runs within shards; for split anchors also (ka, p, shard, digest) of each class of windows."""
    share = F.when(F.col("runs") > MOST_RUNS, F.pmod(F.xxhash64("ch"), F.ceil(F.col("runs") / MOST_RUNS))).otherwise(F.lit(0).cast("long"))
    dealt = contexts.withColumn("shard", F.pmod(F.xxhash64("kh", share), F.lit(n_shards)))
    dealt = dealt.dropDuplicates(["kh", "ch"]).repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "ka", "p", "twin", "runs", "context")]
            for shard, *row in zip(*columns, strict=True):
                if shard != now:
                    if rows:
                        yield close(now, rows)
                    now, rows = shard, []
                rows.append(row)
        if rows:
            yield close(now, rows)

    def close(shard: int, rows: list[list]) -> pa.RecordBatch:
        often, labels = repeated_starts([r[4] for r in rows], width)
        out: list[tuple] = []
        told: set[int] = set()
        for (ka, p, twin, runs, context), some, label in zip(rows, often, labels, strict=True):
            if not twin:
                out += [(ka, q, None, None) for q in _pieces(some, p)]
            if runs > MOST_RUNS:
                for k, name in enumerate(label.tolist()):
                    if name not in told:
                        told.add(name)
                        own = (p >> 40 << 40) | ((((p >> 8) & 0xFFFFFFFF) + k) << 8)
                        digest = hashlib.blake2b(context[k : k + width], digest_size=16).digest()
                        out.append((ka, own, shard, digest))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ka", "p", "shard", "digest"])

    return dealt.mapInArrow(run, "ka long, p long, shard long, digest binary")


#: Digests that a task merges at once.
MERGED = 200_000

#: Digests of windows in ascending order, the window (ka, p) that stands for each, and whether it is told as repeated.
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def merged_pair(a: Run, b: Run) -> tuple[Run, list[tuple[int, int]]]:
    """Two runs as one, and the windows found repeated: each digest of ``b`` is looked up in ``a`` by binary search."""
    place = np.searchsorted(a[0], b[0])
    hit = place < len(a[0])
    hit[hit] = a[0][place[hit]] == b[0][hit]
    at = place[hit]
    new_a, new_b = at[~a[3][at]], np.flatnonzero(hit)[~b[3][hit]]
    found = [*zip(a[1][new_a].tolist(), a[2][new_a].tolist(), strict=True), *zip(b[1][new_b].tolist(), b[2][new_b].tolist(), strict=True)]
    a[3][at] = True
    return tuple(np.insert(x, place[~hit], y[~hit]) for x, y in zip(a, b, strict=True)), found


def _merged(classes: DataFrame, n_parts: int) -> DataFrame:
    """(ka, p): windows of split anchors that several shards have. Shards' sorted runs are merged two by two, in ``n_parts`` shares of the digests."""
    dealt = classes.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(n_parts))).repartition("part").sortWithinPartitions("part", "shard", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        runs: list[Run] = []
        rows: list[tuple[bytes, int, int]] = []

        def close_run() -> None:
            if rows:
                d, ka, p = zip(*rows, strict=True)
                runs.append((np.array(d, "S16"), np.array(ka, np.int64), np.array(p, np.int64), np.zeros(len(d), bool)))
                rows.clear()

        def close_part() -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            while len(runs) > 1:
                pairs = [merged_pair(x, y) for x, y in zip(runs[::2], runs[1::2], strict=False)]
                found += [f for _, some in pairs for f in some]
                runs[:] = [r for r, _ in pairs] + (runs[-1:] if len(runs) % 2 else [])
            runs.clear()
            columns = list(zip(*found, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["ka", "p"])

        for batch in batches:
            for part, shard, digest, ka, p in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "digest", "ka", "p")), strict=True):
                if now != (part, shard):
                    close_run()
                    if now and now[0] != part:
                        yield close_part()
                    now = (part, shard)
                rows.append((digest, ka, p))
        close_run()
        yield close_part()

    return dealt.mapInArrow(run, "ka long, p long")


def repeated_runs(docs: DataFrame, n_docs: int, width: int = WIDTH) -> DataFrame:
    """(ka, p): the runs of repeated windows of all ``n_docs`` rows of ``docs`` (_t, ka, kb)."""
    runs = _runs(docs, width).repartition("kh").sortWithinPartitions("kh", "ch").mapInArrow(_shared_runs, "kh long, ch long, ka long, p long, twin boolean")
    runs = staged(runs, "runs", n_docs, TEXT_ROWS)
    distinct = runs.groupBy("kh", "ch").agg(F.first("ka").alias("ka"), F.first("p").alias("p"), F.first("twin").alias("twin"))
    mixed = distinct.groupBy("kh").agg(F.count("*").alias("runs")).where("runs > 1")
    reps = staged(distinct.join(mixed, "kh"), "contexts", n_docs, TEXT_ROWS)
    starts = F.col("p").bitwiseAND(0xFF)
    total = reps.agg(F.sum(starts + width)).first()[0] or 0
    found = staged(_sharded(_contexts(docs, reps, width), max(1, -(-total // SHARD_BYTES)), width), "shards")
    classes = found.where("digest is not null")
    merged = _merged(classes, max(1, -(-classes.count() // MERGED)))
    return runs.where("twin").select("ka", "p").unionAll(found.where("digest is null").select("ka", "p")).unionAll(merged)


def mask(size: int, runs: np.ndarray, width: int) -> np.ndarray:
    """Which bytes of a text of ``size`` bytes the runs cover."""
    edges = np.zeros(size + 1, np.int64)
    start, count = unpacked(runs)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + count - 1 + width, -1)
    return np.cumsum(edges[:-1]) > 0


def _with_runs(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` without text, with _z (the text, compressed), _null and the list _runs of each row's repeated runs."""
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.withColumn("_t", text_or_empty()).select(*others, F.col("text").isNull().alias("_null"), "_t", *_key())
    n_docs = docs.count()
    runs = repeated_runs(keyed.select("_t", "ka", "kb"), n_docs, width)
    lists = runs.groupBy("ka", F.shiftrightunsigned("p", 40).alias("kb")).agg(F.collect_list("p").alias("_runs"))
    return few(zipped(keyed).join(lists, ["ka", "kb"], "left").drop("ka", "kb"), n_docs, TEXT_ROWS)


def _kept(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of each row's text, and which of them are removed."""
    for text, runs in zip(unzipped(batch.column("_z")), batch.column("_runs"), strict=True):
        data = np.frombuffer(text, np.uint8)
        places = runs.values.to_numpy(zero_copy_only=False) if runs.is_valid else np.zeros(0, np.int64)
        yield data, mask(len(data), places, width)


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    small_batches(docs.sparkSession)
    rows = _with_runs(docs.select("doc_id", "text"), width).select("doc_id", "_z", "_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, gone in _kept(batch, width):
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {DIGEST}")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated spans cut from ``text`` (and n_chars, if there, counted anew). Null texts stay null."""
    small_batches(docs.sparkSession)
    rows = _with_runs(docs.select("doc_id", "text", boxed([c for c in docs.columns if c != "text"])), width).select("_row", "_null", "_z", "_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [data[~gone].tobytes().decode("utf-8", "ignore") for data, gone in _kept(batch, width)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_null"), pa.array(out, pa.string())], ["_row", "_null", "_kept"])

    cut = rows.mapInArrow(run, T.StructType([rows.schema["_row"], rows.schema["_null"], T.StructField("_kept", T.StringType())]))
    new = {"text": F.when(~F.col("_null"), F.col("_kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(~F.col("_null"), F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"])
    return cut.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op9_repeat_spans(docs: DataFrame) -> DataFrame:
    return digests(docs)
