"""Embedding near-dedup by lattice hashing.

Each of several tables projects unit vectors at random to two blocks of eight dimensions and decodes each block to the nearest
point of the E8 lattice; the two points name a cell. A vector lives in its home cell of every table and probes the
cells next to it, those whose lattice vectors point most along the residual. Two vectors meet where one probes or shares
the other's home; vectors that meet are compared by cosine in double precision.

Cells with nobody to meet are dropped before vectors travel. A full cell is cut into blocks, and pairs of blocks are
compared by matrix products, so no task holds an unbounded cell. A task returns link counts and a spanning forest, never
pairs: a pair counts only at the first cell, in order of tables, where it meets. Equal vectors of a label are one
class with a weight.

Defined cases: null, zero or non-finite vectors, vectors with null components, null labels and null vec_ids link with
nothing (component_id is their vec_id); repeated rows are vectors that link with each other; vectors of another length
never meet; rows that share a vec_id are one node; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import components
from sparkloom.llm.shared import few, mixed, small_batches, staged

THRESHOLD = 0.93
TABLES, SCALE, PROBES, SEED = 8, 4.0, 8, 20240101
BLOCK = 512
NO_CELL = np.iinfo(np.int64).max


def lattice_roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


ROOTS = lattice_roots()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer point with an even sum: where the sum is odd, the worst rounded place goes the other way."""
    near = np.rint(x)
    error = x - near
    rows = np.arange(len(x))
    worst = np.abs(error).argmax(axis=1)
    near[rows, worst] += np.where(near.sum(axis=1) % 2 != 0, np.where(error[rows, worst] >= 0, 1.0, -1.0), 0.0)
    return near


def decoded(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of the even integer points and those shifted by one half."""
    plain, shifted = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - plain) ** 2).sum(axis=1) <= ((x - shifted) ** 2).sum(axis=1)
    return np.where(nearer[:, None], plain, shifted)


_projections: dict[tuple, np.ndarray] = {}


def projection(table: int, size: int) -> np.ndarray:
    """Orthonormal directions (as far as there are enough dimensions), scaled; the same in every process."""
    if (table, size) not in _projections:
        made = np.random.default_rng([SEED, table, size]).normal(size=(size, 16))
        q = np.linalg.qr(made)[0] if size >= 16 else made / np.sqrt(size)
        _projections[table, size] = q * SCALE * np.sqrt(size / 64)
    return _projections[table, size]


_PLACES = np.random.default_rng(SEED).integers(1, 1 << 62, 8).astype(np.uint64) | np.uint64(1)


def _cell(points: np.ndarray) -> np.ndarray:
    return (np.rint(points * 2).astype(np.int64).view(np.uint64) * _PLACES).sum(axis=-1, dtype=np.uint64)


def cells(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Cells of unit vectors: (vectors, TABLES, 1 + PROBES) numbers, the home first.

    A number holds its table and a 60-bit hash of label and points; cells that share a number only cost comparisons.
    """
    out = np.empty((len(x), TABLES, 1 + PROBES), np.int64)
    half = PROBES // 2
    for t in range(TABLES):
        y = x @ projection(t, x.shape[1])
        blocks = [y[:, :8], y[:, 8:]]
        points = [decoded(b) for b in blocks]
        codes = [_cell(p) for p in points]
        near = []
        for b, p in zip(blocks, points, strict=True):
            along = (b - p) @ ROOTS.T
            top = np.argpartition(-along, half, axis=1)[:, :half]
            near.append(_cell(p[:, None, :] + ROOTS[top]))
        seed = labels.view(np.uint64) * _PLACES[0] + np.uint64(x.shape[1])
        join = lambda a, b: mixed(a * _PLACES[1] + mixed(b) + seed.reshape(-1, *[1] * (a.ndim - 1)))
        keys = [join(codes[0], codes[1])[:, None], join(near[0], codes[1][:, None] + np.zeros_like(near[0])), join(codes[0][:, None] + np.zeros_like(near[1]), near[1])]
        out[:, t] = (np.concatenate(keys, axis=1) >> np.uint64(4)).astype(np.int64) | (t << 60)
    return out.astype(np.int64)


def unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str = "embedding") -> Column:
    finite = f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return F.expr(f"coalesce({finite} and exists({vector}, x -> x <> 0), false)")


def _classes(rows: DataFrame) -> DataFrame:
    """One row for each distinct vector of a label, with its cells."""
    grouped = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    grouped = grouped.select(F.xxhash64("label", "embedding").alias("cid"), "rep", "weight", F.xxhash64("label").alias("lab"), F.col("embedding").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lab = batch.column("lab").to_numpy(zero_copy_only=False)
            vectors = batch.column("vec").to_pylist()
            keys: list = [None] * len(vectors)
            for size in {len(v) for v in vectors}:
                at = [k for k, v in enumerate(vectors) if len(v) == size]
                found = cells(unit(np.array([vectors[k] for k in at])), lab[at])
                for k, row in zip(at, found.reshape(len(at), -1), strict=True):
                    keys[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    kind = grouped.schema["vec"].dataType.simpleString()
    return grouped.mapInArrow(run, f"cid long, rep long, weight long, lab long, vec {kind}, keys array<long>")


def _met(classes: DataFrame) -> DataFrame:
    """The classes once for each pair of blocks of each cell where they may meet another: with key, low, high and block."""
    each = classes.select("cid", F.posexplode("keys").alias("at", "key")).select("cid", "key", F.expr(f"at % {1 + PROBES} = 0").alias("home")).groupBy("cid", "key").agg(F.max("home").alias("home"))
    full = each.groupBy("key").agg(F.count("*").alias("k"), F.max("home").alias("some")).where("k > 1 and some")
    dealt = each.join(full.select("key", F.ceil(F.col("k") / BLOCK).alias("blocks")), "key")
    dealt = dealt.select("cid", "key", "home", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block"))
    paired = dealt.select("cid", "key", "home", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    paired = paired.select("cid", "key", "home", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return classes.join(paired, "cid")


def compared(rows: dict[str, np.ndarray], key: int, low: int, high: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of one pair of blocks: weights of links that count here, and the least row that links tie each row to."""
    n = len(rows["cid"])
    keys, home, weight = rows["keys"], rows["home"], rows["weight"]
    linked = rows["unit"] @ rows["unit"].T >= threshold
    linked &= home[:, None] | home[None, :]
    linked &= rows["lab"][:, None] == rows["lab"][None, :]
    np.fill_diagonal(linked, False)
    if low != high:
        linked &= rows["block"][:, None] != rows["block"][None, :]
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if (least == label).all():
            break
        label = least
    a, b = np.nonzero(np.triu(linked, 1))
    table = key >> 60
    first = np.ones(len(a), bool)
    for t in range(table + 1):  # a pair that meets in an earlier table, or at a smaller cell of this one, counts there
        go = np.flatnonzero(first)
        if not len(go):
            break
        ka, kb = keys[a[go], t], keys[b[go], t]
        at_a, at_b = (kb == ka[:, :1]).any(axis=1), (ka == kb[:, :1]).any(axis=1)
        if t < table:
            first[go[at_a | at_b]] = False
        else:
            least_key = np.minimum(np.where(at_a, ka[:, 0], NO_CELL), np.where(at_b, kb[:, 0], NO_CELL))
            first[go[least_key != key]] = False
    counts = np.bincount(a[first], weight[b[first]], n) + np.bincount(b[first], weight[a[first]], n)
    return counts.astype(np.int64), label


def links(rows: DataFrame, threshold: float, n_rows: int) -> DataFrame:
    """(cid, n) weights of direct links to sum by class, and (a, b) edges of spanning forests, from about ``n_rows`` usable rows."""
    classes = staged(_classes(rows), "vector-classes", n_rows, 2 * BLOCK)
    met = _met(classes).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            columns = {c: [r[c] for r in held] for c in held[0]}
            out: list[tuple] = []
            for size in {len(v) for v in columns["vec"]}:
                at = [k for k, v in enumerate(columns["vec"]) if len(v) == size]
                own = {c: np.array([columns[c][k] for k in at]) for c in ("cid", "rep", "weight", "lab", "home", "block")}
                own["keys"] = np.array([columns["keys"][k] for k in at]).reshape(len(at), TABLES, 1 + PROBES)
                own["unit"] = unit(np.array([columns["vec"][k] for k in at]))
                counts, label = compared(own, *now, threshold)
                out += [(int(c), int(k), None, None) for c, k in zip(own["cid"], counts, strict=True) if k]
                out += [(None, None, int(own["rep"][k]), int(own["rep"][r])) for k, r in enumerate(label) if k != r]
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cid", "n", "a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                key = (row.pop("key"), row.pop("low"), row.pop("high"))
                if key != now and held:
                    yield close()
                    held = []
                now = key
                held.append(row)
        if held:
            yield close()

    return met.mapInArrow(run, "cid long, n long, a long, b long")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings`` (vec_id, embedding, label)."""
    small_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    good = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    n_rows = rows.count()
    found = staged(links(rows.where(good), threshold, n_rows), "vector-links", n_rows, BLOCK)
    sums = found.where("cid is not null").groupBy("cid").agg(F.sum("n").alias("far"))
    own = rows.where(good).withColumn("cid", F.xxhash64("label", "embedding"))
    sizes = own.groupBy("cid").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    tied = components(found.where("a is not null").select("a", "b").unionAll(own.join(sizes.where("copies > 1").select("cid", "rep"), "cid").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))), n_rows)
    facts = sizes.join(sums, "cid", "left").select("cid", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.withColumn("cid", F.when(good, F.xxhash64("label", "embedding"))).select("vec_id", "cid").join(facts, "cid", "left").join(tied, F.col("vec_id") == F.col("node"), "left")
    out = few(out, n_rows)
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_near_vectors(embeddings: DataFrame) -> DataFrame:
    return near_vectors(embeddings)


def op1_sql() -> str:
    """Brute force within labels."""
    return """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
