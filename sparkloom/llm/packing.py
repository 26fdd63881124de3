"""Packing token sequences into windows by non-negative least squares.

A document is cut into full windows and a remainder. Remainders are counted by length class; shallow combinations of
classes (one to three) that nearly fill a window are the columns of a non-negative least squares problem whose
right-hand side is that histogram. The solution, rounded down, says how often each combination is used; those
windows get whole remainders. What is left is packed greedily, longest first: into the gaps of those windows, then
into windows of its own, cut where a window ends.

Each task packs all documents of its partition in blocks of a bounded number of tokens, each block with its own
histogram, so nothing is shuffled and the memory of a task doesn't grow with the corpus. The few tokens left at
the end of a partition go to sequences whose lengths are powers of two, which need no padding.

Defined cases: a null text is empty and has only its end id; repeated rows are packed each; ties are broken by order
of arrival; an empty table gives no rows; a document longer than a block is a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkloom.llm.shared import small_batches, text_or_empty
from sparkloom.llm.word_ids import word_ids

WINDOW = 2048
END_ID = 1
#: Length classes in a window; a combination's classes, rounded up, fill at least this many of them.
CLASSES, FILL = 64, 62
BLOCK_TOKENS = 6_000_000
DEPTH = 3

Piece = tuple[int, int, int]  # document, start, length


def combinations() -> np.ndarray:
    """Columns of class counts: up to DEPTH classes whose upper bounds fit a window and nearly fill it."""
    found = []
    for depth in range(1, DEPTH + 1):
        for classes in combinations_with_replacement(range(1, CLASSES + 1), depth):
            if FILL <= sum(classes) <= CLASSES:
                column = np.zeros(CLASSES + 1)
                np.add.at(column, list(classes), 1)
                found.append(column)
    return np.array(found).T


def nnls(a: np.ndarray, b: np.ndarray, most: int = 200) -> np.ndarray:
    """Minimises |a x - b| for x >= 0 with an active set; stops early at ``most`` steps with a feasible x."""
    n = a.shape[1]
    x = np.zeros(n)
    active: list[int] = []
    gram, target = a.T @ a, a.T @ b
    for _ in range(most):
        slope = target - gram @ x
        slope[active] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * (1 + np.abs(target).max()):
            break
        active.append(j)
        while active:
            part = np.linalg.lstsq(gram[np.ix_(active, active)], target[active], rcond=None)[0]
            if part.min() > 1e-12:
                x[:] = 0
                x[active] = part
                break
            now = x[active]
            low = part <= 1e-12
            share = np.min(now[low] / np.maximum(now[low] - part[low], 1e-300))
            x[active] = now + share * (part - now)
            gone = [k for k, v in zip(active, x[active], strict=True) if v <= 1e-12]
            if not gone:
                gone = [active[int(np.argmin(part))]]
            x[gone] = 0
            active = [k for k in active if k not in gone]
    return x


_columns: list[np.ndarray] = []


def plan(lengths: np.ndarray) -> list[tuple[list[int], int]]:
    """Combinations of classes and how often each is used, for remainders of these lengths (1 to WINDOW - 1)."""
    if not _columns:
        _columns.append(combinations())
    a = _columns[0]
    classes = -(-lengths * CLASSES // WINDOW)
    have = np.bincount(classes, minlength=CLASSES + 1)
    counts = np.floor(nnls(a, have.astype(float)) + 1e-6).astype(int)
    out = []
    for j in np.argsort(-counts, kind="stable"):
        members = np.repeat(np.arange(CLASSES + 1), a[:, j].astype(int))
        need = np.bincount(members, minlength=CLASSES + 1)
        times = min(int(counts[j]), *(int(have[c] // need[c]) for c in set(members.tolist())))
        if times > 0:
            out.append((members.tolist(), times))
            have -= need * times
    return out


class Packer:
    """Packs blocks of documents; what a block leaves over is carried to the next."""

    def __init__(self, base: int) -> None:
        self.next = base
        self.rest: list[Piece] = []  # under a window of tokens

    def sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def block(self, totals: np.ndarray, first: int) -> list[tuple[Piece, int, int]]:
        """(piece, sequence, offset) of documents first, first + 1, ... with these token counts."""
        out: list[tuple[Piece, int, int]] = []
        remainders: list[Piece] = []
        for k, total in enumerate(totals.tolist()):
            full = total // WINDOW
            out += [((first + k, w * WINDOW, WINDOW), self.sequence(), 0) for w in range(full)]
            if total % WINDOW:
                remainders.append((first + k, full * WINDOW, total % WINDOW))
        lengths = np.array([p[2] for p in remainders], dtype=np.int64)
        by_class: dict[int, list[Piece]] = {}
        for p, c in zip(remainders, (-(-lengths * CLASSES // WINDOW)).tolist(), strict=True):
            by_class.setdefault(c, []).append(p)
        windows = []
        if len(remainders) > 3:
            for members, times in plan(lengths):
                windows += [[by_class[c].pop() for c in members] for _ in range(times)]
        left = sorted((p for some in by_class.values() for p in some), key=lambda p: (-p[2], p[0]))
        spare = sum(p[2] for p in left) + sum(p[2] for p in self.rest)
        gaps = [WINDOW - sum(p[2] for p in w) for w in windows]
        missing = sum(gaps) - spare
        while missing > 0:  # windows that nothing could fill up are taken apart
            gap, pieces = gaps.pop(), windows.pop()
            missing -= gap + sum(p[2] for p in pieces)
            left += pieces
        return out + self.filled(windows, self.rest + left)

    def filled(self, windows: list[list[Piece]], left: list[Piece]) -> list[tuple[Piece, int, int]]:
        """Fills the gaps of ``windows`` and then new windows from ``left``, cutting; keeps less than a window."""
        out: list[tuple[Piece, int, int]] = []
        queue = left[::-1]

        def take(most: int) -> Piece:
            doc, start, length = queue.pop()
            if length > most:
                queue.append((doc, start + most, length - most))
            return doc, start, min(length, most)

        def fill(sequence: int, at: int) -> None:
            while at < WINDOW:
                piece = take(WINDOW - at)
                out.append((piece, sequence, at))
                at += piece[2]

        for pieces in windows:
            sequence, at = self.sequence(), 0
            for piece in pieces:
                out.append((piece, sequence, at))
                at += piece[2]
            fill(sequence, at)
        held = sum(p[2] for p in queue)
        for _ in range(held // WINDOW):
            fill(self.sequence(), 0)
        self.rest = queue[::-1]
        return out

    def finish(self) -> list[tuple[Piece, int, int]]:
        """The rest, in sequences whose lengths are powers of two."""
        out: list[tuple[Piece, int, int]] = []
        queue = self.rest[::-1]
        held = sum(p[2] for p in queue)
        for size in (1 << k for k in range(WINDOW.bit_length(), -1, -1) if held >> k & 1):
            sequence, at = self.sequence(), 0
            while at < size:
                doc, start, length = queue.pop()
                used = min(length, size - at)
                if used < length:
                    queue.append((doc, start + used, length - used))
                out.append(((doc, start, used), sequence, at))
                at += used
        self.rest = []
        return out


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, its place in the document and in its sequence, a checksum of its ids, and the ids if asked."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(tokenizer), END_ID.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 40)
        docs_held: dict[int, tuple[object, bytes]] = {}
        waiting: list[int] = []
        tokens = number = 0
        kinds: list[pa.DataType] = []

        def rows(placed: list[tuple[Piece, int, int]]) -> pa.RecordBatch:
            ids = [docs_held[p[0]][1][4 * p[1] : 4 * (p[1] + p[2])] for p, _, _ in placed]
            columns = [
                pa.array([docs_held[p[0]][0] for p, _, _ in placed], kinds[0]), *(pa.array([p[k] for p, _, _ in placed], pa.int64()) for k in (1, 2)),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(docs_held[p[0]][1]) // 4 for p, _, _ in placed], pa.int64()),
                pa.array([s for _, s, _ in placed], pa.int64()), pa.array([o for _, _, o in placed], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        def flush() -> Iterator[pa.RecordBatch]:
            placed = packer.block(np.array([len(docs_held[k][1]) // 4 for k in waiting], dtype=np.int64), waiting[0])
            for at in range(0, len(placed), 20_000):
                yield rows(placed[at : at + 20_000])
            still = {p[0] for p in packer.rest}
            for k in [k for k in docs_held if k not in still]:
                del docs_held[k]
            waiting.clear()

        for batch in batches:
            kinds[:] = [batch.column("doc_id").type]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("_t"), strict=True):
                ids = encode.encode(text.as_buffer().to_pybytes()) + end
                docs_held[number] = (doc, ids)
                waiting.append(number)
                number += 1
                tokens += len(ids) // 4
                if tokens >= BLOCK_TOKENS:
                    yield from flush()
                    tokens = 0
        if waiting:
            yield from flush()
        if packer.rest:
            yield rows(packer.finish())

    extra = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", text_or_empty().alias("_t")).mapInArrow(run, f"doc_id {kind}, {COLUMNS}{extra}")


def op6_packing(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packed(docs, str(tokenizer))
