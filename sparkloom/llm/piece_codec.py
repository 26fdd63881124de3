"""SentencePiece encoding and decoding with the N best segmentations.

A text is prefixed by a space, spaces become the mark of the piece alphabet, and every way to cut it into pieces is
a path through a lattice; a path's score is the sum of its pieces' scores, as the model file gives them. A character without a piece,
or the mark itself, falls back to its bytes. The forward Viterbi pass finds the best score from the start to each place. They
are exact heuristics for an A* search from the end backwards, so paths come off its queue best first, without detours.
In a BPE model the scores are minus the ranks of merges: the best path is the best sum of them, not the order of merges, so its ids
are not those that the model's own greedy encoder gives. Decoding is the same for both.

Where no piece has the two characters that meet, every path goes through. So the lattice is cut there, and the N best paths of a
text are the N best choices of paths for its parts. Parts recur: a batch's distinct parts are looked up in a table of
bounded size, and searched if they are new; a text's scores, ids and bytes are then put together from the table by array steps. Ties
are broken alike every time.

Defined cases: a null text is empty; an empty text has one path, without pieces; decoding an encoded text gives the text back,
for every text; repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import pairwise
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.shared import byte_view, ragged, small_batches, steps, text_or_empty

MARK = "▁"
N_BEST = 3
#: Most parts that a worker's table keeps, and most ids of all of their paths.
MOST_PARTS, MOST_IDS = 600_000, 12_000_000
#: Bytes of text that are put together at once; a longer text is put together alone.
STEP = 2_000_000
#: A byte fallback scores this much below the worst piece.
FALLBACK = 10.0
#: Pairs of characters inside pieces are marked in a table of this many hashes.
PAIR_BITS = 20

Path = tuple[float, tuple[int, ...]]


class Parts:
    """Paths of parts of texts, best first, in flat arrays: a slot for each part, a run of paths for each slot, a run of ids for each path."""

    def __init__(self, codec: PieceCodec) -> None:
        self.codec = codec
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.first, self.start = array("q", [0]), array("q", [0])
        self.score, self.ids = array("d"), array("I")
        self.uses = np.zeros(0, np.int64)

    def _add(self, key: bytes, paths: list[Path]) -> None:
        self.slot[key] = len(self.slot)
        for score, ids in paths:
            self.score.append(score)
            self.ids.extend(ids)
            self.start.append(len(self.ids))
        self.first.append(len(self.score))

    def slots(self, keys: list[bytes], counts: np.ndarray) -> np.ndarray:
        """The slots of distinct parts (UTF-32), new ones searched for; ``counts`` tells how often each is used."""
        if len(self.slot) > self.codec.most or len(self.ids) > MOST_IDS:
            self._shrink()
        for key in keys:
            if key not in self.slot:
                self._add(key, self.codec._search(key.decode("utf-32-le", "surrogatepass")))
        found = np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))
        grown = np.zeros(len(self.slot), np.int64)
        grown[: len(self.uses)] = self.uses
        grown[found] += counts
        self.uses = grown
        return found

    def _shrink(self) -> None:
        """Keeps a quarter of the parts, the most used ones; uses count half from then on."""
        kept = np.zeros(len(self.uses), bool)
        kept[np.argsort(-self.uses, kind="stable")[: min(self.codec.most, len(self.uses)) // 4]] = True
        old, uses = (self.slot, self.first, self.start, self.score, self.ids), self.uses[kept] // 2
        self._clear()
        slot, first, start, score, ids = old
        for key, k in slot.items():
            if kept[k]:
                self._add(key, [(score[p], tuple(ids[start[p] : start[p + 1]])) for p in range(first[k], first[k + 1])])
        self.uses = uses

    def arrays(self) -> tuple[np.ndarray, ...]:
        """first, start, score and ids, as they are now; to be let go before parts are added."""
        kinds = zip((self.first, self.start, self.score, self.ids), (np.int64, np.int64, np.float64, np.uint32), strict=True)
        return tuple(np.frombuffer(a, kind) if len(a) else np.zeros(0, kind) for a, kind in kinds)


class PieceCodec:
    """Encodes and decodes with the pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str, n_best: int = N_BEST, most: int = MOST_PARTS) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best, self.most = n_best, most
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        self._set({model.id_to_piece(i).replace(MARK, " "): (model.get_score(i), i) for i in plain}, byte)

    @classmethod
    def of(cls, pieces: dict[str, tuple[float, int]], byte: dict[int, int], n_best: int = N_BEST, most: int = MOST_PARTS) -> PieceCodec:
        """A codec over given pieces (with spaces for marks): text to (score, id), and byte to id."""
        made = cls.__new__(cls)
        made.n_best, made.most = n_best, most
        made._set(pieces, byte)
        return made

    def _set(self, pieces: dict[str, tuple[float, int]], byte: dict[int, int]) -> None:
        self.pieces, self.byte = pieces, byte
        #: All beginnings of pieces; for those that are pieces, their score and ids.
        self.prefixes: dict[str, tuple] = {p[:k]: () for p in pieces for k in range(1, len(p) + 1)} | {p: (s, (i,)) for p, (s, i) in pieces.items()}
        self.fallback = min((s for s, _ in pieces.values() if s > -1e8), default=0.0) - FALLBACK
        self.bytes_of = {i: p.encode() for p, (_, i) in pieces.items()} | {i: bytes([b]) for b, i in byte.items()}
        pairs = np.array([(ord(p[k]), ord(p[k + 1])) for p in pieces for k in range(len(p) - 1)], np.uint32).reshape(-1, 2)
        #: Pairs that share a hash with one inside a piece count as inside too: that only makes longer parts.
        self.inside = np.zeros(1 << PAIR_BITS, bool)
        self.inside[self._pair(pairs[:, 0], pairs[:, 1])] = True
        self.vocabulary = pa.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)], pa.large_binary())
        self.parts = Parts(self)

    @staticmethod
    def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - PAIR_BITS)

    def edges(self, part: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place, the pieces that end there: (start, score, ids)."""
        n = len(part)
        ending: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        known = self.prefixes.get
        for i in range(n):
            for j in range(i + 1, n + 1):
                piece = known(part[i:j])
                if piece is None:
                    break
                if piece:
                    ending[j].append((i, *piece))
            if part[i] not in self.pieces:
                ending[i + 1].append((i, self.fallback, tuple(self.byte[b] for b in part[i].encode("utf-8", "surrogatepass"))))
        return ending

    def _search(self, part: str) -> list[Path]:
        ending = self.edges(part)
        best = [0.0]
        for into in ending[1:]:
            best.append(max([best[i] + score for i, score, _ in into]))
        # Every entry of the queue stands for another path, of exactly its cost at best; so the N least are enough.
        n = self.n_best
        queue: list[tuple[float, tuple[int, ...], int, float]] = [(-best[-1], (), len(part), 0.0)]
        done = 0
        while done < len(queue):
            cost, ids, at, behind = queue[done]
            if not at:
                done += 1
                continue
            del queue[done]
            for i, score, own in ending[at]:
                now = behind + score
                cost = -(best[i] + now)
                if len(queue) < n:
                    insort(queue, (cost, own + ids, i, now))
                elif cost < queue[-1][0]:
                    queue.pop()
                    insort(queue, (cost, own + ids, i, now))
            done = 0
        return [(-cost, ids) for cost, ids, _, _ in queue]

    def _choices(self, margins: np.ndarray, first: np.ndarray, n_paths: np.ndarray, score: np.ndarray) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """The N best choices for the parts of a text: how far behind the best one, and which parts take which further path.

        ``margins`` of the parts, and the first and the number of each part's paths in ``score``. Only the parts whose second paths cost least can
        change in one of the N best.
        """
        choices: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        left = margins.copy()
        for _ in range(min(self.n_best - 1, len(left))):
            k = int(left.argmin())
            if left[k] == inf:
                break
            left[k] = inf
            a, b = int(first[k]), int(first[k] + n_paths[k])
            costs = (score[a] - score[a:b]).tolist()
            choices = heapq.nsmallest(self.n_best, [(cost + more, (*own, (k, j))) for cost, own in choices for j, more in enumerate(costs)])
        return choices

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each rank below N: (rank, texts, scores, ids, bounds); ids[bounds[k]:bounds[k + 1]] are those of texts[k].

        Texts are the UTF-8 strings of ``data`` between ``offsets``; texts that have fewer paths are left out.
        """
        n = len(offsets) - 1
        full = np.diff(offsets) > 0
        at = offsets + np.concatenate([[0], np.cumsum(full)])
        spaced = np.full(int(at[-1]), 32, np.uint8)
        mask = np.ones(len(spaced), bool)
        mask[at[:-1][full]] = False
        spaced[mask] = data
        chars = np.frombuffer(spaced.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        char_at = np.concatenate([[0], np.cumsum((spaced & 0xC0) != 0x80)])[at]
        cut = np.ones(len(chars) + 1, bool)
        cut[1:-1] = ~self.inside[self._pair(chars[:-1], chars[1:])]
        cut[char_at] = True
        cuts = np.flatnonzero(cut) if len(chars) else np.zeros(1, np.int64)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 4).astype(np.int64)), pa.py_buffer(chars)])
        coded = whole.dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)
        slots = self.parts.slots(coded.dictionary.to_pylist(), np.bincount(number, minlength=len(coded.dictionary)))
        first, start, score, ids = self.parts.arrays()
        behind = np.full(len(first) - 1, inf)
        several = np.flatnonzero(np.diff(first) > 1)
        behind[several] = score[first[several]] - score[first[several] + 1]
        slot = slots[number]
        path, margin, n_paths = first[slot], behind[slot], np.diff(first)[slot]
        bounds = np.searchsorted(cuts, char_at)
        best = np.concatenate([[0.0], np.cumsum(score[path])])
        top = best[bounds[1:]] - best[bounds[:-1]]
        choices = [self._choices(margin[a:b], path[a:b], n_paths[a:b], score) for a, b in pairwise(bounds.tolist())]
        for rank in range(self.n_best):
            texts = np.array([k for k in range(n) if len(choices[k]) > rank], np.int64)
            owner, part = ragged(bounds[texts], np.diff(bounds)[texts])
            own = path[part]
            head = np.searchsorted(owner, np.arange(len(texts)))
            for k, doc in enumerate(texts.tolist()):
                for place, j in choices[doc][rank][1]:
                    own[head[k] + place] += j
            sizes = start[own + 1] - start[own]
            _, at_ids = ragged(start[own], sizes)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            yield rank, texts, top[texts] - [choices[k][rank][0] for k in texts.tolist()], ids[at_ids], ends[np.searchsorted(owner, np.arange(len(texts) + 1))]

    def encode(self, text: str) -> list[Path]:
        """The N best paths of a whole text, best first: (score, ids)."""
        return [(float(scores[0]), tuple(ids.tolist())) for _, texts, scores, ids, _ in self.encode_all(*byte_view(pa.array([text], pa.string()))) if len(texts)]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The UTF-8 bytes that each run of ids stands for, with the space put before them."""
        taken = self.vocabulary.take(pa.array(ids))
        _, ends, held = taken.buffers()
        places = np.frombuffer(ends, np.int64, len(taken) + 1)[bounds].tolist() if len(taken) else [0] * len(bounds)
        data = memoryview(held).cast("B") if held else memoryview(b"")
        return [data[a:b] for a, b in pairwise(places)]

    def decode(self, ids: list[int] | tuple[int, ...]) -> str:
        """The text that the ids stand for, without the space put before it."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:]


_loaded: dict[tuple[str, int], PieceCodec] = {}


def codec(path: str, n_best: int = N_BEST) -> PieceCodec:
    """One instance for each file and N in a Python process."""
    if (path, n_best) not in _loaded:
        _loaded[path, n_best] = PieceCodec(path, n_best)
    return _loaded[path, n_best]


def _coded(batches: Iterator[pa.RecordBatch], own: PieceCodec) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Iterator]]:
    """(rows, their bytes and offsets, and what :meth:`PieceCodec.encode_all` gives), in steps of bounded size."""
    for batch in batches:
        data, offsets = byte_view(batch.column("_t"))
        for low, high in steps(offsets, STEP):
            some, places = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            yield batch.slice(low, high - low), some, places, own.encode_all(some, places)


def encoded(docs: DataFrame, path: str, n_best: int = N_BEST) -> DataFrame:
    """doc_id, rank, score and ids of the N best segmentations of every text."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _, ranks in _coded(batches, codec(path, n_best)):
            for rank, texts, scores, ids, bounds in ranks:
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(texts)), pa.array(np.full(len(texts), rank), pa.int32()), pa.array(scores, pa.float64()), lists], ["doc_id", "rank", "score", "ids"])

    return docs.select("doc_id", text_or_empty().alias("_t")).mapInArrow(run, f"doc_id {kind}, rank int, score double, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (with ids) and the text of each."""
    others = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*others, "text"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", text string")


def op4_piece_codec(docs: DataFrame, path: str | None = None, n_best: int = N_BEST) -> DataFrame:
    """doc_id, rank (from 0 to N - 1), score, n_ids, ids_crc32 (little-endian 32-bit ids) and decoded_ok of the N best paths of every text."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "rank", "score", "n_ids", "ids_crc32", "decoded_ok"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, n_best)
        for rows, data, offsets, ranks in _coded(batches, own):
            whole = data.tobytes()
            want = [b" " + whole[a:b] if b > a else b"" for a, b in pairwise(offsets.tolist())]
            for rank, texts, scores, ids, bounds in ranks:
                packed = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in pairwise(bounds.tolist())]
                oks = [found == want[k] for k, found in zip(texts.tolist(), own.decode_all(ids, bounds), strict=True)]
                columns = [np.full(len(texts), rank), scores, np.diff(bounds), np.array(sums, np.int64), np.array(oks, bool)]
                kinds = [pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(texts)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select("doc_id", text_or_empty().alias("_t")).mapInArrow(run, f"doc_id {kind}, rank int, score double, n_ids long, ids_crc32 long, decoded_ok boolean")
