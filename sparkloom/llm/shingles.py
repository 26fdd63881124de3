"""Word shingles as 64-bit hashes, straight from the bytes of Arrow strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from sparkloom.llm.shared import mixed, prefix_sums, span_hash, steps

SHINGLE = 5
BASE = 0xD6E8FEB86659FD93
LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
LOWER[65:91] += np.uint64(32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owners (string numbers) of the words `[^\\x20\\x09-\\x0D]+`; no word crosses strings."""
    n = len(offsets) - 1
    text = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = text.copy()
    begins[1:] &= ~text[:-1] | edge[1:-1]
    ends = text.copy()
    ends[:-1] &= ~text[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, stops, np.repeat(np.arange(n), counts)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each word with A-Z lower-cased."""
    return span_hash(prefix_sums(LOWER[data], BASE), starts, stops, BASE)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first, last, sets, bounds): strings first to last - 1 have sets[bounds[k]:bounds[k + 1]], sorted and distinct.

    A string with fewer than ``size`` words has its whole sequence as one shingle; one without words has none.
    """
    for first, last in steps(offsets):
        base = offsets[first]
        yield first, last, *_some_sets(data[base : offsets[last]], offsets[first : last + 1] - base, size)


def _some_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    starts, stops, owner = word_spans(data, offsets)
    words = word_hashes(data, starts, stops)
    counts = np.bincount(owner, minlength=n)
    head = np.concatenate([[0], np.cumsum(counts)])
    # A hash of a run of words: the odd multiplier tells places apart.
    sums = prefix_sums(words, BASE)
    length = np.where(counts >= size, size, counts)
    n_runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(n), n_runs)
    place = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(n_runs)])[:-1], n_runs)
    at = head[doc] + place
    hashes = mixed(span_hash(sums, at, at + length[doc], BASE))
    order = np.lexsort((hashes, doc))
    h = hashes[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=n))])
