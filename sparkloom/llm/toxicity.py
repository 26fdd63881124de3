"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Texts are folded first: lower case, accents off, look-alike letters of other scripts and digit substitutions to
Latin letters, zero-width characters dropped, every other character to a space. The lexicon holds whole words and word
stems (``stem*``) with log-odds weights learned from labelled rows; stems that merely shorten an entry are
dropped. Matches inside an exception phrase don't count. The sum of weights, normalised by length, gives the score.

Defined cases: null and empty texts score as clean; rows without a label are scored only; a null label is
no label; repeated rows are scored each; an empty table gives no rows; without labelled toxic rows nothing matches.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.shared import small_batches, text_or_empty

#: Look-alike letters (Cyrillic, Greek and others) and the Latin letters that they resemble.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe",
}
#: Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases inside which a match doesn't count (folded form). Callers may pass their own.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "stupid simple", "sore loser rule")


class _Folds(dict):
    """What each character becomes: letters, nothing (marks and format signs), or a space."""

    def __missing__(self, code: int) -> str | None:
        ch = chr(code)
        if unicodedata.category(ch) in ("Mn", "Me", "Cf"):
            found = None
        else:
            low = unicodedata.normalize("NFKD", ch.lower())
            found = "".join(HOMOGLYPHS.get(c, c if "a" <= c <= "z" else "") for c in low) if ch.isalpha() else ""
            found = found or " "
        self[code] = found
        return found


def _folds() -> _Folds:
    table = _Folds()
    for code in range(0x250):
        ch = chr(code)
        low = unicodedata.normalize("NFKD", ch.lower())
        table[code] = "".join(c for c in low if "a" <= c <= "z") or " "
    for code in [*range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0xFF00, 0xFF60)]:
        low = unicodedata.normalize("NFKD", chr(code).lower())
        table[code] = "".join(HOMOGLYPHS.get(c, c if "a" <= c <= "z" else "") for c in low) or " "
    table.update({ord(k): v for k, v in HOMOGLYPHS.items()})
    table.update({ord(k): v for k, v in SUBSTITUTES.items()})
    table.update(dict.fromkeys([*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD]))
    return table


_FOLDS = _folds()


def folded(text: str) -> str:
    """Lower-case Latin letters and single spaces, with a space at either end.

    Substitutions apply to digits and signs that touch a letter; a number alone becomes a space.
    """
    if any(c in text for c in SUBSTITUTES):
        text = _lone(text)
    text = text.translate(_FOLDS)
    return f" {' '.join(text.split())} "


def _lone(text: str) -> str:
    """Blanks words without any letter, and signs at the ends of words. A word that signs begin is given with and without them."""
    out = []
    for word in text.split():
        if not any(c.isalpha() for c in word):
            continue
        word = word.rstrip("!$@")
        out.append(word)
        if word[0] in "!$@":
            out.append(word.lstrip("!$@"))
    return " ".join(out)


@dataclass
class Lexicon:
    """Folded terms with weights. A term is ``" word "`` or, for a stem, ``" stem"``."""

    weights: dict[str, float]
    #: The score is 1 / (1 + exp(-(bias + slope * log1p(weighted sum) - drag * log(words)))).
    bias: float = -2.0
    slope: float = 2.0
    drag: float = 0.0
    exceptions: Sequence[str] = EXCEPTIONS
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            made = ahocorasick.Automaton()
            for phrase in self.exceptions:
                made.add_word(f" {phrase} ", (len(phrase) + 2, None))
            for term, weight in self.weights.items():
                made.add_word(term, (len(term), weight))
            if len(made):
                made.make_automaton()
            self._machine = made
        return self._machine

    def mass(self, text: str) -> tuple[float, int]:
        """The weight of the matches outside exception phrases (one for each word, the heaviest), and the words."""
        low = folded(text)
        words = low.count(" ") - 1
        if not len(self.machine()):
            return 0.0, max(words, 0)
        found, spared = {}, []
        for end, (n, weight) in self.machine().iter(low):
            if weight is None:
                spared.append((end - n + 1, end))
            else:
                start = end - n + 1
                found[start] = max(weight, found.get(start, 0.0))
        total = sum(w for at, w in found.items() if not any(a <= at < b for a, b in spared))
        return total, max(words, 0)

    def score(self, text: str) -> float:
        total, words = self.mass(text)
        if total <= 0:
            return 1 / (1 + math.exp(-self.bias))
        return 1 / (1 + math.exp(-(self.bias + self.slope * math.log1p(total) - self.drag * math.log1p(words))))


#: Bounds of what training reads and keeps: labelled rows, at most half of them toxic; sizes of stems; terms.
SAMPLE_ROWS = 8_000
STEM_SIZES = range(3, 9)
#: A term needs so many toxic documents, such a ratio of frequencies and such a gain.
LEAST_DOCS, LEAST_SHARE, LEAST_GAIN = 4, 0.008, 18.0
#: A longer term stands for a stem if it has this share of the stem's documents.
SAME_SHARE = 0.9
LEAST_RATIO = 4.0
MOST_TERMS = 5_000


def _terms(text: str) -> set[str]:
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEM_SIZES if n <= len(w)}


def _copy_key(text: str, label: int) -> tuple[int, bytes]:
    """The same for copies only: a hash of the whole text, without case and spacing. Folding would merge texts of other scripts."""
    return label, hashlib.sha256(" ".join(text.lower().split()).encode("utf-8", "surrogatepass")).digest()


def train(sample: Sample, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """Learns terms from (text, label) rows, copies of a text counting once.

    Document frequencies of words and stems in both classes give smoothed ratios. A term's gain is its toxic documents
    times the log of its ratio. Terms enter by gain, of equals the longest; a term that begins an accepted one, or that an
    accepted one begins, stays out: so each family of words is stood for by its most telling stem. Bias, slope and drag
    are fitted by logistic regression on the same rows.
    """
    rows = list({_copy_key(text, y): (text, y) for text, y in reversed(sample.rows)}.values())
    total = [sum(1 for _, y in rows if not y), sum(1 for _, y in rows if y)]
    toxic = Counter(t for text, y in rows if y for t in _terms(text))
    toxic = Counter({t: k for t, k in toxic.items() if k >= max(LEAST_DOCS, LEAST_SHARE * total[1])})
    clean = Counter(t for text, y in rows if not y for t in _terms(text) & toxic.keys())
    logs = {t: math.log((k + 0.5) / (total[1] + 1) / ((clean[t] + 0.5) / (total[0] + 1))) for t, k in toxic.items()}
    gains = {t: toxic[t] * v for t, v in logs.items() if v >= math.log(LEAST_RATIO) and toxic[t] * v >= LEAST_GAIN}
    weights: dict[str, float] = {}
    begun: set[str] = set()
    longer: dict[str, list[str]] = {}
    for term in gains:
        longer.setdefault(term[:-1], []).append(term)
    for term in sorted(gains, key=lambda t: (-gains[t], -len(t), t)):
        whole = toxic[term]
        while nexts := [t for t in longer.get(term, ()) if toxic[t] >= SAME_SHARE * whole]:
            term = max(nexts, key=lambda t: (toxic[t], t))
        if term not in begun and not any(term[:n] in weights for n in range(2, len(term))) and len(weights) < MOST_TERMS:
            weights[term] = logs[term]
            begun.update(term[:n] for n in range(2, len(term) + 1))
    return fitted(Lexicon(weights, exceptions=exceptions), rows, sample.weights())


def fitted(lexicon: Lexicon, rows: list[tuple[str, int]], weights: tuple[float, float] = (1.0, 1.0)) -> Lexicon:
    """Newton steps of a ridge logistic regression on log mass and log length; rows count by the weights of their classes."""
    if not rows:
        return lexicon
    mass = np.array([lexicon.mass(text) for text, _ in rows], dtype=float)
    x = np.column_stack([np.ones(len(rows)), np.log1p(mass[:, 0]), np.where(mass[:, 0] > 0, -np.log1p(mass[:, 1]), 0.0)])
    y = np.array([label for _, label in rows], dtype=float)
    many = np.array(weights)[y.astype(int)]
    beta = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (many * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (many * (y - p)) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    lexicon.bias, lexicon.slope, lexicon.drag = map(float, beta)
    return lexicon


def crc_mod(column: str, n: int) -> Column:
    """crc32(column as text) mod n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


@dataclass
class Sample:
    """Training rows (text, label), and how many labelled documents of each class there are to train on."""

    rows: list[tuple[str, int]]
    totals: tuple[int, int]

    def weights(self) -> tuple[float, float]:
        """How many labelled documents a row of each class stands for."""
        held = [sum(1 for _, y in self.rows if y == k) for k in (0, 1)]
        return tuple(t / h if h else 1.0 for t, h in zip(self.totals, held, strict=True))


#: Bound of the bytes of training texts.
SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int, most_bytes: int = SAMPLE_BYTES) -> Sample:
    """At most ``most`` training rows and ``most_bytes`` of text, half for each class, chosen by a hash of doc_id.

    The classes' true sizes come along, so that what is learned doesn't depend on how much of each class was read.
    Of documents that share a doc_id one text is read, the least.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in own.groupBy("_y").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = own.where("_y = 1").orderBy(*order).limit(most // 2).unionByName(own.where("_y = 0").orderBy(*order).limit(most // 2))
    texts = docs.select("doc_id", text_or_empty().alias("_t")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_y").agg(F.min("_t").alias("_t"))
    read = F.sum(F.octet_length("_t")).over(Window.partitionBy("_y").orderBy(*order))
    found = texts.withColumn("_read", read).where(F.col("_read") <= most_bytes // 2).select("doc_id", "_t", "_y").collect()
    return Sample([(r["_t"], r["_y"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["_t"]))], (counts.get(0, 0), counts.get(1, 0)))


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and the score of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [lexicon.score(t.as_py()) for t in batch.column("_t")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("_t")).mapInArrow(run, f"doc_id {kind}, score double")


HELD_OUT_MOD, HELD_OUT_REST, CUT = 4, 2, 0.3


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT_REST
    lexicon = train(labelled_sample(docs, labels, "toxic", held_out, SAMPLE_ROWS))
    out = scored(docs, lexicon)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
