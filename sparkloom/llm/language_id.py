"""Language ID by Bayesian evidence fusion.

The posterior of a document's language multiplies four pieces of evidence: the likelihood of its whole text under
letter-trigram models; the language that its markup declares; the language that its address's suffix or path names; and the
prior of its host. Host priors are Dirichlet-smoothed along a hierarchy (corpus, domain, host) from grouped counts
of what texts alone say; the weight of a declaration or a suffix is how often it agrees with the texts, over all rows.
One more class, a uniform model, stands for text in no known language.

Defined cases: a null text is empty; a text without letters is rejected; missing declarations, suffixes or hosts are no
evidence; rows without a label train nothing; without labelled rows nothing is known and every text with letters
is kept with a null language; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.shared import boxed, byte_view, small_batches, staged, steps, text_or_empty

BUCKET_BITS = 13
#: Training reads at most so many texts, and bytes of text, of each language, chosen by a hash of the text.
SAMPLE_TEXTS, SAMPLE_BYTES = 1_500, 8 << 20
#: Neighbouring trigrams repeat each other's evidence; their likelihood counts by this power.
TEMPER = 0.3
#: Pseudo-documents of the level above in a host's prior; prior odds of a text in no language; least posterior to keep.
STRENGTH, UNKNOWN, LEAST_POSTERIOR = 20.0, 1e-3, 0.25

SYMBOLS = np.full(256, 32, np.uint32)
SYMBOLS[97:123] = np.arange(97, 123)
SYMBOLS[65:91] = np.arange(97, 123)
SYMBOLS[128:] = np.arange(128, 256)
IS_LETTER = SYMBOLS != 32


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams with two letters or more, and the string that each belongs to."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = SYMBOLS[data]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = (owner[2:] == owner[:-2]) & ((s[2:] != 32).astype(np.int8) + (s[1:-1] != 32) + (s[:-2] != 32) >= 2)
    with np.errstate(over="ignore"):
        code = s[:-2] * np.uint32(0x9E3779B1) + s[1:-1] * np.uint32(0x85EBCA77) + s[2:] * np.uint32(0xC2B2AE3D)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (code[keep] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), owner[:-2][keep]


@dataclass
class TextModel:
    """Log probabilities of trigram buckets, one column for each language and a last one, uniform."""

    languages: list[str]
    logs: np.ndarray

    def likelihoods(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log likelihoods (strings, languages + 1) of whole strings; strings without trigrams have zeros."""
        n = len(offsets) - 1
        out = np.zeros((n, self.logs.shape[1]))
        for low, high in steps(offsets):
            code, owner = trigrams(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            for j in range(self.logs.shape[1]):
                out[low:high, j] = np.bincount(owner, self.logs[code, j], high - low)
        return out


def train(texts: list[tuple[str, str]]) -> TextModel:
    """From (text, language) rows; smoothed relative frequencies of trigrams."""
    languages = sorted({lang for _, lang in texts})
    size = 1 << BUCKET_BITS
    columns = []
    for lang in languages:
        array = pa.array([t for t, own in texts if own == lang], pa.string())
        counts = np.bincount(trigrams(*byte_view(array))[0], minlength=size) + 0.2
        columns.append(np.log(counts / counts.sum()))
    columns.append(np.full(size, -np.log(size)))
    return TextModel(languages, np.column_stack(columns))


def labelled_texts(docs: DataFrame, label: str = "lang") -> list[tuple[str, str]]:
    """The bounded training sample: of every language, the texts with the least hashes.

    One pass counts the languages' distinct texts; another keeps twice the texts wanted by their hashes, copies
    counting once, and ranks them. Every language that labels name is trained.
    """
    spread = 1 << 30
    some = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).alias("_l"), "text", F.xxhash64("text").alias("_h"))
    counts = some.groupBy("_l").agg(F.approx_count_distinct("_h").alias("n")).collect()  # the model has a column for each language anyway
    if not counts:
        return []
    below = F.create_map(*[x for r in counts for x in (F.lit(r["_l"]), F.lit(min(spread, -(-2 * SAMPLE_TEXTS * spread // max(r["n"], 1)))))])
    near = some.where(F.pmod("_h", F.lit(spread)) < F.try_element_at(below, F.col("_l")))
    texts = near.groupBy("_l", "_h").agg(F.min("text").alias("t"))
    order = Window.partitionBy("_l").orderBy(F.pmod("_h", F.lit(spread)), "_h")
    kept = texts.withColumns({"_rank": F.row_number().over(order), "_read": F.sum(F.octet_length("t")).over(order)}).where(f"_rank <= {SAMPLE_TEXTS} and (_read <= {SAMPLE_BYTES} or _rank = 1)")
    return sorted((r["t"], r["_l"]) for r in kept.select("t", "_l").collect())


@dataclass
class Evidence:
    """Columns of a table that bear on language; absent ones are None. Levels of hosts go from wide to narrow."""

    declared: Column | None = None
    suffix: Column | None = None
    hosts: tuple[Column, ...] = ()


def _with_text(docs: DataFrame, model: TextModel, evidence: Evidence, keep: list[str]) -> DataFrame:
    """_row (a struct of the ``keep`` columns, if any) with _ll (tempered log likelihoods), _top (the likeliest by text alone), _letters and the evidence."""
    small_batches(docs.sparkSession)
    hosts = [h.cast("string").alias(f"_h{k}") for k, h in enumerate(evidence.hosts)]
    none = F.lit(None).cast("string")
    rows = docs.select(*([boxed(keep)] if keep else []), text_or_empty().alias("_t"), *hosts, (evidence.declared if evidence.declared is not None else none).alias("_declared"), (evidence.suffix if evidence.suffix is not None else none).alias("_suffix"))
    extra = [c for c in rows.columns if c != "_t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column("_t"))
            ll = model.likelihoods(data, offsets) * TEMPER
            letters = np.diff(offsets) > 0
            letters[letters] = np.logical_or.reduceat(IS_LETTER[data], offsets[:-1][letters])
            top = np.where(ll[:, -1] < 0, ll.argmax(axis=1), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1) * ll.shape[1], pa.int32()), pa.array(ll.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), lists, pa.array(top, pa.int32()), pa.array(letters, pa.bool_())], [*extra, "_ll", "_top", "_letters"])

    made = [T.StructField("_ll", T.ArrayType(T.DoubleType())), T.StructField("_top", T.IntegerType()), T.StructField("_letters", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in extra), *made]))


def _counted(rows: DataFrame, levels: int) -> DataFrame:
    """How many documents have each combination of hosts, declaration, suffix and likeliest language."""
    keys = [*(f"_h{k}" for k in range(levels)), "_declared", "_suffix", "_top"]
    return staged(rows.where("_top >= 0").groupBy(*keys).agg(F.count("*").alias("n")), "language-counts")


def _priors(counts: DataFrame, model: TextModel, levels: int) -> tuple[list[float], DataFrame | None]:
    """The corpus prior, and for each host the prior smoothed down the hierarchy (host key columns _h0.., _prior)."""
    n = len(model.languages) + 1
    seen = np.ones(n)
    for r in counts.groupBy("_top").agg(F.sum("n").alias("n")).collect():
        seen[r["_top"]] += r["n"]
    base = seen / seen.sum()
    base[-1] = UNKNOWN
    base = (base / base.sum()).tolist()
    if not levels:
        return base, None
    keys = [f"_h{k}" for k in range(levels)]
    sums = [F.coalesce(F.sum(F.when(F.col("_top") == j, F.col("n"))), F.lit(0)).alias(f"c{j}") for j in range(n)]
    narrow = counts.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(*sums).withColumn("_prior", F.array(*[F.lit(p) for p in base]))
    for depth in range(1, levels + 1):
        own = keys[:depth]
        sums = narrow.groupBy(*own).agg(*[F.sum(f"c{j}").alias(f"s{j}") for j in range(n)], F.first("_prior").alias("_above"))
        all_n = " + ".join(f"s{j}" for j in range(n))
        prior = F.array(*[F.expr(f"(s{j} + {STRENGTH}D * _above[{j}]) / ({all_n} + {STRENGTH}D)") for j in range(n)])
        narrow = narrow.drop("_prior").join(sums.select(*own, prior.alias("_prior")), own)
    return base, staged(narrow.select(*keys, "_prior"), "language-priors")


def _agreement(counts: DataFrame, model: TextModel, column: str) -> float:
    """How often a declaration agrees with what the text says, smoothed; 0.5 without any."""
    names = F.array(*[F.lit(x) for x in model.languages])
    same = F.when(F.get(names, F.col("_top")) == F.col(column), F.col("n"))
    got = counts.where(F.col(column).isin(model.languages)).agg(F.sum("n").alias("n"), F.sum(same).alias("k")).first()
    return ((got["k"] or 0) + 1) / ((got["n"] or 0) + 2)


def identified(docs: DataFrame, model: TextModel, evidence: Evidence, keep: list[str]) -> DataFrame:
    """_row (a struct of the ``keep`` columns), language (null: none), posterior and kept.

    One pass over the texts counts what they say by host and declaration; another scores each text with these priors. So only counts
    are written, and no text is shuffled unless the table of hosts is too large to send around.
    """
    facts = _with_text(docs, model, evidence, keep)
    if not model.languages:
        return facts.select("_row", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.col("_letters").alias("kept"))
    levels = len(evidence.hosts)
    counts = _counted(_with_text(docs, model, evidence, []), levels)
    base, hosts = _priors(counts, model, levels)
    corpus = F.array(*[F.lit(p) for p in base])
    joined = facts if hosts is None else facts.join(hosts, [f"_h{k}" for k in range(levels)], "left")
    prior = corpus if hosts is None else F.coalesce("_prior", corpus)
    score = F.zip_with("_ll", prior, lambda x, p: x + F.log(p))
    n = len(model.languages)
    for column, given in (("_declared", evidence.declared), ("_suffix", evidence.suffix)):
        if given is not None:
            right = min(max(_agreement(counts, model, column), 0.01), 0.99)
            weights = F.array(*[F.when(F.col(column) == x, np.log(right)).otherwise(np.log((1 - right) / max(n - 1, 1))) for x in model.languages], F.lit(float(np.log(1 / n))))
            score = F.zip_with(score, F.when(F.col(column).isin(model.languages), weights).otherwise(F.array_repeat(F.lit(0.0), n + 1)), lambda a, b: a + b)
    out = joined.withColumn("_score", score).withColumn("_best", F.array_max("_score"))
    out = out.withColumn("_at", F.array_position("_score", F.col("_best")).cast("int"))
    posterior = 1 / F.aggregate("_score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best")))
    language = F.get(F.array(*[F.lit(x) for x in model.languages]), F.col("_at") - 1)
    out = out.withColumn("posterior", posterior).withColumn("language", F.when(F.col("_letters"), language))
    kept = F.col("_letters") & F.col("language").isNotNull() & (F.col("posterior") >= LEAST_POSTERIOR)
    return out.select("_row", "language", "posterior", F.coalesce(kept, F.lit(False)).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a known language, with their own columns."""
    model = train(labelled_texts(docs))
    return identified(docs, model, Evidence(hosts=(F.col("source"),)), docs.columns).where("kept").select("_row.*")


def op3_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, language, posterior and kept of every document; hosts are sources, and there is no markup or address."""
    model = train(labelled_texts(docs))
    return identified(docs.select("doc_id", "text", "source", "lang"), model, Evidence(hosts=(F.col("source"),)), ["doc_id"]).select("_row.doc_id", "language", "posterior", "kept")


def page_evidence() -> Evidence:
    """What a page's html and url say: the lang attribute, the first path part or last label of the host, domain and host."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    path = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    last = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    named = lambda c: F.when(c != "", c)
    return Evidence(named(declared), F.coalesce(named(path), named(last)), (named(domain), named(host)))


def identified_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, language, posterior and kept of every page, with models trained on documents."""
    model = train(labelled_texts(docs))
    body = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</\1>", " ")
    rows = pages.withColumn("text", F.regexp_replace(body, r"<[^>]*>|&[a-z#0-9]+;", " "))
    return identified(rows, model, page_evidence(), ["page_id"]).select("_row.page_id", "language", "posterior", "kept")
