"""Quality rules with host-level verdicts, in DataFrame functions only.

Each document is measured against rules; failures are summed by host (``source``), each host's rate is shrunk
towards the corpus with a beta prior whose strength is estimated from the spread of the hosts' rates, and the
verdict of the host is joined back to its documents.

Defined cases: a null text counts as empty (no words, so it fails); a null host has no verdict and passes; repeated
rows are measured one by one; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import SPACE_CLASS, TEXT_ROWS, boxed, staged, text_or_empty

#: A text with fewer words fails.
MIN_WORDS = 50
#: A host whose shrunk failure rate of any rule is above this is rejected: of its documents three in four or more fail, once its
#: rate has been drawn towards the corpus, so that those which pass do so by chance rather than by quality. Hosts that merely have more
#: failures than others stay; their documents are judged one by one.
MAX_HOST_RATE = 0.75
#: Bounds of the prior's strength (documents that the prior is worth).
PRIOR_LEAST, PRIOR_MOST = 1.0, 10_000.0

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Per-document rules, as SQL over the measures; both engines read the same text.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "lines": "4 * n_dup_lines > n_words",
}


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 3-word windows that occur twice or more in the array column _words.

    Every step is a column of its own, so that no array is computed again for each element. The windows' hashes are
    sorted with their places; equal neighbours are repeats; their places, sorted, cover 3 words each less overlaps.
    """
    windows = F.when(
        F.size("_words") > 3,
        F.expr("transform(slice(_words, 1, size(_words) - 2), (w, i) -> xxhash64(w, _words[i + 1], _words[i + 2]))"),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    df = df.withColumn("_wins", windows)
    df = df.withColumn("_some", F.size(F.array_distinct("_wins")) < F.size("_wins"))
    df = df.withColumn("_sorted", F.when(F.col("_some"), F.expr("array_sort(transform(_wins, (h, i) -> struct(h, i)))")))
    at = "filter(transform(_sorted, (x, k) -> if(x.h = get(_sorted, k - 1).h or x.h = get(_sorted, k + 1).h, x.i, -1)), p -> p >= 0)"
    df = df.withColumn("_at", F.when(F.col("_some"), F.expr(f"array_sort({at})")))
    covered = "aggregate(transform(_at, (p, k) -> coalesce(least(3, get(_at, k + 1) - p), 3)), 0L, (a, x) -> a + x)"
    return df.withColumn("n_repeat_words", F.when(F.col("_some"), F.expr(covered)).otherwise(F.lit(0)).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of each whole text and base_failed."""
    own = docs.columns
    df = docs.withColumn("_text", text_or_empty())
    df = df.withColumn("_words", F.expr(rf"filter(split(_text, '[\\x20\\x09-\\x0D]+'), w -> w != '')"))
    df = df.withColumn("_lines", F.expr(r"filter(split(_text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": (F.length("_text") - F.regexp_count("_text", F.lit(SPACE_CLASS))).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    df = _repeat_words(df)
    df = df.withColumn("base_failed", base_failed())
    return df.select(*own, *MEASURES, "base_failed")


def base_failed() -> Column:
    return F.expr(f"{RULES['short']} or {RULES['repetitive']}")


def host_rates(facts: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, failures by rule, shrunk rates and host_ok. Null hosts are left out.

    The prior of a rule is the beta distribution with the pooled mean m and the document-weighted variance v of the
    hosts' rates: strength k = m (1 - m) / v - 1, kept within bounds. The shrunk rate is (f + m k) / (n + k).

    The counts are written, so that their size is known: a small table of hosts is sent around, and no text is shuffled by its
    host, which may have a third of all.
    """
    sums = [F.sum(F.expr(f"cast({rule} as bigint)")).alias(f"f_{name}") for name, rule in RULES.items()]
    hosts = facts.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *sums)
    return shrunk(staged(hosts, "host-counts"))


def shrunk(hosts: DataFrame) -> DataFrame:
    """Adds the shrunk rate of each rule and host_ok to host counts; the priors come from two rows of sums over all hosts."""
    sums = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"f_{r}").alias(r) for r in RULES]).first()
    total = sums["n"] or 1
    mean = {r: (sums[r] or 0) / total for r in RULES}
    spread = hosts.agg(*[F.sum(F.expr(f"n * pow(f_{r} / n - {mean[r]!r}D, 2)")).alias(r) for r in RULES]).first()
    out = hosts
    for r in RULES:
        variance = (spread[r] or 0.0) / total
        strength = max(PRIOR_LEAST, min(PRIOR_MOST, mean[r] * (1 - mean[r]) / variance - 1 if variance > 0 else PRIOR_MOST))
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + mean[r] * strength) / (F.col("n") + strength))
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    return out.select("host", "n", *[f"rate_{r}" for r in RULES], (worst <= MAX_HOST_RATE).alias("host_ok"))


def judged(docs: DataFrame, host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """_row (a struct of the ``keep`` columns, doc_id at least) with host, measures, base_failed and kept.

    kept is false for a failed document, else the verdict of its host. The measures are written once, with the
    columns to keep, before the hosts are summed and joined: no array is computed twice.
    """
    own = docs.select(boxed(keep or ["doc_id"]), F.col(host).alias("host"), "text")
    rows = staged(measured(own).select("_row", "host", *MEASURES, "base_failed"), "quality-facts", docs.count(), TEXT_ROWS)
    verdicts = host_rates(rows, "host").select(F.col("host").alias("_host"), "host_ok")
    out = rows.join(verdicts, F.col("host") == F.col("_host"), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))).drop("_host", "host_ok")


def kept_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    return judged(docs, host, docs.columns).where("kept").select("_row.*")


def verdict_sql(documents: str) -> str:
    """DuckDB SQL with the columns of op5 and text, source, lang and n_chars for the rows of ``documents``.

    Rows are told apart by rowid within the statement, so repeated documents stay apart.
    """
    rules = {r: f"({e})" for r, e in RULES.items()}
    sums = ", ".join(f"sum(CAST({e} AS BIGINT)) AS f_{r}" for r, e in rules.items())
    means = ", ".join(f"sum(f_{r})::DOUBLE / sum(n) AS m_{r}" for r in rules)
    spreads = ", ".join(f"max(m_{r}) AS m_{r}, sum(n * pow(f_{r}::DOUBLE / n - m_{r}, 2)) / sum(n) AS v_{r}" for r in rules)
    strength = {r: f"greatest({PRIOR_LEAST}, least({PRIOR_MOST}, CASE WHEN v_{r} > 0 THEN m_{r} * (1 - m_{r}) / v_{r} - 1 ELSE {PRIOR_MOST} END))" for r in rules}
    worst = ", ".join(f"(f_{r} + m_{r} * {k}) / (n + {k})" for r, k in strength.items())
    return rf"""
WITH q_rows AS (SELECT row_number() OVER () AS rid, d.*, coalesce(text, '') AS t FROM {documents} d),
q_words AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, t FROM q_rows),
q_lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM q_rows),
q_wins AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM q_words WHERE len(ws) > 2),
q_win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM q_wins),
q_twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM q_win) WHERE c > 1),
q_covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM q_twice) GROUP BY rid),
q_facts AS (
  SELECT r.*, len(w.ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(r.t) - length(regexp_replace(r.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l.ls) - len(list_distinct(l.ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM q_rows r JOIN q_words w USING (rid) JOIN q_lines l USING (rid) LEFT JOIN q_covered c USING (rid)),
q_hosts AS (SELECT source AS host, count(*) AS n, {sums} FROM q_facts WHERE source IS NOT NULL GROUP BY source),
q_means AS (SELECT {means} FROM q_hosts),
q_spread AS (SELECT {spreads} FROM q_hosts, q_means),
q_verdicts AS (SELECT host, greatest({worst}) <= {MAX_HOST_RATE} AS host_ok FROM q_hosts, q_spread),
q_judged AS (
  SELECT f.*, ({rules['short']} OR {rules['repetitive']}) AS base_failed,
    NOT ({rules['short']} OR {rules['repetitive']}) AND coalesce(v.host_ok, true) AS kept
  FROM q_facts f LEFT JOIN q_verdicts v ON f.source = v.host)
"""


COLUMNS = ["doc_id", *MEASURES, "base_failed", "kept"]


def op5_sql() -> str:
    return f"{verdict_sql('documents')} SELECT {', '.join(COLUMNS)} FROM q_judged"


def op5_quality_rules(docs: DataFrame) -> DataFrame:
    return judged(docs).select("_row.doc_id", *COLUMNS[1:])
