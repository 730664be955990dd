"""Quality rules by host: failures of document rules, pooled per host and shrunk.

Each document is measured in one pass over its text. Every rule's failures are summed by host,
and a host's failure rate is drawn towards the rate of all hosts by a beta prior that is fitted
to the hosts themselves (method of moments for the beta-binomial). The limit of a rule follows from
the fitted prior: three times the mean rate of all hosts, but no less and no more than two fixed
rates. A host is rejected, with all its documents, if its rate of any rule lies over the limit for
nearly certain: its shrunk rate less three standard deviations of its posterior still does.

Only sums leave the map side, so a host with a third of all documents is no heavier than others;
the table of hosts is written once and joins back by whatever way its size suggests to Spark.

Defined cases: a null text has no words; documents without a host form one host; an empty table
has no hosts; repeated rows count as often as they occur; extra columns pass through untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tarnish.llm.texts import WordIds, fresh, raw_texts
from tarnish.session import materialise

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL over the measures. ``most``: the limit of a host's rate is no higher."""

    name: str
    fails: str
    most: float


#: The first two also reject the document itself.
RULES = (
    Rule("few_words", "n_words < 50", 0.5),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words", 0.5),
    Rule("symbols", "10 * n_symbols > n_words", 0.5),
    Rule("dup_lines", "10 * n_dup_lines > n_words", 0.5),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", 0.5),
)
BASE_RULES = ("few_words", "repeats")
#: A prior is worth at most this many documents, and at least the second figure.
STRONGEST, WEAKEST = 10_000.0, 0.01
#: A host stands out at so many times the mean rate, and at this rate at least, by so many deviations.
TIMES, LEAST, DEVIATIONS = 3.0, 0.3, 3.0


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(ids) < 4:
        return 0
    if ids.max() < 1 << 21:
        windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:  # a text of millions of different words
        windows = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = counts[which] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift:shift + len(repeated)] |= repeated
    return int(covered.sum())


def measure_text(raw: bytes, known: WordIds) -> tuple[int, ...]:
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return (len(words), len(b"".join(words).decode()), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(known.of(words)))


def measured(texts: pa.Array) -> pa.Array:
    known = WordIds()
    rows = np.array([measure_text(raw, known) for raw in raw_texts(texts)], np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(MEASURES))], list(MEASURES))


def host_table(measures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(host, host_docs, <rule>_rate ..., host_ok)`` from ``(host, measures ...)``."""
    counts = measures.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"),
        *[F.sum(F.expr(f"CAST({r.fails} AS INT)")).alias(f"{r.name}_fails") for r in rules])
    counts = materialise(counts, "host-counts")
    n, hosts = F.col("host_docs").cast("double"), F.count(F.lit(1)).cast("double")
    totals = counts.agg(
        hosts.alias("hosts"), F.sum(n).alias("docs"), F.sum(n * n).alias("squares"),
        *[F.sum(f"{r.name}_fails").cast("double").alias(f"{r.name}_k") for r in rules],
        *[F.sum(F.col(f"{r.name}_fails") * F.col(f"{r.name}_fails") / n).alias(f"{r.name}_kk") for r in rules],
    ).first()
    rates, ok = [], F.lit(True)
    for r in rules:
        mean, strength = beta_prior(totals.hosts, totals.docs or 0.0, totals.squares or 0.0,
                                    totals[f"{r.name}_k"] or 0.0, totals[f"{r.name}_kk"] or 0.0)
        rate = (F.col(f"{r.name}_fails") + F.lit(mean * strength)) / (n + F.lit(strength))
        rates.append(rate.alias(f"{r.name}_rate"))
        deviation = F.sqrt(rate * (1 - rate) / (n + F.lit(strength) + 1))
        ok = ok & (rate - DEVIATIONS * deviation <= F.lit(limit(r, mean)))
    return counts.select("host", "host_docs", *rates, ok.alias("host_ok"))


def limit(rule: Rule, mean: float) -> float:
    """The rate over which a host stands out from the others."""
    return min(rule.most, max(LEAST, TIMES * mean))


def beta_prior(hosts: float, docs: float, squares: float, k: float, kk: float) -> tuple[float, float]:
    """Mean and strength (a + b) of the beta prior, from sums over the hosts.

    ``squares``: of documents; ``k``: failures; ``kk``: failures squared over documents. The
    spread that binomial chance alone would give is taken off before the rest sets the strength.
    """
    mean = k / docs if docs else 0.0
    chance = mean * (1 - mean)
    room = docs - squares / docs - (hosts - 1) if docs else 0.0
    if chance <= 0 or room <= 0:
        return mean, STRONGEST
    share = (kk - docs * mean * mean - chance * (hosts - 1)) / (chance * room)
    return mean, (min(STRONGEST, max(WEAKEST, 1 / share - 1)) if share > 0 else STRONGEST)


def judge(docs: DataFrame, text: str = "text", host: str = "source", rules: tuple[Rule, ...] = RULES,
          base: tuple[str, ...] = BASE_RULES, out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out``: the measures, ``base_failed``, ``host_docs``, the host's
    shrunk rates, ``host_ok`` and ``kept``. A column that is called ``out`` already is replaced.

    The texts are read twice, once for the hosts and once for the result, and never shuffled for
    the hosts' sake: the hosts' table is written first, so Spark knows its size when it joins.
    """
    docs = docs.drop(out) if out in docs.columns else docs
    m, h = fresh("_measures", docs.columns), fresh("_host", docs.columns)
    measure = F.arrow_udf(measured, "struct<" + ",".join(f"{x}:bigint" for x in MEASURES) + ">")
    measures = measure(F.col(f"`{text}`").cast("string"))
    with_measures = docs.withColumn(m, measures)
    table = host_table(docs.select(F.col(f"`{host}`").alias("host"), measures.alias(m)).select("host", f"{m}.*"), rules)
    hosts = materialise(table, "hosts")
    failed = F.exists(F.array(F.lit(False), *[
        F.expr(in_struct(r.fails, m)) for r in rules if r.name in base]), lambda x: x)
    kept = ~failed & F.coalesce(F.col(f"{h}.host_ok"), F.lit(True))
    joined = with_measures.join(hosts.select(F.struct(*hosts.columns).alias(h)),
                                F.col(f"`{host}`").eqNullSafe(F.col(f"{h}.host")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        *[F.col(f"{m}.{x}").alias(x) for x in MEASURES], failed.alias("base_failed"), f"{h}.host_docs",
        *[f"{h}.{r.name}_rate" for r in rules], f"{h}.host_ok", kept.alias("kept")).alias(out))


def in_struct(sql: str, struct: str) -> str:
    """The same SQL over the fields of a struct column."""
    for x in MEASURES:
        sql = re.sub(rf"\b{x}\b", f"{struct}.{x}", sql)
    return sql


def keep(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their columns as given."""
    out = fresh("quality", docs.columns)
    return judge(docs, out=out, **options).where(f"{out}.kept").drop(out)
