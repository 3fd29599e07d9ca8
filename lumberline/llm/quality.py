"""Quality rules whose cutoffs carry a guarantee.

Labelled documents that pass the base rules are split in halves by a hash of their text, so that copies are on one side,
and copies count once. The tuning half gives each statistic's bins and their evidence (log ratio of the bad and the good
texts' shares); a document's score is the sum over the statistics. In each stratum the scores of the good tuning texts give
a ladder of cutoffs, from their maximum down. The other half (the holdout) certifies the ladder from the most lenient
rung on: a rung passes if an exact binomial test rejects, at level delta / strata, that more than ``alpha`` of good texts
score above it. Testing stops at the first rung that fails (fixed-sequence testing), and strata share delta (Bonferroni),
so that with probability 1 - delta no stratum loses more than ``alpha`` of its good texts. Of the certified rungs that one
is taken which, on the tuning half, has the best share of bad texts above it less that of good ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool

STATISTICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
NAMES = [x.split()[0] for x in STATISTICS.split(", ")]
SYMBOLS = "#*$%&|<>"
BREAKS = " \t\n\x0b\x0c\r"

#: Statistics that a document's score is made of.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}
#: Quantiles of good texts between the bins of a statistic, and shares of good texts above the cutoffs of the ladder.
BINS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
LADDER = (0.0, 0.001, 0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05)
#: At most this share of a stratum's good texts is lost, but for this probability.
ALPHA, DELTA = 0.05, 0.05
#: Tables of cutoffs up to this size are broadcast.
BROADCAST_ROWS = 100_000


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words stand in a window of ``width`` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    window = ids[:n]
    for k in range(1, width):  # dense codes at each step, so products stay below 2**63
        window = np.unique(window * len(known) + ids[k : n + k], return_inverse=True)[1]
    twice = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The values of STATISTICS for one text; null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BREAKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BREAKS)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def with_statistics(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics of each row's whole text, which a task holds.

    A null text counts as empty (all statistics 0). Rows are kept as they are, with nulls and repeats; an empty table gives
    an empty result. A column of ``keep`` named like a statistic raises a ``ValueError``.
    """
    if clash := sorted(set(keep) & set(NAMES)):
        raise ValueError(f"columns named like statistics: {clash}")
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields) + ", " + STATISTICS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x.as_py()) for x in batch.column(len(keep))]
            columns = [pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * len(NAMES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], [*keep, *NAMES])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, ddl)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), from the largest term down."""
    if k >= n:
        return 1.0
    if p <= 0 or k > n * p:  # not in the lower tail: no evidence
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = math.exp(log_term)
    total = 0.0
    while k >= 0 and term > 1e-18 * total:
        total += term
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
    return min(1.0, total)


def certified_rung(losses: list[int], n: int, alpha: float, level: float) -> int:
    """The last rung such that it and all before pass the exact test; -1 if none does."""
    best = -1
    for i, lost in enumerate(losses):
        if binomial_tail(lost, n, alpha) > level:
            break
        best = i
    return best


def chosen_rung(last: int, caught: list[int], bad: int, lost: list[int], good: int) -> int:
    """Of the rungs up to ``last`` the first with the best share of bad texts caught less that of good ones lost."""
    worth = [caught[i] / max(1, bad) - lost[i] / max(1, good) for i in range(last + 1)]
    return worth.index(max(worth))


def evidence(bad: list[int], good: list[int]) -> list[float]:
    """Of each bin: the log ratio of the bad and the good texts' shares, with half a text added to each."""
    return [math.log((b + 0.5) / (sum(bad) + 1)) - math.log((g + 0.5) / (sum(good) + 1)) for b, g in zip(bad, good)]


def risk_controlled(
    scored: DataFrame,
    labels: DataFrame,
    rules: dict[str, str] = RULES,
    id_col: str = "doc_id",
    unit_col: str = "unit",
    stratum_col: str = "lang",
    label_col: str = "quality",
    eligible: str = "true",
    alpha: float = ALPHA,
    delta: float = DELTA,
    ladder: tuple[float, ...] = LADDER,
    out: str = "accepted",
) -> DataFrame:
    """``scored`` with ``out``: the row's score is not above the certified cutoff of its stratum.

    ``labels`` has ``id_col`` and ``label_col`` (1 good, 0 bad). Only rows for which ``eligible`` holds calibrate; rows with
    equal ``unit_col`` (a hash of the text) are one text, good if one of them is. All labelled rows are counted; to the
    driver go bins, and for each stratum and rung the cutoff and four counts: strata are meant to be few (languages, classes
    of sites). A null stratum is a stratum of its own; rows with a null statistic have the evidence of its lowest bin.
    Strata without a certified rung (too few labels) are accepted whole, and so is an empty table or one without labels.
    Ids that occur twice calibrate by both texts; null ids and null labels never. A column named like ``out`` is replaced.
    """
    names = [f"__r{i}" for i in range(len(rules))]
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("\u0000"))
    scored = scored.drop(out)
    rows = scored.withColumns({n: F.coalesce(F.expr(e).cast("double"), F.lit(-math.inf)) for n, e in zip(names, rules.values())} | {"__stratum": stratum})
    by_id = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) > 0).alias("__good"))
    known = rows.where(eligible).join(by_id, F.col(id_col) == F.col("__id"))
    known = known.groupBy("__stratum", F.col(unit_col).alias("__unit")).agg(F.max("__good").alias("__good"), *[F.max(n).alias(n) for n in names])
    tune = F.pmod(F.xxhash64(F.lit(9), F.col("__unit").cast("string")), F.lit(2)) == 0
    known = spool(known.select("__stratum", "__good", tune.alias("__tune"), *names))
    tuned = known.where("__tune")
    at = F.array(*[F.lit(q) for q in BINS])
    found = tuned.where("__good").agg(*[F.percentile_approx(n, at, 100_000).alias(n) for n in names]).first()
    if found[0] is None:
        return scored.withColumn(out, F.lit(True))
    edges = {n: sorted(set(found[n])) for n in names}

    def bin_of(n: str):
        column = F.lit(len(edges[n]))
        for i, edge in reversed(list(enumerate(edges[n]))):
            column = F.when(F.col(n) <= edge, i).otherwise(column)
        return column

    cells = [(n, b, good) for n in names for b in range(len(edges[n]) + 1) for good in (True, False)]
    sums = tuned.agg(*[F.coalesce(F.sum(((bin_of(n) == b) & (F.col("__good") == good)).cast("long")), F.lit(0)) for n, b, good in cells]).first()
    count = dict(zip(cells, sums))
    score = F.lit(0.0)
    for n in names:
        bins = range(len(edges[n]) + 1)
        for b, e in enumerate(evidence([count[n, b, False] for b in bins], [count[n, b, True] for b in bins])):
            score = score + F.when(bin_of(n) == b, e).otherwise(0.0)
    score = F.round(score, 6)
    known = known.withColumn("__score", score)
    at = F.array(*[F.lit(1 - q) for q in ladder])
    cutoffs = {r["__stratum"]: r["c"] for r in known.where("__tune and __good").groupBy("__stratum").agg(F.percentile_approx("__score", at, 100_000).alias("c")).collect()}
    spark = scored.sparkSession
    small = (lambda df: F.broadcast(df)) if len(cutoffs) * len(ladder) <= BROADCAST_ROWS else (lambda df: df)
    rungs = spark.createDataFrame([(s, i, float(c)) for s, cs in cutoffs.items() for i, c in enumerate(cs)], "__s string, __rung int, __cutoff double")
    tested = known.join(small(rungs), F.col("__stratum") == F.col("__s")).groupBy("__s", "__tune", "__good", "__rung").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("__score") > F.col("__cutoff")).cast("long")).alias("over"))
    n, over = {}, {}
    for r in tested.collect():
        side = r["__s"], r["__tune"], r["__good"]
        n[side] = r["n"]
        over.setdefault(side, [0] * len(ladder))[r["__rung"]] = r["over"]
    chosen = []
    none = [0] * len(ladder)
    for s, cs in cutoffs.items():
        held, good, bad = (s, False, True), (s, True, True), (s, True, False)
        last = certified_rung(over.get(held, none), n.get(held, 0), alpha, delta / len(cutoffs))
        if last >= 0:
            chosen.append((s, float(cs[chosen_rung(last, over.get(bad, none), n.get(bad, 0), over[good], n[good])])))
    final = spark.createDataFrame(chosen, "__s string, __cutoff double")
    joined = rows.withColumn("__score", score).join(small(final), F.col("__stratum") == F.col("__s"), "left")
    return joined.select(*[f"`{c.replace('`', '``')}`" for c in scored.columns], (F.col("__cutoff").isNull() | (F.col("__score") <= F.col("__cutoff"))).alias(out))


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("unit", F.xxhash64("text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = spool(with_statistics(docs, ["doc_id", "lang", "unit"]))
    judged = risk_controlled(scored, labels, eligible=f"not ({BASE_FAILED})")
    failed = F.expr(BASE_FAILED)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("accepted")).alias("kept"))
