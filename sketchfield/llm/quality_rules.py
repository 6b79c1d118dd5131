"""Host-level quality rules, in DataFrame functions alone.

Rules judge each document; failures are aggregated by host (the ``source`` column), each host's
failure rate of each rule is shrunk towards the corpus by an empirical beta prior (fitted to
the hosts' rates, weighted by their documents and without the noise of counting, by the method of
moments), and a host is rejected with all its documents if its posterior mean is above a threshold
by ``DEVIATIONS`` posterior standard deviations.  The threshold is ``TIMES`` the corpus rate, but
``LEAST_RATE`` at least and ``MOST_RATE`` at most.

Words are ``[^\\x20\\x09-\\x0D]+``.  Lines are separated by \\n.  A null text has no words and fails
as too short; so does the empty text.  A null host is a host of its own.  A document with tied
or repeated windows counts each covered word once.  Repeated rows are judged and counted once
for each row.  An empty table gives an empty table.  ``kept_documents`` returns the input's
columns as they are, whatever their names.

Only the few host totals are shuffled by host: documents are pre-aggregated before that, and the
rejected hosts are joined back by a broadcast if they are few (checked) and by a shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, stored

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_SYMBOL_PERCENT = 20
MAX_DUP_LINE_PERCENT = 10
TIMES, LEAST_RATE, MOST_RATE = 2.0, 0.2, 0.5
DEVIATIONS = 2.0
BROADCAST_HOSTS = 10_000

RULES = ("too_short", "repetitive", "symbols", "dup_lines")


def _staged(df: DataFrame, steps: dict[str, Callable[[dict[str, Column]], Column]]) -> tuple[DataFrame, dict[str, Column]]:
    """Each step in a projection of its own, so that what several later ones use is computed once."""
    have: dict[str, Column] = {}
    for step, make in steps.items():
        name = free_name(df, step)
        df = df.withColumn(name, make(have))
        have[step] = F.col(f"`{name}`")
    return df, have


def _doubled(grams: Column, step: int) -> Column:
    """Hashes of windows twice as long, of neighbours at a distance of ``step``; those at the end are short."""
    return F.transform(grams, lambda g, i: F.xxhash64(g, F.get(grams, i + step)))


def _starts(order: Column, hashes: Column) -> Column:
    """Starts of windows whose hash a neighbour in (hash, start) order has too."""
    repeated = lambda x, i: (F.get(hashes, i - 1) == x.g) | (F.get(hashes, i + 1) == x.g)
    return F.sort_array(F.array_compact(F.transform(order, lambda x, i: F.when(repeated(x, i), x.i))))


def _covered(starts: Column) -> Column:
    """Words in windows at these starts."""
    steps = F.transform(starts, lambda x, i: F.least(F.get(starts, i + 1) - x, F.lit(WINDOW)))  # least skips the null after the last
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def with_statistics(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with a struct column ``out`` of the statistics of each text.

    Windows are compared by 64-bit hashes built by doubling, and sorted only where some repeat.
    """
    space = F.lit(SPACE)
    staged, have = _staged(
        docs,
        {
            "t": lambda c: F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")),
            "trimmed": lambda c: F.btrim(c["t"], space),
            "words": lambda c: F.when(c["trimmed"] == "", F.array().cast("array<string>")).otherwise(F.split(c["trimmed"], r"[\x20\x09-\x0D]+")),
            "one": lambda c: F.when(F.size(c["words"]) > WINDOW, F.transform(c["words"], lambda w: F.xxhash64(w))),
            "two": lambda c: _doubled(c["one"], 1),
            "four": lambda c: _doubled(c["two"], 2),
            "all": lambda c: _doubled(c["four"], 4),
            "eight": lambda c: F.slice(c["all"], 1, F.size(c["all"]) - (WINDOW - 1)),
            "order": lambda c: F.when(
                F.size(F.array_distinct(c["eight"])) < F.size(c["eight"]),
                F.sort_array(F.transform(c["eight"], lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
            ),
            "hashes": lambda c: F.transform(c["order"], lambda x: x.g),
            "starts": lambda c: F.when(c["order"].isNotNull(), _starts(c["order"], c["hashes"])),
            "lines": lambda c: F.transform(F.filter(F.split(c["t"], "\n"), lambda x: F.btrim(x, space) != ""), lambda x: F.xxhash64(x)),
            out: lambda c: F.struct(
                F.size(c["words"]).cast("long").alias("n_words"),
                F.length(F.translate(c["t"], SPACE, "")).cast("long").alias("word_chars"),
                (F.length(c["t"]) - F.length(F.translate(c["t"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long").alias("n_dup_lines"),
                F.size(c["lines"]).cast("long").alias("n_lines"),
                F.coalesce(F.when(c["starts"].isNotNull(), _covered(c["starts"])), F.lit(0).cast("long")).alias("n_repeat_words"),
                F.monotonically_increasing_id().alias("at"),  # being non-deterministic, it keeps filters from being pushed below and inlining all of this
            ),
        },
    )
    return staged.select(*(F.col(f"`{c}`") for c in docs.columns), have[out].alias(out))


def rule_failures(s: Column) -> dict[str, Column]:
    """Whether each rule fails, of a struct of statistics."""
    return {
        "too_short": s.n_words < MIN_WORDS,
        "repetitive": 100 * s.n_repeat_words > MAX_REPEAT_PERCENT * s.n_words,
        "symbols": 100 * s.n_symbols > MAX_SYMBOL_PERCENT * s.word_chars,
        "dup_lines": 100 * s.n_dup_lines > MAX_DUP_LINE_PERCENT * s.n_lines,
    }


def base_failed(s: Column) -> Column:
    failures = rule_failures(s)
    return failures["too_short"] | failures["repetitive"]


def rejected_hosts(flags: DataFrame, host: str) -> DataFrame:
    """One row ``host`` for each rejected host, of documents with a boolean column for each rule.

    Where the hosts' rates don't vary more than counting explains, all have the corpus rate and none
    is rejected; where they vary more than a beta can, the prior weighs as one document.
    """
    by_host = flags.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES))
    sums = by_host.agg(
        F.sum("n").alias("docs"),
        F.count(F.lit(1)).alias("hosts"),
        *(x for r in RULES for x in (F.sum(r).alias(f"{r}_sum"), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_squares"))),
    )
    rules = F.array(*(F.struct(F.col(r).alias("fails"), F.col(f"{r}_sum").alias("sum"), F.col(f"{r}_squares").alias("squares")) for r in RULES))
    each = by_host.crossJoin(F.broadcast(sums)).select("host", "n", "docs", "hosts", F.inline(rules))  # the sums are one row
    p, between, weight, mean = (F.col(c) for c in ("p", "between", "weight", "mean"))
    noise = p * (1 - p)
    each = each.withColumn("p", F.col("sum") / F.col("docs"))
    each = each.withColumn("between", F.col("squares") / F.col("docs") - p * p - noise * (F.col("hosts") - 1) / F.col("docs"))
    each = each.withColumn("weight", F.when(between < noise, noise / F.nullif(between, F.lit(0.0)) - 1).otherwise(F.lit(1.0)))
    each = each.withColumn("mean", (F.col("fails") + p * weight) / (F.col("n") + weight))
    deviation = F.sqrt(F.greatest(mean * (1 - mean), F.lit(0.0)) / (F.col("n") + weight + 1))
    limit = F.least(F.lit(MOST_RATE), F.greatest(F.lit(LEAST_RATE), TIMES * p))
    bad = F.bool_or(F.when(between > 0, mean - DEVIATIONS * deviation > limit).otherwise(F.lit(False)))
    return each.groupBy("host").agg(bad.alias("bad")).where("bad").select("host")


def _in_rejected(df: DataFrame, host: str, bad: DataFrame, how: str) -> DataFrame:
    """Left or anti join with the rejected hosts; they are broadcast only if few."""
    if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    return df.join(bad, df[host].eqNullSafe(bad["host"]), how)


def verdicts(docs: DataFrame) -> DataFrame:
    """Per document: the statistics, base_failed and kept. The statistics are stored, then joined with the hosts."""
    stats = stored(with_statistics(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", "source"), "text", "s").select("doc_id", "source", "s"), "rules")
    flags = stats.select("source", *(c.alias(r) for r, c in rule_failures(F.col("s")).items()))
    bad = stored(rejected_hosts(flags, "source"), "hosts").withColumn("rejected", F.lit(True))
    failed = base_failed(F.col("s"))
    return _in_rejected(stats, "source", bad, "left").select(
        "doc_id", *(
            f"s.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        ), failed.alias("base_failed"), (~failed & F.col("rejected").isNull()).alias("kept")
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that neither fail a base rule nor come from a rejected host. They are stored with their failures, judged once."""
    s, own = free_name(docs, "statistics"), free_name(docs, "rules")
    judged = with_statistics(docs, "text", s)
    failures = rule_failures(F.col(s))
    judged = judged.select(*(F.col(f"`{c}`") for c in docs.columns), F.struct(*(c.alias(r) for r, c in failures.items())).alias(own))
    judged = stored(judged, "judged")
    bad = stored(rejected_hosts(judged.select("source", f"{own}.*"), "source"), "hosts").withColumnRenamed("host", free_name(docs, "host"))
    host = bad.columns[0]
    good = judged.where(~(F.col(f"{own}.too_short") | F.col(f"{own}.repetitive")))
    few = bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    return good.join(F.broadcast(bad) if few else bad, good["source"].eqNullSafe(bad[host]), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
