"""Document quality rules with verdicts per host."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import SPACE_CHARS, addressed, fresh_name, let, with_decisions, word_array
from tidemill.plans.session import cut_lineage, hint_small

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    A document fails a soft rule beyond ``symbol_percent`` symbols, or ``dup_line_percent``
    repeated lines, per 100 words. Hosts are told apart by their shrunk rates of failing documents, in
    standard deviations of the fitted prior above its mean: from ``watch_margin`` on a host loses the documents that
    fail a soft rule, and from ``host_margin`` on, if more than ``host_limit`` of its documents fail, it loses all.
    Where the hosts' rates don't differ by more than chance explains, no host is watched.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    symbol_percent: int = 30
    dup_line_percent: int = 10
    watch_margin: float = 0.5
    host_margin: float = 1.0
    host_limit: float = 0.5


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by a 64-bit hash together with its position; a text without repeated windows
    never reaches the sort of (hash, position) pairs. Linear memory, n log n time, also for long texts.
    """
    hashes = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda p, i: F.get(s, i - 1)["h"].eqNullSafe(p["h"]) | F.get(s, i + 1)["h"].eqNullSafe(p["h"])),
                lambda p: p["i"],
            )
        )
        # every repeated window adds the words up to the next one, three at most
        steps = lambda r: F.aggregate(
            F.transform(r, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(r, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
        )
        return let(ordered, lambda s: let(places(s), steps))

    return F.when(
        F.size(words) >= 4,
        let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))),
    ).otherwise(F.lit(0))


def base_counts(text: Column) -> Column:
    """Struct of the counts of one whole text; all are 0 for null."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return let(
        word_array(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def soft_failures(c: Column, rules: Rules) -> Column:
    """Whether the symbol rule or the line rule fails."""
    return (100 * c["n_symbols"] > rules.symbol_percent * c["n_words"]) | (100 * c["n_dup_lines"] > rules.dup_line_percent * c["n_words"])


def shrunk_rates(hosts: DataFrame) -> DataFrame:
    """Add ``rate`` and ``margin`` to rows (n, failed): the failure rate shrunk towards all hosts' mean, and how many
    standard deviations of the prior it lies above that (0 where there is no spread).

    The beta prior has the mean of all documents; its weight follows from the spread of the hosts' rates
    beyond what chance explains (method of moments), and is unlimited where there is no such spread.
    """
    total = hosts.agg(
        F.sum("n").alias("all_n"),
        F.sum("failed").alias("all_failed"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n_squares"),
        F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("rate_squares"),
    )
    mean = F.col("all_failed") / F.col("all_n")
    within = mean * (1 - mean)
    between = F.col("rate_squares") - F.col("all_failed") * mean
    room = F.col("all_n") - F.col("n_squares") / F.col("all_n")
    spread = (between - (F.col("hosts") - 1) * within) / F.nullif(room, F.lit(0.0))
    prior = total.select(
        mean.alias("mean"),
        # weight of the prior in documents; null: no spread between hosts, all get the mean
        F.when(spread > 0, F.greatest(within / F.nullif(spread, F.lit(0.0)) - 1, F.lit(0.0))).alias("weight"),
    )
    rate = F.when(F.col("weight").isNull(), F.col("mean")).otherwise((F.col("failed") + F.col("weight") * F.col("mean")) / (F.col("n") + F.col("weight")))
    # the prior is one row
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    margin = F.coalesce((F.col("rate") - F.col("mean")) / F.nullif(deviation, F.lit(0.0)), F.lit(0.0))
    return hosts.join(F.broadcast(prior)).withColumn("rate", rate).withColumn("margin", margin).drop("mean", "weight")


def host_rates(judged: DataFrame, host: str) -> DataFrame:
    """One row per host: n, failed, rate, margin. Counts are combined before the shuffle, so a hot host is cheap."""
    hosts = judged.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failed"))
    return shrunk_rates(hosts)


def measure(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Add ``quality``: struct of the counts of each whole text and of base_failed and soft_failed.

    A column of that name is replaced. Null texts have no words and fail a base rule.
    """
    q = fresh_name(docs, "q")
    counted = docs.withColumn(q, base_counts(F.col(f"`{text}`")))
    c = F.col(q)
    base = (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"])
    fields = [*[c[k].alias(k) for k in COUNTS], base.alias("base_failed"), soft_failures(c, rules).alias("soft_failed")]
    return counted.withColumn("quality", F.struct(*fields)).drop(q)


def judge(measured: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Add host_rate, host_margin and kept to ``quality``.

    Failures of either kind are summed by host, shrunk with an empirical beta prior and turned into a
    verdict per host, which is joined back. Rows without a host form one host of their own (null).
    Repeated rows count as often as they occur. ``measured`` is read twice.
    """
    c, verdict = F.col("quality"), fresh_name(measured, "verdict")
    rates = cut_lineage(host_rates(measured.select(F.col(f"`{host}`").alias("host"), (c["base_failed"] | c["soft_failed"]).alias("failed")), "host"))
    verdicts = rates.select(F.col("host").alias(f"{verdict}host"), F.struct("rate", "margin").alias(verdict))
    joined = measured.join(hint_small(verdicts, rates.count()), F.col(f"`{host}`").eqNullSafe(F.col(f"{verdict}host")), "left")
    v = F.col(verdict)
    lost = (v["margin"] >= rules.host_margin) & (v["rate"] > rules.host_limit)
    kept = ~c["base_failed"] & ~lost & ~(c["soft_failed"] & (v["margin"] >= rules.watch_margin))
    fields = [c[k].alias(k) for k in [*COUNTS, "base_failed", "soft_failed"]]
    judged = F.struct(*fields, v["rate"].alias("host_rate"), v["margin"].alias("host_margin"), kept.alias("kept"))
    return joined.withColumn("quality", judged).drop(verdict, f"{verdict}host")


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Measure all documents once, write them down, and judge them.

    All rows and all other columns are kept. An empty table stays empty.
    """
    return judge(cut_lineage(measure(docs, text, rules)), host, rules)


def keep_documents(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(), stored: bool = False) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever these are called.

    Only counts and verdicts are written; the texts are read twice and stay where they are. ``stored``: see ``addressed``.
    """
    place, mark = fresh_name(docs, "place"), fresh_name(docs, "kept")
    placed = addressed(docs, place, stored)
    counted = measure(placed.select(F.col(place).alias("place"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")), rules=rules).drop("text")
    kept = judge(cut_lineage(counted), "host", rules).where("quality.kept").select("place", F.lit(1).alias("value"))
    return with_decisions(placed, place, kept, mark).where(F.col(mark) == 1).drop(place, mark)
