"""Quality rules per document, judged again per host.

Every document is measured by rules on its own words and lines. The rules'
failures are then counted per host; each host's rate is shrunk towards the
rate of all hosts by a beta prior whose two parameters are fitted to the
hosts' own rates (method of moments), so a host of a few documents is not
condemned by one bad page. A host whose shrunk rate of any rule lies above the
limit is rejected with all its documents. Only built-in expressions run.

Cases: a null text counts as empty and fails; a null host is no host and is
not judged; repeated rows are each counted and each returned; an empty table
gives an empty table; other columns are kept, those named like an added one
are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joining import join_back
from ..plans.session import written
from .expr import let, total, whole, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    # More symbols than this share of the words, or more repeated lines than
    # this share of the lines with a word, count against the host only.
    max_symbol_percent: int = 50
    max_dup_line_percent: int = 50
    # A host is rejected when the shrunk rate of a rule is above this.
    host_limit: float = 0.5
    # Weight of the prior, in documents, when the hosts' rates don't differ.
    prior_weight: float = 20.0


def _repeated(w: Column) -> Column:
    """Words within windows of eight words that the text has twice or more."""
    n = F.size(w)

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            return F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"])

        starts = let(placed, lambda s: F.array_sort(twice(s)))
        step = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return let(starts, lambda p: total(step(p)))

    hashes = F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    repeated = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(repeated).cast("long")


def measure(text: Column) -> Column:
    """Struct of the measures of one text and its number of lines with a word."""
    t = whole(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    by_words = let(words(t), lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("c"), _repeated(w).alias("r")))
    parts = F.struct(by_words.alias("w"), by_lines.alias("l"), symbols.alias("s"))
    return let(parts, lambda p: F.struct(
        p["w"]["n"].cast("long").alias("n_words"), p["w"]["c"].cast("long").alias("word_chars"), p["s"].cast("long").alias("n_symbols"),
        (p["l"]["n"] - p["l"]["d"]).cast("long").alias("n_dup_lines"), p["w"]["r"].alias("n_repeat_words"), p["l"]["n"].cast("long").alias("n_lines")))


def _failures(m: Column, rules: Rules) -> dict[str, Column]:
    return {
        "base": (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"]),
        "symbols": 100 * m["n_symbols"] > rules.max_symbol_percent * m["n_words"],
        "lines": 100 * m["n_dup_lines"] > rules.max_dup_line_percent * m["n_lines"],
    }


def host_verdicts(failed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per host: documents, failures and shrunk rate of each rule, verdict.

    ``failed`` has ``host`` and a boolean ``fail_<rule>`` for each rule. Of a
    rule's prior only the mean and the variance come to the driver.
    """
    names = [c.removeprefix("fail_") for c in failed.columns if c.startswith("fail_")]
    hosts = failed.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"n_{r}") for r in names])
    rate = lambda r: F.col(f"n_{r}") / F.col("host_docs")
    moments = hosts.agg(*[x for r in names for x in (F.avg(rate(r)).alias(f"m_{r}"), F.var_pop(rate(r)).alias(f"v_{r}"))]).first()
    judged = hosts
    for r in names:
        # Rounded, so that sums taken in another order give the same prior.
        m, v = round(moments[f"m_{r}"] or 0.0, 9), round(moments[f"v_{r}"] or 0.0, 12)
        weight = round(m * (1 - m) / v - 1, 6) if v > 0 else 0.0
        weight = weight if weight > 0 else rules.prior_weight
        judged = judged.withColumn(f"rate_{r}", F.round((F.col(f"n_{r}") + m * weight) / (F.col("host_docs") + weight), 6))
    kept = F.greatest(F.lit(0.0), *[F.col(f"rate_{r}") for r in names]) <= rules.host_limit
    return judged.select("host", "host_docs", *[f"rate_{r}" for r in names], kept.alias("host_kept"))


def judge(docs: DataFrame, rules: Rules = Rules(), host: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with their measures, ``base_failed``, the host's rates and ``kept``.

    ``keep`` names the columns that are carried along, all by default. Texts
    are read once: rows and measures are written, and the second pass joins
    the verdicts to them.
    """
    carried = docs.columns if keep is None else keep
    measured = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(host).alias("host"), measure(F.col(text)).alias("m"))
    rows = written(measured.select("*", *[c.alias(f"fail_{r}") for r, c in _failures(F.col("m"), rules).items()]), "quality")
    joined = join_back(rows, host_verdicts(rows.drop("row", "m"), rules).withColumn("docs", F.col("host_docs")), ["host"], "docs")
    added = [F.col(f"m.{c}").alias(c) for c in MEASURES] + [F.col("fail_base").alias("base_failed"), F.coalesce("host_kept", F.lit(True)).alias("host_kept"),
             F.col("rate_base").alias("host_rate"), (~F.col("fail_base") & F.coalesce("host_kept", F.lit(True))).alias("kept")]
    names = {*MEASURES, "base_failed", "host_kept", "host_rate", "kept"}
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in carried if c not in names], *added)


def accepted(docs: DataFrame, rules: Rules = Rules(), host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    whole_row = docs.select(F.struct("*").alias("whole_row"), F.col(host).alias("host_of_row"), F.col(text).alias("text_of_row"))
    return judge(whole_row, rules, "host_of_row", "text_of_row", ["whole_row"]).where("kept").select("whole_row.*")
