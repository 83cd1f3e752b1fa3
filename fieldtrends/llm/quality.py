"""Quality rules: statistics of a text and a learned decision list, with DataFrame operations only.

The list is learned by sequential covering over labelled documents: a rule is a conjunction of thresholds on
statistics, grown condition by condition on two thirds of the labels (largest information gain), pruned on
the rest, and emitted as one branch of an ordered Spark conditional expression. Rules describe rejected
documents; what no rule covers is kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrends.llm.common import text_or_empty, whole_row, without_spaces
from fieldtrends.session import staged

#: Fixed values of the contract.
SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]"
WORD_BREAK = SPACE + "+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The list is fitted on so many labelled documents at most (a broadcast of as many pairs of doc_id and label).
LABEL_BOUND = 20_000

#: Statistics a rule may use; all are ratios or counts that every text has.
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share", "line_words"]


def _window(i: Column) -> Column:
    return F.slice("words", i, WINDOW)


def statistics(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to carry, the five base counts and FEATURES of every whole text (null: no words)."""
    text = F.col("text")
    split = docs.select("doc_id", *carry, text_or_empty().alias("text")).select(
        "doc_id", *carry, "text", F.filter(F.split(text, WORD_BREAK, -1), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(without_spaces(text)).cast("bigint").alias("word_chars"),
    )
    n = F.size("words")
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    counted = split.withColumn("n_words", n.cast("bigint")).withColumn(
        "prints", F.when(n > WINDOW, F.transform(starts, lambda i: F.xxhash64(_window(i)))).otherwise(F.array().cast("array<bigint>"))
    ).withColumn("again", F.size(F.array_distinct("prints")) < F.size("prints"))
    # Only a text with equal fingerprints can hold a window twice; there the windows themselves are sorted and compared.
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(_window(i), " ").alias("w"), i.alias("i"))))
    counted = counted.withColumn("windows", F.when(F.col("again"), windows))
    last = F.size("windows")

    def at(i: Column) -> Column:
        return F.element_at(F.col("windows"), i)["w"]

    twice = F.filter(
        F.transform("windows", lambda x, k: F.when(
            ((k > 0) & (at(F.greatest(k, F.lit(1))) == x["w"])) | ((k + 2 <= last) & (at(F.least(k + 2, last)) == x["w"])), x["i"])),
        lambda i: i.isNotNull(),
    )
    counted = counted.withColumn("twice", F.array_sort(twice))
    # words under the windows: each window adds what the one before it has not covered
    under = F.aggregate(
        "twice", F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("prev")),
        lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["prev"])).alias("sum"), i.alias("prev")),
        lambda a: a["sum"],
    )
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return counted.select(
        "doc_id", *carry, "n_words", "word_chars", F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("again"), under), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("uppers"), F.regexp_count("text", F.lit(r"[!?]")).alias("marks"),
        F.regexp_count("text", F.lit("[0-9]")).alias("digits"), F.size(F.array_distinct("words")).alias("distinct_words"),
        F.size("lines").alias("n_lines"),
    ).select(
        "doc_id", *carry, *BASE,
        (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"), (F.col("uppers") / chars).alias("upper_share"),
        (F.col("marks") / words).alias("mark_share"), (F.col("digits") / chars).alias("digit_share"),
        (F.col("distinct_words") / words).alias("distinct_share"),
        (F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1))).alias("line_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def decision(rules: list[Rule]) -> Column:
    """Number of the first rule that covers the row, as an ordered conditional expression; null: no rule, the row is kept."""
    out = None
    for i, rule in enumerate(rules):
        out = F.when(covers(rule), i) if out is None else out.when(covers(rule), i)
    return F.lit(None).cast("int") if out is None else out


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each statistic over rejected and over kept labels (both matter when one is rare)."""
    steps = [(i + 0.5) / bins for i in range(bins)]
    found: dict[str, set] = {f: set() for f in FEATURES}
    for bad in (True, False):
        got = rows.filter(F.col("bad") == bad).agg(*[F.percentile_approx(F.col(f).cast("double"), steps, 1000).alias(f) for f in FEATURES]).first()
        for f in FEATURES:
            found[f] |= set(got[f] or ())
    return {f: sorted(v) for f, v in found.items()}


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """Per statistic and interval between thresholds: (rejected, kept) labels. A few hundred numbers reach the driver."""
    def place(f: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts[f]]), lambda t: t < F.col(f).cast("double")))

    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), place(f).alias("cell")) for i, f in enumerate(FEATURES) if cuts[f]]))
    got = rows.select("bad", cells.alias("x")).groupBy("x.f", "x.cell").agg(
        F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
    out = {f: [(0, 0)] * (len(cuts[f]) + 1) for f in FEATURES}
    for r in got:
        out[FEATURES[r["f"]]][r["cell"]] = (r["p"], r["n"])
    return out


def _best(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[float, Condition | None]:
    """The condition with the largest gain (covered rejected labels times the rise of log precision)."""
    cells = _histogram(rows, cuts)
    best: tuple[float, Condition | None] = (0.0, None)
    for f in FEATURES:
        p_all, n_all = (sum(c[i] for c in cells[f]) for i in (0, 1))
        if not p_all:
            continue
        now = math.log2((p_all + 1e-9) / (p_all + n_all))
        p_low = n_low = 0
        for k, t in enumerate(cuts[f]):
            p_low, n_low = p_low + cells[f][k][0], n_low + cells[f][k][1]
            for above, p, n in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
                if p:
                    gain = p * (math.log2(p / (p + n)) - now)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(f, above, t))
    return best


def _centred(rows: DataFrame, c: Condition) -> Condition:
    """The same condition with its threshold halfway between the two nearest values of the rows."""
    x = F.col(c.feature).cast("double")
    low, high = rows.agg(F.max(F.when(x <= c.threshold, x)), F.min(F.when(x > c.threshold, x))).first()
    return c if low is None or high is None else Condition(c.feature, c.above, (low + high) / 2)


def learn(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, bins: int = 24, min_precision: float = 0.98, min_covered: int = 20) -> list[Rule]:
    """Decision list from ``doc_id``, ``bad`` (boolean) and the statistics.

    A rule that is less precise than ``min_precision`` or covers fewer than ``min_covered`` rejected labels ends
    the search: clean documents matter more than the last bad one. Every pass aggregates the labelled table; only histograms reach the driver.
    """
    rows = staged(labelled.select("doc_id", F.col("bad").cast("boolean").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow"), *FEATURES).filter("bad is not null"))
    cuts = _thresholds(rows, bins)
    rules: list[Rule] = []
    while len(rules) < max_rules and any(cuts.values()):
        rest = rows.filter(decision(rules).isNull())
        rule: Rule = ()
        while len(rule) < max_conditions:
            reach = rest.filter("grow").filter(covers(rule))
            gain, condition = _best(reach, cuts)
            if condition is None or gain < 1:
                break
            rule += (_centred(reach, condition),)
        if not rule:
            break
        # prune: the shortest prefix with the best value on labels not used to grow
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        got = rest.agg(*[
            F.count_if(covers(r) & (F.col("bad") == bad) & (F.col("grow") if grow else ~F.col("grow"))).alias(f"c{k}_{bad:d}{grow:d}")
            for k, r in enumerate(prefixes) for bad in (True, False) for grow in (True, False)
        ]).first()

        def value(k: int) -> float:
            p, n = got[f"c{k}_10"], got[f"c{k}_00"]
            return (p - n) / (p + n) if p + n else -1.0

        k = max(range(len(prefixes)), key=lambda j: (round(value(j), 3), -j))
        p, n = (got[f"c{k}_{b}0"] + got[f"c{k}_{b}1"] for b in (1, 0))
        if p < min_covered or p < min_precision * (p + n):
            break
        rules.append(prefixes[k])
    return rules


def label_sample(labels: DataFrame, bound: int = LABEL_BOUND) -> DataFrame:
    """At most ``bound`` labelled documents, chosen by a hash of doc_id: doc_id, bad."""
    known = labels.filter("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad")).distinct()
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(bound)


def labelled_statistics(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of labelled documents with ``bad`` = quality 0. Documents that fail the base rules are left out: the list adds to them."""
    return stats.filter(~base_failed()).join(F.broadcast(label_sample(labels)), "doc_id")


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (number of the first rule that covers the document) and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules)).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """One row per document with statistics and verdict, and the learned list.

    Null text has no words and fails the base rules, like every text of fewer than 20 words. Rows with equal
    doc_id are judged one by one. Without labels, or without a good enough rule, the list is empty and the base
    rules decide alone. More columns are ignored.
    """
    stats = staged(statistics(docs))
    rules = learn(labelled_statistics(stats, labels))
    return judge(stats, rules), rules


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns, whatever their names; every row is judged by its own text.

    Null text fails, repeated rows are judged alike, rows without doc_id are judged but not learned from, and an empty table stays empty.
    """
    sample = F.broadcast(label_sample(labels))
    some = docs.select("doc_id", "text").join(sample.select("doc_id"), "doc_id", "left_semi")
    rules = learn(labelled_statistics(staged(statistics(some)), labels))
    stats = statistics(docs.select("doc_id", "text", whole_row(docs)), carry=["row"])
    # The row number keeps the filter above the statistics; pushed below, it would compute each of them anew for every use.
    judged = judge(stats.withColumn("__nr", F.monotonically_increasing_id()), rules)
    return judged.filter(F.col("kept") & (F.col("__nr") >= 0)).select("row.*")
