"""Quality rules: text statistics and a learned decision list over them.

The statistics are DataFrame expressions within one row; a document never leaves
its scan task. The decision list is learned by sequential covering: each rule is
a conjunction of thresholds, grown for information gain on two thirds of the
labelled statistics and pruned on the rest; the result is an ordered conditional
expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.columns import carried, restored
from tillscope.session import materialise

# ASCII white space and the symbols that count as symbols.
WHITE_SPACE = " \t\n\x0b\f\r"
_SPACES = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"

# The base limits.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

FEATURES = (
    "n_words",
    "mean_word_chars",
    "symbols_per_word",
    "dup_line_share",
    "repeat_word_share",
)

# Labelled rows a decision list is learned from.
MAX_LABELLED = 8_000

# Up to so many doubled hashes are looked up one by one.
_FEW = 32


def words(text: Column) -> Column:
    """The words of a text: maximal runs without ASCII white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, _SPACES)
    )


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A lambda over a one-element array names the value; written out twice, it
    would be computed again for every element of an inner lambda.
    """
    return F.get(F.transform(F.array(value), body), 0)


def fenced(value: Column) -> Column:
    """``value``, marked so that the optimiser does not move it.

    A filter on a computed column is normally pushed below the projection, with
    the whole expression copied into it, lambdas over copied arrays included.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _window(tokens: Column, i: Column) -> list[Column]:
    return [F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)]


def _same_window(x: Column, y: Column) -> Column:
    parts = [x[p] == y[p] for p in ("h", "a", "b", "c")]
    return F.coalesce(parts[0] & parts[1] & parts[2] & parts[3], F.lit(False))


def _covered_by_repeats(tokens: Column, hashes: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    ``hashes`` holds a hash of every window. Only the windows whose hash occurs
    twice are sorted, by hash and then by the words themselves, so that the count
    is exact. O(n log n) in the words of the text; most texts have few such
    windows, and they are found by looking their hash up in a short list.
    """
    positions = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    doubled = bound(
        F.sort_array(hashes),
        lambda ordered: F.array_distinct(
            F.filter(ordered, lambda h, k: F.coalesce(h == F.get(ordered, k - 1), F.lit(False)))
        ),
    )
    picked = bound(
        doubled,
        lambda few: F.when(
            F.size(few) <= _FEW, F.filter(positions, lambda p: F.array_contains(few, p["h"]))
        ).otherwise(positions),
    )
    windows = F.transform(
        picked,
        lambda p: F.struct(
            p["h"].alias("h"),
            *[part.alias(name) for part, name in zip(_window(tokens, p["i"]), "abc")],
            p["i"].alias("i"),
        ),
    )
    repeated = bound(
        F.sort_array(windows),
        lambda ordered: F.filter(
            ordered,
            lambda x, k: _same_window(x, F.get(ordered, k - 1))
            | _same_window(x, F.get(ordered, k + 1)),
        ),
    )
    covered = F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    suspect = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(suspect, F.size(F.array_distinct(F.flatten(covered)))).otherwise(0)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics and the rule features of every whole text.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``
    (long), ``base_failed``, and the columns of ``FEATURES``. A null or empty text
    has no words: all counts are 0 and the base test fails. Existing columns of
    these names are replaced, all others stay.
    """
    plain, docs = docs, carried(docs, [text])
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(
        F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(WHITE_SPACE)) != ""
    )
    tokens = F.col("_words")
    hashes = F.when(
        F.size(tokens) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(tokens) - 3), lambda i: F.xxhash64(*_window(tokens, i))
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    staged = (
        docs.withColumn("_words", fenced(words(F.col(text))))
        .withColumns({"_lines": lines, "_hashes": fenced(hashes)})
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(F.translate(whole, WHITE_SPACE, "")).cast("long"),
                "n_symbols": F.regexp_count(whole, F.lit(_SYMBOLS)).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": fenced(
                    _covered_by_repeats(tokens, F.col("_hashes")).cast("long")
                ),
                "_n_lines": F.size("_lines"),
            }
        )
        .drop("_words", "_lines", "_hashes")
    )

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return restored(
        staged,
        plain.columns,
        [text],
        {
            **{name: F.col(name) for name in counts},
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "mean_word_chars": share("word_chars", "n_words"),
            "symbols_per_word": share("n_symbols", "n_words"),
            "dup_line_share": share("n_dup_lines", "_n_lines"),
            "repeat_word_share": share("n_repeat_words", "n_words"),
        },
    )


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold`` or, if not ``above``, ``feature < threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.above else value < self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a row that any of them covers is rejected."""

    rules: tuple[tuple[Condition, ...], ...]

    def keeps(self) -> Column:
        """The list as one conditional expression: false where a rule fires."""
        verdict = None
        for rule in self.rules:
            fires = F.lit(True)
            for condition in rule:
                fires = fires & condition.column()
            verdict = F.when(fires, False) if verdict is None else verdict.when(fires, False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)


def labelled_statistics(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED
) -> DataFrame:
    """Features and ``bad`` of a bounded sample of labelled rows that pass the base test.

    The sample holds the ``max_labelled`` rows with the smallest hash of the id,
    at every size of the tables; rows without an id or a label take no part. The
    sample's bound is that of the broadcast.
    """
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("bad"))
        .orderBy(F.xxhash64("_id"), "_id", "bad")
        .limit(max_labelled)
    )
    chosen = docs.select("doc_id", "text").join(
        F.broadcast(sample), F.col("doc_id") == F.col("_id")
    )
    return text_statistics(chosen).where("NOT base_failed").select("_id", "bad", *FEATURES)


def learn_rules(
    statistics: DataFrame,
    max_rules: int = 8,
    max_conditions: int = 4,
    cuts_per_feature: int = 64,
    min_precision: float = 0.8,
) -> DecisionList:
    """Learn a decision list from ``labelled_statistics`` by sequential covering.

    Features are cut at quantiles of the bad and of the good rows; Spark counts
    good and bad rows by cell of cuts, and the search works on these counts (at
    most one cell per sampled row). Each rule is grown on two thirds of the ids by
    information gain and pruned on the rest by (p - n) / (p + n); a rule whose
    precision there is below ``min_precision`` ends the list, so that clean rows
    stay. No rows, or no bad ones, give an empty list.
    """
    rows = materialise(statistics)
    shares = [i / cuts_per_feature for i in range(1, cuts_per_feature)]
    quantiles = rows.groupBy("bad").agg(
        *[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES],
        *[F.min(f).alias(f"min_{f}") for f in FEATURES],
        *[F.max(f).alias(f"max_{f}") for f in FEATURES],
    )
    cuts: dict[str, list[float]] = {f: [] for f in FEATURES}
    for found in quantiles.collect():  # two rows
        for f in FEATURES:
            cuts[f] += [*found[f], found[f"min_{f}"], found[f"max_{f}"]]
    # Cut halfway between neighbouring values, so that no class sits on an edge.
    for f in FEATURES:
        values = sorted({float(v) for v in cuts[f]})
        cuts[f] = [(x + y) / 2 for x, y in zip(values, values[1:])]
    if not any(cuts.values()):
        return DecisionList(())

    def cell(f: str) -> Column:
        edges = F.array(*[F.lit(c) for c in cuts[f]]).cast("array<double>")
        return F.size(F.filter(edges, lambda edge: edge <= F.col(f)))

    counted = (
        rows.select(
            "bad",
            (F.pmod(F.xxhash64(F.col("_id"), F.lit("fold")), F.lit(3)) > 0).alias("grow"),
            *[cell(f).alias(f) for f in FEATURES],
        )
        .groupBy("grow", *FEATURES)
        .agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
        .collect()  # at most one row per sampled row
    )
    cells = [(r["grow"], tuple(r[f] for f in FEATURES), r["p"], r["n"]) for r in counted]
    rules = []
    while len(rules) < max_rules:
        grow = [c[1:] for c in cells if c[0]]
        prune = [c[1:] for c in cells if not c[0]]
        rule = _prune(_grow(grow, cuts, max_conditions), prune, grow)
        if not rule:
            break
        p, n = _counts(cells_of(prune, rule))
        if p + n == 0:
            p, n = _counts(cells_of(grow, rule))
        if p < min_precision * (p + n) or p == 0:
            break
        rules.append(rule)
        cells = [c for c in cells if not _covers(rule, c[1])]
    return DecisionList(
        tuple(
            tuple(Condition(FEATURES[k], above, cuts[FEATURES[k]][edge]) for k, above, edge in rule)
            for rule in rules
        )
    )


# Within the search a condition is (feature number, above, edge number): a cell
# number counts the edges at or below the value, so "above" is cell > edge.
_Test = tuple[int, bool, int]
_Cell = tuple[tuple[int, ...], int, int]


def _covers(rule: Sequence[_Test], place: Sequence[int]) -> bool:
    return all((place[k] > edge) == above for k, above, edge in rule)


def cells_of(cells: Sequence[_Cell], rule: Sequence[_Test]) -> list[_Cell]:
    return [c for c in cells if _covers(rule, c[0])]


def _counts(cells: Sequence[_Cell]) -> tuple[int, int]:
    return sum(c[1] for c in cells), sum(c[2] for c in cells)


def _grow(
    cells: Sequence[_Cell], cuts: dict[str, list[float]], max_conditions: int
) -> list[_Test]:
    """Add the condition with the largest information gain until no good row is covered."""
    rule: list[_Test] = []
    p, n = _counts(cells)
    while p and n and len(rule) < max_conditions:
        base, best = math.log2(p / (p + n)), (0.0, None)
        for k, f in enumerate(FEATURES):
            bad, good = [0] * (len(cuts[f]) + 1), [0] * (len(cuts[f]) + 1)
            for place, cp, cn in cells:
                bad[place[k]] += cp
                good[place[k]] += cn
            below_p = below_n = 0
            for edge in range(len(cuts[f])):
                below_p += bad[edge]
                below_n += good[edge]
                for above, tp, tn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                    if tp:
                        gain = tp * (math.log2(tp / (tp + tn)) - base)
                        if gain > best[0] + 1e-12:
                            best = (gain, (k, above, edge))
        if best[1] is None:
            break
        rule.append(best[1])
        cells = cells_of(cells, rule)
        p, n = _counts(cells)
    return rule


def _prune(rule: list[_Test], prune: Sequence[_Cell], grow: Sequence[_Cell]) -> list[_Test]:
    """The shortest front part of the rule with the best (p - n) / (p + n)."""
    held = prune if _counts(prune)[0] else grow
    best, kept = -2.0, rule
    for length in range(1, len(rule) + 1):
        p, n = _counts(cells_of(held, rule[:length]))
        value = (p - n) / (p + n) if p + n else -1.0
        if value > best + 1e-12:
            best, kept = value, rule[:length]
    return kept


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with statistics and ``kept``: the base test and the learned list.

    Every row stays, repeated rows and rows without id or text included; a null
    or empty text fails the base test and is not kept.
    """
    return text_statistics(docs).withColumn("kept", ~F.col("base_failed") & rules.keeps())
