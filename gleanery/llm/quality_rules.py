"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a column that is true where it rejects a text. On a sample every rule's cost
(seconds over the sample, the least of several runs) and rejections are measured; the rules
then run as one CASE in order of rejections per second, so that a text rejected by a cheap rule
never meets a dear one. What a rule takes is told apart from what any job takes by as many runs
without a rule: their spread is the least cost that counts, so rules below it go by their
rejections. The order has no influence on which texts are rejected.

All rules compare whole numbers, so results do not depend on rounding.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.once import bound
from gleanery.llm.words import INK, ink_only, single_spaced, whole, word_count
from gleanery.session import freeze_table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 2000  # about
SAMPLE_PARTS = 8
RUNS = (3, 7)  # fewest and most runs of a rule
STEADY = 0.1  # a rule's two fastest runs differ by at most this share
SEED = 20240104


# Statistics of a text -----------------------------------------------------------------


def word_chars(text: Column) -> Column:
    return F.length(ink_only(text)).cast("long")


def symbol_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(INK))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return bound(
        lines_with_words(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
    )


def word_windows(text: Column, size: int = WINDOW) -> Column:
    """All runs of ``size`` words, in order, joined by blanks."""
    one = "[^ ]+"
    run = " ".join([one] * size)
    return F.regexp_extract_all(F.btrim(single_spaced(text)), F.lit(rf"(?<![^ ])(?=({run})(?![^ ]))"), F.lit(1))


def covered_words(windows: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window which occurs at least twice. ``windows`` is an array column."""

    def repeated(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda x, i: (F.get(ordered, i - 1)["w"] == x["w"]).eqNullSafe(True)
            | (F.get(ordered, i + 1)["w"] == x["w"]).eqNullSafe(True),
        )

    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    starts = F.sort_array(F.transform(bound(ordered, repeated), lambda x: x["at"]))
    start = F.struct(F.lit(0).alias("until"), F.lit(0).alias("words"))
    # Windows that overlap count their common words once.
    return F.aggregate(
        starts,
        start,
        lambda s, at: F.struct(
            (at + size).alias("until"), (s["words"] + at + size - F.greatest(at, s["until"])).alias("words")
        ),
        lambda s: s["words"].cast("long"),
    )


def repeated_words(text: Column, size: int = WINDOW) -> Column:
    """Words in windows found twice or more in the text, the first included. Texts whose
    windows all differ, nearly all, are told by a hash set and not sorted."""
    return bound(
        word_windows(text, size),
        lambda windows: F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            covered_words(windows, size)
        ),
    )


# Rules --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``reject`` is true where a text goes; it must not be null."""

    name: str
    reject: Column


def base_rules(text: Column) -> list[Rule]:
    return [
        Rule("few_words", word_count(text) < 10),
        Rule("repeated_words", 100 * repeated_words(text) > 20 * word_count(text)),
    ]


def further_rules(text: Column) -> list[Rule]:
    """Rules beyond the base, with wide margins for clean prose."""
    words = word_count(text)
    marks = (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long")
    lines = bound(lines_with_words(text), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > 50 * F.size(x))
    return [
        Rule("symbols", 100 * symbol_count(text) > 40 * words),
        Rule("exclamations", 100 * marks > 50 * words),
        Rule("word_length", (word_chars(text) < 2 * words) | (word_chars(text) > 20 * words)),
        Rule("duplicate_lines", lines),
    ]


# The cascade --------------------------------------------------------------------------


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: int
    sampled: int = 0

    @property
    def selectivity(self) -> float:
        return self.rejected / max(1, self.sampled)

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-4)


def sample_of(docs: DataFrame, text_column: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` texts, each row as likely as any other, written once so that all rules are
    timed on the same ones. Tasks draw on their own and few rows move."""
    share = min(1.0, rows / max(1, docs.count()))
    drawn = docs.select(whole(text_column).alias(text_column)).sample(share, seed=SEED)
    return freeze_table(drawn.repartition(SAMPLE_PARTS), "rule-sample")


def _fastest(run: Callable[[], object], runs: tuple[int, int] = RUNS) -> list[float]:
    """Seconds of runs, the fastest first, as many as it takes until the two fastest agree."""
    seen: list[float] = []
    while len(seen) < runs[1]:
        start = time.perf_counter()
        run()
        seen = sorted([*seen, time.perf_counter() - start])
        if len(seen) >= runs[0] and seen[1] - seen[0] <= STEADY * seen[0]:
            break
    return seen


def measure(rules: Sequence[Rule], sample: DataFrame) -> list[Measured]:
    """Seconds and rejections of each rule over the sample, less what reading it takes."""

    def counted(column: Column) -> tuple[int, int]:
        hits = F.coalesce(F.sum(column.cast("long")), F.lit(0))
        return tuple(sample.agg(hits, F.count(F.lit(1))).first())

    idle = F.length(sample.columns[0]) < 0
    counted(idle)
    base = _fastest(lambda: counted(idle))
    noise = base[1] - base[0]
    out = []
    for rule in rules:
        rejected, sampled = counted(rule.reject)
        seconds = _fastest(lambda: counted(rule.reject))[0] - base[0]  # noqa: B023
        out.append(Measured(rule.name, max(noise, seconds), rejected, sampled))
    return out


def ordered(rules: Sequence[Rule], measured: Sequence[Measured]) -> list[Rule]:
    """Most rejections per second first; ties by less time, then by name."""
    by_name = {m.name: m for m in measured}
    return sorted(rules, key=lambda r: (-by_name[r.name].worth, by_name[r.name].seconds, r.name))


def first_failed(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, else null; later rules are then not computed."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.reject, F.lit(rule.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, rules: Sequence[Rule], text_column: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` in the order in which to run them over ``docs``."""
    return ordered(rules, measure(rules, sample_of(docs, text_column, rows)))


def cascade_report(docs: DataFrame, rules: Sequence[Rule], text_column: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``place, rule, seconds, rejected, sampled, selectivity``: what the order rests on."""
    found = {m.name: m for m in measure(rules, sample_of(docs, text_column, rows))}
    lines = [
        (place, m.name, m.seconds, m.rejected, m.sampled, m.selectivity)
        for place, m in enumerate((found[r.name] for r in ordered(rules, list(found.values()))), 1)
    ]
    schema = "place int, rule string, seconds double, rejected long, sampled long, selectivity double"
    return docs.sparkSession.createDataFrame(lines, schema)


def quality_columns(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's statistics and verdict.

    ``id_column, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept``. A missing text counts as an empty one and fails the base rule on few words. The base
    statistics are part of every row, so only the further rules are a cascade here.
    Repeated ids and ties need no rule: each row is judged by its text alone.
    """
    text = whole(text_column)
    rules = cascade(docs, further_rules(text), text_column)
    verdict = first_failed(rules).isNull()
    counted = docs.select(
        id_column,
        word_count(text).alias("n_words"),
        word_chars(text).alias("word_chars"),
        symbol_count(text).alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        repeated_words(text).alias("n_repeat_words"),
        verdict.alias("_passed"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).select(
        *[c for c in counted.columns if c != "_passed"],
        "base_failed",
        (~F.col("base_failed") & F.col("_passed")).alias("kept"),
    )


def drop_rejected(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns; base and further rules are one
    cascade, so a text is measured only up to the first rule that rejects it."""
    text = whole(text_column)
    rules = cascade(docs, [*base_rules(text), *further_rules(text)], text_column)
    return docs.filter(first_failed(rules).isNull())
