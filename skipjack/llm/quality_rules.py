"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a fail condition over measures of one text. Some measures are wanted for every row (``counts``); any other is
an expression that stands inside the branches of the rules that use it. The branches form one CASE, which is evaluated in
order and stops at a row's first failing rule, so a row that fails early never pays for what comes later. The order is by
rejections per cost: on a random sample of about ``sample_rows`` rows of the whole table each rule is run several times,
alone, and its cost is its least time above that of a job without rules. The order can only change which rule is
named first, never which rows are kept.

Defined cases: null and blank texts have no words and fail ``few_words``; repeated rows are judged one by one; an
empty table gives an empty result; other columns of the input are ignored, so their names cannot clash.
No shuffle: every row is judged alone, whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skipjack.llm.common import forget, stored

#: Rows of the sample that orders the rules (expected), runs of each rule, and copies of the sample in a run.
SAMPLE_ROWS, RUNS, COPIES = 256, 3, 8
SPACE = r"[ \x09-\x0D]+"
Of = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """fails: given how to get a measure by its name, the condition on which a text fails."""

    name: str
    fails: Callable[[Of], Column]
    base: bool = False


def _let(value: Column, body) -> Column:
    """Evaluate value once a row and give it to body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more: windows sorted within the row, neighbours compared."""

    def covered(s: Column) -> Column:
        m = F.size(s)
        at = lambda j: F.get(s, j)["w"]
        twice = F.filter(F.sequence(F.lit(0), m - 1), lambda j: (at(j) == F.coalesce(at(j - 1), F.lit(""))) | (at(j) == F.coalesce(at(j + 1), F.lit(""))))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda j: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.get(s, j)["i"] + k)))))

    def windows(n: Column) -> Column:
        key = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        hashes = F.transform(F.sequence(F.lit(0), n - 3), key)
        full = lambda hs: F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), F.concat_ws(" ", F.slice(words, i + 1, F.lit(3))).alias("w"), i.alias("i"))))
        return _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(_let(full(hs), covered)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(F.size(words), windows))


def _lines() -> Column:
    """The lines that hold a word."""
    return F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))


def _removed(pattern: str) -> Column:
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


def _lines_like(pattern: str) -> Column:
    return F.size(F.filter(_lines(), lambda x: x.rlike(pattern)))


#: Measures of a row with the columns text and words.
MEASURES: dict[str, Callable[[], Column]] = {
    "n_words": lambda: F.size("words"),
    "word_chars": lambda: F.length(F.array_join("words", "")),
    "n_symbols": lambda: _removed(r"[#*$%&|<>]+"),
    "n_dup_lines": lambda: _let(_lines(), lambda ls: F.size(ls) - F.size(F.array_distinct(ls))),
    "n_repeat_words": lambda: _repeat_words(F.col("words")),
    "n_lines": lambda: F.size(_lines()),
    "n_exclaim": lambda: _removed("!+"),
    "n_letterless": lambda: F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))),
    "n_bullet_lines": lambda: _lines_like(r"^[ \x09-\x0D]*[-*•]"),
    "n_cut_lines": lambda: _lines_like(r"(\.\.\.|…)[ \x09-\x0D]*\z"),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Base rules, then ratios in the manner of published web-corpus filters.
RULES = (
    Rule("few_words", lambda of: of("n_words") < 50, True),
    Rule("repeated_windows", lambda of: 100 * of("n_repeat_words") > 50 * of("n_words"), True),
    Rule("symbols", lambda of: 10 * of("n_symbols") > of("n_words")),
    Rule("word_length", lambda of: _let(of("word_chars"), lambda c: (c < 2 * of("n_words")) | (c > 25 * of("n_words")))),
    Rule("duplicate_lines", lambda of: _let(of("n_dup_lines"), lambda d: (d >= 3) & (10 * d > 3 * of("n_lines")))),
    Rule("exclamations", lambda of: 5 * of("n_exclaim") > of("n_words")),
    Rule("letterless_words", lambda of: 10 * of("n_letterless") > 4 * of("n_words")),
    Rule("bullet_lines", lambda of: 10 * of("n_bullet_lines") > 9 * of("n_lines")),
    Rule("cut_off_lines", lambda of: 10 * of("n_cut_lines") > 3 * of("n_lines")),
)


def measures(docs: DataFrame, counts: tuple[str, ...] = COUNTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, words and the wanted counts, one row per input row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    return df.select("*", *[MEASURES[c]().cast("long").alias(c) for c in counts])


def measure_of(counts: tuple[str, ...]) -> Of:
    """A measure that is a column already, or its expression."""
    return lambda name: F.col(name) if name in counts else MEASURES[name]().cast("long")


def rule_order(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, text_col: str = "text", counts: tuple[str, ...] = COUNTS, runs: int = RUNS) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds a row) on a sample, by rejections per second; ties by the order given."""
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    texts = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = stored(texts.sample(share, seed=17), "rule-sample")
    # About sample_rows rows: one task of equal work for each rule.
    measured = stored(measures(sample.repartition(1), counts), "rule-sample")
    rows = measured.count()
    copied = measured.select("*", F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy"))
    of = measure_of(counts)

    def cost(condition: Column) -> tuple[float, float]:
        least, failed = float("inf"), 0
        for _ in range(runs):
            began = time.perf_counter()
            failed = copied.agg(F.coalesce(F.sum(condition.cast("int")), F.lit(0)).alias("n")).first()["n"]
            least = min(least, time.perf_counter() - began)
        return failed / max(rows * COPIES, 1), least

    _, idle = cost(F.col("text") == "")
    found = []
    for rule in rules:
        rejected, seconds = cost(rule.fails(of))
        found.append((rule, rejected, max(seconds - idle, 1e-6) / max(rows * COPIES, 1)))
    forget(sample, measured)
    return sorted(found, key=lambda x: -x[1] / x[2])


def cascade(rules: list[Rule] | tuple[Rule, ...], counts: tuple[str, ...] = COUNTS) -> Column:
    """Name of the first rule that fails, in the order given; null if none does."""
    of, chain = measure_of(counts), F
    for rule in rules:
        chain = chain.when(rule.fails(of), F.lit(rule.name))
    return F.lit(None).cast("string") if chain is F else chain.otherwise(F.lit(None).cast("string"))


def quality_cascade(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, ...] = COUNTS) -> DataFrame:
    """doc_id, the counts, base_failed, failed_rule (the cascade's first; null if kept) and kept, per row.

    With no counts, every measure is taken only where the cascade comes to it.
    """
    order = [x[0] for x in rule_order(docs, rules, sample_rows, text_col, counts)]
    of, base = measure_of(counts), F.lit(False)
    for rule in rules:
        base = base | rule.fails(of) if rule.base else base
    out = measures(docs, counts, id_col, text_col).withColumn("failed_rule", cascade(order, counts))
    names = [r.name for r in rules if r.base]
    if not set(counts) >= {"n_words", "n_repeat_words"}:  # known from the cascade alone, where base rules come first
        base = F.col("failed_rule").isin(names) & F.col("failed_rule").isNotNull()
    return out.select("doc_id", *counts, base.alias("base_failed"), "failed_rule", F.col("failed_rule").isNull().alias("kept"))
