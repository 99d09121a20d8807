"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a text by its measures. On a bounded sample each rule is timed
and its rejections are counted; rules then run in the order of what they reject
of the texts still left, per second. The first that rejects a text ends its
cascade: measures that only later rules need are never taken.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import new_names, written

#: White space between words: space and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Differences in time below this are noise: such rules count as equally cheap.
LEAST_SECONDS = 0.01
#: Files of the sample: its passes run side by side.
SAMPLE_PARTS = 8


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words within three-word windows that occur twice or more, by sorting the windows of a text."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2]))

    def places(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, j)["w"] == s[i]["w"], F.lit(False))
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.transform(again, lambda i: s[i]["p"])

    def covered(found: Column) -> Column:
        ranked = F.sort_array(F.transform(found, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
        three = F.flatten(F.transform(_let(ranked, places), lambda p: F.array(p, p + 1, p + 2)))
        # a text that repeats nothing: a hash set tells, without sorting
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(F.size(F.array_distinct(three)))

    return F.when(F.size(words) < 3, 0).otherwise(_let(windows, covered))


def _lines_that(test: Callable[[Column], Column]) -> Callable[[dict[str, Column]], Column]:
    return lambda m: F.size(F.filter(m["lines"], test))


#: Measures of a text, and what each is worked out from: the text, its words, or its lines that have a word.
MEASURES: dict[str, tuple[tuple[str, ...], Callable[[dict[str, Column]], Column]]] = {
    "words": ((), lambda m: F.filter(F.split(m["text"], f"[{SPACE}]+"), lambda w: w != "")),
    "lines": ((), lambda m: F.filter(F.split(m["text"], "\n"), lambda x: _without(x, SPACE) != "")),
    "n_words": (("words",), lambda m: F.size(m["words"])),
    "word_chars": ((), lambda m: F.length(_without(m["text"], SPACE))),
    "n_symbols": ((), lambda m: F.length(m["text"]) - F.length(_without(m["text"], SYMBOLS))),
    "n_lines": (("lines",), lambda m: F.size(m["lines"])),
    "n_dup_lines": (("lines",), lambda m: F.size(m["lines"]) - F.size(F.array_distinct(m["lines"]))),
    "n_repeat_words": (("words",), lambda m: _repeat_words(m["words"])),
    "n_letter_words": (("words",), lambda m: F.size(F.filter(m["words"], lambda w: w.rlike(r"\p{L}")))),
    "n_bullet_lines": (("lines",), _lines_that(lambda x: x.rlike("^[ \t]*[-*•]"))),
    "n_open_lines": (("lines",), _lines_that(lambda x: x.rlike("(\\.\\.\\.|…)[ \t\r]*$"))),
}


def _bound(names: Sequence[str], have: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` of the measures ``names`` and of those it ``have``s, each new one worked out once, when ``body`` is."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in have and name not in order:
            for below in MEASURES[name][0]:
                need(below)
            order.append(name)

    for name in names:
        need(name)

    def bind(k: int, have: dict[str, Column]) -> Column:
        if k == len(order):
            return body(have)
        value = MEASURES[order[k]][1](have)
        value = value if order[k] in ("words", "lines") else value.cast("long")
        return _let(value, lambda v: bind(k + 1, have | {order[k]: v}))

    return bind(0, have)


@dataclass(frozen=True)
class Rule:
    """Rejects a text if ``fails`` holds for its measures, which it asks for by name."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]

    def needs(self) -> list[str]:
        names: list[str] = []
        self.fails(lambda n: names.append(n) or F.lit(1))
        return names

    def test(self, have: dict[str, Column], body: Callable[[Column, dict[str, Column]], Column]) -> Column:
        """``body`` of whether the rule rejects, and of the measures that are known then."""
        return _bound(self.needs(), have, lambda known: body(self.fails(known.__getitem__), known))


RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("many_words", lambda m: m("n_words") > 100_000),
    Rule("word_length", lambda m: ~m("word_chars").between(3 * m("n_words"), 10 * m("n_words"))),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("letters", lambda m: 10 * m("n_letter_words") < 8 * m("n_words")),
    Rule("repeated_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule("bullets", lambda m: 10 * m("n_bullet_lines") > 9 * m("n_lines")),
    Rule("open_lines", lambda m: 10 * m("n_open_lines") > 3 * m("n_lines")),
)


def _text(column: str) -> dict[str, Column]:
    return {"text": F.coalesce(F.col(column), F.lit(""))}


def _cascade(rules: Sequence[Rule], have: dict[str, Column]) -> Column:
    """The name of the first rule that rejects; measures are taken as the cascade reaches them."""
    if not rules:
        return F.lit(None).cast("string")
    first, *rest = rules
    return first.test(have, lambda fails, known: F.when(fails, F.lit(first.name)).otherwise(_cascade(rest, known)))


def rank(outcomes: Sequence[tuple[Sequence[bool], int]], seconds: Sequence[float]) -> list[int]:
    """The order of rules: next is always that which rejects most of the rows still left, per second.

    ``outcomes`` are the distinct verdicts of all rules with their numbers of
    rows. Ties go to the cheaper rule, then to the one stated first.
    """
    left, waiting, order = list(outcomes), list(range(len(seconds))), []
    while waiting:
        rejects = {r: sum(n for v, n in left if v[r]) for r in waiting}
        best = min(waiting, key=lambda r: (-rejects[r] / seconds[r], seconds[r], r))
        order.append(best)
        waiting.remove(best)
        left = [(v, n) for v, n in left if not v[best]]
    return order


def plan_cascade(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, report: Sequence[str] = (), sample_rows: int = 2000, seed: int = 42
) -> list[Rule]:
    """``rules`` in the order in which their cascade should run.

    Costs and rejections come from at most ``sample_rows`` rows, drawn from all
    of ``docs`` and written once: of each rule the better of two timed passes
    over what a pass without it takes. The order decides what the cascade
    costs, never what it keeps.
    """
    n = docs.count()
    share = min(1.0, 1.2 * sample_rows / max(n, 1))
    drawn = docs.select(F.col(text).alias("text")).sample(share, seed).limit(sample_rows).repartition(SAMPLE_PARTS)
    told = _bound(report, _text("text"), lambda have: F.struct(F.lit(True).alias("drawn"), *[have[n].alias(n) for n in report]))
    sample = written(drawn.select("text", told.alias("m")), "rule-sample")
    # reported measures are there, the others are taken anew
    have = _text("text") | {n: F.col(f"m.{n}") for n in report}

    def seconds(rule: Rule | None) -> float:
        failed = F.octet_length(have["text"]) < 0 if rule is None else rule.test(have, lambda fails, _: fails)
        found, took = sample.agg(F.count_if(failed)), []
        for _ in range(2):
            start = time.perf_counter()
            found.collect()
            took.append(time.perf_counter() - start)
        return min(took)

    nothing = seconds(None)
    costs = [max(seconds(r) - nothing, LEAST_SECONDS) for r in rules]
    verdicts = sample.select(*[r.test(have, lambda fails, _: fails).alias(f"r{k}") for k, r in enumerate(rules)])
    # at most a row for each row of the sample
    outcomes = [(tuple(r)[:-1], r["n"]) for r in verdicts.groupBy(*verdicts.columns).agg(F.count("*").alias("n")).collect()]
    return [rules[k] for k in rank(outcomes, costs)]


def judge_quality(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, report: Sequence[str] = (), out: str = "_quality", plan: Sequence[Rule] | None = None
) -> DataFrame:
    """``docs`` with the struct ``out``: the measures ``report`` (longs), ``kept``, and ``rule``, the first of the cascade that rejected the text.

    All rows and columns are kept; null and empty texts have no words, and whole
    texts count, however long. ``out`` must be a new name, else a ``ValueError``
    says so. ``plan`` is an order of the rules; without it, a sample of ``docs``
    decides (``plan_cascade``). One projection: no shuffle, no Python worker.
    """
    new_names(docs, out)
    order = plan_cascade(docs, text, rules, report) if plan is None else plan

    made = lambda known, rule: F.struct(*[known[n].alias(n) for n in report], rule.alias("rule"), rule.isNull().alias("kept"))
    return docs.withColumn(out, _bound(report, _text(text), lambda known: _let(_cascade(order, known), lambda rule: made(known, rule))))


def keep_by_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, plan: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text passes all rules; all columns."""
    return judge_quality(docs, text, rules, out="_rules_verdict", plan=plan).filter("_rules_verdict.kept").drop("_rules_verdict")
