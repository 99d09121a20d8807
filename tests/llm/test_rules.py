"""Quality rules against plain Python, and the order of their cascade."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowgauge.llm import rules as R

TEXTS = [
    None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "x " * 60, "a a a a", "äö ü　ß 😀 #*$%&|<> \x0b\x0c\r\n.",
    "same line\nsame line\n \nsame line\r\n\nother", "- a\n* b\n  • c\nd", "so...\nand …  \nno", "1 2 3 " * 30, "word " * 200_000,
    " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(120)), "\x00 nul   nbsp\x85",
]


def measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    many = Counter(grams)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in R.SYMBOLS for c in text), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len({p + k for p, g in enumerate(grams) if many[g] > 1 for k in range(3)}),
        "n_letter_words": sum(any(c.isalpha() for c in w) for w in words), "n_bullet_lines": sum(bool(re.match("[ \t]*[-*•]", x)) for x in lines),
        "n_open_lines": sum(bool(re.search(r"(\.\.\.|…)[ \t\r]*$", x)) for x in lines),
    }


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "s", 1) for k, t in enumerate(TEXTS)] + [(None, "one", "s", 1), (3, "one", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, m string, n_words int")


def test_measures_and_verdicts(docs):
    got = R.judge_quality(docs, report=tuple(R.MEASURES)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        m = measures(r["text"])
        assert {n: r["_quality"][n] for n in m} == m, r["doc_id"]
        fails = {x.name for x in R.RULES if x.fails(lambda n: m[n] if n != "word_chars" else _Number(m[n]))}
        assert r["_quality"]["kept"] == (not fails) and (r["_quality"]["rule"] in fails or not fails)


class _Number(int):
    """A number with the test that a rule asks of a column."""

    def between(self, low, high):
        return _Truth(low <= self <= high)


class _Truth:
    def __init__(self, value):
        self.value = value

    def __invert__(self):
        return not self.value


def test_any_order_keeps_the_same(docs):
    base = ("n_words", "n_repeat_words")
    found = [
        sorted((r["text"] or "", r["_quality"]["kept"]) for r in R.judge_quality(docs, report=report, plan=plan).collect())
        for report in ((), base) for plan in (R.RULES, R.RULES[::-1], None)
    ]
    assert all(f == found[0] for f in found) and any(k for _, k in found[0])
    kept = R.keep_by_rules(docs, plan=R.RULES)
    assert kept.columns == docs.columns and kept.count() == sum(k for _, k in found[0])


def test_stops_at_the_first_rejection(spark):
    """A rule behind one that rejects everything is never reached; one in front of it is."""
    docs = spark.createDataFrame([("a b",), ("c",)], "text string")
    bad = R.Rule("raises", lambda m: F.raise_error(F.concat(F.lit("reached "), m("n_words").cast("string"))).cast("boolean"))
    every = R.Rule("all", lambda m: m("n_words") > 0)
    assert [r["_quality"]["rule"] for r in R.judge_quality(docs, plan=[every, bad]).collect()] == ["all", "all"]
    with pytest.raises(Exception, match="reached"):
        R.judge_quality(docs, plan=[bad, every]).collect()


def test_rank():
    """Rejections of what is left, per second: a rule that another one covers comes last."""
    outcomes = [((True, True, False), 50), ((False, False, True), 10), ((False, False, False), 40), ((True, False, False), 5)]
    assert R.rank(outcomes, [1.0, 1.0, 1.0]) == [0, 2, 1]
    assert R.rank(outcomes, [100.0, 1.0, 1.0]) == [1, 2, 0]
    assert R.rank([], [2.0, 1.0, 1.0]) == [1, 2, 0]


def test_empty_table_and_taken_name(docs):
    assert R.judge_quality(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="_quality"):
        R.judge_quality(docs.withColumn("_QUALITY", F.lit(1)))


def test_no_python_worker(docs):
    plan = R.judge_quality(docs, plan=R.RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "Exchange" not in plan
