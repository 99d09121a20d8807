"""Licences of several sentences and lines inside longer texts."""

import textwrap

import pytest

from flowgauge.llm import licenses
from flowgauge.llm.license_texts import TEXTS

BEFORE, AFTER = "def area(r):\n    return r * r\n\n", "\n\nNothing else. The rest is prose about\ngardens and rivers.\n"


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
@pytest.mark.parametrize("columns", [3, 7])
def test_wrapped_notice_inside_a_text(name, columns):
    w = licenses.TEMPLATES[name].split()
    wrapped = "\n".join(" ".join(w[k : k + columns]) for k in range(0, len(w), columns))
    found = licenses.find_licenses(BEFORE + wrapped + AFTER, licenses.Templates(licenses.TEMPLATES, 0.8))
    assert found == [(name, 1.0, len(BEFORE), len(BEFORE) + len(wrapped))]


def test_longer_run_stays():
    short, long = "Licensed under this.", "One two three four. Licensed under this.\n\nFive six seven; eight nine ten."
    templates = licenses.Templates({"short": short, "long": long}, 0.8)
    found = licenses.find_licenses(f"{AFTER}{long}{AFTER}{short}", templates)
    assert [(m[0], m[1]) for m in found] == [("long", 1.0), ("short", 1.0)]


def test_default_finds_bodies_and_headers(spark):
    rows = [(name, BEFORE + textwrap.fill(text, 72) + AFTER) for name, text in TEXTS.items()]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "name string, text string")).collect()
    assert {r["name"]: [(m["license"], m["dice"]) for m in r["licenses"]] for r in got} == {n: [(n, 1.0)] for n in TEXTS}
