"""Whole licenses, their siblings and the usual notices; notices broken over lines."""

import pytest

from pushgraph.llm import licenses as L


@pytest.fixture(scope="module")
def matcher():
    return L.Matcher()


@pytest.mark.parametrize("name", L.TEXTS)
def test_whole_text(matcher, name):
    text = "before it\n" + dict(L.TEMPLATES[-len(L.TEXTS) :])[name] + "\nafter it"
    found = matcher.best(text)
    top = max(found, key=lambda r: r[1])
    assert top[0] == name and top[1] > 0.99


def test_siblings_and_wordings(matcher):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    for text, name in ((gnu.format("", 2), "GPL-2.0"), (gnu.format("", 3), "GPL-3.0"), (gnu.format("Affero ", 3), "AGPL-3.0"), (gnu.format("Lesser ", "2.1"), "LGPL-2.1"), ("Licensed under the MIT License.", "MIT"), ("Licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0")):
        assert [r[0] for r in matcher.best(text)] == [name], text


def test_broken_lines(matcher):
    for text in ("Released\nunder\nthe\nMIT\nLicense.", "Released\nunder the MIT\nLicense."):
        assert [(r[0], r[1]) for r in matcher.best(text)] == [("MIT", 1.0)]
