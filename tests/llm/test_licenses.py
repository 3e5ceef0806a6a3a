"""License runs against a brute force over all runs of words."""

import random

import pytest

from pushgraph.llm import licenses as L

SHORT = [*[x for x in L.NOTICES if len(x[1].split()) < 15], ("Word", "copyleft"), ("Twin-A", "all rites reversed by the twins"), ("Twin-B", "all rites reversed by the twins"), ("Again", "so so so say we all say we all")]


def brute(words, m):
    """(dice, template, first, last) of the nearest run, and of what is before and after it."""
    found = None
    for a in range(len(words)):
        for b in range(a + 1, len(words) + 1):
            run = L.bigrams(words[a:b])
            for t, (_, w) in enumerate(m.templates):
                d = L.dice(run, w)
                if d >= m.threshold and (found is None or (-d, -len(w), b - a, a, t) < found[0]):
                    found = ((-d, -len(w), b - a, a, t), (d, t, a, b - 1))
    if found is None:
        return []
    _, _, a, b = found[1]
    after = [(d, t, x + b + 1, y + b + 1) for d, t, x, y in brute(words[b + 1 :], m)]
    return [*brute(words[:a], m), found[1], *after]


@pytest.mark.parametrize("threshold", [0.85, 0.6])
def test_brute_force(threshold):
    m = L.Matcher(SHORT, threshold)
    r = random.Random(3)
    for _ in range(60):
        words = []
        for _ in range(r.randint(0, 4)):
            words += r.choices("under the license so say we all of copyleft all rites".split(), k=r.randint(0, 6))
            some = L.normalised(r.choice(SHORT)[1])
            for _ in range(r.randint(0, 2)):
                some[r.randrange(len(some))] = r.choice(["other", "the", "under"])
            words += some * r.randint(1, 2)
        words = words[: r.choice([30, 45])]
        assert sorted(m.runs(words), key=lambda x: x[2]) == brute(words, m), words


def test_in_the_middle_of_a_line():
    m = L.Matcher()
    found = m.best("Some prose. Released under the MIT License. and more words follow here\nMIT, released\nunder the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0.")
    assert [(r[0], r[1], r[2], r[3]) for r in found] == [("MIT", 1.0, 0, 0), ("Apache-2.0", pytest.approx(10 / 11, abs=0.1), 1, 2), ("Apache-2.0", 1.0, 2, 2)]
    whole = dict(L.TEMPLATES[-len(L.TEXTS) :])["MIT"]
    for text in (whole.replace("\n", " "), "\n".join(whole.split()), "x " * 3000 + whole + " y" * 3000):
        top = max(m.best(text), key=lambda r: r[1])
        assert top[:2] == ("MIT", 1.0)


def test_one_bigram_many_times():
    m = L.Matcher([("A", "spam egg"), ("B", " ".join(f"w{i}" for i in range(300)))])
    assert [r[0] for r in m.best("spam egg " * 3000)] == ["A"] * 3000
    assert m.best("w1 w2 " * 20_000) == []


def test_query(spark):
    rows = [(1, None), (2, ""), (3, "x\nReleased under the MIT License.\ny"), (4, "RELEASED under, the MIT license"), (5, "nothing " * 50_000), (None, "Licensed under CC BY-NC 4.0."), (3, "x\nReleased under the MIT License.\ny")]
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license")).collect()
    told = sorted(((r["doc_id"] or 0, r["license"], r["n_found"]) for r in got), key=str)
    assert told == sorted([(1, None, 0), (2, None, 0), (3, "MIT", 1), (4, "MIT", 1), (5, None, 0), (0, "CC-BY-NC-4.0", 1), (3, "MIT", 1)], key=str)
    assert [r["found"][0]["first"] for r in got if r["doc_id"] == 3] == [1, 1]


def test_empty(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert L.Matcher(()).best("any text") == []
