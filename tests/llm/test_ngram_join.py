"""The n-gram join against a brute force over all pairs."""

import random

import pytest

from pushgraph.llm.ngram_join import jaccard_components
from tests.llm.conftest import words


def brute(rows):
    sets = []
    for _, t in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids, default=None) if sets[i] else rows[i][0]) for i in g]
    return sorted(out, key=repr)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    common = [r.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.45:
            t = words(r.choice(rows)[1] or "x")
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice(vocab)
            t = t[: max(1, len(t) - r.randint(0, 9))]
        else:
            t = [r.choice(vocab) for _ in range(r.randint(1, 150))]
            if kind > 0.7:
                t[5:5] = common
        rows.append((i, " ".join(t) if r.random() < 0.9 else " ".join(t).upper()))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, rows[3][1]), (5, rows[5][1]), (7, rows[8][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 2_000_000), (2, 20_000), (3, 900), (4, 400)])
def test_brute_force(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_components(df, block_tokens=block, pivots=4).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_sets_with_the_same_first_half_of_a_digest(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard_components(df, class_bits=4).collect()), key=repr) == brute(rows)


def test_a_token_in_all_sets(spark):
    """A passage in very many texts, whose rows are linked where they are; some of them are near copies too."""
    r = random.Random(6)
    shared = " ".join(f"s{i}" for i in range(8))
    rows = [(i, shared + " " + " ".join(f"x{r.randrange(40)}" for _ in range(r.choice([1, 2, 3, 30])))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard_components(df).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string, component_id int, class string")).collect() == []
