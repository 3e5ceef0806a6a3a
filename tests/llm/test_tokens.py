"""Token attribution against tokens decoded one by one."""

import pytest

from pushgraph.llm import tokens as T


def brute(text, rule):
    import base64

    import tiktoken

    with open(T.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("b", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    starts = T.line_sections(text)
    section_of = [max(i for i, s in enumerate(starts) if s <= c) for c, ch in enumerate(text) for _ in ch.encode()]
    owned, crossing, at, n = [0] * len(starts), [0] * len(starts), 0, 0
    for token in enc.encode_ordinary(text):
        size = len(enc.decode_single_token_bytes(token))
        held = section_of[at : at + size]
        at += size
        n += 1
        owned[{"first": held[0], "last": held[-1], "most": max(sorted(set(held)), key=held.count)}[rule]] += 1
        if len(set(held)) > 1:
            for s in set(held):
                crossing[s] += 1
    ends = [*starts[1:], len(text)]
    return [(i, a, b, k, c, n) for i, (a, b, k, c) in enumerate(zip(starts, ends, owned, crossing, strict=True))]


TEXTS = ["", None, "one line", "a\n\n\n b\n   \n\tc", "é\nçà è\n\n", "\n", "x" * 5000 + "\n" + "y ", "<|endoftext|>\nz", "   \n   \n  q"]


@pytest.mark.parametrize("rule", T.RULES)
def test_brute_force(spark, rule):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as section")
    got = sorted(map(tuple, T.count_tokens(df, rule=rule).collect()))
    assert got == [(i, *row) for i, t in enumerate(TEXTS) for row in brute(t or "", rule)]


def test_some_tokens_cross():
    assert any(r[4] for t in TEXTS for r in brute(t or "", "first"))


def test_empty_and_rule(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.count_tokens(df).collect() == []
    with pytest.raises(ValueError):
        T.count_tokens(df, rule="other")
