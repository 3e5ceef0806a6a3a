"""The lexicon holds every significant term, however many there are and however small their share."""

import random

from pushgraph.llm import toxicity as X


def test_many_rare_words(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    terms, vocab = sorted({word() for _ in range(60)}), [word() for _ in range(100)]
    texts = [[t] for t in terms for _ in range(16)] + [[] for _ in range(3000)]
    rows = [(i, " ".join(r.choices(vocab, k=8) + t), int(bool(t))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.learn(docs, docs)
    assert set(terms) <= set(model.automaton.words)
    assert X.score_texts(docs, model).filter("toxic = 1 and n_exact = 0").count() == 0


def test_chosen():
    words, beginnings = X._chosen(["scum ", "scu", "abcde", "abcdef ", "abcd", "xyzw", "xyzwv ", "abcdx "])
    assert words == ["scum"] and sorted(beginnings) == ["abcd", "xyzw"]
