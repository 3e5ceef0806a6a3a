"""The automaton against edit distances; learning on planted words; odd input."""

import random
import re
import zlib

import numpy as np
import pytest

from pushgraph.llm import toxicity as X

WORDS, BEGINNINGS = ["moron", "idiot", "scum", "réeux", "worthless"], ["achlich", "bom"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(word):
    if word in WORDS:
        return X.EXACT
    if any(word.startswith(b) for b in BEGINNINGS):
        return X.BEGIN
    return X.FUZZY if any(len(t) >= 5 and distance(word, t) == 1 for t in WORDS) else X.NONE


def test_automaton():
    a = X.Automaton(WORDS, BEGINNINGS)
    r = random.Random(1)
    words = {*WORDS, *BEGINNINGS, "achlichst", "bo", "x", "moronmoron", "wortless", "worthlesss", "sccum"}
    for _ in range(3000):
        w = list(r.choice([*WORDS, *BEGINNINGS, "rand", "thing"]))
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(w))
            w[i : i + r.randint(0, 1)] = r.choice(["", "a", "o", "é", "s", "z"])
        words.add("".join(w))
    words = sorted(w for w in words if w)
    chars = np.array([ord(c) for w in words for c in w], np.uint32)
    ends = np.cumsum([len(w) for w in words])
    kind, _ = a.match(chars, ends - [len(w) for w in words], ends)
    assert [(w, int(k)) for w, k in zip(words, kind, strict=True)] == [(w, brute(w)) for w in words]


def brute_features(text, model):
    """Severity and share of a text, word by word."""
    text, a = (text or "").lower(), model.automaton
    plain = lambda w: w in a.words or any(w.startswith(b) for b in a.beginnings)
    words, hits = list(re.finditer(r"[^\W\d_]+", text)), {}
    for i, m in enumerate(words):
        if plain(m[0]):
            hits[i] = 1.0
        elif any(len(t) >= 5 and distance(m[0], t) == 1 for t in a.words):
            hits[i] = X.MISSPELLED
    marks = [i for i, c in enumerate(text) if c in X.QUOTES and not (0 < i < len(text) - 1 and text[i - 1].isalpha() and text[i + 1].isalpha())]
    total = 0.0
    for i, severity in hits.items():
        left = words[i - 3].end() if i >= 3 else 0
        right = words[i + 3].start() if i + 3 < len(words) else len(text)
        if any(left <= m < words[i].start() for m in marks) and any(words[i].end() <= m < right for m in marks):
            severity *= X.QUOTED
        if not any(j != i and abs(j - i) <= X.WINDOW for j in hits):
            severity *= X.LONE
        total += severity
    return [np.log1p(total), np.log1p(200 * total / max(len(words), 20))]


def test_whole_query_by_brute_force(corpus, spark, tmp_path):
    docs, labels, truth = corpus
    docs, labels = docs.select("doc_id", "text"), labels
    more = spark.createDataFrame([(9200 + i, t) for i, t in enumerate(QUOTES)], docs.schema)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = {(r["doc_id"], r["text"]): r for r in X.op7_toxicity(spark, str(tmp_path)).join(docs.unionByName(more), "doc_id").collect()}
    model = X.learn(spark.read.parquet(str(tmp_path / "documents.parquet")), labels)
    assert {"idiot", "scum"} <= set(model.automaton.words) and (model.weights[:-1] >= 0).all() and model.weights[:-1].any()
    for (doc, text), r in got.items():
        z = ((np.array(brute_features(text, model)) - model.center) / model.scale) @ model.weights[:-1] + model.weights[-1]
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2)


QUOTES = ["he said \"moron\" to me", "don't moron can't", "'a b moron c d' ef", "'a b c moron d e f'", "\"x\"\nmoron \"y\"", "moron", "« idiot »\nidiot", "x moron y idiot z " * 3, "a𐐀moron moron"]


def test_spelling_and_quotation_through_the_learned_model(corpus, spark):
    docs, labels, _ = corpus
    model = X.learn(docs, labels)
    texts = ["a clean sentence about nothing", "a clean sentence about morno", "a clean sentence about idiott", "a clean sentence about idiot", 'a clean sentence about "idiot" he said', "a clean sentence about idiot he said"]
    clean, far, misspelled, plain, quoted, unquoted = model.score(X.features(texts, model.automaton)[0])
    assert clean == far < misspelled < plain and clean < quoted < unquoted


def test_words_near_to_a_term_that_clean_texts_hold(spark):
    rows = [(i, f"you idiot w{'x' * (i % 7)}", 1) for i in range(60)] + [(100 + i, f"the idiom w{'x' * (i % 7)}", 0) for i in range(300)] + [(500 + i, f"a b c w{'x' * (i % 7)}", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.learn(docs, docs)
    assert [r["n_misspelled"] for r in X.score_texts(docs, model).filter("doc_id between 100 and 110").collect()] == [0] * 11


def test_repeated_ids(spark, corpus):
    docs, labels, _ = corpus
    again = docs.unionByName(docs).unionByName(docs.filter("doc_id = 3").withColumn("text", X.F.lit("zz")))
    one, two = X.learn(docs, labels), X.learn(again, labels)
    assert one.automaton.words == two.automaton.words and np.allclose(one.weights, two.weights)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(2)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        t = [r.choice(vocab) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(2, 5)):
                t.insert(r.randint(0, len(t)), r.choice(["moron", "Idiot!", "scum", "moronn"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    rows += [(9000, None), (9001, ""), (9002, "word " * 200_000), (None, "moron idiot scum"), (5, rows[5][1])]
    labels += [(None, 1), (9100, 1), (7, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels[:600])


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    got = X.score_texts(docs, X.learn(docs, labels)).withColumn("held", X.held_out(X.F.col("doc_id"))).collect()
    assert len(got) == 605 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held"] and r["doc_id"] < 600]
    assert len(held) > 100 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[9000]["score"] == by_id[9001]["score"] < X.THRESHOLD and by_id[9002]["predicted"] == 0 and by_id[None]["predicted"] == 1


def test_nothing_to_learn(spark, corpus):
    docs, labels, _ = corpus
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert X.score_texts(docs, X.learn(docs, some)).filter("predicted = 1").count() == 0
    assert X.score_texts(docs.limit(0), X.learn(docs.limit(0), labels)).collect() == []
