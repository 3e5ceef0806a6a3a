"""Toxicity: a lexicon trie met by Levenshtein automata, with context windows around the hits.

The lexicon is learned from labelled texts: whole words and word beginnings that toxic texts hold
far more often. Its trie is intersected with the Levenshtein automaton of distance 1 of every word that can
come, once, as a deterministic automaton over characters; all words of a batch then run through it together.
A hit's severity is what its spelling leaves, times what its context window leaves: less among quotation marks, less
where no other hit is near. A text's score is a logistic model of its severities' sum and share, whose weights are not
negative: a misspelled term scores above none, a quoted one below a plain one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushgraph.session import small_batches, table

# Quotation marks; the held-out fold; the decision threshold.
QUOTES = "\"'«»“”„‘’"
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
NONE, EXACT, FUZZY, BEGIN = 0, 1, 2, 3
#: Words around a hit that are looked at: for quotation marks, and for other hits.
QUOTED_WITHIN, WINDOW = 2, 12
#: What is left of a hit's severity if it is misspelled, quoted, without another hit near.
MISSPELLED, QUOTED, LONE = 0.75, 0.25, 0.75
#: Letters of a term at most: longer runs of letters are no words.
LONGEST_TERM = 255
#: Log likelihood ratio of a term; chance seldom reaches it among some 100,000 terms.
LEAST_GAIN = 8.0
PIECE = 1 << 20

_POINTS = 0x110000
_LETTER = np.array([chr(c).isalpha() for c in range(_POINTS)])
_QUOTE = np.zeros(_POINTS, bool)
_QUOTE[[ord(c) for c in QUOTES]] = True


class Automaton:
    """Deterministic automaton of the lexicon: for a word, which term it is, misspells or begins with.

    A state is a set of (trie node, edits) pairs. Reading a character follows the trie without edit, or
    with one edit replaces it, inserts it, or skips a trie character. Terms shorter than ``least`` and those in
    ``plain`` are matched exactly only. Word beginnings are matched without edits and absorb what follows.
    """

    def __init__(self, words: list[str], beginnings: list[str], least: int = 5, plain: frozenset[str] = frozenset()) -> None:
        self.words, self.beginnings = words, beginnings
        alphabet = sorted({c for t in (*words, *beginnings) for c in t})
        self.klass = np.zeros(_POINTS, np.int32)
        for i, c in enumerate(alphabet, 1):
            self.klass[ord(c)] = i
        width = len(alphabet) + 1
        kids: list[dict[int, int]] = [{}]
        term: list[tuple[int, int] | None] = [None]

        def grow(root: int, t: str) -> int:
            at = root
            for c in t:
                k = int(self.klass[ord(c)])
                if k not in kids[at]:
                    kids[at][k] = len(kids)
                    kids.append({})
                    term.append(None)
                at = kids[at][k]
            return at

        for i, t in enumerate(words):
            term[grow(0, t)] = (EXACT, i)
        begin_root = len(kids)
        kids.append({})
        term.append(None)
        for i, t in enumerate(beginnings):
            at = grow(begin_root, t)
            if term[at] is None:
                term[at] = (BEGIN, i)
        edited = {t for t in words if len(t) >= least} - plain
        long_enough = {n for t in edited for n in self._path(kids, t)}

        def close(state: set[tuple[int, int]]) -> frozenset:
            out = set(state)
            for node, edits in state:
                if edits == 0 and node in long_enough:
                    out |= {(kid, 1) for kid in kids[node].values() if kid in long_enough}
            return frozenset(out)

        def absorbed(state) -> int | None:
            return min((term[n][1] for n, e in state if term[n] is not None and term[n][0] == BEGIN), default=None)

        def outcome(state) -> tuple[int, int]:
            exact = [term[n][1] for n, e in state if e == 0 and term[n] is not None and term[n][0] == EXACT]
            if exact:
                return EXACT, min(exact)
            near = [term[n][1] for n, e in state if e == 1 and term[n] is not None and term[n][0] == EXACT and words[term[n][1]] in edited]
            return (FUZZY, min(near)) if near else (NONE, 0)

        start = close({(0, 0), (begin_root, 0)})
        number, todo, rows, kinds, terms = {frozenset(): 0, start: 1}, [start], {0: [0] * width}, [NONE, NONE], [0, 0]
        ends: dict[int, int] = {}  # absorbing states by beginning
        while todo:
            state = todo.pop()
            row = []
            for k in range(width):
                step = set()
                for node, edits in state:
                    if k in kids[node]:
                        step.add((kids[node][k], edits))
                    if edits == 0 and node in long_enough:
                        step.add((node, 1))
                        step |= {(kid, 1) for kid in kids[node].values() if kid in long_enough}
                step = {(n, 0 if (n, 0) in step else e) for n, e in step}
                new = close(step)
                begun = absorbed(new)
                if begun is not None:
                    if begun not in ends:
                        ends[begun] = len(kinds)
                        rows[len(kinds)] = [len(kinds)] * width
                        kinds.append(BEGIN)
                        terms.append(begun)
                    row.append(ends[begun])
                    continue
                if new not in number:
                    number[new] = len(kinds)
                    kind, which = outcome(new)
                    kinds.append(kind)
                    terms.append(which)
                    todo.append(new)
                row.append(number[new])
            rows[number[state]] = row
        self.table = np.array([rows[i] for i in range(len(kinds))], np.int32)
        self.kinds, self.terms = np.array(kinds, np.int8), np.array(terms, np.int32)
        self.longest = max((len(t) for t in (*words, *beginnings)), default=0) + 1

    def _path(self, kids: list[dict[int, int]], t: str) -> list[int]:
        out = [0]
        for c in t:
            out.append(kids[out[-1]][int(self.klass[ord(c)])])
        return out

    def match(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind, term) of each word, given as a range of lower-cased code points."""
        state = np.ones(len(starts), np.int32)
        active = np.arange(len(starts))
        for step in range(self.longest):
            active = active[starts[active] + step < ends[active]]
            if not len(active):
                break
            c = chars[starts[active] + step]
            state[active] = self.table[state[active], self.klass[c]]
            active = active[state[active] > 0]
        kind, term = self.kinds[state], self.terms[state]
        too_long = (ends - starts > self.longest) & (kind != BEGIN)
        return np.where(too_long, NONE, kind), term


@dataclass
class Model:
    """A learned lexicon with its automaton, and the logistic weights of the features."""

    automaton: Automaton
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.center) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for runs of rows of about PIECE characters."""
    first, part, held = 0, [], 0
    for i, x in enumerate(texts):
        t = x.as_py() or ""
        if part and held + len(t) > PIECE:
            yield first, part
            first, part, held = i, [], 0
        part.append(t)
        held += len(t)
    if part:
        yield first, part


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased code points, starts, ends, text of each word, where each text begins); words are runs of letters."""
    lowered = [t.lower() for t in texts]
    chars = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[chars]
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.cumsum([0] + [len(t) + 1 for t in lowered])
    return chars, starts, ends, np.searchsorted(begins[1:], starts, "right"), begins


FEATURES = ("severity", "share")


def features(texts: list[str], automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(features, hits) of each text: a row of FEATURES; hits by kind (exact, misspelled, beginning)."""
    chars, starts, ends, text, begins = _words(texts)
    n = len(texts)
    kind, _ = automaton.match(chars, starts, ends)
    words = np.bincount(text, minlength=n).astype(float)
    hit = np.flatnonzero(kind != NONE)
    owner = text[hit]
    hits = np.stack([np.bincount(owner[kind[hit] == k], minlength=n) for k in (EXACT, FUZZY, BEGIN)], axis=1).astype(float)
    quoted, lone = _context(chars, starts, ends, text, begins, hit)
    severity = np.where(kind[hit] == FUZZY, MISSPELLED, 1.0) * np.where(quoted, QUOTED, 1.0) * np.where(lone, LONE, 1.0)
    total = np.bincount(owner, weights=severity, minlength=n)
    return np.stack([np.log1p(total), np.log1p(200 * total / np.maximum(words, 20))], axis=1), hits


def _context(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, begins: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(quoted, lone) of each hit, a word's number. It is quoted where quotation marks stand on both sides, with no more than
    QUOTED_WITHIN words of its text between, an apostrophe among letters being none; lone where none of the WINDOW words on
    either side is a hit."""
    if not len(hit):
        return np.zeros(0, bool), np.zeros(0, bool)
    letter = _LETTER[chars]
    inner = np.zeros(len(chars), bool)
    inner[1:-1] = letter[:-2] & letter[2:]
    upto = np.concatenate(([0], np.cumsum(_QUOTE[chars] & ~inner)))
    owner, far = text[hit], QUOTED_WITHIN + 1
    before, after = np.maximum(hit - far, 0), np.minimum(hit + far, len(starts) - 1)
    left = np.where((hit >= far) & (text[before] == owner), ends[before], begins[owner])
    right = np.where((hit + far < len(starts)) & (text[after] == owner), starts[after], begins[owner + 1] - 1)
    quoted = (upto[starts[hit]] > upto[left]) & (upto[right] > upto[ends[hit]])
    gap = np.where(np.diff(owner) == 0, np.diff(hit), 10**9)
    before, after = np.concatenate(([10**9], gap)), np.concatenate((gap, [10**9]))
    return quoted, np.minimum(before, after) > WINDOW


def _near_counts(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    """(term, texts, toxic): how many texts of each batch hold a misspelling of each word of the lexicon."""
    for batch in batches:
        for first, texts in _pieces(batch.column("text")):
            toxic = batch.column("toxic").slice(first, len(texts)).to_numpy(zero_copy_only=False)
            chars, starts, ends, text, _ = _words(texts)
            kind, term = automaton.match(chars, starts, ends)
            near = np.unique(np.stack([text[kind == FUZZY], term[kind == FUZZY]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([automaton.words[t] for t in near[:, 1]], pa.string()), pa.array(np.ones(len(near), np.int64)), pa.array(toxic[near[:, 0]].astype(np.int64))], ["term", "n", "toxic"])


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, none of them negative but the last, the constant, of a logistic model with a ridge: Newton steps on the
    features left, of which the one with the most negative weight goes until there is none."""
    used = list(range(x.shape[1]))
    while True:
        a = np.column_stack([x[:, used], np.ones(len(x))])
        w = np.zeros(a.shape[1])
        ridge = np.append(np.full(len(used), 1.0), 1e-6)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-9:
                break
        if not used or w[:-1].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[used] = w[:-1]
            out[-1] = w[-1]
            return out
        used.pop(int(np.argmin(w[:-1])))


def _terms(batches: Iterator[pa.RecordBatch], shortest: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(term, texts, toxic) of each batch: whole words end in a space; others are beginnings of words."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for x, y in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            chars, starts, ends, _, _ = _words([x.as_py() or ""])
            text = chars.tobytes().decode("utf-32-le", "surrogatepass")
            found = set()
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if b - a <= LONGEST_TERM:
                    found.add(text[a:b] + " ")
                found.update(text[a : a + k] for k in range(shortest, min(longest, b - a - 1) + 1))
            for t in found:
                c = counts.setdefault(t, [0, 0])
                c[0] += 1
                c[1] += y
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["term", "n", "toxic"])


def _chosen(terms: list[str]) -> tuple[list[str], list[str]]:
    """(words, beginnings) of terms, best first: what a chosen beginning covers, or begins a chosen word, adds nothing."""
    words: list[str] = []
    beginnings: dict[str, None] = {}
    begun: set[str] = set()  # all that a chosen word begins with
    inside: dict[str, list[str]] = {}  # chosen beginnings by what they begin with
    for term in terms:
        starts = [term[:k] for k in range(1, len(term) + 1)]
        if any(x in beginnings for x in starts):
            continue
        if term.endswith(" "):
            words.append(term[:-1])
            begun.update(starts[:-1])
        elif term not in begun:
            for b in inside.get(term, ()):
                beginnings.pop(b, None)
            beginnings[term] = None
            for x in starts:
                inside.setdefault(x, []).append(term)
    return words, list(beginnings)


def held_out(doc_id):
    """Whether a document's label is held out: crc32 of its id as text, mod 4, is 2. Null: not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, most_rows: int = 10_000, least_texts: int = 3, shortest: int = 4, longest: int = 8) -> Model:
    """A model from the labelled rows of docs that are not held out, most_rows of them at most (by hash of the id).

    Terms are all those whose share of toxic texts exceeds that of others e**2 times, in least_texts toxic
    texts or more, with a log likelihood ratio above LEAST_GAIN; the best first, whole words before beginnings. Words of the
    lexicon whose misspellings are not found e**2 times as often in toxic texts, though least_texts texts hold them, are
    matched exactly only: what is near to them are other words. Labels without text, ids without a label and null labels are
    left out; of an id labelled twice, the higher label counts, of an id with several texts the least. Without any toxic
    label the lexicon is empty and the score is the labels' mean, 0 if there are none.
    """
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Labels of documents that aren't there don't count towards the bound.
    chosen = chosen.join(docs.select(F.col("doc_id").alias("d_id")), F.col("doc_id") == F.col("d_id"), "left_semi")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).select(F.col("doc_id").alias("l_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).groupBy("l_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").persist()
    try:
        total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
        n, t = total["n"], total["t"]
        if not t or t == n:
            flat = Automaton([], [])
            base = np.clip(t / n if n else 0.0, 1e-6, 1 - 1e-6)
            return Model(flat, np.append(np.zeros(len(FEATURES)), np.log(base / (1 - base))), np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        terms = rows.mapInArrow(lambda b: _terms(b, shortest, longest), "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("k"))
        p, q = (F.col("k") + 0.5) / (t + 1.0), (F.col("n") - F.col("k") + 0.5) / (n - t + 1.0)
        gain = F.col("k") * F.log(p) + (t - F.col("k")) * F.log(1 - p) + (F.col("n") - F.col("k")) * F.log(q) + (n - t - F.col("n") + F.col("k")) * F.log(1 - q)
        both = (F.col("n") + 0.5) / (n + 1.0)
        gain = gain - F.col("n") * F.log(both) - (n - F.col("n")) * F.log(1 - both)
        telling = F.log(p / q) > 2
        good = terms.filter((F.col("k") >= least_texts) & telling).withColumn("gain", gain).filter(F.col("gain") > LEAST_GAIN)
        found = good.orderBy(F.desc(F.round("gain", 6)), F.desc(F.endswith("term", F.lit(" "))), "term").collect()
        words, beginnings = _chosen([r["term"] for r in found])
        edited = Automaton(words, beginnings)
        near = rows.mapInArrow(lambda b: _near_counts(b, edited), "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("k"))
        others = frozenset(r["term"] for r in near.filter((F.col("n") >= least_texts) & ~telling).collect())  # words of the lexicon
        automaton = Automaton(words, beginnings, plain=others) if others else edited

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, texts in _pieces(batch.column("text")):
                    x, _ = features(texts, automaton)
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("toxic").slice(first, len(texts))], ["x", "y"])

        sample = rows.mapInArrow(measured, "x array<double>, y int").collect()  # most_rows rows of a few numbers at most
    finally:
        rows.unpersist()
    sample = sorted((*r["x"], r["y"]) for r in sample)  # one order, whatever the partitions
    data = np.array(sample, float)
    x, y = data[:, :-1], data[:, -1]
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    return Model(automaton, _fitted((x - center) / scale, y), center, scale)


def score_texts(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """docs with score (0 to 1), predicted (1 at THRESHOLD or more), n_exact, n_misspelled, n_beginnings.

    Only the text is an input. Null and empty texts have no hit and get the score of a text without any. Rows are
    independent: equal texts get equal scores, no rows give none. Columns of docs with one of the new names, to
    which prefix is put, are replaced.
    """
    new = [prefix + x for x in ("score", "predicted", "n_exact", "n_misspelled", "n_beginnings")]
    kept = [c for c in docs.columns if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, texts in _pieces(batch.column("text")):
                x, hits = features(texts, m.automaton)
                score = np.round(m.score(x), 12)
                part = batch.slice(first, len(texts))
                hit = hits.astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), *(pa.array(hit[:, k]) for k in range(3))], [*kept, *new])

    return docs.select(*kept).mapInArrow(apply, ", ".join(fields) + ", " + ", ".join(f"`{n}` {t}" for n, t in zip(new, ("double", "int", "long", "long", "long"), strict=True)))


def op7_toxicity(spark, sf_dir):
    """All documents; learned from the labels that are not held out."""
    docs = table(small_batches(spark), sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_exact", "n_misspelled", "n_beginnings")
