"""Fill-in-middle by a parallel automaton scan.

One automaton reads a text byte by byte: it tells where a token ends and whether a sentinel stands in the text. A chunk of a text does not
know in which state it is entered, so it emits a function: for every start state, the state it is left in and the tokens that end
in it. Functions compose associatively. Composed over the chunks of a document they give every chunk its entry state and the tokens before
it; a cut after k tokens then lies in one chunk, which alone looks for it. Documents above ``chunk_bytes`` are dealt out
by chunks; a shorter one is a single chunk, and a batch of them is composed in one go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pushgraph.llm import textvec as V
from pushgraph.session import forget, small_batches, table, written

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"

# Classes of bytes; runs of the first two are one symbol, for to read one twice is to read it once.
OTHER, WHITE, OPEN, PRE, SUF, MID, CLOSE, NOTHING = range(8)
CLASS = np.zeros(256, np.uint8)
CLASS[V.SPACE] = WHITE
for _c, _byte in zip((OPEN, PRE, SUF, MID, CLOSE), b"<PSM>", strict=True):
    CLASS[_byte] = _c
# States: between words or in one; in a word also how much of a sentinel was read last; all of it with or without a sentinel behind.
GAP, GAP_SEEN, WORD, W_OPEN, W_PRE, W_SUF, W_MID, WORD_SEEN = range(8)
STATES = 8


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(step, ends): next state, and tokens that end, by class and state."""
    step, ends = np.zeros((8, STATES), np.uint8), np.zeros((8, STATES), np.int64)
    for s in range(STATES):
        seen = s in (GAP_SEEN, WORD_SEEN)
        for c in (OTHER, OPEN, PRE, SUF, MID, CLOSE):
            step[c, s] = WORD_SEEN if seen else WORD
        if not seen:
            step[OPEN, s] = W_OPEN
        step[WHITE, s] = GAP_SEEN if seen else GAP
        ends[WHITE, s] = s not in (GAP, GAP_SEEN)
        step[NOTHING, s] = s
    for c, s in ((PRE, W_PRE), (SUF, W_SUF), (MID, W_MID)):
        step[c, W_OPEN] = s
        step[CLOSE, s] = WORD_SEEN
    return step, ends


STEP, ENDS = _automaton()


def _then(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """f, then g, row by row: (state after, tokens ended) for every start state."""
    return np.take_along_axis(g[0], f[0].astype(np.intp), 1), f[1] + np.take_along_axis(g[1], f[0].astype(np.intp), 1)


def _fours() -> tuple[np.ndarray, np.ndarray]:
    """The functions of all sequences of four classes."""
    at = np.arange(8**4)
    f = STEP[at % 8], ENDS[at % 8]
    for i in range(1, 4):
        c = at // 8**i % 8
        f = _then(f, (STEP[c], ENDS[c]))
    return f


FOUR = _fours()


def functions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state after, tokens ended), a row of STATES each, of the chunks data[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    cls = CLASS[data]
    keep = np.ones(len(cls), bool)
    keep[1:] = (cls[1:] != cls[:-1]) | (cls[1:] > WHITE)
    firsts = offsets[:-1][offsets[:-1] < len(cls)]
    keep[firsts] = True
    kept = np.flatnonzero(keep)
    bounds = np.searchsorted(kept, offsets)
    size = np.diff(bounds)
    # Four symbols at a time by a table, then by halves: neighbours in a chunk are composed until it is one function.
    fours = -(-size // 4)
    start = np.concatenate(([0], np.cumsum(fours)))
    padded = np.full(4 * start[-1], NOTHING, np.uint8)
    padded[np.arange(len(kept)) + np.repeat(4 * start[:-1] - bounds[:-1], size)] = cls[kept]
    code = padded.reshape(-1, 4).astype(np.intp) @ np.array([1, 8, 64, 512])
    f, size = (FOUR[0][code], FOUR[1][code]), fours
    while len(size) and size.max() > 1:
        start = np.concatenate(([0], np.cumsum(size)))
        nth = np.arange(start[-1]) - np.repeat(start[:-1], size)
        left = np.flatnonzero(nth % 2 == 0)
        paired = np.flatnonzero((nth % 2 == 0) & (nth + 1 < np.repeat(size, size)))
        out = f[0][left], f[1][left]
        where = np.searchsorted(left, paired)
        both = _then((f[0][paired], f[1][paired]), (f[0][paired + 1], f[1][paired + 1]))
        out[0][where], out[1][where] = both
        f, size = out, -(-size // 2)
    states, counts = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1)), np.zeros((n, STATES), np.int64)
    some = np.flatnonzero(size)
    states[some], counts[some] = f
    return states, counts


def token_ends(data: np.ndarray, offsets: np.ndarray, entered: np.ndarray) -> np.ndarray:
    """Positions at which a token ends before the byte, in chunks that are entered in the states ``entered``."""
    white = V.SPACE[data]
    in_word = np.empty_like(white)
    in_word[1:] = ~white[:-1]
    some = np.flatnonzero(offsets[:-1] < offsets[1:])
    in_word[offsets[some]] = entered[some] >= WORD
    return np.flatnonzero(white & in_word)


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def chosen(doc_id, n: int, sentinel: bool, seed: int, fim_percent: int, spm_percent: int) -> tuple[str, int, int]:
    """(form, tokens of the prefix, tokens up to the middle's end), by the hash of the seed and the id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or sentinel or h3 % 100 >= fim_percent:
        return PLAIN, a, b
    return (SPM if h4 % 100 < spm_percent else PSM), a, b


def joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = (x.encode() for x in SENTINELS)
    return b"".join((p, prefix, s, suffix, m, middle) if form == PSM else (s, suffix, p, prefix, m, middle))


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from the output and its form; the three parts hold no sentinel."""
    parts = F.split(output, "<[PSM]>", 4)
    in_order = F.when(form == PSM, F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == PLAIN, output).otherwise(in_order)


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
KEY = ["who", "t1", "t2"]


def _out(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _short(docs: DataFrame, options: tuple[int, int, int]) -> DataFrame:
    """Documents that are one chunk each, a batch of them at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, data, offsets in V.doc_pieces(batch, "text", V.PIECE):
                state, ended = functions(data, offsets)
                ends = token_ends(data, offsets, np.full(j - i, GAP))
                first = np.searchsorted(ends, offsets)
                raw, rows = data.tobytes(), []
                for r in range(j - i):
                    a, b = int(offsets[r]), int(offsets[r + 1])
                    n = int(ended[r, GAP]) + (b > a)
                    form, k1, k2 = chosen(ids[i + r], n, state[r, GAP] in (GAP_SEEN, WORD_SEEN), *options)
                    if form == PLAIN:
                        rows.append((ids[i + r], n, form, None, None, raw[a:b].decode()))
                        continue
                    x, y = (a if not k else b if k == n else int(ends[first[r] + k - 1]) for k in (k1, k2))
                    rows.append((ids[i + r], n, form, code_points(data[a:x]), code_points(data[x:y]), joined(form, raw[a:x], raw[x:y], raw[y:b]).decode()))
                yield _out(rows)

    return docs.mapInArrow(scan, OUT)


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(key, nth, piece) of documents (doc_id, key, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *KEY, "nth", "piece"]
        for batch in batches:
            data, offsets = V.batch_bytes(batch.column("text"))
            for r in range(batch.num_rows):
                key = [batch.column(c)[r].as_py() for c in ("doc_id", *KEY)]
                for nth, a in enumerate(range(int(offsets[r]), int(offsets[r + 1]), chunk_bytes)):
                    piece = data[a : min(a + chunk_bytes, int(offsets[r + 1]))].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*key, nth, piece], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()], strict=True)], names)

    return docs.mapInArrow(cut, "doc_id long, who string, t1 long, t2 long, nth int, piece binary")


def _summaries(chunks: DataFrame) -> DataFrame:
    """(doc_id, key, nth, bytes, chars, states, ends): each chunk's function."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *KEY, "nth", "bytes", "chars", "states", "ends"]
        for batch in batches:
            for r in range(batch.num_rows):
                data = np.frombuffer(batch.column("piece")[r].as_buffer(), np.uint8)
                state, ended = functions(data, np.array([0, len(data)]))
                more = [pa.array([len(data)], pa.int64()), pa.array([code_points(data)], pa.int64()), pa.array([state[0].tolist()], pa.list_(pa.int32())), pa.array([ended[0].tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(r, 1) for c in names[:5]] + more, names)

    return chunks.mapInArrow(scan, "doc_id long, who string, t1 long, t2 long, nth int, bytes long, chars long, states array<int>, ends array<long>")


CUT = "who string, t1 long, t2 long, n long, form string, side int, k long, nth int, entered int, nth_end long, bytes long, chars long"


def _composed(summaries: DataFrame, options: tuple[int, int, int]) -> DataFrame:
    """Two rows for each document, its cuts: the chunk that each lies in (null at the text's start or end), the state that chunk is
    entered in, which of its token ends it is, and bytes and code points before the chunk. A group is one document's
    functions, some hundred bytes for each chunk."""

    def compose(key, rows):
        rows = rows.sort_by("nth")
        states = np.array(rows.column("states").to_pylist(), np.intp)
        ends = np.array(rows.column("ends").to_pylist(), np.int64)
        size, chars = (rows.column(c).to_numpy() for c in ("bytes", "chars"))
        # All entry states at once: functions are composed with those 1, 2, 4, .. chunks before them.
        to, width = states.copy(), 1
        while width < len(to):
            to[width:] = np.take_along_axis(to[width:], to[:-width], 1)
            width *= 2
        entered = np.concatenate(([GAP], to[:-1, GAP]))
        ended = np.cumsum(ends[np.arange(len(ends)), entered])
        n = int(ended[-1]) + 1
        form, *cuts = chosen(rows.column("doc_id")[0].as_py(), n, to[-1, GAP] in (GAP_SEEN, WORD_SEEN), *options)
        before = [np.concatenate(([0], np.cumsum(x))) for x in (size, chars)]
        out = []
        for side, k in enumerate(cuts):
            at = [x.as_py() for x in key]
            if k in (0, n):
                out.append((*at, n, form, side, k, None, None, None, int(before[0][-1] if k else 0), int(before[1][-1] if k else 0)))
                continue
            c = int(np.searchsorted(ended, k))
            out.append((*at, n, form, side, k, c, int(entered[c]), k - int(ended[c - 1] if c else 0), int(before[0][c]), int(before[1][c])))
        types = [pa.string(), *[pa.int64()] * 3, pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in CUT.split(", ")])

    return summaries.groupBy(*KEY).applyInArrow(compose, CUT)


def _long(docs: DataFrame, options: tuple[int, int, int], chunk_bytes: int) -> DataFrame:
    """Documents of several chunks. Rows alike in id and text have the same chunks, which count once."""
    docs = docs.withColumns({"who": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    chunks = _chunks(docs, chunk_bytes).repartition(*KEY, "nth").dropDuplicates([*KEY, "nth"])
    chunks = written(chunks)
    cuts = written(_composed(_summaries(chunks), options))
    here = cuts.filter((F.col("form") != PLAIN) & F.col("nth").isNotNull())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for r in range(batch.num_rows):
                data = np.frombuffer(batch.column("piece")[r].as_buffer(), np.uint8)
                ends = token_ends(data, np.array([0, len(data)]), np.array([batch.column("entered")[r].as_py()]))
                x = int(ends[batch.column("nth_end")[r].as_py() - 1])
                at.append((x + batch.column("bytes")[r].as_py(), code_points(data[:x]) + batch.column("chars")[r].as_py()))
            cols = [*KEY, "n", "form", "side"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in cols] + [pa.array([x[i] for x in at], pa.int64()) for i in (0, 1)], [*cols, "bytes", "chars"])

    inside = here.join(chunks.select(*KEY, "nth", "piece"), [*KEY, "nth"]).mapInArrow(find, "who string, t1 long, t2 long, n long, form string, side int, bytes long, chars long")
    edges = cuts.filter((F.col("form") == PLAIN) | F.col("nth").isNull()).select(*inside.columns)
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    found = inside.unionByName(edges).groupBy(*KEY, "n", "form").agg(*(pick(side, c).alias(f"{c}{side}") for side in (0, 1) for c in ("bytes", "chars")))
    found = written(found)
    forget(chunks, cuts)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
                form, text = get("form"), get("text")
                if form == PLAIN:
                    yield _out([(get("doc_id"), get("n"), form, None, None, text)])
                    continue
                raw, x, y = text.encode(), get("bytes0"), get("bytes1")
                yield _out([(get("doc_id"), get("n"), form, get("chars0"), get("chars1") - get("chars0"), joined(form, raw[:x], raw[x:y], raw[y:]).decode())])

    return docs.join(found, KEY).select("doc_id", "text", "n", "form", "bytes0", "chars0", "bytes1", "chars1").mapInArrow(assemble, OUT)


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, chunk_bytes: int = 1 << 16) -> DataFrame:
    """One row for each input row: (doc_id, n, form, prefix_chars, middle_chars, output).

    n counts the tokens of the text: a word with the white space before it, and white space at the end. The first four groups of the
    sha256 of ``seed:id`` choose two cuts after whole tokens, whether the document is transformed (fim_percent) and into which form
    (spm_percent of them spm, the others psm). A text that is empty or holds a sentinel stays plain, with null prefix_chars and
    middle_chars. Null text: empty. Null id: the empty string in the hash. Repeated rows each give their row, equal ones equal.
    No rows: no rows. Other columns are ignored, whatever their names.

    Texts of chunk_bytes at most are read where they are. Only longer ones move: once in chunks, once whole, to be put together.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    options = seed, fim_percent, spm_percent
    size = F.octet_length("text")
    return _short(docs.filter(size <= chunk_bytes), options).unionByName(_long(docs.filter(size > chunk_bytes), options, chunk_bytes))


def op12_fill_in_middle(spark, sf_dir):
    """All documents; half of them transformed, four fifths of these with the suffix first."""
    rows = fill_in_middle(table(small_batches(spark), sf_dir, "documents"))
    sha = lambda c: F.sha2(c, 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS t FROM documents),
g AS (SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT doc_id, n, form, text, array_to_string(t[1:a], '') AS x, array_to_string(t[a + 1:b], '') AS y, array_to_string(t[b + 1:], '') AS z FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
