"""Substring dedup: windows of words that repeat across documents, behind a count-min prefilter.

Pass 1 sketches. Of the 5-word runs inside a window of 13 the one with the least hash is its anchor;
windows with equal words have equal anchors, and neighbouring windows mostly share one, so only a
fifth of the positions is counted. Each partition counts its anchors into ``depth`` rows of cells (0, 1, 2 or
more); partitions' cells are added, block by block, on the executors. The merged sketch overestimates
only: a window whose sequence stands in two places has a count of 2 or more in every row.

Pass 2 groups exactly the windows estimated repeated, by an 80-bit hash of their words: they are sorted by
hash and document and streamed, so that no group is held, however large; of a window in very many documents
each batch sends one row only. A window that an earlier document has goes back to its own document, whose
words it covers are cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushgraph.llm import textvec as V
from pushgraph.llm.sketch import maybe_repeated, repeated_bits
from pushgraph.session import small_batches, table


def _anchors(h: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, at): hashes of the gram-word runs, and for each window the position of its least one."""
    grams = V.runs(h, gram, 1)
    span = size - gram + 1
    # Least over a sliding span: doubling, then two overlapping halves.
    at = np.arange(len(grams))
    width = 1
    while width * 2 <= span:
        right = at[width:]
        left = at[: len(right)]
        at = np.where(grams[right] < grams[left], right, left)
        width *= 2
    rest = span - width
    if rest:
        right = at[rest:]
        left = at[: len(right)]
        at = np.where(grams[right] < grams[left], right, left)
    return grams, at


def _docs(batches: Iterator[pa.RecordBatch], text_col: str, size: int):
    """(batch, row, word hashes) for every text of size words or more."""
    for batch in batches:
        for i, j, data, offsets in V.doc_pieces(batch, text_col):
            starts, ends, first = V.words(data, offsets)
            h = V.word_hashes(data, starts, ends)
            for r in range(i, j):
                if first[r - i + 1] - first[r - i] >= size:
                    yield batch, r, h[first[r - i] : first[r - i + 1]]


def repeated_words(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 13,
    gram: int = 5,
    depth: int = 2,
    bits: int | None = None,
    most_bits: int = 27,
) -> DataFrame:
    """One row for each input row: (doc_id, n_words, n_removed, removed, kept): removed holds (first,
    last + 1) word ranges, disjoint and in order, of the words in a window whose sequence also starts in
    a document with a smaller id; kept is the words left, joined by one space.

    Null and empty texts have no words. Rows with the same id never take words from each other; nor
    does a null id take or lose any. Windows repeated inside one document stay. No rows: no rows. Further
    columns are ignored.

    bits: cells of a sketch row, as a power of two; by default from the documents' number and average
    length, most_bits at most, which bounds the broadcast to depth * 2**most_bits / 8 bytes. Beyond that bound
    the filter passes more windows to the exact pass and loses none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if bits is None:
        size_of = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
        bits = min(most_bits, max(16, math.ceil(math.log2(max(1, size_of) / 3))))

    def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, h in _docs(batches, "text", size):
            grams, at = _anchors(h, size, gram)
            yield grams[np.unique(at)]  # once for each place it stands at

    repeated = spark.sparkContext.broadcast(repeated_bits(docs.select("text"), anchors_of, depth=depth, bits=bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[] for _ in range(5)]

        def flush() -> pa.RecordBatch:
            key, low, doc, tag, pos = (np.concatenate(x) for x in out)
            for x in out:
                x.clear()
            # Windows that a smaller document among these holds are settled here: they go on under a key of their
            # document, so that a window in very many documents sends one row of each batch to its group.
            order = np.lexsort((doc, low, key))
            k, w, d = key[order], low[order], doc[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
            least = d[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
            settled = np.zeros(len(k), bool)
            settled[order] = d > least
            own = V.mix(doc.view(V.U) * V._STEP[0]).view(np.int64)  # one for each document: its rows pack well
            low = np.where(settled, 0, low).astype(np.int16)
            return pa.RecordBatch.from_arrays([pa.array(np.where(settled, own, key)), pa.array(low), pa.array(doc), pa.array(tag), pa.array(pos), pa.array(settled)], ["key", "low", "doc", "tag", "pos", "settled"])

        held = 0
        for batch, r, h in _docs(batches, "text", size):
            who = batch.column("doc_id")[r].as_py()
            if who is None:
                continue
            grams, at = _anchors(h, size, gram)
            anchors, where = np.unique(at, return_inverse=True)
            hit = maybe_repeated(grams[anchors], repeated.value, depth=depth, bits=bits)
            found = np.flatnonzero(hit[where])
            if not len(found):
                continue
            out[0].append(V.runs(h, size, 2)[found].view(np.int64))
            out[1].append((V.runs(h, size, 3)[found] >> V.U(48)).astype(np.uint16).view(np.int16))
            out[2].append(np.full(len(found), who, np.int64))
            out[3].append(np.full(len(found), batch.column("tag")[r].as_py(), np.int64))
            out[4].append(found.astype(np.int32))
            held += len(found)
            if held > 300_000:
                yield flush()
                held = 0
        if held:
            yield flush()

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, low, doc): those whose group starts with a smaller document, and settled ones."""
        last = (None, None, 0)
        for batch in batches:
            known = batch.column("settled").to_numpy(zero_copy_only=False)
            rest = np.flatnonzero(~known)
            take = np.flatnonzero(known)
            if len(rest):
                key, low, doc = (batch.column(c).to_numpy()[rest] for c in ("key", "low", "doc"))
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1])
                first = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
                if (key[0], low[0]) == last[:2]:
                    head = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(key)
                    first[:head] = last[2]
                last = (key[-1], low[-1], first[-1])
                take = np.concatenate((take, rest[doc > first]))
            at = pa.array(take)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("doc", "tag", "pos")], ["doc", "tag", "pos"])

    # The tag tells rows apart that share an id.
    tagged = docs.withColumn("tag", F.xxhash64("text"))
    every = tagged.mapInArrow(candidates, "key long, low short, doc long, tag long, pos int, settled boolean")
    taken = every.repartition("key").sortWithinPartitions("key", "low", "doc").mapInArrow(later, "doc long, tag long, pos int")
    marks = taken.groupBy("doc", "tag").agg(F.collect_set("pos").alias("at"))
    joined = tagged.join(marks, (F.col("doc_id") == F.col("doc")) & (tagged["tag"] == marks["tag"]), "left").select("doc_id", "text", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, removed, kept = [], [], [], []
            for text, at in zip(batch.column("text"), batch.column("at"), strict=True):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                spans = []
                if at.values is not None and len(at.values):
                    pos = np.sort(at.values.to_numpy())
                    new = np.flatnonzero(np.diff(pos, prepend=-size - 2) > size)
                    spans = list(zip(pos[new].tolist(), (pos[np.concatenate((new[1:] - 1, [len(pos) - 1]))] + size).tolist(), strict=True))
                for a, b in reversed(spans):
                    del words[a:b]
                gone.append(counts[-1] - len(words))
                removed.append([{"first": a, "last": b} for a, b in spans])
                kept.append(b" ".join(words).decode())
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, span), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "removed", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<first:int,last:int>>, kept string")


def op9_repeated_windows(spark, sf_dir):
    """All documents; windows of 13 words."""
    rows = repeated_words(table(small_batches(spark), sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS p, unnest([array_to_string(w[i:i + 12], ' ') FOR i IN range(1, len(w) - 11)]) AS s FROM d WHERE len(w) >= 13),
own AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
bad AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS p FROM win JOIN own USING (s) WHERE doc_id > least),
each AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN bad USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
