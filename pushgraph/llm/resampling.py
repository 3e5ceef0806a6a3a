"""Importance resampling towards a target distribution over hashed word runs.

Both corpora are counted into ``buckets`` of features; a bucket's gain is the log ratio of its shares, and a document's weight the sum of
its features' gains, looked up in one array. Gumbel noise of the id makes the highest scores a draw without replacement.

The draw. Each partition of scores is sorted into a run, cut into pages at splitters that all runs share. Exact counts by splitter range tell
which ranges hold the draw; the others' pages are never read. A task merges the pages of a range, which come in the order of their first rows,
by a tournament tree that holds one page of each run, and stops after the exact number of rows; ranks go on from range to range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushgraph.llm import crc
from pushgraph.llm import textvec as V
from pushgraph.llm.tournament import LAST, Page, Tournament
from pushgraph.session import forget, small_batches, table, written

#: Bytes of words: all but ASCII that is neither letter nor digit (looked at in lower case).
INSIDE = np.ones(256, bool)
INSIDE[:0x30] = INSIDE[0x3A:0x61] = INSIDE[0x7B:0x80] = False
PIECE = 4 * V.PIECE
NO_ID = 2**63 - 1
PAGE_ROWS = 4096


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, end row, bytes, offsets, goes on): rows together up to PIECE bytes, a longer text in parts that end
    outside words; goes on: the part's first word follows the last part's."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        if j > i + 1 or b - a <= PIECE:
            yield i, j, data[a:b], offsets[i : j + 1] - a, False
        else:
            on = False
            while a < b:
                end = min(a + PIECE, b)
                while end < b and INSIDE[V.LOWER[data[end - 1]]]:  # not within a word
                    end += 1
                yield i, j, data[a:end], np.array([0, end - a]), on
                a, on = end, True
        i = j


def features(batch: pa.RecordBatch, text_col: str, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bucket of each feature, its row less the first, words of each row); a long text's row comes in parts."""
    data, offsets = V.batch_bytes(batch.column(text_col))
    held_crc, held_size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for i, j, part, bounds, on in _pieces(data, offsets):
        low = V.LOWER[part]
        starts, ends, first = V.spans(INSIDE[low], bounds)
        one, size = crc.of_words(low, starts, ends), ends - starts
        row = np.repeat(np.arange(j - i), np.diff(first))
        # The last two words of the part before stand in front, without features of their own.
        held = len(held_crc) if on else 0
        if held:
            one, size, row = np.concatenate((held_crc, one)), np.concatenate((held_size, size)), np.concatenate((np.zeros(held, row.dtype), row))
        pair = crc.moved(crc.spaced(one[:-1]), size[1:]) ^ one[1:] if len(one) > 1 else one[:0]
        triple = crc.moved(crc.spaced(pair[:-1]), size[2:]) ^ one[2:] if len(one) > 2 else one[:0]
        two, three = row[1:] == row[:-1], row[2:] == row[:-2]
        two[: held - 1 if held else 0] = False
        keys = np.concatenate((one[held:], pair[two], triple[three])) if len(one) else one
        rows = np.concatenate((row[held:], row[1:][two], row[2:][three])) if len(one) else row
        yield i, j, keys % np.uint32(buckets), rows, np.diff(first)
        held_crc, held_size = one[-2:], size[-2:]


def bucket_counts(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: a partition's counts are added up by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, keys, _, _ in features(batch, text_col, buckets):
                total += np.bincount(keys, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share, target to source, one feature added to each bucket; rounded down."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, from the hash of the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, *, seed: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_features, n_words, weight, score)."""
    buckets, shared = len(gain), docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, j, keys, rows, counts in features(batch, "text", buckets):
                n[i:j] += np.bincount(rows, minlength=j - i)
                words[i:j] += counts
                weight[i:j] += np.bincount(rows, weights=shared.value[keys], minlength=j - i).astype(np.int64)  # whole numbers far below 2**53
            drawn = np.array([noise(d, seed) for d in batch.column("doc_id").to_pylist()], np.int64)
            cols = [pa.array(x, pa.int64()) for x in (n, words, weight, weight + drawn)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_features", "n_words", "weight", "score"])

    return docs.mapInArrow(score, "doc_id long, n_features long, n_words long, weight long, score long")


def _splitters(rows: DataFrame, n: int, range_rows: int, most_ranges: int) -> np.ndarray:
    """Keys (3 by ranges - 1) that cut n rows into about equal ranges, from 32 sampled rows a range. They bear on balance alone: counts are exact."""
    ranges = min(most_ranges, -(-n // range_rows))
    if ranges < 2:
        return np.zeros((3, 0), np.int64)
    sample = np.array([tuple(r) for r in rows.sample(min(1.0, 32 * ranges / n), seed=1).collect()], np.int64).reshape(-1, 3).T  # bounded by most_ranges
    sample = sample[:, np.lexsort(sample[::-1])]
    return sample[:, [len(sample[0]) * i // ranges for i in range(1, ranges)]] if len(sample[0]) else sample


def _pages(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Runs: each partition's rows (key columns a, b, c) sorted, as pages of one splitter range each, PAGE_ROWS rows at most."""
    names = ["range", "a", "b", "c", "n", "first", "second", "third"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(x).to_numpy() for x in ("a", "b", "c")]
            n, m = len(keys[0]), len(cuts[0])
            # Where the splitters stand among the rows: a row equal to a splitter lies behind it.
            mixed = np.lexsort([np.concatenate((np.zeros(m, int), np.ones(n, int)))] + [np.concatenate((c, k)) for c, k in zip(cuts[::-1], keys[::-1], strict=True)])
            of = np.empty(n, np.int64)
            of[mixed[mixed >= m] - m] = np.cumsum(mixed < m)[mixed >= m]
            edges = np.flatnonzero(np.diff(of, prepend=-1))
            starts = [x for a, b in zip(edges, [*edges[1:], n], strict=True) for x in range(a, b, PAGE_ROWS)]
            parts = list(zip(starts, [*starts[1:], n], strict=True))
            lists = [pa.array([k[a:b] for a, b in parts], pa.list_(pa.int64())) for k in keys]
            heads = [pa.array(k[starts], pa.int64()) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(of[starts], pa.int32()), *heads, pa.array([b - a for a, b in parts], pa.int64()), *lists], names)

    schema = "range int, a long, b long, c long, n long, first array<long>, second array<long>, third array<long>"
    return rows.sortWithinPartitions("a", "b", "c").mapInArrow(cut, schema)


def _merged(pages: DataFrame, offsets: list[int], draw: int) -> DataFrame:
    """(seq, rank) of the first ``draw`` rows; offsets: how many rows lie before each range that holds some of them."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at, rank = Tournament(), None, 0

        def out(bound: tuple) -> Iterator[pa.RecordBatch]:
            nonlocal rank
            if rank >= draw:
                return
            for _, _, seq in tree.below(bound):
                seq = seq[: draw - rank]
                yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(np.arange(rank + 1, rank + len(seq) + 1), pa.int64())], ["seq", "rank"])
                rank += len(seq)
                if rank >= draw:
                    return

        for batch in batches:
            for r in range(batch.num_rows):
                here = batch.column("range")[r].as_py()
                if here != at:
                    yield from out(LAST)
                    tree, at, rank = Tournament(), here, offsets[here]
                page = Page(tuple(batch.column(x)[r].values.to_numpy() for x in ("first", "second", "third")))
                yield from out(page.head())
                tree.add(page)
        yield from out(LAST)

    return pages.repartition("range").sortWithinPartitions("range", "a", "b", "c").mapInArrow(merge, "seq long, rank long")


def ranked_draw(rows: DataFrame, draw: int, n: int, *, range_rows: int = 1 << 16, most_ranges: int = 4096) -> DataFrame:
    """(seq, rank) of the first ``draw`` of the n rows (a, b, c) in order of the three; c, which tells rows apart, is the seq."""
    pages = written(_pages(rows, _splitters(rows, n, range_rows, most_ranges)))
    held = {r["range"]: r["n"] for r in pages.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # a row a range
    offsets, before = [], 0
    for i in range(max(held, default=-1) + 1):
        if before >= draw:
            break
        offsets.append(before)
        before += held.get(i, 0)
    out = written(_merged(pages.filter(F.col("range") < len(offsets)), offsets, draw))
    forget(pages)
    return out


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 5,
    seed: int = 42,
    range_rows: int = 1 << 16,
    most_ranges: int = 4096,
) -> DataFrame:
    """One row for each input row: (doc_id, n_features, weight, score, rank): the documents that are most like target's texts, drawn with
    probabilities by weight. rank is null for what isn't drawn: percent of the documents with least_words words, rounded down, are.

    Words are runs of letters and digits (and of all that isn't ASCII), A-Z in lower case; features are their runs of one to three. Null text: no
    words, weight 0. Null id: the empty string in the noise, last among ties. Equal rows are each a document; which of them comes first
    is open. An empty target gives every bucket the same share. No rows: no rows. Other columns are ignored, whatever their names.

    The texts are scanned twice, with counts of ``buckets`` numbers in between; after that about 50 bytes a document move.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    target = target.select(F.coalesce(F.col(target_text_col), F.lit("")).alias("text"))
    gain = gains(bucket_counts(docs, "text", buckets), bucket_counts(target, "text", buckets))
    rows = written(scores(docs, gain, seed=seed).withColumn("seq", F.monotonically_increasing_id()))
    able = rows.filter(F.col("n_words") >= least_words).select((-F.col("score")).alias("a"), F.coalesce("doc_id", F.lit(NO_ID)).alias("b"), F.col("seq").alias("c"))
    n = able.count()
    ranks = ranked_draw(able, percent * n // 100, n, range_rows=range_rows, most_ranges=most_ranges)
    return rows.join(ranks, "seq", "left").select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark, sf_dir):
    """All documents towards the benchmark's texts; five in a hundred are drawn."""
    spark = small_batches(spark)
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
