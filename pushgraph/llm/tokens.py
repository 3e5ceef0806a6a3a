"""Token counts by offset-mapped attribution.

Every text is encoded once, whole. Token byte spans come from the tokens' lengths; they are joined, as sorted
intervals, to the spans of the text's sections. A token that crosses a boundary is allocated by the rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushgraph.session import small_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that this vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "most", "last")


@lru_cache(maxsize=2)
def encoder(name: str):
    """(encode, length in bytes of each token) of a vocabulary file that was added to the job."""
    import tiktoken

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def line_sections(text: str) -> list[int]:
    """Starts of the sections, in code points: each line with its line feed; the empty text is one section."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(text) else starts


def allocate(ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; ends of the tokens and starts of the sections in bytes.

    first, last: to the section with the token's first or last byte. most: to the one with most of its bytes, the
    earlier one of equals. A crossing token counts as such in every section that it touches.
    """
    begins = np.concatenate(([0], ends))[:-1]
    a = np.searchsorted(starts, begins, "right") - 1
    b = np.searchsorted(starts, ends - 1, "right") - 1
    owner = {"first": a, "most": a.copy(), "last": b}[rule]
    crossing = np.zeros(len(starts), np.int64)
    for t in np.flatnonzero(a != b):
        bounds = np.concatenate(([begins[t]], starts[a[t] + 1 : b[t] + 1], [ends[t]]))
        crossing[a[t] : b[t] + 1] += np.diff(bounds) > 0
        if rule == "most":
            owner[t] = a[t] + int(np.argmax(np.diff(bounds)))
    return np.bincount(owner, minlength=len(starts)), crossing


def count_tokens(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, rule: str = "most", sections: Callable[[str], list[int]] = line_sections
) -> DataFrame:
    """One row for each section of each input row: (doc_id, section, start, end, n_tokens, n_crossing,
    doc_tokens), start and end in code points.

    Null and empty texts have one empty section without tokens. The sections' counts sum to doc_tokens, the
    count of the whole text. Rows are independent: repeated rows give repeated rows, no rows give none.
    Further columns are ignored. vocabulary is a file on the driver; it goes to the executors with the job.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}, not {rule!r}")
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rpartition("/")[2]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = encoder(name)
        for batch in batches:
            rows, columns = [], [[] for _ in range(5)]
            held = 0

            def flush() -> pa.RecordBatch:
                n = [r[1] for r in rows]
                out = [batch.column("doc_id").take(pa.array(np.repeat([r[0] for r in rows], n))), *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns), pa.array(np.repeat(np.array([r[2] for r in rows], np.int64), n))]
                rows.clear()
                for c in columns:
                    c.clear()
                return pa.RecordBatch.from_arrays(out, ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

            for i, x in enumerate(batch.column("text")):
                text = x.as_py() or ""
                ids = np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.int64)
                starts = np.array(sections(text), np.int64)
                ends = np.concatenate((starts[1:], [len(text)]))
                if text.isascii():
                    at = starts
                else:
                    chars = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)
                    at = np.concatenate((chars, [0]))[starts] if len(text) else starts
                owned, crossing = allocate(np.cumsum(lengths[ids]), at, rule)
                for c, v in zip(columns, (np.arange(len(starts)), starts, ends, owned, crossing), strict=True):
                    c.append(v)
                rows.append((i, len(starts), len(ids)))
                held += len(starts)
                if held > 100_000:
                    yield flush()
                    held = 0
            if rows:
                yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long")


def op6_section_tokens(spark, sf_dir):
    """All documents by line."""
    return count_tokens(table(small_batches(spark), sf_dir, "documents"))
