"""N-gram Jaccard join: shingle sets in a prefix tree, joined within candidate clusters.

1. One pass gives every document its set of distinct 5-word shingles (64-bit hashes), the set's size
   and the set's class (a digest); equal sets are one class from then on.
2. The global order puts shingles that stand in one class alone first, as far as a count-min sketch
   (over half of the hash space, a bit for each shingle up to 2**31) proves it, then the rest of the hash space's other half, then
   what may be repeated; by hash within each. Two sets of Jaccard 0.8 or more share a shingle among the
   first n - ceil(0.8 n) + 1 of each, whatever the order. This one fills the prefixes of texts that copy less
   than most of their shingles with shingles that can't be shared, which needn't move at all. The others go,
   sorted by shingle and size class, past a task that notes which classes meet.
3. Classes that meet, transitively, are a cluster. No link leaves a cluster. Only the sets in clusters
   move. Among them the same is done again, this time rare first by how many of them hold a shingle, which
   leaves clusters of texts that copy one another, however common the passages in them are. Each
   cluster's sets are joined in a trie (see trie.py), ordered most frequent first.
4. A cluster above ``block_tokens`` is split into blocks. Every block first meets a few pivots; what this
   leaves outside the cluster's largest component is then compared with every block. Near copies by the
   thousand mostly join a pivot at once, so they cost in proportion.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pushgraph.llm import textvec as V
from pushgraph.llm.components import components
from pushgraph.llm.sketch import count_levels, levels_of, maybe_repeated, repeated_bits
from pushgraph.llm.trie import spanning_links
from pushgraph.session import small_batches, table, written

K = 5
SKETCHED = V.U(2**63)  # the half of the hash space that the sketch covers


def _sets(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, sorted distinct shingle hashes) for every row."""
    for batch in batches:
        for i, j, data, offsets in V.doc_pieces(batch, text_col):
            starts, ends, first = V.words(data, offsets)
            h = V.word_hashes(data, starts, ends, lower=True)
            for r in range(i, j):
                w = h[first[r - i] : first[r - i + 1]]
                yield batch, r, np.unique(V.runs(w, min(K, max(1, len(w))), 4))


def _digests(s: np.ndarray, bits: int) -> tuple[int, int]:
    """The halves of the set's digest of 128 bits; the first one has only so many bits."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    first, second = (int.from_bytes(x, "little", signed=True) for x in (d[:8], d[8:]))
    return first & ((1 << bits) - 1) if bits < 64 else first, second


def _class_of(s: np.ndarray, clashes: frozenset[int], bits: int) -> int:
    """The set's class: the first half of its digest, or the second where other sets have the same first."""
    first, second = _digests(s, bits)
    return second if first in clashes else first


def _prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _sketch_bits(shingles: int, most_bits: int) -> int:
    """Cells of the first sketch, as a power of two: 0.7 a shingle, so that at most 0.72 of the sketched half fall on a cell and half of those that
    stand alone are proven, a quarter of a set: more than its prefix. 2**(most_bits + 3) at most."""
    return min(most_bits + 3, max(16, math.ceil(math.log2(max(1, 0.7 * shingles)))))


def _size_class(n: int) -> int:
    """Sizes of sets that link differ by a quarter at most, so by one class at most."""
    return int(math.floor(math.log(n) / math.log(1.25) + 1e-9))


def _prefix(s: np.ndarray, sketch: bytes, bits: int) -> np.ndarray:
    """The shingles of the set's prefix that another set may hold."""
    rank = np.ones(len(s), np.uint8)
    inside = int(np.searchsorted(s, SKETCHED, "right"))  # s is sorted
    rank[:inside] = np.where(maybe_repeated(s[:inside], sketch, depth=1, bits=bits), 2, 0)
    first = np.argsort(rank, kind="stable")[: _prefix_length(len(s))]
    return s[first[rank[first] > 0]]


def _rare_prefix(s: np.ndarray, levels: bytes, bits: int) -> np.ndarray:
    """The same where levels tell how many sets hold a shingle; level 0 is one set alone."""
    rank = levels_of(s, levels, bits)
    first = np.argsort(rank, kind="stable")[: _prefix_length(len(s))]
    return s[first[rank[first] > 0]]


def _prefix_rows(sets: Iterator[tuple[int, np.ndarray]], prefix) -> Iterator[pa.RecordBatch]:
    """(token, size, class) rows of the sets' prefixes. Classes that meet among the rows held are linked here: one of them goes
    on under the token and size, the others as (class, -1, that one), so that no token's rows are many in one place."""
    rows, held = [], 0

    def flush() -> pa.RecordBatch:
        n = [len(x[0]) for x in rows]
        token, size, node = np.concatenate([x[0] for x in rows]).view(np.int64), np.repeat(np.array([x[1] for x in rows], np.int32), n), np.repeat(np.array([x[2] for x in rows], np.int64), n)
        rows.clear()
        order = np.lexsort((node, size, token))
        token, size, node = token[order], size[order], node[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (size[1:] != size[:-1])
        first = node[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        others = node != first
        links = np.unique(np.stack([node[others], first[others]], axis=1), axis=0)
        arrays = [np.concatenate((token[new], links[:, 0])), np.concatenate((size[new], np.full(len(links), -1, np.int32))), np.concatenate((node[new], links[:, 1]))]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["token", "size", "class"])

    for node, s in sets:
        rows.append((prefix(s), _size_class(len(s)), node))
        held += len(rows[-1][0])
        if held > 200_000 or len(rows) > 20_000:
            yield flush()
            held = 0
    if rows:
        yield flush()


_PREFIX = "token long, size int, class long"


def _clusters(prefixes: DataFrame) -> DataFrame:
    """(class, cluster) of the classes that meet another, from prefix rows."""
    rows = prefixes.repartition("token").sortWithinPartitions("token", "size", "class")
    return components(rows.mapInArrow(_meeting, _EDGES)).select(F.col("node").alias("class"), F.col("component").alias("cluster"))


def _stored_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for node, tokens in zip(batch.column("class").to_pylist(), batch.column("tokens"), strict=True):
            yield node, np.frombuffer(tokens.as_buffer(), np.uint64)


class _Forest:
    """Union-find over ids as they come; gives each node's link to an earlier one."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def meet(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.up) if self.find(x) != x]


def _new_sets(batches: Iterator[pa.RecordBatch], class_of) -> Iterator[tuple[int, np.ndarray]]:
    """(class, set) for the sets of a partition; copies of those that it has just seen are left out."""
    seen: set[int] = set()
    for _, _, s in _sets(batches, "text"):
        if not len(s) or (node := class_of(s)) in seen:
            continue
        if len(seen) < 200_000:
            seen.add(node)
        yield node, s


_EDGES = "u long, v long"


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["u", "v"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, size, class): neighbours with the same token and near sizes have met, as have those of size -1."""
    forest, last = _Forest(), (None, 0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        token, size, node = (batch.column(c).to_numpy() for c in ("token", "size", "class"))
        met = size < 0
        for a, b in zip(token[met].tolist(), node[met].tolist(), strict=True):
            forest.meet(a, b)
        if met.any():
            token, size, node = token[~met], size[~met], node[~met]
            if not len(token):
                continue
        if token[0] == last[0] and size[0] - last[1] <= 1 and node[0] != last[2]:
            forest.meet(int(node[0]), last[2])
        meets = np.flatnonzero((token[1:] == token[:-1]) & (size[1:] - size[:-1] <= 1) & (node[1:] != node[:-1]))
        if len(meets):
            for a, b in np.unique(np.stack([node[meets], node[meets + 1]], axis=1), axis=0).tolist():
                forest.meet(a, b)
        last = (token[-1], int(size[-1]), int(node[-1]))
        if len(forest.up) > 1_000_000:
            yield _edge_batch(forest.edges())
            forest = _Forest()
    yield _edge_batch(forest.edges())


def _trie_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: the links that span each group's components."""
    group, held = None, []

    def links() -> pa.RecordBatch:
        return _edge_batch(spanning_links([x[0] for x in held], [x[1] for x in held], [x[2] for x in held], [x[3] for x in held]))

    for batch in batches:
        groups, ids, labels, probes, sets = (batch.column(c) for c in ("group", "class", "label", "probe", "tokens"))
        for r in range(batch.num_rows):
            g = groups[r].as_py()
            if g != group:
                if held:
                    yield links()
                group, held = g, []
            if held and held[-1][0] == ids[r].as_py():
                continue  # the same set again; the row that probes is first
            held.append((ids[r].as_py(), np.frombuffer(sets[r].as_buffer(), np.uint64), labels[r].as_py(), probes[r].as_py()))
    if held:
        yield links()


def _joined(rows: DataFrame) -> DataFrame:
    return rows.repartition("group").sortWithinPartitions("group", "class", F.desc("probe")).select("group", "class", "label", "probe", "tokens").mapInArrow(_trie_join, _EDGES)


def linked(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 8_000_000, pivots: int = 64, bits: int | None = None, most_bits: int = 28, class_bits: int = 64
) -> DataFrame:
    """One row for each input row: (doc_id, text_key, n_shingles, component, component_id); text_key is
    xxhash64 of the text, component tells groups apart (null for empty sets).

    A set is the distinct 5-word shingles of the text, A-Z lower-cased; the whole sequence where it
    has fewer words; empty for a null text or one without words. Two rows link when 100 * common >=
    80 * union; an empty set links with nothing, and its component_id is its own id. component_id is the
    least id that links reach. Rows with equal sets are one class, so repeated rows and copies are never paired.
    A null id is no component's name and gets a null component_id if nothing else is reached. Shingles are
    compared by 64-bit hashes, sets by 128 bits: the few whose first class_bits are those of another are named by their others.
    No rows: no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, keys, classes, checks, sizes = None, [], [], [], [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, keys, classes, checks, sizes)], ["doc_id", "text_key", "class", "other", "n"])
            for x in (ids, keys, classes, checks, sizes):
                x.clear()
            return out

        for batch, r, s in _sets(batches, "text"):
            if batch is not now and ids:
                yield flush()
            now = batch
            ids.append(batch.column("doc_id")[r].as_py())
            keys.append(batch.column("text_key")[r].as_py())
            first, second = _digests(s, class_bits)
            classes.append(first)
            checks.append(second)
            sizes.append(len(s))
        yield flush()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, s in _new_sets(batches, class_of):
            yield s[: np.searchsorted(s, SKETCHED, "right")]

    base = written(docs.mapInArrow(describe, "doc_id long, text_key long, class long, other long, n long"))
    grouped = lambda: base.filter(F.col("n") > 0).groupBy("class").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.min("other").alias("a"), F.max("other").alias("b"))
    nodes = written(grouped())
    # Of n sets about n**2 / 2**65 share their first half with another: three of 10**10.
    clashes = frozenset(r["class"] for r in nodes.filter("a <> b").select("class").collect())
    if clashes:
        base = written(base.withColumn("class", F.when(F.col("class").isin(*clashes), F.col("other")).otherwise(F.col("class"))))
        nodes = written(grouped())
    nodes = nodes.select("class", "least", "n")
    class_of = lambda s: _class_of(s, clashes, class_bits)
    if bits is None:
        bits = _sketch_bits(base.agg(F.sum("n")).first()[0] or 0, most_bits)
    repeated = spark.sparkContext.broadcast(repeated_bits(docs.select("text"), sketched, depth=1, bits=bits))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _prefix_rows(_new_sets(batches, class_of), lambda s: _prefix(s, repeated.value, bits))

    clusters = written(_clusters(docs.select("text").mapInArrow(prefixes, _PREFIX)))
    repeated.unpersist()
    # A fixed-size bitmap of the classes in clusters keeps other sets from moving.
    wide = 26
    position = F.shiftrightunsigned("class", 64 - wide) + 1  # Spark counts positions from 1
    bitmap = clusters.select(position.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    member = np.zeros((1 << wide) // 8, np.uint8)
    for r in bitmap.collect():  # 8 MB at most
        member[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    members = spark.sparkContext.broadcast(member.tobytes())

    def members_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_class, at_tokens, held, seen = [], [], 0, set()
        bits_of = np.frombuffer(members.value, np.uint8)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(at_class, pa.int64()), pa.array(at_tokens, pa.binary())], ["class", "tokens"])
            at_class.clear()
            at_tokens.clear()
            return out

        for _, _, s in _sets(batches, "text"):
            if not len(s):
                continue
            node = class_of(s)
            p = (node & 0xFFFFFFFFFFFFFFFF) >> (64 - wide)
            if node in seen or not bits_of[p >> 3] >> (p & 7) & 1:
                continue
            if len(seen) < 200_000:
                seen.add(node)
            at_class.append(node)
            at_tokens.append(s.tobytes())
            held += len(s)
            if held > 500_000:
                yield flush()
                held = 0
        if at_class:
            yield flush()

    sets = written(docs.select("text").mapInArrow(members_sets, "class long, tokens binary").dropDuplicates(["class"]))
    members.unpersist()

    # Again among the members, rare first.
    total = clusters.join(nodes, "class").agg(F.sum("n")).first()[0] or 0
    level_bits = min(most_bits - 3, max(16, math.ceil(math.log2(max(1, total))) + 1))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (s for _, s in _stored_sets(batches))

    levels = spark.sparkContext.broadcast(count_levels(sets, stored, bits=level_bits))

    def rare_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _prefix_rows(_stored_sets(batches), lambda s: _rare_prefix(s, levels.value, level_bits))

    clusters = written(_clusters(sets.mapInArrow(rare_prefixes, _PREFIX)).join(nodes, "class"))
    levels.unpersist()
    weight = clusters.groupBy("cluster").agg(F.sum("n").alias("tokens_in")).select("cluster", F.ceil(F.col("tokens_in") / block_tokens).cast("int").alias("blocks"))
    clusters = written(clusters.join(weight, "cluster"))
    sets = sets.join(clusters.select("class", "cluster", "blocks"), "class")
    n_large = clusters.filter(F.col("blocks") > 1).count()
    if n_large:
        sets = written(sets)
    whole = sets.filter(F.col("blocks") == 1).select(F.col("cluster").cast("string").alias("group"), "class", F.col("class").alias("label"), F.lit(True).alias("probe"), "tokens")
    links = written(_joined(whole))
    if n_large:
        links = links.unionByName(_large(sets.filter(F.col("blocks") > 1), clusters, pivots))
    parts = components(links).select(F.col("node").alias("class"), F.col("component").alias("part"))
    named = nodes.select("class", "least").join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))
    names = named.groupBy("part").agg(F.min("least").alias("name"))
    named = named.join(names, "part").select("class", "name", "part")
    out = base.join(named, "class", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("part")).alias("component"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, **params) -> DataFrame:
    """linked() reduced to (doc_id, n_shingles, component_id)."""
    return linked(docs, **params).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """docs with one row of each group of linked texts: the one with the least id (then text hash; null ids last).

    Texts without words are linked with nothing and all stay; other repeated rows are one group.
    """
    found = linked(docs, **params)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")).alias("k")
    chosen = found.filter(F.col("component").isNotNull()).groupBy("component").agg(first).select(F.col("k.doc_id").alias("__k_id"), F.col("k.text_key").alias("__k_key"))
    empty = found.filter(F.col("component").isNull()).select(F.col("doc_id").alias("__k_id"), F.col("text_key").alias("__k_key"))
    keep = written(chosen.withColumn("__once", F.lit(True)).unionByName(empty.withColumn("__once", F.lit(False))).distinct())
    hit = docs.withColumn("__key", F.xxhash64("text")).join(keep, F.col("doc_id").eqNullSafe(F.col("__k_id")) & (F.col("__key") == F.col("__k_key")))
    order = Window.partitionBy("doc_id", "__key").orderBy(F.lit(1))
    hit = hit.withColumn("__nth", F.row_number().over(order)).filter(~F.col("__once") | (F.col("__nth") == 1))
    return hit.select(*docs.columns)


def _large(sets: DataFrame, clusters: DataFrame, pivots: int) -> DataFrame:
    """Links that span the components of clusters of several blocks."""
    sets = sets.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    order = Window.partitionBy("cluster").orderBy("h", "class")
    chosen = sets.select("cluster", "class", F.xxhash64("class", F.lit(1)).alias("h")).withColumn("i", F.row_number().over(order)).filter(F.col("i") <= pivots).select("class", F.lit(True).alias("pivot"))
    first = sets.join(chosen, "class", "left")
    everywhere = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = first.select("cluster", "class", "tokens", "pivot", F.explode(everywhere).alias("b"))
    # Pivots go into the trie first; the others look for them there.
    group = F.concat_ws(":", "cluster", "b")
    met = written(_joined(first.select(group.alias("group"), "class", F.col("class").alias("label"), F.lit(True).alias("probe"), "tokens")))
    labels = clusters.select("class", "cluster").join(components(met).select(F.col("node").alias("class"), "component"), "class", "left").withColumn("label", F.coalesce("component", "class"))
    labels = written(labels.join(sets.select("class"), "class", "left_semi").select("class", "cluster", "label"))
    sizes = labels.groupBy("cluster", "label").count()
    biggest = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    state = labels.join(biggest, "cluster").select("class", "label", (F.col("label") != F.col("main")).alias("rest"))
    again = sets.join(state, "class")
    # What lies outside the largest component is dealt to parts of a block's size, each of which meets every block.
    n_rest = again.filter("rest").groupBy("cluster").agg(F.sum(F.octet_length("tokens")).alias("rest_bytes"))
    mean = sets.groupBy("cluster").agg((F.sum(F.octet_length("tokens")) / F.max("blocks")).alias("block_bytes"))
    parts = n_rest.join(mean, "cluster").select("cluster", F.ceil(F.col("rest_bytes") / F.col("block_bytes")).cast("int").alias("parts"))
    again = again.join(parts, "cluster")
    part = F.pmod(F.xxhash64("class", F.lit(2)), F.col("parts")).cast("int")
    as_block = again.select("cluster", "class", "label", "tokens", F.col("block").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.lit(False).alias("probe"))
    as_rest = again.filter("rest").select("cluster", "class", "label", "tokens", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), part.alias("p"), F.lit(True).alias("probe"))
    both = as_block.unionByName(as_rest).select(F.concat_ws(":", "cluster", "b", "p").alias("group"), "class", "label", "probe", "tokens")
    return met.unionByName(written(_joined(both)))


def op2_ngram_components(spark, sf_dir):
    """All documents; five words, Jaccard 0.8."""
    return jaccard_components(table(small_batches(spark), sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM d),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, t) AS (SELECT r, r FROM d UNION SELECT reach.r, sym.b FROM reach JOIN sym ON sym.a = reach.t)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach USING (r) JOIN d o ON o.r = reach.t GROUP BY d.r, d.doc_id, n.n
"""
