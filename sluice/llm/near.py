"""N-gram Jaccard join: MinHash prefixes by tree, then exact verification.

Rows become vertices by their sequence of words: rows of equal words are one vertex with a count, so copies are never paired.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, drop, mix, partitions, settled, shingles, sifted, stream, words

TREES, LONGEST, RECALL = 17, 6, 0.9998
#: Members and bytes of shingles that a block holds, and columns of shingles that are multiplied at once.
BLOCK, BYTES, WIDTH = 512, 8 << 20, 4096


def depths(threshold: float, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> list[int]:
    """The length of each tree's prefixes: all begin at longest, and one tree after the other is shortened by a value until a pair of this similarity meets in some tree with probability recall (or all prefixes are of one value).

    Rows and their matches have no say in it: a tree that is shortened because a row met nobody there, or not because it met somebody, would make what is missed depend on what is sought.
    """
    found = [longest] * trees
    for k in range(trees * (longest - 1)):
        if 1 - math.prod(1 - threshold**d for d in found) >= recall:
            break
        found[k % trees] -= 1
    return found


def signatures(hashes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """rows x n MinHash values of 16 bits of the shingles (each row has at least one)."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    factor = (stream(11, n) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (stream(12, n) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, n), np.uint16)
    for j in range(n):
        least = np.minimum.reduceat(x * factor[j] + add[j], offsets[:-1])
        out[:, j] = (mix(least.astype(np.uint64) + np.uint64(j << 33)) >> np.uint64(48)).astype(np.uint16)
    return out


def _identity(text: str) -> bytes:
    """16 bytes of a cryptographic hash of the sequence of words."""
    return hashlib.blake2b(b" ".join(text.encode().split()), digest_size=16).digest()


def _sketches(values: int, size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0)
            for lo, hi, hashes, offsets in words(batch.column(1)):
                full = np.flatnonzero(np.diff(offsets) > 0)
                own, texts = ids.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                vid, labels = [None] * (hi - lo), [None] * (hi - lo)
                size_of = np.zeros(hi - lo, np.int64)
                if len(full):
                    at = np.append(offsets[:-1][full], offsets[-1])
                    grams, where = shingles(hashes, at, size)
                    size_of[full] = np.diff(where)
                    found = signatures(grams, where, values).astype(">u2").tobytes()
                    row = values * 2
                    for i, r in enumerate(full.tolist()):
                        vid[r] = _identity(texts[r].as_py())
                        labels[r] = found[row * i : row * i + row]
                yield pa.RecordBatch.from_arrays([own, pa.array(vid, pa.binary()), pa.array(labels, pa.binary()), pa.array(size_of)], ["id", "vid", "labels", "grams"])

    return run


def _shingle_sets(size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, _, hashes, offsets in words(batch.column(0)):
                full = np.flatnonzero(np.diff(offsets) > 0)
                if not len(full):
                    continue
                at = np.append(offsets[:-1][full], offsets[-1])
                grams, where = shingles(hashes, at, size)
                names = [_identity(batch.column(0)[lo + r].as_py()) for r in full.tolist()]
                sets = [np.unique(grams[where[i] : where[i + 1]]).tobytes() for i in range(len(full))]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["vid", "grams"])

    return run


def _shared(lists: list[np.ndarray]) -> np.ndarray:
    """How many numbers each pair of lists (sorted, without repeats) has in common."""
    m = len(lists)
    _, column, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    out = np.full((m, m), float((count == m).sum()), np.float32)
    some = (count > 1) & (count < m)
    place = np.cumsum(some) - 1
    row = np.repeat(np.arange(m), [len(x) for x in lists])
    kept = some[column]
    row, column = row[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(some.sum()), WIDTH):
        lo, hi = np.searchsorted(column, [a, a + WIDTH])
        part = np.zeros((m, WIDTH), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        out += part @ part.T
    return out


def _linked(threshold: float):
    """Rows come sorted by unit. Of each unit all pairs of its two blocks are compared; each member with links gives a row."""

    def solve(key: tuple, rows: list) -> tuple[list, list, list]:
        centre, i, j = key
        m = len(rows)
        block = np.array([r[1] for r in rows])
        size = np.array([len(r[4]) // 8 for r in rows])
        both = _shared([np.frombuffer(r[4], np.uint64) for r in rows])
        links = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
        links &= (block[:, None] != block[None, :]) if i != j else ~np.eye(m, dtype=bool)
        if not links.any():
            return [], [], []
        root, before = np.arange(m), None
        while before is None or (root != before).any():
            before = root
            root = np.minimum(root, np.where(links, root[None, :], m).min(1))
        lower = [np.array(sorted(x for x in r[3] if x < centre), np.int64) for r in rows]
        if sum(len(x) > 0 for x in lower) > 1:  # a pair counts where its least common centre is
            links &= _shared(lower) == 0
        weight = links @ np.array([r[2] for r in rows], np.int64)
        there = np.flatnonzero((weight > 0) | (root != np.arange(m)))
        return [rows[k][0] for k in there], [rows[root[k]][0] for k in there], weight[there].tolist()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], ([], [], [])

        def flush() -> None:
            if len(rows) > 1:
                for to, new in zip(out, solve(key, rows), strict=True):
                    to.extend(new)
            rows.clear()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["vid", "root", "weight"])

        for batch in it:
            columns = [batch.column(k) for k in range(8)]
            for r in range(batch.num_rows):
                own = tuple(columns[k][r].as_py() for k in range(3))
                if own != key:
                    flush()
                    key = own
                rows.append([columns[k][r].as_py() for k in (3, 4, 5, 6, 7)])
            yield made()
            out = ([], [], [])
        flush()
        yield made()

    return run


def _compared(stars: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(vid, root, weight) for the members of stars (centre, vid): all pairs that share a centre are compared exactly, in memory. weight: rows of the texts linked; root: another vertex of the same component.

    The side of a join that has one row for each key is written first, so adaptive execution finds plain shuffles on both sides and can split a hot centre. Members of a centre are dealt into blocks, and each pair of blocks is a unit of its own, so a centre with any number of members is spread over tasks that each hold two blocks. A pair that shares several centres counts at the least one.
    """
    spark = stars.sparkSession
    of = stars.groupBy("vid").agg(F.collect_set("centre").alias("centres"))  # one for each tree at most
    members = cut(stars.join(sets.select("vid", "copies", F.length("grams").alias("bytes")), "vid"))
    blocks = cut(members.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BYTES)).cast("int").alias("blocks")).where("n > 1"))
    placed = members.join(blocks, "centre").select("centre", "vid", "blocks", F.pmod(F.xxhash64("vid", F.lit(3)), F.col("blocks").cast("long")).cast("int").alias("block"))
    unit = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    units = placed.select("centre", "vid", "block", unit.alias("unit")).select("centre", "unit.i", "unit.j", "vid", "block")
    full = units.join(sets.join(of, "vid"), "vid").select("centre", "i", "j", "vid", "block", "copies", "centres", "grams")
    dealt = full.repartition(partitions(spark), "centre", "i", "j").sortWithinPartitions("centre", "i", "j")
    return arrow_map(dealt, _linked(threshold), "vid binary, root binary, weight long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the least vertex of its component.

    Labels are lowered to the least among neighbours and then to the label's own label, until none changes; each round is checkpointed. Nothing is gathered: a hot vertex is aggregated on the map side and its join can be split.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    labels = before = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy(F.col("a").alias("w")).agg(F.min("root").alias("m"))
        lower = labels.join(near, F.col("v") == F.col("w")).select("v", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        of = labels.select(F.col("v").alias("up"), F.col("root").alias("top"))
        new = cut(lower.join(of, F.col("root") == F.col("up"), "left").select("v", "old", F.least("root", F.coalesce("top", "root")).alias("root")))
        drop(before)
        labels, before = new.select("v", "root"), new
        if new.where("old != root").isEmpty():
            return labels


def _counted(base: DataFrame, sketched: DataFrame, lengths: list[int], size: int, threshold: float) -> DataFrame:
    """(vid, root, least, n_copies, n_links) for each vertex: root names its component, least is its least id."""
    vertices = cut(sketched.where("vid IS NOT NULL").groupBy("vid").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("labels").alias("labels")))

    # Buckets and centres are named by 64-bit hashes: two that share a name only have more pairs compared.
    names = [F.xxhash64(F.lit(k), F.expr(f"substring(labels, {2 * sum(lengths[:k]) + 1}, {2 * d})")) for k, d in enumerate(lengths)]
    rows = vertices.select("vid", F.explode(F.array(*names)).alias("bucket"))
    met = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min(F.xxhash64("vid")).alias("centre")).where("m > 1").drop("m"))
    stars = cut(rows.join(met, "bucket").select("centre", "vid").distinct())
    drop(met)

    wanted = cut(stars.select("vid").distinct().join(vertices.select("vid", F.col("least").alias("id"), "copies"), "vid"))
    texts = sifted(base, wanted, "id").where("__marked").select("text")  # sets are shuffled, texts aren't
    sets = arrow_map(texts, _shingle_sets(size), "vid binary, grams binary").dropDuplicates(["vid"])
    sets = cut(sets.join(wanted.select("vid", "copies"), "vid"))
    drop(wanted)
    found = settled(lambda: _compared(stars, sets, threshold))
    drop(stars, sets)

    linked = found.groupBy("vid").agg(F.sum("weight").alias("linked"))
    roots = components(found.select(F.col("vid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("v", "vid")
    counted = vertices.select("vid", "least", "copies").join(roots, "vid", "left").join(linked, "vid", "left")
    return counted.select("vid", F.coalesce("root", "vid").alias("root"), "least", F.col("copies").alias("n_copies"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))


def jaccard_join(df: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 5, threshold: float = 0.8, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> DataFrame:
    """One row per row of df: id_col, class_id, n_links, n_copies.

    Two rows are linked if the Jaccard similarity of their sets of size-word shingles (64-bit hashes, common.digests; words are split at ASCII white space; a text of fewer words is one shingle) is threshold or more. class_id is the least id in the row's connected component of links, n_links the number of other rows linked to it, n_copies the number of rows with the same words (128 bits of a cryptographic hash), itself included. Rows without words (null, empty, blank) link to nothing: class_id is their own id, n_links 0, n_copies 1. Repeated rows and ids are rows like others; a null id is greater than all others. Columns besides the two are ignored.

    1. Prefixes of MinHash values, one for each tree, of the lengths that depths gives; rows are grouped by tree and prefix, and what depths allows to miss is the only loss. Only values that are read are computed. No trie is walked row by row: a walk that stops at a row's longer match would miss links that meet by a shorter one.
    2. Members of a bucket of equal prefixes all get its least member, by hash, as a centre: linear in the bucket, and two members of any bucket share a centre.
    3. All pairs that share a centre are compared exactly, in blocks and in memory; what leaves a task is a row for each member, not for each pair. The work, not the rows, grows with the square of a group of similar but different texts.
    """
    lengths = depths(threshold, trees, longest, recall)
    base = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sketched = cut(arrow_map(base, _sketches(sum(lengths), size), f"id {df.schema[id_col].dataType.simpleString()}, vid binary, labels binary, grams long"))
    blank = sketched.where("vid IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    counted = settled(lambda: _counted(base, sketched, lengths, size, threshold))
    classes = cut(counted.groupBy("root").agg(F.min("least").alias("class_id")))
    result = counted.join(classes, "root").select("vid", "class_id", "n_links", "n_copies")
    out = sketched.where("vid IS NOT NULL").select("id", "vid").join(result, "vid").select("id", "class_id", "n_links", "n_copies")
    return out.unionByName(blank).withColumnRenamed("id", id_col)
