"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere go.

Text is first thinned out without loss: of each string of the length asked for, the least hash of a short substring (its anchor) is what equal strings share, so only text around anchors that occur twice is sorted, in shards by anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, digests, mix, partitions, settled, sifted, stream, text_bytes
from .suffixes import HELD, repeated

LENGTH, ANCHOR = 200, 32
#: Bytes of text that are searched at once for anchors, and that a shard sorts at once if its anchors allow.
SPAN, SHARD = 1 << 19, 1 << 19
#: Bytes of differing stretches around one anchor beyond which its strings are dealt out one by one instead of sorted in one shard.
HOT = 1 << 23
#: Stretches whose strings are hashed at once.
ROWS = 512


_BYTE = stream(1, 256)
_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A rolling hash of the k bytes from each place on: it only chooses anchors, so a collision merely puts two of them into one shard."""
    n = len(data)
    if not _powers or len(_powers[0]) <= n:
        longest = max(n, SPAN) + 1
        _powers[:] = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(longest - 1, p, np.uint64))) for p in (_P, pow(_P, -1, 2**64))]
    power, inverse = _powers
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: n - k + 1])


def _anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int, lanes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Runs of string starts that share an anchor: first and last start, the anchor's hash, and 64 bits a lane of hash of the whole stretch with the anchor's place in it. ends: for each byte, where its document ends."""
    n = len(data)
    none = np.zeros(0, np.int64)
    nothing = (none, none, *([none.astype(np.uint64)] * (1 + len(lanes))))
    if n < length:
        return nothing
    grams = _grams(data, k)
    low = np.uint64((1 << 20) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    w = length - k + 1
    rows = -(-len(key) // w)
    padded = np.full(rows * w, 2**64 - 1, np.uint64)
    padded[: len(key)] = key
    ahead = np.minimum.accumulate(padded.reshape(rows, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(padded.reshape(rows, w), axis=1).ravel()
    starts = n - length + 1
    at = (np.minimum(ahead[:starts], back[w - 1 : w - 1 + starts]) & low).astype(np.int64)
    valid = np.flatnonzero(np.arange(starts) + length <= ends[:starts])
    if not len(valid):
        return nothing
    at = at[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    i, j, at = valid[first], valid[last], at[first]
    place = mix(((at - i) << 32 | (j - i)).astype(np.uint64))
    return i, j, grams[at], *(mix(digests(data, i, j + length, lane) + place) for lane in lanes)


def _documents(data: np.ndarray, offsets: np.ndarray, length: int, k: int, lanes: tuple[int, ...] = (0, 1)) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, first and last start, anchor and stretch, over spans of documents; a longer document is taken in spans that overlap."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SPAN, "right")) - 1)
        begin, end = int(offsets[lo]), int(offsets[hi])
        for a in range(begin, max(begin + 1, end - length + 1), SPAN - length + 1) if hi == lo + 1 else (begin,):
            b = min(end, a + SPAN) if hi == lo + 1 else end
            row = np.repeat(np.arange(lo, hi), np.diff(np.clip(offsets[lo : hi + 1], a, b)))
            i, j, *hashes = _anchors(data[a:b], np.minimum(offsets[row + 1], b) - a, length, k, lanes)
            if len(i):
                own = row[i]
                yield own, i + a - offsets[own], j + a - offsets[own], *hashes
        lo = hi


def _counts(length: int, k: int):
    """Texts to their anchors, with the number of stretches of each in a span of text; nothing else is hashed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, _, _, anchors in _documents(*text_bytes(batch.column(0)), length, k, ()):
                found, n = np.unique(anchors, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return run


def _find(length: int, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = text_bytes(batch.column(2))
            for row, i, j, *hashes in _documents(data, offsets, length, k):
                own = pa.array(row)
                places = [pa.array(x.astype(np.int32)) for x in (i, j)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *places, *(pa.array(x.view(np.int64)) for x in hashes)], ["id", "print", "i", "j", "anchor", "stretch", "twin"])

    return run


def _fetch(length: int):
    """Rows of text and wanted stretches to rows of a stretch and its bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = text_bytes(batch.column(2))
            wanted = batch.column(3)
            flat, per = wanted.flatten(), np.diff(np.asarray(wanted.offsets))
            row = np.repeat(np.arange(batch.num_rows), per)
            i, j = np.asarray(flat.field("i"), np.int64), np.asarray(flat.field("j"), np.int64)
            begin = offsets[row] + i
            cuts = [data[a : a + n].tobytes() for a, n in zip(begin.tolist(), (j - i + length).tolist(), strict=True)]
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), flat.field("i"), flat.field("anchor"), flat.field("n"), pa.array(cuts, pa.binary())], ["id", "print", "i", "anchor", "n", "bytes"])

    return run


def _strings(length: int):
    """Like _fetch, then each stretch's strings: a row for each start, with 128 bits of the string's hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _fetch(length)(it):
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                data, offsets = text_bytes(batch.column(5))
                per = np.diff(offsets) - length + 1
                row = np.repeat(np.arange(batch.num_rows), per)
                step = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                at = offsets[row] + step
                string, twin = (pa.array(digests(data, at, at + length, lane).view(np.int64)) for lane in (0, 1))
                own = pa.array(row)
                begin = pa.array((np.asarray(batch.column(2))[row] + step).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), begin, batch.column(3).take(own), batch.column(4).take(own), string, twin], ["id", "print", "begin", "anchor", "n", "string", "twin"])

    return run


def _sort(length: int, held: int):
    """Rows sorted by anchor: those that share one are sorted together, with those of other anchors up to SHARD bytes."""

    def solve(rows: list) -> pa.RecordBatch:
        ids, prints, begins, ends = [], [], [], []
        for (own, print_, i, n, _), found in zip(rows, repeated([r[4] for r in rows], length, held), strict=True):
            if n == 1 and found.any():
                edge = np.diff(np.concatenate([[0], found.view(np.int8), [0]]))
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    ids.append(own)
                    prints.append(print_)
                    begins.append(i + a)
                    ends.append(i + b - 1 + length)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["id", "print", "begin", "end"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in it:
            anchors = np.asarray(batch.column(3))
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5)]
            for r, anchor in enumerate(anchors.tolist()):
                if anchor != last and size >= SHARD:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append([c[r] for c in columns])
                size += len(columns[4][r])
                last = anchor
        if rows:
            yield solve(rows)

    return run


def _spans(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _documents_of(df: DataFrame, text: str, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _wanted(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, print, text, wanted) for documents that hold a stretch of rows: wanted has all of theirs, as many as a document has stretches."""
    wanted = cut(rows.groupBy("id", "print").agg(F.collect_list(F.struct("i", "j", "anchor", "n")).alias("wanted")))
    some = sifted(docs, wanted, "id", "print").where("__marked")
    same = some["id"].eqNullSafe(wanted["id"]) & (some["print"] == wanted["print"])
    return some.join(wanted, same).select(wanted["id"], wanted["print"], "text", "wanted")


def repeated_spans(docs: DataFrame, length: int = LENGTH, held: int = HELD, hot: int = HOT) -> DataFrame:
    """(id, print, spans) for documents (id, print, text) that have bytes to remove: spans is an array of (begin, end) in UTF-8 bytes, unmerged.

    1. Strings of length bytes that share an anchor are a stretch. Equal stretches, such as those of copies, are counted by 128 bits of their bytes' hash (common.digests); all of what they cover repeats.
    2. Of each anchor with stretches that differ, one of each is fetched and sorted: external induced sorting within shards by anchor; neighbours that have length bytes in common repeat.
    3. An anchor whose differing stretches exceed hot bytes, such as a phrase that a third of all documents hold in different surroundings, would be one task's shard. Its strings are dealt out by 128 bits of their hash instead and counted, so they spread over all tasks.

    The side of a join that has one row for each key is written first, so adaptive execution finds plain shuffles on both sides and can split a hot anchor or stretch; counts are aggregated on the map side. A shard has fewer than hot bytes more than SHARD; what is beyond held numbers of it is on disk.
    """
    spark = docs.sparkSession
    found = arrow_map(docs, _find(length, min(ANCHOR, length)), "id long, print long, i int, j int, anchor long, stretch long, twin long")
    each = arrow_map(docs.select("text"), _counts(length, min(ANCHOR, length)), "anchor long, n long")
    several = cut(each.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor"))
    met = cut(found.join(several, "anchor"))
    one = [F.first(c).alias(c) for c in ("id", "print", "i", "j")]  # of one row: all see the same rows in the same order
    same = ["anchor", "stretch", "twin"]
    counts = cut(met.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), *one))
    whole = met.join(counts.where("n > 1").select(*same), same).select("id", "print", F.col("i").alias("begin"), (F.col("j") + length).alias("end"))
    kinds = counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("j") - F.col("i") + length).alias("bytes"))
    kinds = cut(kinds.where("kinds > 1").drop("kinds"))
    one_each = counts.join(kinds, "anchor")
    stretches = arrow_map(_wanted(docs, one_each.where(F.col("bytes") <= hot)), _fetch(length), "id long, print long, i int, anchor long, n long, bytes binary")
    dealt = stretches.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    spans = whole.distinct().unionByName(arrow_map(dealt, _sort(length, held), "id long, print long, begin int, end int"))
    if not kinds.where(F.col("bytes") > hot).isEmpty():
        strings = arrow_map(_wanted(docs, one_each.where(F.col("bytes") > hot)), _strings(length), "id long, print long, begin int, anchor long, n long, string long, twin long")
        named = ["anchor", "string", "twin"]
        again = strings.groupBy(*named).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*named)
        single = strings.where("n = 1").join(again, named, "left_semi")  # others are whole
        spans = spans.unionByName(single.select("id", "print", "begin", (F.col("begin") + length).alias("end")))
    return spans.groupBy("id", "print").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, offsets = text_bytes(batch.column(1))
        all_spans = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        n_removed, n_spans, sha, kept_texts = [], [], [], []
        for r, spans in enumerate(all_spans):
            text = data[offsets[r] : offsets[r + 1]].tobytes()
            merged = _spans([(x["begin"], x["end"]) for x in spans or ()])
            at, kept = 0, []
            for a, b in merged:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            kept = b"".join(kept)
            n_removed.append(len(text) - len(kept))
            n_spans.append(len(merged))
            sha.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept)
        n_bytes = pa.array(np.diff(offsets))
        yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_texts, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(df: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, held: int = HELD, hot: int = HOT) -> DataFrame:
    """One row per row of df: id_col, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A byte goes if a string of length bytes that covers it also starts anywhere else, in another row or in the same one; strings are compared as UTF-8 bytes, overlap freely and never cross rows. n_spans counts maximal removed runs, kept (binary) is what remains, concatenated; it need not be valid UTF-8. null and empty texts have no bytes. Repeated rows repeat each other, so nothing of them that is long enough stays. id_col is a number, not necessarily unique: rows are told apart by it and the text. Other columns are ignored.
    """
    docs = _documents_of(df, text, id_col)
    spans = settled(lambda: repeated_spans(docs, length, held, hot))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    dealt = sifted(docs, spans, "id", "print")
    clean = arrow_map(dealt.where("NOT __marked").select("id", "text"), _digests, schema)
    some = dealt.where("__marked")
    same = some["id"].eqNullSafe(spans["id"]) & (some["print"] == spans["print"])
    touched = arrow_map(some.join(spans, same, "left").select(some["id"], "text", "spans"), _digests, schema)
    return clean.unionByName(touched).withColumnRenamed("id", id_col)
