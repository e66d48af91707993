"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, aside, cut, mix, words

#: Word positions that a seed looks at; the others may differ. In any 13 words of which two were replaced, and any 7 of an item of 8 of which one was, at least one of them hits.
SEEDS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4, 7), (0, 2, 3, 5, 8))
#: A leak has at least LEAST words (or a whole shorter item of at least SHORT), of which SHARE are equal. Items of fewer than SEEDED words are looked up whole.
LEAST, SHORT, SHARE, SEEDED = 13, 1, 0.8, 8
#: Words of test items that are held at once, 8 bytes each and some 100 for their seeds. More are taken in blocks, one pass over the documents each.
HELD = 200_000
#: Words of documents that are compared at once along the alignments that seeds gave.
COMPARED = 1 << 20
#: What separates words, as common.words has it with fold.
APART = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
#: The column that find_leaks adds.
MADE = ("leaks",)


def _seeded(hashes: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """The hash at each position where the seed's whole extent lies within hashes."""
    n = len(hashes) - seed[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(seed) * 64 + seed[-1], np.uint64)
    for j in seed:
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)


class Items:
    """Test items of at least SHORT words, and a table of their seeds' hashes."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.words, found = [], [], []
        used: dict[tuple[int, ...], None] = {}
        for lo, hi, hashes, offsets in words(pa.array(texts, pa.string()), fold=True):
            for i in range(lo, hi):
                own = hashes[offsets[i - lo] : offsets[i - lo + 1]]
                if len(own) >= SHORT:
                    seeds = SEEDS if len(own) >= SEEDED else (tuple(range(len(own))),)
                    used.update(dict.fromkeys(seeds))
                    for seed in seeds:
                        h = _seeded(own, seed)
                        found.append(np.stack([h, np.full(len(h), len(self.ids), np.uint64), np.arange(len(h), dtype=np.uint64)], 1))
                    self.ids.append(ids[i])
                    self.words.append(own)
        self.seeds = tuple(used)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.least = SHARE * np.minimum(LEAST, SHARE * self.size) - 1e-9
        table = np.concatenate(found) if found else np.zeros((0, 3), np.uint64)
        table = table[np.argsort(table[:, 0], kind="stable")]
        self.hash, self.item, self.at = table[:, 0].copy(), table[:, 1].astype(np.int64), table[:, 2].astype(np.int64)
        bits = max(18, int(32 * len(table)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.there = np.zeros(1 << bits, bool)
        self.there[(self.hash >> self.shift).astype(np.int64)] = True

    def _enough(self, hashes: np.ndarray, offsets: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Those of the hits (row, item, begin) with as many equal words along the alignment as the shortest leak has."""
        row, item, begin = hit.T
        lo, hi = np.maximum(begin, 0), np.minimum(begin + self.size[item], offsets[row + 1] - offsets[row])
        n = hi - lo
        at = np.concatenate([[0], np.cumsum(n)])
        step = np.arange(at[-1]) - np.repeat(at[:-1], n)
        equal = hashes[np.repeat(offsets[row] + lo, n) + step] == self.flat[np.repeat(self.begin[item] + lo - begin, n) + step]
        return hit[np.add.reduceat(equal, at[:-1], dtype=np.int64) >= self.least[item]] if len(hit) else hit

    def hits(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Distinct (row, item, word of the row where the item would begin) with enough equal words, as rows of an array.

        A seed that many items share is looked at along each of its alignments, COMPARED words at once and without a loop over them.
        """
        out = [np.zeros((0, 3), np.int64)]
        longest_item = int(self.size.max()) if len(self.size) else 1
        for seed in self.seeds:
            h = _seeded(hashes, seed)
            at = np.flatnonzero(self.there[(h >> self.shift).astype(np.int64)])
            row = np.searchsorted(offsets, at, "right") - 1
            within = at + seed[-1] < offsets[row + 1]
            at, row = at[within], row[within]
            first, last = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            upto = np.concatenate([[0], np.cumsum(last - first)])
            step = max(1, COMPARED // longest_item)
            for a in range(0, int(upto[-1]), step):
                k = np.arange(a, min(a + step, int(upto[-1])))
                place = np.searchsorted(upto, k, "right") - 1
                entry = first[place] + k - upto[place]
                hit = np.stack([row[place], self.item[entry], at[place] - offsets[row[place]] - self.at[entry]], 1)
                out.append(self._enough(hashes, offsets, np.unique(hit, axis=0)))
        return np.unique(np.concatenate(out), axis=0)


def longest(equal: np.ndarray) -> tuple[int, int]:
    """Start and length of the longest run of positions of which SHARE are equal that begins and ends at an equal one (0, 0: none)."""
    if not equal.any():
        return 0, 0
    # Integer steps: a share of 0.8 is a sum of 0 with 1 for an equal and -4 for another word.
    total = np.concatenate([[0], np.cumsum(np.where(equal, round((1 - SHARE) * 10), -round(SHARE * 10)))])
    least = np.minimum.accumulate(total)
    first = np.searchsorted(-least, -total, "left")
    length = np.arange(len(total)) - first
    k = int(length.argmax())
    start, end = int(first[k]), k
    inside = np.flatnonzero(equal[start:end])
    return (start + int(inside[0]), int(inside[-1] - inside[0]) + 1) if len(inside) else (0, 0)


def _leaks(sent, at: int, back: list[int], names: list[str], kind: pa.DataType):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        for batch in it:
            found: list[dict] = [{} for _ in range(batch.num_rows)]
            for lo, _, hashes, offsets in words(batch.column(at), fold=True):
                for row, item, begin in items.hits(hashes, offsets):
                    own, test = hashes[offsets[row] : offsets[row + 1]], items.words[item]
                    if len(test) < SEEDED and int(item) in found[lo + row]:
                        continue  # a whole item is the same everywhere, and the first place counts
                    a, b = max(begin, 0), min(begin + len(test), len(own))
                    equal = own[a:b] == test[a - begin : b - begin]
                    start, n = longest(equal)
                    if n >= min(LEAST, SHARE * len(test)):
                        leak = (int(equal[start : start + n].sum()), n, -int(a + start))
                        found[lo + row][int(item)] = max(leak, found[lo + row].get(int(item), leak))
            rows = [[{"item_id": items.ids[i], "start": -s, "n_words": n, "n_equal": e} for i, (e, n, s) in sorted(x.items())] for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in back), pa.array(rows, kind)], [*names, "leaks"])

    return run


def find_leaks(df: DataFrame, tests: DataFrame, text: str = "text", test_id: str = "item_id", test_text: str = "text", held: int = HELD) -> DataFrame:
    """df with leaks: an array of (item_id, start, n_words, n_equal), one for each test item that the row's text holds.

    Words are lower-cased runs of letters and digits, so punctuation, case and white space don't matter. A text holds an item if, aligned word by word, there is a run of at least LEAST words (of a shorter item: of SHARE of its words) of which SHARE are equal; start is the run's first word in the text, counted from 0. Every seed of every position of the whole text is looked up among the seeds of all items, and each place that hits is verified along the alignment, so replaced words are tolerated. Of several places the one with most equal words counts. Items of fewer than SEEDED words are held only word for word. Items without words, null and empty ones say nothing and are ignored; a null or empty text holds none. Repeated rows and items are treated each by itself. A column of df named leaks is replaced; none may begin with two underscores.

    The words of the test items are counted first. Up to held of them go to the workers at once, and documents are neither shuffled nor gathered. More are taken in as many blocks by hash: each has a pass of its own over rows that were written once, after which its broadcast is destroyed, and only the few leaks found are joined to the rows. So what is held is bounded for any set of tests, but for one item, which is held whole.
    """
    df, names = aside(df, MADE)
    text, spark = names.get(text, text), df.sparkSession
    own = tests.select(F.col(test_id).alias("id"), F.col(test_text).alias("text"))
    total = own.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), APART)).cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // held))
    id_kind = tests.schema[test_id].dataType
    leaks = f"array<struct<item_id:{id_kind.simpleString()},start:bigint,n_words:bigint,n_equal:bigint>>"
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(id_kind)), ("start", pa.int64()), ("n_words", pa.int64()), ("n_equal", pa.int64())]))

    def sent(block: int):
        rows = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block).orderBy("id", "text").collect()  # about held words
        return spark.sparkContext.broadcast(Items([r["id"] for r in rows], [r["text"] for r in rows]))

    if n_blocks == 1:
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"leaks {leaks}"])
        return arrow_map(df, _leaks(sent(0), df.columns.index(text), list(range(len(df.columns))), df.columns, kind), schema).drop(*names.values())
    rows = cut(df.withColumn("__row", F.monotonically_increasing_id()))
    found = None
    for block in range(n_blocks):
        items = sent(block)
        part = cut(arrow_map(rows.select("__row", text), _leaks(items, 1, [0], ["__row"], kind), f"__row long, leaks {leaks}").where(F.size("leaks") > 0))
        items.destroy()
        found = part if found is None else found.unionByName(part)
    whole = found.groupBy("__row").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    joined = rows.join(whole, "__row", "left").withColumn("leaks", F.coalesce("leaks", F.array().cast(leaks)))
    return joined.drop("__row", *names.values())
