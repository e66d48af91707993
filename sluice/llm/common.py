"""What several operators of this subpackage share: table access, checkpoints, Arrow maps and hashing."""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word splitter: the six ASCII white-space characters.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that are hashed at once, so that the arrays stay in the processor's cache.
SPAN = 1 << 20
#: Bytes of rows that a Python worker gets and works on at once; a longer row is a batch of its own.
BATCH = 4 << 20
#: Bits of the table of sifted for each row that is sought, and the most that it may have: 32 MB.
BITS, MOST = 16, 1 << 28
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _release() -> None:
    """Gives freed memory back to the system: workers live on between stages, and what they keep adds up with the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) with bounded memory: batches come in slices of BATCH bytes, and workers return what they freed.

    Spark's own batches are bounded likewise where the session leaves that setting alone. Python workers find this package where it is installed, or at the driver's place.
    """
    spark = df.sparkSession
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [environment.get("PYTHONPATH")])])
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH))

    def sliced(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = max(1, batch.num_rows // max(1, -(-batch.nbytes // BATCH)))
            for lo in range(0, batch.num_rows, rows):
                yield batch.slice(lo, rows)

    def bounded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(sliced(it))
        finally:
            _release()

    return df.mapInArrow(bounded, schema)


def lighten(spark: SparkSession) -> None:
    """Has executors collect their heaps: what earlier work grew them to goes back to the system. A task for each core, so every executor that is idle gets one; a JVM told to ignore System.gc() keeps its heap.

    Python workers come on top of the heap. So do, in the system's books, the processes by which Hadoop sets each new file's mode on local disks where its native library is missing: until they run their own program, all of the heap counts as theirs too.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set on a local master, as in tests. Checkpoints go there too."""
    context, named = spark.sparkContext._jsc.sc(), spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir().isEmpty():
        if not named and not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="sluice-"))
    return named or context.getCheckpointDir().get()


_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder until drop or scratch deletes it; its lineage ends there."""
    shared_folder(df.sparkSession)
    return _noted(df.checkpoint())


def _noted(df: DataFrame) -> DataFrame:
    if (made := _made.get()) is not None:
        made.append(df)
    return df


def drop(*frames: DataFrame) -> None:
    """Deletes the checkpoints that cut made of frames. Only for what nothing reads any more: what follows from it must be cut or written, so that a lost executor's work starts from there."""
    for df in frames:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at the end, all checkpoints that were made within: by then, what was made of them must be written or settled."""
    made: list[DataFrame] = []
    before = _made.set(made)
    try:
        yield
    finally:
        _made.reset(before)
        drop(*made)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, cut; the checkpoints that it made on the way are deleted."""
    with scratch():
        out = make()
        shared_folder(out.sparkSession)
        out = out.checkpoint()
    return _noted(out)


def sifted(df: DataFrame, these: DataFrame, *keys: str) -> DataFrame:
    """df with __marked: true where the row's keys, nulls too, are among those of these (cut), and in a few other rows. df isn't shuffled.

    The keys of these are hashed to a table of bits, by aggregation, whose rows of 4 KB are broadcast. It grows with the rows of these up to MOST bits: up to a sixteenth of MOST rows it marks a sixteenth of other rows at most, with as many as MOST two thirds. So a join must follow that decides; it is spared the other rows.
    """
    places = min(MOST, max(1 << 16, 1 << (BITS * these.count() - 1).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(places)) + 1  # the functions count from 1
    rows = these.select(place.alias("__place"))
    table = rows.groupBy(F.bitmap_bucket_number("__place").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__bits"))
    own = df.withColumn("__place", place)
    joined = own.join(F.broadcast(cut(table)), F.bitmap_bucket_number("__place") == F.col("__bucket"), "left")
    bit = "shiftright(cast(conv(hex(substring(__bits, cast(bitmap_bit_position(__place) div 8 + 1 as int), 1)), 16, 10) as int), cast(bitmap_bit_position(__place) % 8 as int)) & 1 = 1"
    return joined.select(*df.columns, F.coalesce(F.expr(bit), F.lit(False)).alias("__marked"))


def aside(df: DataFrame, made: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns that are named, in any case, like one of made under reserved names, and these by the old names; df itself where there are none."""
    taken = {m.lower() for m in made}
    names = {c: f"__own_{k}" for k, c in enumerate(df.columns) if c.lower() in taken}
    return (df.toDF(*(names.get(c, c) for c in df.columns)) if names else df), names


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n reproducible 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
# For folding: what isn't an ASCII letter or digit, nor a part of a longer character, separates words.
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Runs of more bytes are hashed one by one with BLAKE2b, shorter ones together, eight bytes a step.
LONG = 1 << 10
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k of eight bytes
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the runs of bytes data[start:end]. Each step of eight bytes is a bijection of the state, so there is no algebra by which long runs collide; two lanes together give 128 bits."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(_FACTORS[lane]))
    going, k = np.flatnonzero(size <= LONG), 0
    while len(going):
        rest = size[going] - k
        block = eights[starts[going] + k] & _FIRST[np.minimum(rest, 8)]
        out[going] = mix((out[going] ^ block) * np.uint64(_FACTORS[1 - lane]))
        going, k = going[rest > 8], k + 8
    for i in np.flatnonzero(size > LONG).tolist():
        whole = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        out[i] = int.from_bytes(whole[8 * lane : 8 * lane + 8], "little")
    return out


def _folded(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    out = _LOWER[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    out[latin] += 32
    return out


def _span(data: np.ndarray, first: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word in data; first: where documents begin."""
    n = len(data)
    space = apart[data]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[0] = edge[n] = True
    before = edge.copy()
    before[1:n] |= space[:-1]
    after = edge
    after[1:n] |= space[1:]
    starts = np.flatnonzero(~space & before[:n])
    ends = np.flatnonzero(~space & after[1:]) + 1
    return digests(data, starts, ends), starts, ends


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row's begin (one offset more than rows); null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, span: int = SPAN, fold: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For consecutive rows lo to hi of a string column: the words' 64-bit hashes and the rows' word offsets (hi - lo + 1 of them).

    Words are runs of bytes other than ASCII white space; with fold, lower-cased runs of letters and digits. Rows are taken together up to span bytes; a longer row is hashed in parts that end at white space, so that no more than a span (or one longer word) is expanded at once.
    """
    data, offsets = text_bytes(column)
    apart = _APART if fold else _SPACE
    if fold:
        data = _folded(data)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + span, "right")) - 1)
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if len(part) <= span:
            hashes, starts, _ = _span(part, at[:-1][np.diff(at) > 0], apart)
            yield lo, hi, hashes, np.searchsorted(starts, at)
        else:
            found, begin = [], 0
            while begin < len(part):
                end = min(len(part), begin + span)
                while end < len(part) and not len(gap := np.flatnonzero(apart[part[begin:end]])):
                    end = min(len(part), end + span)
                if end < len(part):
                    end = begin + int(gap[-1]) + 1
                found.append(_span(part[begin:end], np.zeros(1, np.int64), apart)[0])
                begin = end
            hashes = np.concatenate(found)
            yield lo, hi, hashes, np.array([0, len(hashes)])
        lo = hi


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of k words of each row and the rows' offsets; a row of fewer words, but at least one, has one shingle of them all."""
    counts = np.diff(offsets)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    starts = np.repeat(offsets[:-1] - at[:-1], n) + np.arange(at[-1])
    out = np.zeros(len(starts), np.uint64)
    last = np.repeat(offsets[1:], n)
    for j in range(k):
        there = starts + j < last
        word = hashes[np.minimum(starts + j, max(len(hashes) - 1, 0))] if len(hashes) else hashes
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + np.where(there, word, np.uint64(0)) + np.uint64(j + 1))
    return out, at
