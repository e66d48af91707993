"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import arrow_map, aside

#: A long text is cut into parts of about this many characters.
PART = 1 << 16
#: Fixed value: the pattern that SAFE is made for. Texts of other patterns are encoded whole.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where that pattern's matches always end: before white space that follows something else, and where letters and digits meet. No alternative goes on from one to the other, and what looks ahead looks at what follows white space, which stays in one part with it.
SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_codecs: dict = {}


class Codec:
    """Encodes and decodes with the ranks in a file of lines `base64 rank` and the pattern that splits text before merging."""

    def __init__(self, ranks: str, pattern: str):
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.cuts = pattern == KNOWN
        self.tiktoken = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.decimal = {i: str(i) for i in table.values()}

    def parts(self, text: str) -> Iterator[str]:
        """text in parts of PART characters or a little more, cut only at SAFE places; whole where the pattern isn't KNOWN."""
        begin = 0
        while self.cuts and len(text) - begin > PART:
            found = SAFE.search(text, begin + PART)
            if not found:
                break
            yield text[begin : found.start()]
            begin = found.start()
        yield text[begin:]

    def encode(self, text: str) -> np.ndarray:
        """The ids, 4 bytes each."""
        return np.concatenate([np.array(self.tiktoken.encode_ordinary(part), np.int32) for part in self.parts(text)])

    def decode(self, ids) -> bytes:
        """The raw bytes: ids may end within a character."""
        return self.tiktoken.decode_bytes(list(ids))


def codec(ranks: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (ranks, pattern) not in _codecs:
        _codecs[ranks, pattern] = Codec(ranks, pattern)
    return _codecs[ranks, pattern]


def _rows(df: DataFrame, text: str, made: dict[str, str], per_text, ranks: str, pattern: str, keep: bool = True) -> DataFrame:
    """df with the columns made, per_text(codec, text) of each row; without text, which then doesn't travel back, unless keep."""
    df, names = aside(df, made)
    text = names.get(text, text)
    back = [c for c in df.columns if keep or c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in back] + [f"{k} {v}" for k, v in made.items()])
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in it:
            column = batch.column(batch.schema.get_field_index(text))
            rows = [per_text(own, x.as_py() or "") for x in column]
            new = [pa.array([r[i] for r in rows], kinds[v]) for i, v in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in back), *new], [*back, *made])

    return arrow_map(df, batches, schema).drop(*names.values())


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """df with ids (array of int) and n_tokens of each whole text, each match of pattern merged by itself, without special tokens; null is empty. Map only. Columns of df with these names are replaced."""
    return _rows(df, text, {"ids": "array<int>", "n_tokens": "long"}, lambda c, x: (ids := c.encode(x), len(ids)), ranks, pattern)


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with decoded (binary), the raw bytes of the ids; null ids are none. Map only. A column of df named decoded is replaced."""
    df, names = aside(df, ("decoded",))
    ids = names.get(ids, ids)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["decoded binary"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in it:
            new = pa.array([own.decode(x.as_py() or []) for x in batch.column(batch.schema.get_field_index(ids))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, "decoded"])

    return arrow_map(df, batches, schema).drop(*names.values())


def _digest(c: Codec, text: str, keep: bool = False) -> tuple:
    """n_tokens, ids_sha256, decoded_sha256 of the text, part by part, and the ids if they are kept."""
    n, kept, ids_hash, bytes_hash, name = 0, [], hashlib.sha256(), hashlib.sha256(), c.decimal.__getitem__
    for part in c.parts(text):
        ids = c.tiktoken.encode_ordinary(part)
        if ids:
            ids_hash.update(((b"," if n else b"") + ",".join(map(name, ids)).encode()))
        bytes_hash.update(c.decode(ids))
        n += len(ids)
        if keep:
            kept.append(np.array(ids, np.int32))
    found = (n, ids_hash.hexdigest(), bytes_hash.hexdigest())
    return (*found, np.concatenate(kept)) if keep else found


def digest(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: bool = False, keep: bool = True) -> DataFrame:
    """df with n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 of each whole text, encoded and decoded again, and with the ids themselves if asked for; null is empty. The text column comes back if keep. Map only. Columns of df with these names are replaced."""
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if ids else {})
    return _rows(df, text, made, lambda c, x: _digest(c, x, ids), ranks, pattern, keep)
