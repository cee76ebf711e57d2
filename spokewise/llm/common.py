"""Small helpers shared by the text operators."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import is_stashed, stash


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file ``name`` lies."""
    return importlib.import_module("public_tokenizers").path(name)


def text_slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of text, and of one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(x) if x is not None else 0 for x in map(_buffer, batch.column(text))], dtype=np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def _buffer(value: pa.Scalar):
    return value.as_buffer() if value.is_valid else None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Stands for a null id inside operators.
NULL_ID = -(2**63)


def ids_of(b) -> np.ndarray:
    return b.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they travel: compressed, which makes shuffles of whole texts a third of their size."""
    pressed = zstandard.ZstdCompressor(level=1)
    for b in text_slices(batches, "text", 8 << 20):
        z = [pressed.compress(x.as_buffer()) if x.is_valid else None for x in b.column("text")]
        keys = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(b.column, keys), pa.array(z, pa.binary())], [*keys, "z"])


_opener = zstandard.ZstdDecompressor()


def unpacked(z: pa.Scalar) -> bytes:
    return _opener.decompress(z.as_buffer()) if z.is_valid else b""


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str = "n") -> DataFrame:
    """``rows`` with the columns of ``groups``, of which each key has one row, at most; ``size`` is the number of
    rows that a key has.

    A key with over one in 1,000 of all these rows, of which there are fewer than 1,000, is met by broadcast, so
    its rows stay where they are; the others are met by a shuffle.
    """
    groups = groups if is_stashed(groups) else stash(groups, "groups")
    least = (groups.agg(F.sum(size)).first()[0] or 0) // 1_000
    hot = F.broadcast(groups.where(F.col(size) > least))
    rest = groups.where(F.col(size) <= least)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(groups.where(F.col(size) > least).select(*keys)), keys, "left_anti").join(rest.hint("merge"), keys))
