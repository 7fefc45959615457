"""Jaro and Jaro-Winkler similarity of many pairs of texts: Arrow batches, the matched bytes of a text as the bits of a number.

similarity.jaro is the same as a Column, for plans without Python; this is for tables of pairs, where its steps an item cost too much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows whose bytes are compared at once.
ROWS = 10_000
_LOWEST = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def _matrix(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each text, one row a text, zeros behind its end; lengths)."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    own = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lengths = np.diff(ends)
    out = np.zeros((len(texts), width), np.uint8)
    inside = np.arange(width) < lengths[:, None]
    out[inside] = own[ends[0] : ends[-1]]
    return out, lengths


def _short(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matched items, those of them that are out of place) for texts of 1 to 64 bytes."""
    most = int(max(pc.max(pc.binary_length(a)).as_py(), pc.max(pc.binary_length(b)).as_py()))
    width = next(w for w in (8, 16, 32, 64) if w >= most)
    kind = np.dtype(f"<u{width // 8}")
    (x, la), (y, lb) = _matrix(a, width), _matrix(b, width)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used, one, steps = np.zeros(len(x), kind), kind.type(1), []
    for i in range(int(la.max())):
        equal = np.packbits(y == x[:, i : i + 1], axis=1, bitorder="little").view(kind)[:, 0]
        window = _LOWEST[np.minimum(i + reach + 1, lb)] & ~_LOWEST[np.maximum(i - reach, 0)]
        free = np.where(i < la, equal & window.astype(kind) & ~used, 0).astype(kind)
        used |= free & (~free + one)
        steps.append((equal, free != 0))
    moved, rest = np.zeros(len(x), np.int64), used.copy()
    for equal, matched in steps:
        lowest = rest & (~rest + one)
        moved += matched & ((equal & lowest) == 0)
        rest = np.where(matched, rest & ~lowest, rest)
    return np.bitwise_count(used).astype(np.int64), moved


def _long(a: bytes, b: bytes) -> tuple[int, int]:
    """The same for texts of any length, with whole numbers of any length."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    reach, used, first = max(max(len(a), len(b)) // 2 - 1, 0), 0, []
    for i, x in enumerate(a):
        free = places.get(x, 0) & ~used & ((1 << min(i + reach + 1, len(b))) - 1)
        free = free >> max(i - reach, 0) << max(i - reach, 0)
        if free:
            used |= free & -free
            first.append(x)
    second = [x for j, x in enumerate(b) if used >> j & 1]
    return len(first), sum(x != y for x, y in zip(first, second, strict=True))


def scores(a: pa.Array, b: pa.Array, whole: bool = False) -> tuple[pa.Array, pa.Array]:
    """(Jaro, Jaro-Winkler) of pairs of texts over UTF-8 bytes; null if either is null, 1 for equal texts. Every two items out of place are a
    transposition; with ``whole`` an odd one is none (DuckDB's reading), else it is half of one (similarity.jaro)."""
    out, there = np.zeros(len(a)), np.asarray(pc.and_(a.is_valid(), b.is_valid()))
    a, b = a.fill_null(""), b.fill_null("")
    la, lb = (np.asarray(pc.binary_length(x)).astype(np.int64) for x in (a, b))
    equal, m, moved = np.asarray(pc.equal(a, b)), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    asked = there & ~equal & (la > 0) & (lb > 0)
    short = np.flatnonzero(asked & (la <= 64) & (lb <= 64))
    if len(short):
        m[short], moved[short] = _short(a.take(pa.array(short)), b.take(pa.array(short)))
    for i in np.flatnonzero(asked & ((la > 64) | (lb > 64))):
        m[i], moved[i] = _long(a[i].as_py().encode(), b[i].as_py().encode())
    k = np.flatnonzero(m)
    half = moved[k] // 2 if whole else moved[k] / 2
    out[k] = (m[k] / la[k] + m[k] / lb[k] + (m[k] - half) / m[k]) / 3
    out[equal] = 1.0
    (x, _), (y, _) = (_matrix(pc.binary_slice(v.cast(pa.binary()), 0, 4), 4) for v in (a, b))
    run = np.cumprod((x == y) & (np.arange(4) < np.minimum(la, lb)[:, None]), axis=1).sum(axis=1)
    return pa.array(out, mask=~there), pa.array(out + run * 0.1 * (1 - out), mask=~there)


def jaro_scores(pairs: DataFrame, a: str, b: str, whole: bool = False) -> DataFrame:
    """``pairs`` with the columns jaro and jaro_winkler of the texts ``a`` and ``b``; see scores."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("jaro", T.DoubleType()), T.StructField("jaro_winkler", T.DoubleType())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, y = (part.column(part.schema.names.index(c)).cast(pa.string()) for c in (a, b))
                yield pa.RecordBatch.from_arrays([*part.columns, *scores(x, y, whole)], [*part.schema.names, "jaro", "jaro_winkler"])

    return pairs.mapInArrow(of_batches, schema)
