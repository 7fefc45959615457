"""Packing documents into fixed windows by minimum bin slack.

A document longer than the window is cut into full windows, which need no packing, and one remainder. The remainders of an
input partition wait in a pool of counts by length. For each window a bitset dynamic programme over the pool's multiset finds
which totals can be reached; the total closest to the capacity is taken and the counts of its lengths are traced back. A piece is
cut only where the best total leaves more than a few ids free.
Nothing is shuffled: a task packs what it reads, holds a bounded pool, and gives the same pieces when it is run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import encoder

CAPACITY, SEPARATOR = 4096, 2
#: Slack in a window up to which no further piece is cut to fill it.
CUT = 16
#: Remainders that wait in a task's pool before windows are filled, and that stay to fill later ones.
POOL, LEFT = 2400, 800
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths {length: how many} out of ``counts`` whose total is closest to ``capacity`` without passing it.

    The longest length is always used, so that hard pieces go first. reach[i] is a bitset of the totals that the first i
    entries can make; an entry is a length times a power of two, so counts enter as their binary parts. It stops as soon
    as the capacity itself is reached.
    """
    lengths = sorted(counts, reverse=True)
    first = lengths[0]
    mask, full = (1 << capacity + 1) - 1, 1 << capacity
    reach, entries = [1 << first], []
    for length in lengths:
        left, part = min(counts[length] - (length == first), (capacity - first) // length), 1
        while left > 0:
            take = min(part, left)
            entries.append((length, take))
            reach.append((reach[-1] | reach[-1] << length * take) & mask)
            left -= take
            part *= 2
            if reach[-1] & full:
                break
        if reach[-1] & full:
            break
    total = reach[-1].bit_length() - 1
    used = {first: 1}
    for (length, take), before in zip(reversed(entries), reversed(reach[:-1]), strict=True):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def _pack(encode: Callable[[list], list[bytes]], capacity: int, separator: int, pool_size: int, left_size: int, least: int = CUT):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        pool: dict[int, list[tuple]] = {}
        waiting = 0
        end = np.array([separator], "<u4").tobytes()
        out: list[tuple] = []

        def drain(down_to: int) -> None:
            nonlocal number, waiting
            while waiting > down_to:
                used, at = fill({k: len(v) for k, v in pool.items()}, capacity), 0
                for length, n in used.items():
                    for _ in range(n):
                        doc, start, data, tokens = pool[length].pop()
                        out.append((doc, start, length, zlib.crc32(data), tokens, number, at))
                        at += length
                    if not pool[length]:
                        del pool[length]
                    waiting -= n
                slack = capacity - at
                if slack > least and waiting and (length := max(pool)) > slack:  # no multiset comes near: a piece is cut
                    doc, start, data, tokens = pool[length].pop()
                    if not pool[length]:
                        del pool[length]
                    out.append((doc, start, slack, zlib.crc32(data[: 4 * slack]), tokens, number, at))
                    pool.setdefault(length - slack, []).append((doc, start + slack, data[4 * slack :], tokens))
                number += 1

        def rows() -> pa.RecordBatch:
            names = [x.split()[0] for x in PIECE.split(", ")]
            batch = pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], names)
            out.clear()
            return batch

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                texts = [x or "" for x in batch.column(1).slice(at, 256).to_pylist()]
                for doc, data in zip(ids[at : at + 256], encode(texts), strict=True):
                    data += end
                    tokens = len(data) // 4
                    for start in range(0, tokens, capacity):
                        piece = data[4 * start : 4 * (start + capacity)]
                        length = len(piece) // 4
                        if length == capacity:
                            out.append((doc, start, length, zlib.crc32(piece), tokens, number, 0))
                            number += 1
                        else:
                            pool.setdefault(length, []).append((doc, start, piece, tokens))
                            waiting += 1
                if waiting > pool_size:
                    drain(left_size)
            yield rows()
        drain(0)
        yield rows()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text", pool: int = POOL) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    A document is its ids (tokenizer file ``tokenizer``, no special tokens added) and then ``separator``. Each id lies in
    exactly one piece; pieces of a sequence follow each other from offset 0 without gaps and hold ``capacity`` ids at most.
    sequence_id is unique: the input partition in the upper bits. A null or empty text is one piece of the separator alone.
    Null and repeated doc_ids are packed like any other, an empty table gives an empty table, other columns are ignored.
    Where no multiset comes within CUT ids of a window's capacity, one more piece is cut to fill it, so that windows are full
    but for the last of each input partition.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pack(encoder(tokenizer), capacity, separator, pool, min(LEFT, pool // 3)), PIECE)
