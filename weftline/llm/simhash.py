"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Anchors are the words of a covering code: the product of two perfect binary Golay codes
[23, 12] (covering radius 3) on bits 0-22 and 23-45, so 2^24 anchors; the other 18 bits are free. Every fingerprint has one
home anchor (the code word within radius 3 of each block) and is replicated to every anchor within covering radius plus
threshold: per block the distance beyond the radius is its excess, and the excesses add up to the threshold at most. If two
fingerprints differ in at most ``threshold`` bits, the second reaches the home of the first, so comparing homes with all rows
of their anchor finds every link. Only links that join something new leave an anchor (a spanning forest), never all pairs.

An anchor with more than ``HOT_ANCHOR`` rows isn't compared in one task. Its fingerprints go a second, exact way: each is
replicated to the 65 points within one bit; fingerprints at a common point differ in two bits at most, and a point holds at
most 65 distinct fingerprints, so no group can grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import values
from weftline.operators.components import connected_components
from weftline.plans.storage import Spill, shuffle_partitions

SHINGLE_WORDS, SEED, THRESHOLD = 3, 42, 2
#: Rows of an anchor that one task compares with each other; see the module's text for larger ones.
HOT_ANCHOR = 4096
GOLAY_LENGTH, GOLAY_RADIUS = 23, 3
#: Generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code.
GOLAY_POLYNOMIAL = 0b110001110101


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned SimHash of a whole text; null and wordless texts have 0.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a shingle of fewer words is the whole sequence.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line, n, digest = b" ".join(found), max(1, len(found) - words + 1), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounds the memory of very long texts
        part = np.array([digest(line[i:j], seed) for i, j in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator: 0 for code words."""
    x = x.astype(np.uint32).copy()
    for bit in range(GOLAY_LENGTH - 1, 10, -1):
        x ^= np.where(x >> np.uint32(bit) & np.uint32(1), np.uint32(GOLAY_POLYNOMIAL << (bit - 11)), np.uint32(0))
    return x


def golay_errors(threshold: int = THRESHOLD) -> list[tuple[np.ndarray, np.ndarray]]:
    """For excess 0..threshold: error patterns by syndrome, padded, and how many there are.

    Excess 0 has the one pattern of weight <= 3 (the code is perfect), excess e those of weight 3 + e.
    """
    out = []
    for e in range(threshold + 1):
        sizes = range(GOLAY_RADIUS + 1) if e == 0 else [GOLAY_RADIUS + e]
        words = np.array(sorted(sum(1 << b for b in bits) for n in sizes for bits in combinations(range(GOLAY_LENGTH), n)), np.uint32)
        syndrome = _syndromes(words)
        order = np.argsort(syndrome, kind="stable")
        words, syndrome = words[order], syndrome[order]
        count = np.bincount(syndrome, minlength=2048)
        table = np.zeros((2048, count.max()), np.uint32)
        table[syndrome, np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)] = words
        out.append((table, count))
    return out


_TABLES: dict[int, list] = {}


def anchors_of(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint, is home) for every anchor within covering radius plus threshold."""
    tables = _TABLES.setdefault(threshold, None) or _TABLES.__setitem__(threshold, golay_errors(threshold)) or _TABLES[threshold]
    low = (fps & np.uint64(0x7FFFFF)).astype(np.uint32)
    high = (fps >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.uint32)
    s_low, s_high = _syndromes(low), _syndromes(high)
    anchors, index, home = [], [], []
    for e1, (t1, n1) in enumerate(tables):
        for e2, (t2, n2) in enumerate(tables[: threshold + 1 - e1]):
            a, b = t1[s_low] ^ low[:, None], t2[s_high] ^ high[:, None]
            ok = (np.arange(a.shape[1]) < n1[s_low][:, None])[:, :, None] & (np.arange(b.shape[1]) < n2[s_high][:, None])[:, None, :]
            i, j, k = np.nonzero(ok)
            anchors.append(b[i, k].astype(np.int64) << 23 | a[i, j].astype(np.int64))
            index.append(i)
            home.append(np.full(len(i), e1 + e2 == 0))
    return np.concatenate(anchors), np.concatenate(index), np.concatenate(home)


def _replicate(threshold: int):
    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2000):
                part = fps[at : at + 2000]
                anchor, index, home = anchors_of(part, threshold)
                yield pa.record_batch([pa.array(anchor), pa.array(part[index].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    return replicate


def spanning_links(fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """Indexes of links (one end at home) that form a spanning forest of the rows of one anchor."""
    label, src, dst = np.arange(len(fps)), [], []
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= threshold)
        own, first = np.unique(label[near], return_index=True)
        for other, at in zip(own, first, strict=True):
            if other != label[i]:
                src.append(int(i))
                dst.append(int(near[at]))
        if len(own) > 1:
            label[np.isin(label, own)] = label[i]
    return src, dst


def _compare(threshold: int, hot: int):
    """Rows sorted by anchor -> (kind, a, b): kind 0 a link, kind 1 a fingerprint a of a hot anchor."""
    few = 24

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(a), kind, np.int8)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

    def links(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.flatnonzero(np.diff(anchor)) + 1
        start = np.concatenate([[0], bounds])
        length = np.diff(np.concatenate([start, [len(anchor)]]))
        src, dst = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        small = np.repeat(length <= few, length)
        for k in range(1, min(few, int(length.max())) if len(length) else 0):
            ok = (anchor[k:] == anchor[:-k]) & small[k:] & (home[k:] | home[:-k])
            at = np.flatnonzero(ok)
            at = at[np.bitwise_count(fps[at] ^ fps[at + k]) <= threshold]
            src.append(fps[at])
            dst.append(fps[at + k])
        for s, n in zip(start[length > few], length[length > few], strict=True):
            i, j = spanning_links(fps[s : s + n], home[s : s + n], threshold)
            src.append(fps[s : s + n][i])
            dst.append(fps[s : s + n][j])
        pairs = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)], 1), axis=0)
        if len(pairs):
            yield out(0, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)]
        overflowing: int | None = None
        for batch in batches:
            cols = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            if overflowing is not None:  # the hot anchor goes on
                end = int(np.searchsorted(cols[0], overflowing, "right"))
                if end:
                    yield out(1, cols[1][:end], cols[1][:end])
                if end == len(cols[0]):
                    continue
                cols, overflowing = [c[end:] for c in cols], None
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(cols[0])) + 1, [len(cols[0])]])
            large = np.flatnonzero(np.diff(bounds) > hot)
            keep = np.ones(len(cols[0]), bool)
            for g in large:
                keep[bounds[g] : bounds[g + 1]] = False
                yield out(1, cols[1][bounds[g] : bounds[g + 1]], cols[1][bounds[g] : bounds[g + 1]])
            last = int(bounds[-2])
            if len(large) and large[-1] == len(bounds) - 2:
                overflowing, rest = int(cols[0][-1]), [c[:0] for c in cols]
            else:
                rest = [c[last:].copy() for c in cols]
                keep[last:] = False
            yield from links(*(c[keep] for c in cols))
        yield from links(*rest)

    return compare


def fingerprint_links(fps: DataFrame, threshold: int = THRESHOLD, hot: int = HOT_ANCHOR) -> DataFrame:
    """(src, dst): links that span every group of distinct long fingerprints ``fp`` at most ``threshold`` (<= 2) bits apart."""
    if not 0 <= threshold <= 2:
        raise ValueError("threshold must be 0, 1 or 2")
    spark = fps.sparkSession
    rows = fps.select("fp").repartition(shuffle_partitions(spark), "fp").mapInArrow(_replicate(threshold), "anchor long, fp long, home boolean")
    found = Spill(rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(threshold, hot), "kind byte, a long, b long"), "links").df
    links = found.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    over = found.where("kind = 1").select(F.col("a").alias("fp")).distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    if threshold == 2:  # two bits apart: a point one bit from both, which links its members to the least of them
        near = over.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
        more = near.join(near.groupBy("point").agg(F.min("fp").alias("m")), "point").where(F.col("fp") != F.col("m"))
    else:  # one bit apart: one is a flip of the other; none apart are one fingerprint
        near = over.select("fp", F.explode(flips if threshold else F.array().cast("array<long>")).alias("m"))
        more = near.join(over.select(F.col("fp").alias("m")), "m").where(F.col("m") < F.col("fp"))
    return links.union(more.select(F.col("fp").alias("src"), F.col("m").alias("dst")))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t) for t in values(batch.column(1))], np.uint64).view(np.int64)
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(fps)], ["doc_id", "text_hash", "fp"])


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id long, fingerprint string of 16 lowercase hex digits, component_id long, group_id long, text_hash long), one row per
    row of ``docs``. group_id tells groups apart that a doc_id of several texts names alike; text_hash is the text's XXH64.

    Exact copies share a fingerprint and fold into one before any comparison. component_id is the smallest doc_id reachable
    by links of at most ``threshold`` differing bits. Null and wordless texts have the fingerprint zero and link like any
    other; a null doc_id keeps its row and never names a component (null if its group has no doc_id); repeated rows give
    repeated rows; an empty table an empty table; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    table = Spill(rows.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long"), "fingerprints").df
    fps = table.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    parts = connected_components(fingerprint_links(fps, threshold))
    parts = parts.select(F.col("node").alias("fp"), "component")
    least = parts.join(fps, "fp").groupBy("component").agg(F.min("rep").alias("low"))
    linked = parts.join(least, "component").select("fp", "low", "component")
    named = fps.join(linked, "fp", "left").select("fp", F.when(F.col("component").isNotNull(), F.col("low")).otherwise(F.col("rep")).alias("component_id"), F.coalesce("component", "fp").alias("group_id"))
    return table.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_id", "text_hash")
