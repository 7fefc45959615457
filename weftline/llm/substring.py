"""Substring near-duplicates by collinear chaining.

1. Seeds: all runs of SHINGLE words, and minimisers of longer runs (LONG), which tell documents that share a passage from those
   that only hold its lines. The key of a seed holds how often it came before in its document, so repetitive texts match place
   by place; later occurrences have the first one's key too. Seeds of a group of documents travel as packed columns, one row
   for each bucket of keys, so the shuffle moves about seven bytes a seed and is sorted in numpy.
2. Each occurrence of a seed links to the document before it and to the first one that has it (by doc_id): two links an
   occurrence, never pairs of occurrences. Keys of very many documents are split by ranges of doc_id (HOT_SHARE, RANGE_DOCS).
3. Matches of a (document, earlier document) pair are chained: best sum of seed weights minus a cost for the words skipped on
   both sides, with a Fenwick tree over places in the earlier document for the best chain so far (n log n). Matches that
   ascend on both sides need no tree: the best one before is the one before.
4. Chains are aligned, over 24-bit hashes of the words: gaps between seeds by a word diff, ends by extension with a drop-off, weak gaps split a chain. Parts of
   MIN_WORDS words or more with an identity of 0.8 or more are passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.batches import STEP, values
from weftline.plans.storage import Spill, record_batches, shuffle_partitions

SHINGLE, MIN_WORDS, IDENTITY = 4, 50, 0.8
#: (words, window) of the long seeds: two texts with the same words + window - 1 words share one. A long seed is enough for a chain.
LONG = ((16, 16), (40, 11))
#: Words of the kinds of seeds.
WORDS = np.array([SHINGLE, *(k for k, _ in LONG)])
#: Seeds of a chain that is aligned: n words with a fifth of them replaced share n - 3 - 4 * n / 5 shingles at least, 7 of 50.
#: Fewer are asked for, as seeds may have other documents before and between.
MIN_SEEDS = 3
#: Rounds in which seeds are matched, each with its share of the keys: bounds the disk that seeds take at a time.
ROUNDS = 2
#: Bytes of text of a shuffle partition and of a bucket of keys (about a seed for every five bytes).
PART_BYTES, BUCKET_BYTES = 64 << 20, 4 << 20
#: Bytes of text whose seeds are packed at once, and those hashed at once.
GROUP_BYTES, HASH_BYTES = 4 << 20, 1 << 20
#: Documents of a range of doc_id. Where there are more, keys that HOT_SHARE of a sample of HOT_SAMPLE documents hold are dealt by
#: key and range. The sample decides only how such keys are dealt; what their ranges link to is found over all documents.
RANGE_DOCS, HOT_SHARE, HOT_SAMPLE = 500_000, 0.01, 20_000
#: Longest piece of a chain that is aligned at once; longer passages are reported in pieces.
MAX_WORDS = 2000
#: Rows of an Arrow batch: packed columns and ranges of words are long; a row of packed matches is some 60 KB.
BATCH_ROWS, MATCH_ROWS = 2000, 100
#: Words beyond a chain's outer seeds that the alignment may take in.
MARGIN = 64
#: A passage of n words has n / 5 other words at most, so n / 5 + 1 runs of equal ones; those of less than SHINGLE words hold
#: three fifths of n at most, so seeds shared with its other document cover a fifth of n: ten words of the shortest passage.
MIN_COVER = MIN_WORDS // 5
#: Bytes of a word's hash in the alignment (two different words in 17 million pass for equal).
CODE = 3
#: Cost of a skipped word on either side, in words of seed weight.
GAP_COST = 0.06
#: Unmatched words in a row that split a chain.
SPLIT = 12
PASSAGE = "doc_id long, text_hash long, start_word long, end_word long, rep_doc_id long, rep_start long, rep_end long, identity double"

_M, _R = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def split_words(text: str | None) -> list[bytes]:
    """Words of a whole text: runs of anything but ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


_BYTE = _mix(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R ** j and R ** -j modulo 2 ** 64 for j < n."""
    ratio = np.ones((2, n), np.uint64)
    ratio[:, 1:] = np.array([[_R], [pow(_R, -1, 1 << 64)]], np.uint64)
    return tuple(np.cumprod(ratio, axis=1))


def _next_cut(data: np.ndarray, offsets: np.ndarray, a: int) -> int:
    """A place after ``a``, about HASH_BYTES on, at which no word is cut."""
    end, b = int(offsets[-1]), a + HASH_BYTES
    if b >= end:
        return end
    blank = np.flatnonzero(_SPACE[data[a:b]])
    best = max(int(offsets[np.searchsorted(offsets, b, "right") - 1]), a + int(blank[-1]) + 1 if len(blank) else a)
    while best <= a:  # a word of more than HASH_BYTES
        blank, stop = np.flatnonzero(_SPACE[data[b : b + HASH_BYTES]]), int(offsets[np.searchsorted(offsets, b, "right")])
        best = min(stop, b + int(blank[0]) if len(blank) else end) if len(blank) or stop <= b + HASH_BYTES else a
        b += HASH_BYTES
    return best


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each text) of the texts data[offsets[i]:offsets[i + 1]].

    A word's hash is a polynomial of its bytes, read off running sums: no word becomes a Python value.
    """
    hashes, starts, a = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], int(offsets[0])
    while a < offsets[-1]:
        b = _next_cut(data, offsets, a)
        space, edge = _SPACE[data[a:b]], np.zeros(b - a + 1, bool)
        edge[[0, -1]] = True
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= space[:-1]
        after[:-1] |= space[1:]
        s, e = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        up, down = _powers(max(b - a, HASH_BYTES))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * up[: b - a], out=sums[1:])
        hashes.append(_mix((sums[e] - sums[s]) * down[s]))
        starts.append(s + a)
        a = b
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, from those of runs of 1, 2, 4, ... words."""

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = min(len(a), len(b))
        return _mix(a[:n] * _M + b[:n])

    out, have, power, width = None, 0, h, 1
    while True:
        if k & width:
            out = power if out is None else join(out, power[have:])
            have += width
        if have == k:
            return out
        power, width = join(power, power[width:]), width * 2


def _minimisers(s: np.ndarray, window: int) -> np.ndarray:
    """Whether a value is the least of any ``window`` values in a row (ties count), of fewer at the ends."""

    def slide(x: np.ndarray, pick, fill) -> np.ndarray:  # over x[i : i + window]
        width = 1
        x = np.concatenate([x, np.full(window - 1, fill, np.uint64)])
        while width < window:
            step = min(width, window - width)
            x = pick(x[:-step], x[step:])
            width += step
        return x

    low = slide(np.concatenate([np.full(window - 1, ~np.uint64(0)), s]), np.minimum, ~np.uint64(0))
    return slide(low[::-1], np.maximum, np.uint64(0))[::-1][window - 1 :] == s


def _numbers(keys: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How often a key came before in its text."""
    both = keys + texts.astype(np.uint64) * np.uint64(_R)
    order = np.argsort(both)
    same = both[order[1:]] == both[order[:-1]]
    again = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(keys) else order
    again = again[np.lexsort((again, both[again]))]
    new = np.concatenate([[True], both[again[1:]] != both[again[:-1]]])[: len(again)]
    out = np.zeros(len(keys), np.uint64)
    out[again] = np.arange(len(again)) - np.maximum.accumulate(np.where(new, np.arange(len(again)), 0))
    return out


def seeds_of(data: np.ndarray, offsets: np.ndarray, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, texts, places) of the seeds of texts, of one share of the keys. A place is 8 * word + 2 * kind + again.

    A seed that came before in its text is there twice, the second time (again) with the key of the first occurrence.
    """
    h, bounds = word_hashes(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    found = []
    for kind, (k, window) in enumerate(((SHINGLE, 1), *LONG)):
        if len(h) < k:
            continue
        keys = _runs(h, k)
        whole = owner[: len(keys)] == owner[k - 1 :]
        if window > 1:
            whole &= _minimisers(np.where(whole, keys, ~np.uint64(0)), window)
        if parts > 1:
            whole &= (keys >> np.uint64(40)) % np.uint64(parts) == part
        at = np.flatnonzero(whole)
        found.append((keys[at], owner[at], (at - bounds[owner[at]]) * 8 + kind * 2))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    keys, texts, places = map(np.concatenate, zip(*found, strict=True))
    before = _numbers(keys, texts)
    more = np.flatnonzero(before)
    keys = np.concatenate([keys + before * np.uint64(_R), keys[more]])
    return keys, np.concatenate([texts, texts[more]]), np.concatenate([places, places[more] + 1])


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, data, offsets) of GROUP_BYTES of text at most, or of one longer text."""
    column = batch.column(1)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    docs = batch.column(0).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(docs):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
        yield docs[at:end], data, offsets[at : end + 1]
        at = end


def _packed(bucket: np.ndarray, cols: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row for each bucket: its values of every column, as planes of bytes (planes of zeros vanish in the shuffle)."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else order
    ends = np.append(at[1:], len(order))[: len(at)]
    out = [pa.array(ordered[at].astype(np.int32))]
    for c in cols:
        c = c[order]
        planes = [c[s:e].view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for s, e in zip(at.tolist(), ends.tolist(), strict=True)]
        out.append(pa.array(planes, pa.binary()))
    return pa.record_batch(out, names)


def _buckets(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket, from rows sorted by bucket."""
    held: list[list[np.ndarray]] = []
    last = None

    def unpack(x, kind: type) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(x.as_buffer(), np.uint8).reshape(size, -1).T.copy().view(kind).ravel()

    for batch in batches:
        for row, bucket in enumerate(batch.column(0).to_pylist()):
            if held and bucket != last:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held.clear()
            last = bucket
            held.append([unpack(batch.column(i + 1)[row], kind) for i, kind in enumerate(kinds)])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mix(keys) >> np.uint64(33)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int32)


SEEDS, MATCHES = ["bucket", "keys", "docs", "places"], ["bucket", "docs", "reps", "places", "rplaces"]
SEED_ROW = "bucket int, keys binary, docs binary, places binary"
#: Matches that are packed at once.
PACK_MATCHES = 500_000


def _ranged(keys: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The keys that hot ones are dealt by in a range of doc_id."""
    return keys + (spans + 1).astype(np.uint64) * _M


def _heads(buckets: int):
    """Rows (key, span, doc, place) of documents before a range as seeds of that range."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, spans, docs, places = (x.to_numpy() for x in batch.columns)
            keys = _ranged(keys.view(np.uint64), spans)
            yield _packed(_bucket(keys, buckets), [keys.astype(np.uint32), docs, places], SEEDS)

    return heads


def _seeds(part: int, parts: int, buckets: int, hot=None):
    """Rows (bucket, keys, docs, places). ``hot``: broadcast (keys, upper bounds of ranges of doc_id)."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, data, offsets in _groups(batch):
                keys, texts, places = seeds_of(data, offsets, part, parts)
                own = docs[texts]
                if hot is not None:
                    known, bounds = hot.value
                    mine = np.flatnonzero(known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys)
                    keys[mine] = _ranged(keys[mine], np.searchsorted(bounds, own[mine]))
                yield _packed(_bucket(keys, buckets), [keys.astype(np.uint32), own, places], SEEDS)

    return seeds


def _by_pair(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The order by (key, doc, place) of keys of 32 bits: a sort of one number, then of those that have it in common."""
    low = int(doc.min())
    if int(doc.max()) - low >> 32:
        return np.lexsort((place, doc, key))
    both = (key.astype(np.uint64) << np.uint64(32)) + (doc - low).astype(np.uint64)
    order = np.argsort(both)
    both = both[order]
    same = both[1:] == both[:-1]
    at = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    again = order[at]
    order[at] = again[np.lexsort((place[again], both[at]))]
    return order


def links(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, rep, place, rplace): each seed with the document before its own that has the key, and with the first one."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    shared = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(key) else order
    key, doc, place = key[shared], doc[shared], place[shared]
    if not len(key):
        return doc, doc, place, place
    order = _by_pair(key, doc, place)
    key, doc, place = key[order], doc[order], place[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = np.concatenate([[True], doc[1:] != doc[:-1]]) | new_key
    holder, at = np.cumsum(new) - 1, np.flatnonzero(new)  # of each seed its (key, document), of that its first seed
    first = np.maximum.accumulate(np.where(new_key, holder, 0))
    keep = new | np.concatenate([[True], place[1:] != place[:-1]])
    before, far = np.flatnonzero(keep & (holder > first)), np.flatnonzero(keep & (holder > first + 1))
    mine = np.concatenate([before, far])
    rep = at[np.concatenate([holder[before] - 1, first[far]])]
    return doc[mine], doc[rep], place[mine], place[rep]


def _link(buckets: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def table() -> pa.RecordBatch:
            doc, rep, place, rplace = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            order = np.argsort(doc)
            doc, rep, place, rplace = (x[order] for x in (doc, rep, place, rplace))
            return _packed(_bucket(doc.view(np.uint64), buckets), [doc, rep, place, rplace], MATCHES)

        for cols in _buckets(batches, [np.uint32, np.int64, np.int64]):
            held.append(links(*cols))
            if sum(len(x[0]) for x in held) > PACK_MATCHES:
                yield table()
        if held:
            yield table()

    return link


def chains(pos: np.ndarray, rpos: np.ndarray, weight: float = SHINGLE, gap: float = GAP_COST) -> list[list[int]]:
    """Disjoint chains of the matches (sorted by pos), best first; a chain strictly ascends on both sides.

    score[i] = weight + max(0, best over j with pos_j < pos_i and rpos_j < rpos_i of score[j] - gap * (skipped words)); the cost
    is linear, so score[j] + gap * (pos_j + rpos_j) is what the Fenwick tree keeps prefix maxima of, by rank of rpos.
    """
    n = len(pos)
    if n == 1:
        return [[0]]
    rank = (np.unique(rpos, return_inverse=True)[1] + 1).tolist()
    pos, rpos = pos.tolist(), rpos.tolist()
    size = max(rank)
    tree, owner = [-1e300] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        end = i
        while end < n and pos[end] == pos[i]:  # equal places don't follow each other
            best, who, r = -1e300, -1, rank[end] - 1
            while r > 0:
                if tree[r] > best:
                    best, who = tree[r], owner[r]
                r &= r - 1
            gain = best - gap * (pos[end] + rpos[end]) if who >= 0 else 0.0
            score[end] = weight + max(0.0, gain)
            back[end] = who if gain > 0 else -1
            end += 1
        for j in range(i, end):
            value, r = score[j] + gap * (pos[j] + rpos[j]), rank[j]
            while r <= size:
                if value > tree[r]:
                    tree[r], owner[r] = value, j
                r += r & -r
        i = end
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda x: (-score[x], x)):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            out.append(path[::-1])
    return out

def _steps(pair: np.ndarray, pos: np.ndarray, rpos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, chain) of the matches of many pairs, which are sorted by pair, pos and rpos: chains as ``chains`` finds them.

    Where all matches of a pair ascend on both sides, a chain is a stretch of neighbours: with linear costs the best match
    before is the last one, and a chain ends where its score is used up. Whole numbers, in fiftieths of a word.
    """
    gap, weight, far = round(GAP_COST * 50), SHINGLE * 50, 1 << 40
    inner = pair[1:] == pair[:-1]
    a, b = np.diff(pos), np.diff(rpos)
    starts = np.flatnonzero(np.concatenate([[True], ~inner]))
    tangled = np.logical_or.reduceat(np.concatenate([[False], inner & ~((a > 0) & (b > 0))]), starts)
    total = np.cumsum(np.concatenate([[-far], np.where(inner, weight - gap * (a + b), -far)]))
    least = np.minimum.accumulate(total)
    score, stretch = total - least, np.cumsum(total == least)
    over = stretch * (int(score.max()) + 1) - score  # a chain ends where no later score of its stretch is higher
    ends = np.minimum.accumulate(over[::-1])[::-1] == over
    fresh = np.concatenate([[True], ends[:-1]])
    size = np.diff(np.append(starts, len(pair)))
    plain = np.flatnonzero(np.repeat(~tangled, size))
    known = np.cumsum(fresh[plain]) - 1 if len(plain) else plain
    order: list[int] = []
    sizes: list[int] = []
    for s, e in zip(starts[tangled].tolist(), (starts + size)[tangled].tolist(), strict=True):
        for c in chains(pos[s:e], rpos[s:e]):
            order += [i + s for i in c]
            sizes.append(len(c))
    more = np.repeat(np.arange(len(sizes)) + (int(known[-1]) + 1 if len(plain) else 0), sizes) if sizes else plain[:0]
    return np.concatenate([plain, np.array(order, np.int64)]), np.concatenate([known, more])


def _pieces(runs: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Runs (pos, rpos, words) of a chain, in pieces of MAX_WORDS words at most and even length."""
    first, last = runs[0][0], runs[-1][0] + runs[-1][2]
    if len(runs) == 1 and last - first <= MAX_WORDS:
        yield runs
        return
    n = max(1, -(-(last - first) // MAX_WORDS))
    for k in range(n):
        lo, hi = first + (last - first) * k // n, first + (last - first) * (k + 1) // n
        own = [(max(p, lo), r + max(p, lo) - p, min(p + size, hi) - max(p, lo)) for p, r, size in runs if p < hi and p + size > lo]
        if own:
            yield own


def _worth(found: list[tuple[int, int, list]]) -> list[tuple[int, int, list]]:
    """Chains (doc, rep, runs) of a document without those that lie inside a run of MIN_WORDS equal words of another one:
    what they could show is shown."""
    if len(found) == 1:
        return found
    out, shown = [], []
    for doc, rep, runs in sorted(found, key=lambda x: (-max(n for *_, n in x[2]), x[1])):
        lo, hi = runs[0][0], runs[-1][0] + runs[-1][2]
        if any(s <= lo and hi <= e for s, e in shown):
            continue
        out.append((doc, rep, runs))
        shown += [(p, p + n) for p, _, n in runs if n >= MIN_WORDS]
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def document_chains(doc: np.ndarray, rep: np.ndarray, place: np.ndarray, rplace: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(doc, rep, runs (pos, rpos, words)) of the chains of MIN_SEEDS seeds or more, or with a long one; all of a document's
    matches are given at once."""
    if not len(doc):
        return
    known = _distinct(doc)
    number = np.searchsorted(known, doc)
    seed = _distinct((number << 40) + (place >> 3) * 4 + ((place >> 1) & 3))
    start, until = seed >> 2 << 2, ((seed >> 2) + WORDS[seed & 3]) << 2
    covered = np.cumsum(np.concatenate([[0], np.maximum(until - np.maximum(start, np.maximum.accumulate(np.concatenate([[0], until[:-1]]))), 0) >> 2]))
    pair = _mix(doc.view(np.uint64)) * np.uint64(_R) + _mix(rep.view(np.uint64))
    order = np.argsort(pair)
    pair = pair[order]
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else order
    size = np.diff(np.append(starts, len(pair)))
    enough = (size >= MIN_SEEDS) | np.logical_or.reduceat((place[order] & 6) > 0, starts) if len(pair) else size > 0
    order = order[np.repeat(enough, size)]
    doc, rep, place, rplace = (x[order] for x in (doc, rep, place, rplace))
    pos, kind, again, rpos = place >> 3, (place >> 1) & 3, place & 1, rplace >> 3
    order = np.lexsort((rpos, again, pos, rep, doc))
    doc, rep, pos, kind, again, rpos = (x[order] for x in (doc, rep, pos, kind, again, rpos))
    if not len(doc):
        return
    pair = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (rep[1:] != rep[:-1])]))
    spot = np.concatenate([[True], (pos[1:] != pos[:-1]) | (pair[1:] != pair[:-1])])
    lead = np.maximum.accumulate(np.where(spot, np.arange(len(spot)), 0))
    keep = np.flatnonzero(again == again[lead])  # an occurrence that is matched as such isn't matched to the first one too
    doc, rep, pos, kind, rpos, pair = (x[keep] for x in (doc, rep, pos, kind, rpos, pair))
    at = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (pos[1:] != pos[:-1]) | (rpos[1:] != rpos[:-1])]))
    kind = np.maximum.reduceat(kind, at)
    doc, rep, pos, rpos, pair = (x[at] for x in (doc, rep, pos, rpos, pair))
    order, chain = _steps(pair, pos, rpos)
    starts = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    size = np.diff(np.append(starts, len(chain)))
    good = np.repeat((size >= MIN_SEEDS) | (np.maximum.reduceat(kind[order], starts) > 0), size)
    order, chain = order[good], chain[good]
    if not len(order):
        return
    p, r, n = pos[order], rpos[order], WORDS[kind[order]]
    new_chain = np.concatenate([[True], chain[1:] != chain[:-1]])
    new = new_chain | np.concatenate([[True], (np.diff(p) != np.diff(r)) | (p[1:] > (p + n)[:-1])])
    at = np.flatnonzero(new)
    words = np.maximum.reduceat(p + n, at) - p[at]
    runs = list(zip(p[at].tolist(), r[at].tolist(), words.tolist(), strict=True))
    first = np.flatnonzero(new_chain[at])
    whose = order[at[first]]
    ends = np.append(first[1:], len(runs))
    # Words near a chain that any earlier document's seeds cover: too few can't be a passage (seeds that reach in count whole).
    base, last = np.searchsorted(known, doc[whose]) << 40, at[ends - 1]
    near, far = p[at[first]] - MARGIN - WORDS.max(), p[last] + words[ends - 1] + MARGIN
    cover = covered[np.searchsorted(seed, base + far * 4)] - covered[np.searchsorted(seed, base + np.maximum(near, 0) * 4)]
    own: list[tuple[int, int, list]] = []
    by_doc = np.argsort(doc[whose], kind="stable")
    for k in by_doc[cover[by_doc] >= MIN_COVER].tolist():
        found = (int(doc[whose[k]]), int(rep[whose[k]]), runs[first[k] : ends[k]])
        if own and own[0][0] != found[0]:
            yield from _worth(own)
            own = []
        own.append(found)
    if own:
        yield from _worth(own)


CHAIN = "doc long, rep long, lo int, hi int, rlo int, rhi int, pos array<int>, rpos array<int>, size array<int>"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches by bucket of documents -> chains, with the ranges of words to align."""
    types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())] * 3
    names = [x.split()[0] for x in CHAIN.split(", ")]
    for cols in _buckets(batches, [np.int64] * 4):
        out = []
        for doc, rep, runs in document_chains(*cols):
            for piece in _pieces(runs):
                (p, q, _), (x, y, k) = piece[0], piece[-1]
                out.append((doc, rep, max(0, p - MARGIN), x + k + MARGIN, max(0, q - MARGIN), y + k + MARGIN, *zip(*piece, strict=True)))
        for at in range(0, len(out), 4096):
            part = zip(*out[at : at + 4096], strict=True)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(part, types, strict=True)], names)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, text, text_hash) -> (own, words): the eight bytes of text_hash, then CODE bytes of hash for each word of a text."""
    for batch in batches:
        at = 0
        for docs, data, offsets in _groups(batch):
            h, bounds = word_hashes(data, offsets)
            raw = h.view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes()
            marks = batch.column(2).slice(at, len(docs)).to_numpy().tobytes()
            words = [marks[8 * i : 8 * i + 8] + raw[s:e] for i, (s, e) in enumerate(zip((bounds[:-1] * CODE).tolist(), (bounds[1:] * CODE).tolist(), strict=True))]
            yield pa.record_batch([pa.array(docs), pa.array(words, pa.binary())], ["own", "words"])
            at += len(docs)


def align(a: list, b: list, pos: list[int], rpos: list[int], size: list[int], min_words: int = MIN_WORDS, identity: float = IDENTITY, split: int = SPLIT) -> list[tuple]:
    """Passages (a_start, a_end, b_start, b_end, identity) of a chain of runs: size[i] words at pos[i] in a and rpos[i] in b."""
    runs: list[tuple[int, int, int]] = []  # (a, b, equal words) in ascending order
    inner: list[tuple[int, int, int]] = []  # the same between the outer seeds, as found

    def add(i: int, j: int, n: int) -> None:
        if runs and i - j == runs[-1][0] - runs[-1][1] and i <= runs[-1][0] + runs[-1][2]:
            runs[-1] = (*runs[-1][:2], max(runs[-1][2], i + n - runs[-1][0]))
        elif not runs or i >= runs[-1][0] + runs[-1][2] and j >= runs[-1][1] + runs[-1][2]:
            runs.append((i, j, n))

    def extend(i: int, j: int, step: int, limit_a: int, limit_b: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Runs of equal words beyond an end on its diagonal, outwards: those that hold up the score (1 for equal, -1 for not), and all
        until it falls."""
        out, score, best, good, words = [], 0, 0, 0, 0
        while (i < limit_a and j < limit_b if step > 0 else i > limit_a and j > limit_b) and score > best - split:
            x, y = (i, j) if step > 0 else (i - 1, j - 1)
            if a[x] == b[y]:
                score += 1
                if out and out[-1][0] + (out[-1][2] if step > 0 else -1) == x:
                    out[-1] = (*out[-1][:2], out[-1][2] + 1) if step > 0 else (x, y, out[-1][2] + 1)
                else:
                    out.append((x, y, 1))
                if score > best:
                    best, good, words = score, len(out), out[-1][2]
            else:
                score -= 1
            i, j = i + step, j + step
        near = out[:good]
        if near:
            x, y, n = near[-1]
            near[-1] = (x, y, words) if step > 0 else (x + n - words, y + n - words, words)
        return near, out

    near_left, left = extend(pos[0], rpos[0], -1, 0, 0)
    i, j = pos[0], rpos[0]
    for p, q, k in zip(pos, rpos, size, strict=True):
        if p > i and q > j:
            x, y = a[i:p], b[j:q]
            if x == y:
                inner.append((i, j, p - i))
            else:
                inner += [(i + m.a, j + m.b, m.size) for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if m.size]
        n = k if a[p : p + k] == b[q : q + k] else 0
        while n < k and p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
            n += 1
        if n:
            inner.append((p, q, n))
        i, j = max(i, p + n), max(j, q + n)
    near_right, right = extend(i, j, 1, len(a), len(b))
    out, part = [], []

    def close() -> None:
        """The longest stretch of runs that is a passage is reported, then what lies left and right of it is searched alike."""
        todo = [(0, len(part))]
        while todo:
            lo, hi = todo.pop()
            if lo >= hi:
                continue
            (p, q, _), (x, y, k), whole = part[lo], part[hi - 1], sum(r[2] for r in part[lo:hi])
            most = max(x + k - p, y + k - q)
            if most < min_words or whole < identity * min_words:
                continue
            if whole >= identity * most:
                out.append((p, x + k, q, y + k, whole / most))
                continue
            n = np.array(part[lo:hi])
            start, end, before = n[:, :2], n[:, :2] + n[:, 2:], np.cumsum(n[:, 2]) - n[:, 2]
            length, equal, first, last = 0, 0, 0, 0
            for i in range(hi - lo):
                if (end[-1] - start[i]).max() <= length:
                    break
                long, same = (end[i:] - start[i]).max(axis=1), (before + n[:, 2])[i:] - before[i]
                ok = np.flatnonzero((long >= min_words) & (same >= identity * long))
                if len(ok) and long[ok[-1]] > length:
                    length, equal, first, last = int(long[ok[-1]]), int(same[ok[-1]]), i, i + int(ok[-1])
            if length:
                out.append((int(start[first][0]), int(end[last][0]), int(start[first][1]), int(end[last][1]), equal / length))
                todo += [(lo + last + 1, hi), (lo, lo + first)]
        part.clear()

    for x, y in ((near_left, near_right), (left, right)):  # scattered equal words beyond an end count only where it takes them
        runs.clear()
        for r in x[::-1] + inner + y:
            add(*r)
        for r in runs:
            if part and max(r[0] - part[-1][0], r[1] - part[-1][1]) - part[-1][2] > split:
                close()
            part.append(r)
        close()
        if out:
            break
    return sorted(out)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of words before each row) of rows of CODE bytes a word."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, CODE)
    return sum(raw[:, i].astype(np.int32) << 8 * i for i in range(CODE)), (offsets - offsets[0]) // CODE


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, number of values before each row) of a column of lists."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _equal(wa: np.ndarray, at_a: np.ndarray, wb: np.ndarray, at_b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the n[i] words from wa[at_a[i]] and from wb[at_b[i]] on are equal."""
    before = np.cumsum(n) - n
    step = np.arange(n.sum())
    same = wa[np.repeat(at_a - before, n) + step] == wb[np.repeat(at_b - before, n) + step]
    return np.diff(np.concatenate([[0], np.cumsum(same)])[np.append(before, n.sum())])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, rep, text_hash, lo, seg, rlo, rseg, pos, rpos, size) -> passages. text_hash comes as its eight bytes."""
    names = [x.split()[0] for x in PASSAGE.split(", ")]
    for batch in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
        out: list[tuple] = []
        (wa, ea), (wb, eb) = _words(batch.column(4)), _words(batch.column(6))
        (pos, runs), (rpos, _), (size, _) = (_lists(batch.column(i)) for i in (7, 8, 9))
        lo, rlo = (batch.column(i).to_numpy() for i in (3, 5))
        one = np.flatnonzero(np.diff(runs) == 1)  # all equal words lie on one diagonal: too few of them are no passage
        p, q, la, lb = pos[runs[one]] - lo[one], rpos[runs[one]] - rlo[one], np.diff(ea)[one], np.diff(eb)[one]
        inside = (p >= 0) & (p < la) & (q >= 0) & (q < lb)
        at = np.minimum(p, q)
        n = np.where(inside, np.minimum(la - p, lb - q) + at, 0)
        keep = np.ones(batch.num_rows, bool)
        keep[one] = _equal(wa, ea[one] + p - at, wb, eb[one] + q - at, n) >= IDENTITY * MIN_WORDS
        docs, reps = (batch.column(i).to_numpy() for i in (0, 1))
        for i in np.flatnonzero(keep).tolist():
            a, b = wa[ea[i] : ea[i + 1]].tolist(), wb[eb[i] : eb[i + 1]].tolist()
            start, rstart, own = int(lo[i]), int(rlo[i]), slice(runs[i], runs[i + 1])
            found = zip((pos[own] - start).tolist(), (rpos[own] - rstart).tolist(), size[own].tolist(), strict=True)
            ok = [(p, q, n) for p, q, n in found if 0 <= p < len(a) and 0 <= q < len(b)]
            if not ok:
                continue
            text_hash = int.from_bytes(batch.column(2)[i].as_py(), "little", signed=True)
            for x, end, y, rend, same in align(a, b, *map(list, zip(*ok, strict=True))):
                out.append((int(docs[i]), text_hash, x + start, end + start, int(reps[i]), y + rstart, rend + rstart, same))
        types = [pa.int64()] * 7 + [pa.float64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, types, strict=True)], names)


def _cleaned(spark: SparkSession, df: DataFrame, name: str) -> Spill:
    """A spilled table whose shuffle files go as soon as it is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return Spill(df, name)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _hot(rows: DataFrame, n: int, range_docs: int):
    """(broadcast (keys, bounds of ranges), rows (key, span, doc, place)) of the keys that very many documents hold; None for few
    documents.

    The keys are those of HOT_SHARE of the sampled documents, so 1 / HOT_SHARE times the seeds of a mean document at most. A range
    that holds a key, but not its first document, is given two documents: the first one of all, and the last one before the
    range. So each occurrence links as it would if the key weren't dealt by ranges.
    """
    if n <= range_docs:
        return None
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in _groups(batch):
                keys, texts, places = seeds_of(data, offsets)
                own = np.unique(np.stack([keys, texts.astype(np.uint64)], 1), axis=0)
                key, k = np.unique(own[:, 0], return_counts=True)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(k.astype(np.int64))], ["key", "n"])

    part = rows.sample(min(1.0, HOT_SAMPLE / n), seed=1).mapInArrow(count, "key long, n long")
    least = max(2, int(HOT_SHARE * min(n, HOT_SAMPLE)))
    top = part.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")
    keys = np.sort(top.toArrow()["key"].to_numpy().view(np.uint64))
    if not len(keys):
        return None
    ranges = -(-n // range_docs)
    bounds = rows.stat.approxQuantile("doc", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))
    sent = spark.sparkContext.broadcast((keys, np.unique(np.array(bounds, np.int64))))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last document of each key and range, with the first place in them."""
        known, limits = sent.value
        for batch in batches:
            for docs, data, offsets in _groups(batch):
                keys, texts, places = seeds_of(data, offsets)
                mine = np.flatnonzero(np.isin(keys, known))
                key, doc, place = keys[mine], docs[texts[mine]], places[mine]
                order = np.lexsort((place, doc, key))
                key, doc, place = key[order], doc[order], place[order]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])[: len(key)])
                key, doc, place = key[new], doc[new], place[new]
                span = np.searchsorted(limits, doc)
                edge = np.concatenate([[True], (key[1:] != key[:-1]) | (span[1:] != span[:-1]), [True]])
                low, high = np.flatnonzero(edge[:-1][: len(key)]), np.flatnonzero(edge[1:][: len(key)])
                yield pa.record_batch([pa.array(x) for x in (key[low].view(np.int64), span[low], doc[low], place[low], doc[high], place[high])], ["key", "span", "doc", "place", "last", "last_place"])

    held = rows.mapInArrow(ends, "key long, span long, doc long, place long, last long, last_place long").groupBy("key", "span")
    held = held.agg(F.min(F.struct("doc", "place")).alias("first"), F.max(F.struct("last", (-F.col("last_place")).alias("back"))).alias("end"))
    ranged = Window.partitionBy("key").orderBy("span")  # as many rows as there are ranges
    held = held.select("key", "span", F.first("first").over(ranged).alias("first"), F.lag("end").over(ranged).alias("end")).where("end is not null")
    before = F.struct(F.col("end.last").alias("doc"), (-F.col("end.back")).alias("place"))
    return sent, _cleaned(spark, held.select("key", "span", F.explode(F.array("first", before)).alias("x")).select("key", "span", "x.*"), "heads")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_docs: int = RANGE_DOCS) -> DataFrame:
    """(doc_id, text_hash, start_word, end_word, rep_doc_id, rep_start, rep_end, identity): passages of MIN_WORDS words or more
    that repeat, up to 20 % of their words, in a document of a smaller doc_id. Word places count from 0, ends are exclusive.

    The first document of a passage has no row for it. Two documents are compared if one is the first holder, or the last one
    before the other, of MIN_SEEDS short seeds or a long one that they share; where documents before and between hold all pieces
    of a passage, it can be missed. A stretch that repeats in several earlier documents is shown with one of them at least. Rows
    with a null doc_id or text neither have nor give passages. Repeats inside a document aren't looked for. Rows that share a
    doc_id are searched together, and text_hash (XXH64 of the text) tells which text a passage is of. Passages of a document may
    overlap if they match several documents; those of more than MAX_WORDS words come in pieces. Very long texts are hashed in
    parts; ties go to the smaller doc_id. Keys of very many documents are dealt by ranges of ``range_docs`` documents, which links
    the same documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(shuffle_partitions(spark), -(-size // PART_BYTES))
    buckets = n * max(1, -(-size // (n * BUCKET_BYTES)))
    hot, heads = _hot(rows, count, range_docs) or (None, None)
    dealt = lambda df: df.repartition(n, "bucket").sortWithinPartitions("bucket")
    with record_batches(spark, BATCH_ROWS):
        rounds = []
        for part in range(ROUNDS):
            seeds = rows.mapInArrow(_seeds(part, ROUNDS, buckets, hot), SEED_ROW)
            if heads is not None:  # those of the other rounds' keys only link to each other, as they do there
                seeds = seeds.unionByName(heads.df.mapInArrow(_heads(buckets), SEED_ROW))
            rounds.append(_cleaned(spark, dealt(seeds).mapInArrow(_link(buckets), "bucket int, docs binary, reps binary, places binary, rplaces binary"), "matches"))
    matches = reduce(DataFrame.union, [x.df for x in rounds])
    with record_batches(spark, MATCH_ROWS):
        chained = _cleaned(spark, dealt(matches).mapInArrow(_chain, CHAIN), "chains").df
    for x in [*rounds, *([heads] if heads is not None else [])]:
        x.drop()
    # Both joins move three bytes a word, no texts, and read one exchange, so words holds the text's hash too; ranges of words are cut in the JVM.
    codes = rows.select(F.col("doc").alias("own"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_codes, "own long, words binary")
    cut = lambda words, lo, hi: F.substring(words, F.col(lo) * CODE + 9, (F.col(hi) - F.col(lo)) * CODE)
    plan = ["doc", "rep", "lo", "hi", "rlo", "pos", "rpos", "size"]
    others = chained.join(codes, F.col("rep") == F.col("own")).select(*plan, cut(F.col("words"), "rlo", "rhi").alias("rseg"))
    both = others.join(codes, F.col("doc") == F.col("own")).select("doc", "rep", F.substring("words", 1, 8).alias("text_hash"), "lo", cut(F.col("words"), "lo", "hi").alias("seg"), "rlo", "rseg", "pos", "rpos", "size")
    with record_batches(spark, BATCH_ROWS):
        return _cleaned(spark, both.mapInArrow(_align, PASSAGE), "passages").df


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (start, end); what stands between other words stays."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(data)]
    out, at = [], 0
    for s, e in sorted(spans):
        s, e = places[s][0], places[min(e, len(places)) - 1][1]
        if e <= at:
            continue
        out.append(data[at : max(at, s)])
        at = e
    return (b"".join(out) + data[at:]).decode("utf-8", "surrogatepass").strip()


def _fresh(taken: list[str], name: str) -> str:
    """A column name that is not taken."""
    while name in taken:
        name += "_"
    return name


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of all but their first documents; documents that nothing is left of go.

    Documents without such passages come through unchanged, whatever else they hold (null ids and texts too).
    """
    found = repeated_passages(docs, id_col, text_col)
    doc, mark, own = (_fresh(docs.columns, n) for n in ("_doc", "_hash", "_spans"))
    spans = found.groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(mark)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(own))
    on = (F.col(id_col).cast("long") == F.col(doc)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(mark))
    joined = docs.join(spans, on, "left").drop(doc, mark)
    at, spans_at = joined.columns.index(text_col), joined.columns.index(own)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_words(t, [(x["start_word"], x["end_word"]) for x in s]) if s else t for t, s in zip(values(batch.column(at)), values(batch.column(spans_at)), strict=True)]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            keep = pa.array([not s or bool(t) for t, s in zip(texts, batch.column(spans_at).to_pylist(), strict=True)])
            yield pa.record_batch(cols, batch.schema.names).filter(keep)

    return joined.mapInArrow(cut, joined.schema).drop(own)
