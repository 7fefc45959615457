"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words, patterns the benchmark's windows. Windows of one length m form a table: the shift table maps a block of B
words to the distance from its last place in any window to the window's end (a block in no window lets the search jump m-B+1
words), the suffix-hash buckets list the windows that end with a block, and a direct comparison of all m words confirms an
occurrence. Tables are compiled by tasks, for blocks of windows of bounded size, and written to the shared folder; documents are
scanned against one block after another inside a narrow pass, with no shuffle, so a hot source or passage costs nothing extra.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import STEP, values
from weftline.plans.storage import Spill

WINDOW = 10
#: Benchmark words in one compiled block (about 100 bytes a word): a task holds the tables of one block at a time.
BLOCK_WORDS = 300_000
#: Blocks that one pass over the documents takes in turn; more need one more pass, in the same tasks.
PASS_BLOCKS = 8
#: Bytes of text that are scanned against all blocks of a pass before the next documents are read.
GROUP_BYTES = 16 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Bytes of words: digits, letters (A-Z become a-z) and everything beyond ASCII; the rest separates.
TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    """The words of a whole text, lower-cased in A-Z only; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


class WuManber:
    """Windows of one length. ``find`` yields (start, items) for each occurrence of a window in a list of words."""

    def __init__(self, windows: dict[tuple, list], length: int):
        self.m = length
        self.b = min(3, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}
        for window, items in windows.items():
            for end in range(self.b, length + 1):
                block = window[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, length), length - end)
            self.buckets.setdefault(window[-self.b :], {})[window] = items

    def find(self, words: list) -> Iterator[tuple[int, list]]:
        m, b, jump, shift, n = self.m, self.b, self.m - self.b + 1, self.shift.get, len(words)
        end = m
        while end <= n:
            block = tuple(words[end - b : end])
            step = shift(block, jump)
            if step:
                end += step
                continue
            found = self.buckets[block].get(tuple(words[end - m : end]))  # direct comparison of all words
            if found:
                yield end - m, found
            end += 1


def compile_block(items: Iterable[tuple], window: int = WINDOW) -> bytes:
    """Pickled tables, one for each window length, of (item_id, words) rows; an item of fewer words is one window of its own."""
    by: dict[int, dict[tuple, dict]] = {}
    for item, words in items:
        m = min(window, len(words))
        for i in range(len(words) - m + 1):
            by.setdefault(m, {}).setdefault(tuple(words[i : i + m]), {})[item] = None  # each item once, in order
    return pickle.dumps([WuManber({w: list(own) for w, own in x.items()}, m) for m, x in sorted(by.items())])


def _compile(window: int, block_words: int):
    """(item, text) -> compiled blocks. A longer item is cut into pieces that overlap by all but one word of a window."""

    def pieces(words: list) -> Iterator[list]:
        for at in range(0, max(1, len(words) - window + 1), block_words):
            yield words[at : at + block_words + window - 1]

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for item, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                for words in pieces(split_words(text)):
                    if held and size + len(words) > block_words:
                        yield pa.record_batch([pa.array([compile_block(held, window)], pa.binary())], ["tables"])
                        held, size = [], 0
                    if words:
                        held.append((item, words))
                        size += len(words)
        if held:
            yield pa.record_batch([pa.array([compile_block(held, window)], pa.binary())], ["tables"])

    return compiled


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Spill:
    """(tables): compiled blocks of ``block_words`` + ``window`` benchmark words at most, written to the shared folder."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    tasks = max(1, math.ceil(chars / 2 / block_words))  # a word and its separator take two characters at least
    return Spill(items.repartition(tasks).mapInArrow(_compile(window, block_words), "tables binary"), "blocks")


def _spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint (start, end)."""
    out: list[list[int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _search(text: str | None, tables: list[WuManber], spans: list, items: list) -> tuple[list | None, list | None]:
    """Word spans (flat) and items of a text: those known before, and what occurs in it of the tables of one block."""
    words, hits, own = split_words(text), [], set()
    for table in tables:
        for start, found in table.find(words):
            if hits and hits[-1][0] <= start <= hits[-1][1] <= start + table.m:
                hits[-1] = (hits[-1][0], start + table.m)
            else:
                hits.append((start, start + table.m))
            own.update(found)
    if not hits:
        return spans, items
    known = list(zip((spans or [])[::2], (spans or [])[1::2], strict=True))
    return [x for s in _spans(hits + known) for x in s], sorted(own.union(items or []), key=lambda x: "" if x is None else x)


def _scan(blocks: list[Broadcast], text_at: int, spans_at: int, items_at: int, schema_names: list[str]):
    """Adds the occurrences of some blocks to the columns of word spans and items."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                held.append(batch.slice(at, STEP))
                size += held[-1].column(text_at).nbytes
                if len(blocks) == 1 or size >= GROUP_BYTES:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for parts in groups(batches):
            found = [list(zip(p.column(spans_at).to_pylist(), p.column(items_at).to_pylist(), strict=True)) for p in parts]
            for block in blocks:
                if tables is None or len(blocks) > 1:
                    tables = None  # the block before goes first
                    tables = pickle.loads(block.value)
                for part, own in zip(parts, found, strict=True):
                    own[:] = [_search(text, tables, *x) for text, x in zip(part.column(text_at).to_pylist(), own, strict=True)]
            for part, own in zip(parts, found, strict=True):
                cols = list(part.columns)
                cols[spans_at], cols[items_at] = pa.array([x for x, _ in own], pa.list_(pa.int64())), pa.array([x for _, x in own], pa.list_(pa.string()))
                yield pa.record_batch(cols, schema_names)

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with two more columns: ``hit_spans`` (flat list start, end, start, end, ... of hit words, disjoint) and
    ``hit_items`` (item ids as strings, sorted). Both are null where nothing occurs.

    Null and empty texts have no words, and so have benchmark items without words. A null item_id is reported as null.
    Columns of ``docs`` with these two names are replaced, all others stay. Texts of any length are read whole; repeated rows stay;
    an empty benchmark hits nothing. Ties don't arise: all items with a window count. Blocks are compiled by tasks and
    broadcast one by one. Memory of a task: the tables of one block, the bytes of PASS_BLOCKS and GROUP_BYTES of text (or 128 documents).
    """
    spark = docs.sparkSession
    docs = docs.drop("hit_spans", "hit_items")
    out = docs.withColumns({"hit_spans": F.lit(None).cast("array<long>"), "hit_items": F.lit(None).cast("array<string>")})
    at = {f: i for i, f in enumerate(out.columns)}
    blocks = benchmark_blocks(benchmark, item_col, window=window, block_words=block_words)
    sent = [spark.sparkContext.broadcast(bytes(r.tables)) for r in blocks.df.toLocalIterator()]
    blocks.drop()
    for k in range(0, len(sent), PASS_BLOCKS):
        out = out.mapInArrow(_scan(sent[k : k + PASS_BLOCKS], at[text_col], at["hit_spans"], at["hit_items"], out.columns), out.schema)
    return out


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RESULT.split(", ")]
    for batch in batches:
        doc, text, spans, items = (batch.column(i) for i in range(4))
        n_words = [len(split_words(t)) for t in values(text)]
        hit = [sum(x[1::2]) - sum(x[::2]) if x else 0 for x in spans.to_pylist()]
        own = [x or [] for x in items.to_pylist()]
        sha = [hashlib.sha256(",".join(x or "" for x in y).encode()).hexdigest() for y in own]
        yield pa.record_batch([doc, pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names)


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of ``docs``; see find_contamination."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return find_contamination(rows, benchmark).mapInArrow(_report, RESULT)


def _cut(text_at: int, spans_at: int):
    def keep(text: str | None, spans: list | None) -> str | None:
        if not text or not spans:
            return text
        data = text.encode("utf-8", "surrogatepass")
        places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(TABLE))]
        out, at = [], 0
        for s, e in zip(spans[::2], spans[1::2], strict=True):
            out.append(data[at : places[s][0]])
            at = places[e - 1][1]
        return (b"".join(out) + data[at:]).decode("utf-8", "surrogatepass")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            cols[text_at] = pa.array([keep(t, s) for t, s in zip(values(cols[text_at]), values(cols[spans_at]), strict=True)], pa.string())
            yield pa.record_batch(cols, batch.schema.names)

    return cut


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_share: float | None = None) -> DataFrame:
    """``docs`` without hit words: passages of the benchmark are cut out of the texts, all else stays as it was.

    With ``max_share``, documents with a larger share of hit words go altogether. Documents without hits pass unchanged.
    """
    found = find_contamination(docs, benchmark, text_col)
    if max_share is not None:
        hit = F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, b: a + b)
        n = F.size(F.regexp_extract_all(F.col(text_col), F.lit("([0-9A-Za-z\\x{80}-\\x{10FFFF}]+)"), F.lit(1)))
        found = found.where(F.col("hit_spans").isNull() | (hit <= F.lit(max_share) * n))
    at = found.columns
    return found.mapInArrow(_cut(at.index(text_col), at.index("hit_spans")), found.schema).drop("hit_spans", "hit_items")
