"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

Counting: every task sums the n-grams of its trusted texts, one shuffle adds them up. Lower orders hold continuation counts
(distinct left neighbours), each order has discounts D1, D2, D3+ from its counts of counts. Scoring: the distinct n-grams of
all documents are joined, sharded by n-gram, with the counts of each order from the lowest up, which gives the log-probability
of every n-gram that occurs; that table travels to the documents in shards of bounded size, and each document adds up the
log-probabilities of its own. Thresholds are quantiles, by language, over trusted texts that were held out of the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.batches import values
from weftline.plans.storage import Spill

ORDER = 4
#: N-grams in a shard of the table that travels to the executors (12 bytes each): the bound on a broadcast.
SHARD_GRAMS = 3_000_000
#: Shards that a task holds at once; more need one more pass over the texts, in the same tasks.
PASS_SHARDS = 4
QUANTILE, SLACK = 0.99, 0.05
#: Characters of a language's median that a text's mean is shrunk by, so that very short texts aren't judged on chance.
SHRINK = 60


def codes(text: str) -> np.ndarray:
    """Signed 64-bit codes of the n-grams that end at each character of a whole text: four symbols of 16 bits.

    Digits are one symbol, runs of white space one blank; code points beyond 16 bits share the private area's symbols.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = np.where(points > 0xFFFF, 0xE000 + points % 0x1900, points).astype(np.uint64)
    symbols[(symbols >= 48) & (symbols <= 57)] = 48
    blank = (symbols <= 32) | (symbols == 0xA0)
    symbols[blank] = 32
    if len(symbols) > 1:
        symbols = symbols[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    line = np.concatenate([np.full(ORDER - 1, 2, np.uint64), symbols])
    n = len(symbols)
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = out << np.uint64(16) | line[k : k + n]
    return out.view(np.int64)


def _count(with_counts: bool):
    """(text) -> (g, n) summed over runs of a bounded number of characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(held or [np.empty(0, np.int64)]), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(g), pa.array(n.astype(np.int64))], ["g", "n"])

        for batch in batches:
            for text in values(batch.column(0)):
                if text:
                    held.append(codes(text))
                    size += len(held[-1])
                    if size > 3_000_000:
                        held[:] = [np.concatenate(held)] if with_counts else [np.unique(np.concatenate(held))]
                        yield out()
                        size = 0
        yield out()

    return count


def _mask(level: int) -> Column:
    """The last ``level`` symbols of g."""
    return F.col("g") if level == ORDER else F.col("g").bitwiseAND((1 << 16 * level) - 1)


def _context() -> Column:
    return F.call_function("shiftrightunsigned", "g", F.lit(16))


class KneserNey:
    """counts[level] (g, c), contexts[level] (h, s, gamma) and discounts of each order; tables in the shared folder."""

    def __init__(self, trusted: DataFrame, text_col: str = "text"):
        texts = trusted.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"))
        table = Spill(texts.mapInArrow(_count(True), "g long, n long").groupBy("g").agg(F.sum("n").alias("c")), "grams").df
        self.counts, self.contexts, self.discounts = {}, {}, {}
        for level in range(ORDER, 0, -1):
            if level < ORDER:
                table = self.counts[level + 1].groupBy(_mask(level).alias("g")).agg(F.count("*").alias("c"))
            table = self.counts[level] = table if level == ORDER else Spill(table, f"grams{level}").df
            row = table.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
            n1, n2, n3, n4 = (max(1, row[f"n{k}"]) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            d = [min(k, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            self.discounts[level] = d
            parts = F.sum(self.discount(level))
            self.contexts[level] = table.groupBy(_context().alias("h")).agg(F.sum("c").cast("double").alias("s"), parts.alias("left")).select("h", "s", (F.col("left") / F.col("s")).alias("gamma"))

    def discount(self, level: int) -> Column:
        d = self.discounts[level]
        return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """(g, lp): natural logarithms for distinct n-grams ``g`` of the highest order, seen or not."""
        symbols = max(1, self.counts[1].count()) + 1  # one more for what was never seen
        lower = None
        for level in range(1, ORDER + 1):
            need = grams.select(_mask(level).alias("g")).distinct() if level < ORDER else grams.select("g")
            rows = need.join(self.counts[level], "g", "left").withColumn("h", _context()).join(self.contexts[level], "h", "left")
            own = F.coalesce(F.greatest(F.col("c") - self.discount(level), F.lit(0.0)) / F.col("s"), F.lit(0.0))
            gamma = F.coalesce("gamma", F.lit(1.0))
            if lower is None:
                rows = rows.select("g", (own + gamma / float(symbols)).alias("p"))
            else:
                rows = rows.withColumn("low", _mask(level - 1)).join(lower, "low").select("g", (own + gamma * F.col("q")).alias("p"))
            lower = rows.select(F.col("g").alias("low"), F.col("p").alias("q"))
        return rows.select("g", F.ln("p").cast("float").alias("lp"))


def _pack(shard_grams: int):
    """(g, lp) -> one row for each shard of ``shard_grams`` n-grams at most: both columns as bytes, sorted by g."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            g, lp = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(g)
            held.clear()
            return pa.record_batch([pa.array([x[order].tobytes()], pa.binary()) for x in (g, lp)], ["g", "lp"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, shard_grams - size)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)))
                at, size = at + part.num_rows, size + part.num_rows
                if size == shard_grams:
                    yield shard()
                    size = 0
        if held:
            yield shard()

    return pack


def _add(shards: list[Broadcast], text_at: int, sum_at: int, n_at: int, names: list[str], last: bool):
    """Adds the log-probabilities that some shards know to the sums of each document."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            if known is None:
                known = [(np.frombuffer(g, np.int64), np.frombuffer(lp, np.float32)) for g, lp in (s.value for s in shards)]
            sums, counts = batch.column(sum_at).to_pylist(), batch.column(n_at).to_pylist()
            for k, text in enumerate(values(batch.column(text_at))):
                if not text:
                    continue
                own, times = np.unique(codes(text), return_counts=True)
                for g, lp in known:
                    at = np.minimum(np.searchsorted(g, own), len(g) - 1)
                    ok = g[at] == own
                    sums[k] += float((lp[at] * times)[ok].sum(dtype=np.float64))
                    counts[k] += int(times[ok].sum())
            cols = list(batch.columns)
            cols[sum_at], cols[n_at] = pa.array(sums, pa.float64()), pa.array(counts, pa.int64())
            if last:
                cols[text_at] = pa.array([None if t is None else len(t) for t in values(cols[text_at])], pa.int64())
            yield pa.record_batch(cols, names)

    return add


def score_documents(docs: DataFrame, model: KneserNey, text_col: str = "text", shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """``docs`` with ``text_col`` replaced by its length and the columns log_prob and n_scored (its n-grams) added."""
    spark = docs.sparkSession
    grams = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col)).mapInArrow(_count(False), "g long, n long").select("g").distinct()
    grams = Spill(grams, "asked").df
    table = Spill(model.log_probabilities(grams), "scores").df
    tasks = max(1, math.ceil(table.count() / shard_grams))
    packed = Spill(table.repartition(tasks).mapInArrow(_pack(shard_grams), "g binary, lp binary"), "shards")
    sent = [spark.sparkContext.broadcast((bytes(r.g), bytes(r.lp))) for r in packed.df.toLocalIterator()]
    packed.drop()
    out = docs.withColumns({"log_prob": F.lit(0.0), "n_scored": F.lit(0).cast("long")})
    names = out.columns
    for k in range(0, max(1, len(sent)), PASS_SHARDS):
        last = k + PASS_SHARDS >= len(sent)
        schema = T.StructType([T.StructField(f.name, T.LongType() if last and f.name == text_col else f.dataType) for f in out.schema])
        out = out.mapInArrow(_add(sent[k : k + PASS_SHARDS], names.index(text_col), names.index("log_prob"), names.index("n_scored"), names, last), schema)
    return out


def quality_by_perplexity(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, kept), one row per row of ``docs``.

    ``trusted_ids`` (doc_id, repeats ignored) names the trusted documents: four fifths by crc32 of the id train the model, one
    fifth sets the thresholds. A threshold is the language's ``quantile`` of the cross-entropy (nats a character) times
    1 + ``slack``; a language without held-out trusted text uses that of all. Each text's cross-entropy is shrunk toward the
    language's median by SHRINK characters. Null and empty texts have no perplexity and are not kept. If nothing is trusted,
    thresholds are null and all texts with characters are kept. Null doc_ids keep their rows and are never trusted.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    trusted = trusted_ids.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    # Joined by shuffle at every size: a side that is small enough to broadcast today isn't bounded.
    model = KneserNey(rows.join(trusted.where(~held).hint("merge"), "doc_id", "left_semi"))
    scored = Spill(score_documents(rows, model), "perplexities").df.withColumn("h", -F.col("log_prob") / F.when(F.col("n_scored") > 0, F.col("n_scored")))
    fold = scored.join(trusted.where(held), "doc_id", "left_semi").where("h is not null")
    cut = lambda p: F.percentile_approx("h", p, 10_000)
    by = Spill(fold.where("lang is not null").groupBy("lang").agg(cut(0.5).alias("own_mid"), cut(quantile).alias("own_top")), "thresholds").df
    whole = fold.agg(cut(0.5).alias("mid"), cut(quantile).alias("top")).first()
    # As many languages as there are: Spark broadcasts the table only if its measured size is small.
    scored = scored.join(by, "lang", "left")
    n, mid, limit = F.col("n_scored"), F.coalesce("own_mid", F.lit(whole.mid).cast("double")), F.coalesce("own_top", F.lit(whole.top).cast("double")) * (1 + slack)
    smooth = F.coalesce((F.col("h") * n + mid * SHRINK) / (n + SHRINK), "h")
    kept = F.col("h").isNotNull() & F.coalesce(smooth <= limit, F.lit(True))
    return scored.select("doc_id", "lang", F.coalesce("text", F.lit(0)).cast("long").alias("n_chars"), F.exp("h").alias("perplexity"), F.exp(limit).alias("threshold"), kept.alias("kept"))
