"""Language identification by rank-order profiles.

A profile lists a language's most frequent character n-grams (1 to 3 characters of lower-cased words, words bounded by a
blank) by rank. A document's own most frequent n-grams are ranked alike; its out-of-place distance to a profile sums the
differences of ranks, with the largest difference for n-grams that a profile lacks. The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.batches import values

UNDETERMINED = "und"
#: N-grams of a profile and of a document that are ranked.
PROFILE, DOCUMENT = 400, 400
#: Distinct n-grams of documents that a task holds before it sums them up.
COUNTED = 1_500_000
#: Most languages that a model may have; more raise an error. It bounds what is sent to the executors.
MAX_LANGUAGES = 2000
RESULT = "lang_pred string, score double"
_LETTERS: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point its lower-case code point if it is a letter or a mark, else 0."""
    global _LETTERS
    if _LETTERS is None:
        import unicodedata

        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] in "LM":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS = table
    return _LETTERS


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of a whole text. A code packs up to three code points, 21 bits each; 0 is the blank."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letter_table()[points]
    letters = letters[(letters > 0) | np.concatenate([[True], letters[:-1] > 0])] if len(letters) else letters
    line = np.concatenate([[0], letters, [0]]).astype(np.int64)
    one = line[line > 0]
    two = line[:-1] << 21 | line[1:]
    two = two[(line[:-1] > 0) | (line[1:] > 0)] | 1 << 63 - 1
    middle = line[1:-1] > 0
    three = (line[:-2] << 42 | line[1:-1] << 21 | line[2:])[middle]
    # 1-grams lie below 2^21; a 2-gram gets bit 62 so that it differs from a 3-gram that begins with a blank.
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent codes, the most frequent first, ties by code."""
    return codes[np.lexsort((codes, -counts))[:n]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n), summed over runs of documents of a bounded number of characters."""
    held: dict[str, list] = {}

    def summed() -> pa.RecordBatch:
        lang, code, count = [], [], []
        for name, parts in held.items():
            c = np.concatenate([x for x, _ in parts])
            n = np.concatenate([x for _, x in parts])
            c, at = np.unique(c, return_inverse=True)
            lang += [name] * len(c)
            code.append(c)
            count.append(np.bincount(at, n).astype(np.int64))
        held.clear()
        empty = [np.empty(0, np.int64)]
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(np.concatenate(code or empty)), pa.array(np.concatenate(count or empty))], ["lang", "gram", "n"])

    size = 0
    for batch in batches:
        for lang, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
            if text:
                held.setdefault(lang, []).append(grams(text))
                size += len(held[lang][-1][0])
                if size > COUNTED:
                    yield summed()
                    size = 0
    yield summed()


def fit_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, np.ndarray]:
    """{language: its ``size`` most frequent n-grams by rank}, from all of ``docs`` that have a language and a text."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    best = counts.withColumn("r", F.row_number().over(by)).where(F.col("r") <= size).select("lang", "gram", "r")
    found = best.limit(MAX_LANGUAGES * size + 1).toArrow().sort_by([("lang", "ascending"), ("r", "ascending")])
    if found.num_rows > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles: dict[str, list] = {}
    for lang, gram in zip(found["lang"].to_pylist(), found["gram"].to_pylist(), strict=True):
        profiles.setdefault(lang, []).append(gram)
    return {k: np.array(v, np.int64) for k, v in profiles.items()}


class Classifier:
    def __init__(self, profiles: dict[str, np.ndarray], document: int = DOCUMENT):
        self.document, self.langs, self.size = document, sorted(profiles), max([1, *(len(v) for v in profiles.values())])
        every = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
        # ranks[gram, language]; an n-gram outside a profile has the largest distance, whatever its rank
        self.every, self.ranks = every, np.full((len(every) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(every, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - distance / largest distance); ("und", 0) without letters (marks alone are none) or without a model.
        Ties: first by name."""
        if not self.langs or not any(map(str.isalpha, text or "")):
            return UNDETERMINED, 0.0
        codes, counts = grams(text or "")
        own = top(codes, counts, self.document)
        at = np.searchsorted(self.every, own)
        at[(at == len(self.every)) | (self.every[np.minimum(at, len(self.every) - 1)] != own)] = len(self.every)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.size))
        total = away.sum(axis=0)
        best = int(np.argmin(total))
        return self.langs[best], 1.0 - float(total[best]) / (self.size * len(own))


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with the columns lang_pred and score (replaced if there). Only the text is read for a prediction.

    Null texts and texts without letters get "und" and 0; repeated rows repeated rows; very long texts are read whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    docs = docs.drop("lang_pred", "score")
    at, names = docs.columns.index(text_col), [*docs.columns, "lang_pred", "score"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(sent.value)
        for batch in batches:
            found = [model.predict(t) for t in values(batch.column(at))]
            yield pa.record_batch([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names)

    schema = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return docs.mapInArrow(predict, schema)


def is_held_out(id_col: str = "doc_id"):
    """crc32 of the id as text modulo 4 is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
