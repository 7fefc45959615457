"""Similarity of texts, numbers and dates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.paths import bind

#: Letters and their Soundex digits, vowels and H, W, Y as 0.
SOUNDEX_LETTERS, SOUNDEX_DIGITS = "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000"


def soundex(c: Column) -> Column:
    """Four-character Soundex in which every letter, vowels and H and W too, parts equal digits; "" for no letters."""
    word = F.upper(c)
    first = F.substring(word, 1, 1)
    letters = F.concat(first, F.regexp_replace(F.substring(word, 2, 1 << 30), "[^A-Z]", ""))
    codes = F.regexp_replace(F.translate(letters, SOUNDEX_LETTERS, SOUNDEX_DIGITS), r"(.)\1+", "$1")
    tail = F.replace(F.substring(codes, 2, 1 << 30), F.lit("0"), F.lit(""))
    return F.when(word == "", "").otherwise(F.rpad(F.substring(F.concat(first, tail), 1, 4), 4, "0"))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of lower-cased alphanumeric words, each with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / F.when(every > 0, every)).otherwise(0.0)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, 1 for two empty texts."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / F.when(n > 0, n))


def _bytes(c: Column) -> Column:
    """The UTF-8 bytes of a text, as an array of their hexadecimal forms."""
    return F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit(1))


def _places(items: Column, x: Column) -> Column:
    """The places of ``x`` in an array."""
    return F.filter(F.transform(items, lambda y, i: F.when(y == x, i)), lambda i: i.isNotNull())


def _matched(a: Column, b: Column) -> Column:
    """Pairs (i, j, x) of equal items of two arrays: from left to right each item of ``a`` takes the first free equal one of ``b`` that is
    no further away than half the longer array.

    Equal items are matched among themselves. Going to the right, a free one that was passed is out of reach for good, so the one to take
    is the first in reach behind the last one taken.
    """
    reach = F.greatest((F.greatest(F.size(a), F.size(b)) / 2).cast("int") - 1, F.lit(0))

    def of_item(x: Column) -> Column:
        there = _places(b, x)

        def step(s: Column, i: Column) -> Column:
            j = F.get(F.filter(there, lambda j: (j > s["last"]) & (j >= i - reach) & (j <= i + reach)), F.lit(0))
            taken = F.when(j.isNull(), s["pairs"]).otherwise(F.concat(s["pairs"], F.array(F.struct(i.alias("i"), j.alias("j"), x.alias("x")))))
            return F.struct(F.coalesce(j, s["last"]).alias("last"), taken.alias("pairs"))

        start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<i:int,j:int,x:string>>").alias("pairs"))
        return F.aggregate(_places(a, x), start, step, lambda s: s["pairs"])

    return F.flatten(F.transform(F.array_intersect(a, b), of_item))


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity over UTF-8 bytes, for texts of any length; null if either is null, 1 for equal texts."""

    def score(s: Column) -> Column:
        x, y, pairs = s["x"], s["y"], s["pairs"]
        m = F.size(pairs)
        by_first = F.transform(F.array_sort(pairs), lambda p: p["x"])
        by_second = F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(p["j"].alias("j"), p["x"].alias("x")))), lambda p: p["x"])
        moved = F.size(F.filter(F.zip_with(by_first, by_second, lambda p, q: p != q), lambda z: z))
        return F.when(m == 0, 0.0).otherwise((m / F.size(x) + m / F.size(y) + (m - moved / 2) / m) / 3)

    halves = F.struct(_bytes(a).alias("x"), _bytes(b).alias("y"))
    matched = bind(halves, lambda h: F.struct(h["x"].alias("x"), h["y"].alias("y"), _matched(h["x"], h["y"]).alias("pairs")))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(bind(matched, score))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro similarity raised by 0.1 for each of up to four equal leading bytes."""
    x, y = F.hex(F.encode(a, "UTF-8")), F.hex(F.encode(b, "UTF-8"))
    same = F.lit(0)
    for n in range(1, 5):
        same = same + ((F.length(x) >= 2 * n) & (F.length(y) >= 2 * n) & (F.substring(x, 1, 2 * n) == F.substring(y, 1, 2 * n))).cast("int")
    return bind(F.struct(jaro(a, b).alias("s"), same.alias("n")), lambda v: v["s"] + v["n"] * 0.1 * (1 - v["s"]))


def metaphone(c: Column) -> Column:
    """A simplified Metaphone of up to six characters: silent beginnings, digraphs, then one code a letter, inner vowels off."""
    w = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    for old, new in (
        ("^(KN|GN|PN|WR|AE)", None), ("^X", "S"), ("^WH", "W"), ("MB$", "M"), ("SCH", "SK"), ("TIA|TIO", "X"), ("CIA", "X"), ("SIA|SIO", "X"), ("TCH", "CH"),
        ("TH", "0"), ("CH|SH", "X"), ("PH", "F"), ("GH", ""), ("DG(?=[EIY])", "J"), ("C(?=[EIY])", "S"), ("[CQ]", "K"), ("CK", "K"), ("G(?=[EIY])", "J"), ("G", "K"),
        ("D", "T"), ("V", "F"), ("Z", "S"), ("X(?=.)", "X"), ("(?<=[AEIOU])H(?![AEIOU])", ""), ("W(?![AEIOU])", ""), ("Y(?![AEIOU])", ""),
    ):
        w = F.when(w.rlike(old), F.substring(w, 2, 1 << 30)).otherwise(w) if new is None else F.regexp_replace(w, old, new)
    w = F.regexp_replace(w, r"([^C])\1+", "$1")
    w = F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substring(w, 2, 1 << 30), "[AEIOU]", ""))
    return F.substring(w, 1, 6)


def date_proximity(a: Column, b: Column, max_days: float) -> Column:
    """1 at the same time, falling to 0 at ``max_days`` apart; a bound of 0 asks for equality."""
    days = F.abs(F.unix_micros(a) - F.unix_micros(b)) / 86_400_000_000
    return F.when(days == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - days / max_days) if max_days > 0 else F.lit(0.0))


def numeric_proximity(a: Column, b: Column, max_difference: float) -> Column:
    d = F.abs(a - b)
    return F.when(d == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - d / max_difference) if max_difference > 0 else F.lit(0.0))


def weighted(scores: list[tuple[Column, float]]) -> Column:
    """Weighted mean, 0 without weights."""
    total = sum(w for _, w in scores)
    if not total:
        return F.lit(0.0)
    out = F.lit(0.0)
    for c, w in scores:
        out = out + c * w
    return out / total
