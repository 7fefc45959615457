"""Normalizers of match values, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that a person's name loses, in this order.
SUFFIXES = (" jr.", " jr", " sr.", " sr", " iii", " ii", " iv", " phd", " md", " dds")


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def person_name(c: Column) -> Column:
    """Lower case, suffixes off one after another, letters and digits only, single blanks."""
    c = F.lower(c)
    for s in SUFFIXES:
        c = F.regexp_replace(c, s.replace(".", r"\.") + "$", "")
    c = F.regexp_replace(c, r"[^\p{L}\p{Nd}\s]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{Nd}]", "")


def ssn(c: Column) -> Column:
    """The nine digits, else the text as it was."""
    return F.when(F.length(digits(c)) == 9, digits(c)).otherwise(c)


def zip_code(c: Column) -> Column:
    """The first five digits, as far as there are that many."""
    return F.left(digits(c), F.lit(5))


#: Street words and their short forms, applied in this order.
STREET_WORDS = (("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("lane", "ln"), ("road", "rd"), ("court", "ct"), ("apartment", "apt"), ("suite", "ste"), ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"))


def address(c: Column) -> Column:
    c = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[.,#]", ""), r"\s+", " "))
    for long, short in STREET_WORDS:
        c = F.regexp_replace(c, rf"\b{long}\b", short)
    return c


REGISTRY: dict[str, Callable[[Column], Column]] = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "trim": trim_space,
    "nphone": digits,
    "digits_only": digits,
    "nemail": lambda c: F.lower(trim_space(c)),
    "remove_whitespace": lambda c: F.regexp_replace(c, r"(?U)\s", ""),
    "remove_punctuation": lambda c: F.regexp_replace(c, r"\p{P}", ""),
    "alphanumeric": lambda c: F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""),
    "nname": person_name,
    "ssn": ssn,
    "zip": zip_code,
    "address": address,
}


def register(name: str, f: Callable[[Column], Column]) -> None:
    REGISTRY[name] = f


def normalize(c: Column, name: str | None) -> Column:
    """By one name or a chain "a|b"; an unknown name changes nothing."""
    for part in (name or "").split("|"):
        c = REGISTRY.get(part, lambda x: x)(c)
    return c
