"""Column expressions that several text operators share."""

from __future__ import annotations

import string
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space. Every other character, also a non-breaking space, belongs to a word.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
# What separates words once A-Z are lower-cased: all ASCII but digits and a-z.
BREAK_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. `lower` says the same of a pure ASCII text, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def utf8_size(text: Column) -> Column:
    """Bytes of the text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("bigint")


def text_key(text: Column) -> Column:
    """128 bits that stand for the text; two texts with one key are taken to be equal."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("2"), text, F.length(text)).alias("b"))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what the operators read, under names that no column of the caller can clash with."""
    return docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
