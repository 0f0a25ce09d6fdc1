"""Fill-in-the-middle: a text is cut at two places between its tokens and written as prefix, suffix and middle in another order.

Tokens are runs of the letters A to Z and a to z, and every other code point by itself.  They are never listed: a text becomes one big integer with
a bit for each code point.  bytes.translate turns the text into a string of 0 and 1 (1: a letter), which int() reads; a token starts
wherever a code point or the one before it is no letter, so the starts are one shift, one `and` and one `xor` away; bit_count() is
the number of tokens; and the place of the k-th start is found by halving the integer and counting the ones of one half.
Each of these is linear in the text.

Where to cut and which form to write is drawn from a digest of the seed and doc_id, natively, so it is the same in every run and partitioning.  Only
the text and the draws go to Python, and three numbers come back; the text is put together by Spark.

A null text is an empty one.  Empty texts and those that contain a mark are left plain.  A null doc_id draws like an empty string; repeated rows draw
alike and are all returned.  Texts of any length are read whole.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LETTERS = bytes(b"01"[chr(c).isascii() and chr(c).isalpha()] for c in range(256))


def token_starts(text: str) -> tuple[int, int]:
    """(starts, width): an integer of `width` bits, the first code point's is the highest, with ones where tokens start."""
    width = len(text)
    if not width:
        return 0, 0
    # One byte a code point: what Latin-1 lacks becomes a question mark, which is no letter either.
    letters = int(text.encode("latin-1", "replace").translate(_LETTERS), 2)
    return ((1 << width) - 1) ^ (letters & (letters >> 1)), width


def place_of(bits: int, width: int, k: int) -> int:
    """Where the k-th one (from 0) of `bits` is, counted from the highest of its `width` bits; `width` if there are no more than k."""
    if k >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        low = width // 2
        upper = bits >> low
        ones = upper.bit_count()
        if k < ones:
            bits, width = upper, width - low
        else:
            k, at = k - ones, at + width - low
            bits, width = bits & ((1 << low) - 1), low
    return at


def cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Number of tokens, and the code points before the first and the second cut."""
    bits, width = token_starts(text)
    n = bits.bit_count()
    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, place_of(bits, width, a), place_of(bits, width, b)


def _cut_column(text: Column, first: Column, second: Column) -> Column:
    kind = StructType([StructField(c, LongType()) for c in ("n", "a", "b")])

    def run(texts: pd.Series, firsts: pd.Series, seconds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cuts(*row) for row in zip(texts, firsts.tolist(), seconds.tolist(), strict=True)], columns=["n", "a", "b"], dtype="int64")

    run.__annotations__ = {"texts": pd.Series, "firsts": pd.Series, "seconds": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, kind)(text, first, second)


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, output, prefix_chars, middle_chars): each document as `plain`, `psm` (prefix, suffix, middle) or `spm` (suffix, prefix,
    middle).  plain_percent of all stay plain; of the others spm_percent have the suffix first."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), draw.alias("d"))
    number = lambda k: F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("long")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("t", F.lit(mark))
    plain = (F.col("t") == "") | marked | (number(2) % 100 >= 100 - plain_percent)
    drawn = rows.select("doc_id", "t", number(0).alias("h1"), number(1).alias("h2"), F.when(plain, "plain").when(number(3) % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    placed = drawn.select("doc_id", "t", "form", _cut_column(F.col("t"), F.col("h1"), F.col("h2")).alias("c"))
    a, b = F.col("c.a").cast("int"), F.col("c.b").cast("int")
    prefix, middle, suffix = F.substring("t", F.lit(1), a), F.substring("t", a + 1, b - a), F.substring("t", b + 1, F.length("t"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    written = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("t"))
    moved = F.col("form") != "plain"
    return placed.select("doc_id", F.col("c.n").alias("n"), "form", written.alias("output"), F.when(moved, F.col("c.a")).alias("prefix_chars"), F.when(moved, F.col("c.b") - F.col("c.a")).alias("middle_chars"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from.  No part of it holds a mark, so there are three in the outputs that aren't plain."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(found: DataFrame) -> DataFrame:
    """Digests of the outputs, and of the texts that are restored from them."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
