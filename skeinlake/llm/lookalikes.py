"""Texts that look the same but consist of different characters, brought to one form.

``unify`` maps look-alikes in SQL: full-width forms to ordinary ones, fixed-width and
non-breaking spaces to a space, Cyrillic and Greek letters to the Latin letters they look like,
invisible characters to nothing. The mapped values are grouped under the accent- and
case-sensitive Unicode collation, under which a letter with a combining mark equals the composed
letter; the smallest id of each class is its canonical member and is joined back. Grouping and
joining go by hashes of texts and forms; the texts themselves are compared only inside classes.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlake.plans.staging import Workspace

#: Cyrillic and Greek letters drawn like Latin ones, each followed by the Latin letter.
LATIN_LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K",
    "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ү": "Y", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    # Cyrillic small letters
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p",
    "с": "c", "у": "y", "х": "x", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ү": "y", "ѵ": "v",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "α": "a", "ι": "i", "ρ": "p",
}

#: Full-width signs outside the block that mirrors ASCII.
WIDE_SIGNS = {"￠": "¢", "￡": "£", "￢": "¬", "￣": "¯", "￤": "¦", "￥": "¥", "￦": "₩"}

#: Spaces of other widths or without a break, and characters that draw nothing.
SPACES = [0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
INVISIBLE = [0x00AD, 0x034F, 0x061C, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]


def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """Characters replaced by at most one character, and those replaced by several."""
    one = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | WIDE_SIGNS | LATIN_LOOKALIKES
    one |= {chr(c): " " for c in SPACES} | {chr(c): "" for c in INVISIBLE}
    several = {}
    for c in map(chr, [*range(0x0370, 0x0530), *range(0x1F00, 0x2000)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base in LATIN_LOOKALIKES:
            form = unicodedata.normalize("NFC", LATIN_LOOKALIKES[base] + "".join(marks))
            (one if len(form) == 1 else several)[c] = form
    return one, several


ONE, SEVERAL = _tables()
#: Finds texts that may hold one of ``SEVERAL``; the block of polytonic Greek counts as a whole.
_MAY_SPELL = "[\u1f00-\u1fff" + "".join(c for c in SEVERAL if not "\u1f00" <= c <= "\u1fff") + "]"


def unify(text: Column) -> Column:
    """``text`` with look-alikes mapped; composed and decomposed letters are left as they are."""
    order = sorted(ONE, key=lambda c: not ONE[c])  # what translates to nothing comes last
    mapped = F.translate(text, "".join(order), "".join(ONE[c] for c in order))
    rare = F.create_map(*[F.lit(x) for kv in SEVERAL.items() for x in kv])
    spelled = F.array_join(F.transform(F.split(mapped, ""), lambda c: F.coalesce(F.try_element_at(rare, c), c)), "")
    return F.when(_ascii(text), text).when(text.rlike(_MAY_SPELL), spelled).otherwise(mapped)


def _ascii(text: Column) -> Column:
    """Whether a text has one byte a character; such texts are their own form."""
    return F.octet_length(text) == F.char_length(text)


_PYTHON = {ord(k): v for k, v in (ONE | SEVERAL).items()}


def unified(text: str) -> str:
    """The one form of a text: look-alikes mapped, letters composed."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(_PYTHON))


def unified_character(c: str) -> str:
    """What a character is mapped to before letters are composed."""
    return c.translate(_PYTHON)


def _composable() -> str:
    """A pattern that finds whatever composing letters could change: marks, parts of Hangul syllables and characters with another standard form."""
    single, ranges = [c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)], []
    for c in single:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[\\p{M}\u1161-\u1175\u11a8-\u11c2" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "\\x{2f800}-\\x{2fa1d}\\x{1d15e}-\\x{1d1c0}\\x{11000}-\\x{11fff}]"


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")


def _keys(documents: DataFrame, key: str, text: str, work: Workspace) -> DataFrame:
    """id, own, looks of each row: a 128-bit key of its text and a hash of its composed form.

    Texts are read once here and, for the few classes with several spellings, once again; what
    is shuffled are keys. Only forms that composing can change are sent to Python.
    """
    own = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("own"), F.col("text")).alias("b"))
    formed = _texts(documents, key, text).select("id", own.alias("own"), unify(F.col("text")).alias("form"))
    changes = ~_ascii(F.col("form")) & F.col("form").rlike(_composable())
    split = formed.select("id", "own", F.when(changes, F.col("form")).alias("form"), F.when(~changes, F.xxhash64("form")).alias("plain"))
    looks = F.coalesce("plain", F.xxhash64(_composed("form")))
    return work.save(split.select("id", "own", looks.alias("looks")), "keys")


def _spellings(documents: DataFrame, key: str, text: str, keys: DataFrame, work: Workspace) -> DataFrame:
    """own, variant, canonical of the texts whose class has several spellings.

    ``variant`` is the smallest id that has the text, ``canonical`` the smallest of the class.
    Forms with the same hash are candidates; these are grouped under the collation. The collation
    also equates a few characters that are drawn differently, such as digits of other scripts;
    comparing the composed forms inside a class parts them.
    """
    variants = work.save(keys.groupBy("looks", "own").agg(F.min("id").alias("variant")), "variants")
    several = variants.groupBy("looks").count().where("count > 1").select("looks")
    candidates = work.save(variants.join(several, "looks").select("own", "variant"), "candidates")
    # The text of one row of each spelling; an id with several texts has them all.
    texts = _texts(documents, key, text).join(candidates.select(F.col("variant").alias("id")).distinct(), "id", "left_semi")
    whole = texts.select(F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("own"), F.col("text")).alias("b")).alias("own"), unify(F.col("text")).alias("form")).distinct()
    inside = work.save(candidates.join(whole, "own"), "inside").withColumn("looks", F.collate("form", "UNICODE"))
    classes = inside.groupBy("looks").agg(F.min("variant").alias("class"))
    inside = inside.join(classes, "looks").select("own", "variant", "class", _composed("form").alias("composed"))
    parts = inside.groupBy("class", "composed").agg(F.min("variant").alias("canonical"), F.count("*").alias("spellings"))
    split = inside.join(parts.where("spellings > 1"), ["class", "composed"])
    return work.save(split.select("own", "variant", "canonical"), "spellings")


def canonical_members(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, canonical_id: for each row with a text, the smallest id among texts that look the same.

    Rows without id or text are left out; empty texts look the same; rows with one id count for
    each of their texts.
    """
    work = Workspace(documents.sparkSession, "lookalikes")
    keys = _keys(documents, key, text, work)
    spellings = _spellings(documents, key, text, keys, work)
    rows = keys.select("id", "own").distinct()
    first = rows.groupBy("own").agg(F.min("id").alias("first"))
    same = rows.join(first, "own").join(spellings.select("own", "canonical"), "own", "left")
    return same.select(F.col("id").alias(key), F.coalesce("canonical", "first").alias("canonical_id"))


def lookalike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """{key}_a, {key}_b (a smaller): rows whose texts differ in characters but look the same.

    Rows with one spelling are never paired with each other; rows without id or text are left out.
    """
    work = Workspace(documents.sparkSession, "lookalikes")
    keys = _keys(documents, key, text, work)
    held = keys.select("id", "own").join(_spellings(documents, key, text, keys, work), "own").select("id", "variant", "canonical").distinct()
    left = held.select("canonical", F.col("id").alias("x"), F.col("variant").alias("xv"))
    right = held.select("canonical", F.col("id").alias("y"), F.col("variant").alias("yv"))
    pairs = left.join(right, "canonical").where((F.col("xv") < F.col("yv")) & (F.col("x") != F.col("y")))
    return pairs.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()
