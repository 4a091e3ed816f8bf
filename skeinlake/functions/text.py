"""Trimming of any white space; SQL ``trim`` removes U+0020 only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode, and the byte order mark.
WHITE_SPACE = "".join(c for c in map(chr, range(0x10000)) if c.isspace()) + "\ufeff"


def strip(text: Column | str) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))
