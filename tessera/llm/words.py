"""Words of whole texts as columns: ASCII letters lower-cased, cut at all other ASCII characters but digits.

DataFrame functions only.  Characters beyond ASCII belong to words and are never changed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER, _DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
_BORDERS = "".join(c for c in map(chr, range(128)) if c not in _UPPER + _LOWER + _DIGITS)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none.  One translation, then a split at spaces without a pattern."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BORDERS, _LOWER + " " * len(_BORDERS))
    return F.array_remove(F.split(spaced, " "), "")


#: DuckDB's form of ``words`` over a column that is not null.
SQL_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: One row with ``tab``, the 256 remainders that a crc32 looks up, made by their rule.
SQL_CRC32_TABLE = (
    "(SELECT list(r ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), "
    "lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) t(b)))"
)


def sql_crc32(text: str, tab: str = "tab") -> str:
    """DuckDB's form of the unsigned crc32 of a text's UTF-8 bytes, with the list of ``SQL_CRC32_TABLE``."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({digits}), 2), lambda i: ('0x' || substr({digits}, i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, {tab}[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
