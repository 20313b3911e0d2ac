"""Text and time Column functions (T1-T9, T12). All JVM-side except entity decoding."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Java's plain \w is ASCII-only; this class matches Python's Unicode \w.
WORD = r"[\p{L}\p{N}_]"
MENTION = r"@[\p{L}\p{N}_]+"
LINK = r"https?://\S+|www\.\S+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
# Alternating runs of word and non-word characters: concatenated they give the text back.
RUNS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"

STRICT_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) else v)


def decode_entities(c) -> Column:
    """HTML entity decoding (T1 d); only texts that contain '&' are sent to Python."""
    c = _c(c)
    some = F.when(F.instr(c, "&") > 0, c)  # the function's input: NULL, and so nothing to send, for all other rows
    return F.coalesce(_unescape(some), c)


def clean_text(c, decode: bool = True) -> Column:
    """Mentions -> '@user', links -> 'http', newlines deleted, then HTML entities decoded."""
    c = _c(c)
    out = F.regexp_replace(c, MENTION, "@user")
    out = F.regexp_replace(out, LINK, "http")
    out = F.replace(out, F.lit("\n"), F.lit(""))
    return decode_entities(out) if decode else out


def tokens(c) -> Column:
    """Lower-cased words of at least two word characters, in text order."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN), 0)


def parse_created_at(c, strict: bool = True) -> Column:
    """Strict form needs a fraction and a literal Z (else NULL); lenient takes any ISO text as UTC."""
    c = _c(c)
    if strict:
        return F.try_to_timestamp(c, F.lit(STRICT_TS))
    return F.try_to_timestamp(c)


def fire_timestamp(date_col, time_col) -> Column:
    """T5: HHMM integer zero-padded to 4 (longer input kept whole), joined to the date."""
    t = F.col(time_col).cast("string") if isinstance(time_col, str) else time_col.cast("string")
    padded = F.lpad(t, F.greatest(F.lit(4), F.length(t)), "0")
    hhmm = F.concat(F.substring(padded, 1, 2), F.lit(":"), F.substring(padded, 3, 2))
    return F.try_to_timestamp(F.concat(F.date_format(_c(date_col), "yyyy-MM-dd"), F.lit(" "), hhmm),
                              F.lit("yyyy-MM-dd HH:mm"))


def iso_week(c) -> Column:
    """ISO week number (no year)."""
    return F.weekofyear(_c(c))


def iso_year(c) -> Column:
    """ISO week-numbering year, so that weeks across New Year stay apart."""
    return F.extract(F.lit("YEAROFWEEK"), _c(c))


def percent_label(c) -> Column:
    """T12: '%.1f%%'."""
    return F.format_string("%.1f%%", _c(c))


def strip_prefix(name: str, prefix: str = "p_") -> str:
    """Driver-side rename helper (``p_anger`` -> ``anger``)."""
    return name[len(prefix):] if name.startswith(prefix) else name
