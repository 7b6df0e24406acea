"""Column expressions on text and document metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that count as whitespace besides the ASCII ones
# (tab, line feed, vertical tab, form feed, carriage return, space).
OTHER_WHITESPACE = (
    "\u0020\u2009\u200a\u202f\u2005\u3000\u2002\u00a0\u2008\u2003\ufffc\u0084"
)
ASCII_WHITESPACE = "\t\n\x0b\x0c\r "

# Control characters, code points 0-31 and 127-159.
CONTROL_CLASS = r"[\x00-\x1f\x7f-\x{9f}]"

# What is stripped at both ends of a text (Unicode whitespace).
STRIP_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Punctuation marks and their ASCII form.
PUNCTUATION = {
    "，": ",",
    "。": ".",
    "、": ",",
    "„": '"',
    "”": '"',
    "“": '"',
    "«": '"',
    "»": '"',
    "１": '"',
    "」": '"',
    "「": '"',
    "《": '"',
    "》": '"',
    "´": "'",
    "∶": ":",
    "：": ":",
    "？": "?",
    "！": "!",
    "（": "(",
    "）": ")",
    "；": ";",
    "–": "-",
    "—": " - ",
    "．": ". ",
    "～": "~",
    "’": "'",
    "…": "...",
    "━": "-",
    "〈": "<",
    "〉": ">",
    "【": "[",
    "】": "]",
    "％": "%",
    "►": "-",
}


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_control(text: Column | str) -> Column:
    """Delete control characters. Line breaks are among them, so words may fuse."""
    return F.regexp_replace(_column(text), CONTROL_CLASS, "")


def strip_ends(text: Column | str) -> Column:
    """Remove whitespace at both ends."""
    return F.regexp_replace(_column(text), f"^{STRIP_CLASS}+|{STRIP_CLASS}+$", "")


def uniform_whitespace(text: Column | str) -> Column:
    """Turn every kind of whitespace into a plain space."""
    kinds = OTHER_WHITESPACE + ASCII_WHITESPACE
    return F.translate(_column(text), kinds, " " * len(kinds))


def zero_digits(text: Column | str) -> Column:
    """Replace every decimal digit of any script by 0."""
    return F.regexp_replace(_column(text), r"\p{Nd}", "0")


def ascii_punctuation(text: Column | str) -> Column:
    """Replace the listed punctuation marks by their ASCII form."""
    single = {mark: to for mark, to in PUNCTUATION.items() if len(to) == 1}
    result = F.translate(_column(text), "".join(single), "".join(single.values()))
    for mark, to in PUNCTUATION.items():
        if len(to) > 1:
            result = F.replace(result, F.lit(mark), F.lit(to))
    return result


def normalized(
    text: Column | str,
    control: bool = True,
    strip: bool = True,
    lower: bool = False,
    whitespace: bool = True,
    digits: bool = True,
    punctuation: bool = True,
) -> Column:
    """The normalisation chain used before scoring, each step switchable.

    An empty text stays empty through every later step, so no early exit is
    needed.
    """
    result = _column(text)
    if control:
        result = strip_control(result)
    if strip:
        result = strip_ends(result)
    if lower:
        result = F.lower(result)
    if whitespace:
        result = uniform_whitespace(result)
    if digits:
        result = zero_digits(result)
    if punctuation:
        result = ascii_punctuation(result)
    return result


def normalize(df: DataFrame, text: str = "text", **switches: bool) -> DataFrame:
    """Replace the text column by its normalised form."""
    return df.withColumn(text, normalized(text, **switches))


def with_text_length(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("text_length", F.length(text).cast("bigint"))


def with_bytes_len(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("bytes_len", F.octet_length(text).cast("bigint"))


def with_url(df: DataFrame, kind: str, meta: str = "meta") -> DataFrame:
    """URL out of the metadata. Only crawls kept in archive records have one."""
    if kind != "oscar":
        return df.withColumn("url", F.lit(None).cast("string"))
    if df.schema[meta].dataType.typeName() == "string":
        url = F.get_json_object(meta, "$.warc_headers['warc-target-uri']")
    else:
        url = F.col(meta)["warc_headers"]["warc-target-uri"]
    return df.withColumn("url", url)


def domain_of(url: Column | str) -> Column:
    """Third part of the URL split at slashes: host with port, or null."""
    return F.get(F.split(_column(url), "/", -1), 2)


def with_domain(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("domain", domain_of(url))


def with_meta_perplexity(df: DataFrame, meta: str = "meta", as_int: bool = False) -> DataFrame:
    """Stored perplexity out of a struct, a JSON text or a printed dictionary."""
    if df.schema[meta].dataType.typeName() == "string":
        found = F.regexp_extract(meta, r"""["']perplexity_score["']\s*:\s*([-+0-9.eE]+)""", 1)
        score = found.try_cast("double")
    else:
        score = F.col(meta)["perplexity_score"].cast("double")
    return df.withColumn("perplexity", score.cast("bigint") if as_int else score)


def clipped(value: Column | str, cut: float, to: float | None = None) -> Column:
    """Values from ``cut`` upward become ``to`` (``cut`` itself by default)."""
    column = _column(value)
    return F.when(column < cut, column).otherwise(F.lit(cut if to is None else to))


def remap_range(
    value: Column | str, old_low: float, old_high: float, new_low: float, new_high: float
) -> Column:
    """Map one interval linearly onto another."""
    share = (_column(value) - F.lit(old_low)) / F.lit(old_high - old_low)
    return share * F.lit(new_high - new_low) + F.lit(new_low)


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def tag_source(df: DataFrame, name: str, column: str = "dataset") -> DataFrame:
    return df.withColumn(column, F.lit(name))


def token_count(text: Column | str, pattern: str = r"\S+") -> Column:
    """Number of tokens by a regular expression."""
    return F.regexp_count(_column(text), F.lit(pattern)).cast("bigint")


def token_counts(df: DataFrame, pattern: str = r"\S+", text: str = "text") -> DataFrame:
    return df.withColumn("tokens", token_count(text, pattern))
