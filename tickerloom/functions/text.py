"""Text columns: tickers, markup, ages, keywords, fixed-size slices. Whole texts are read in every case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DESCRIPTION_CHARS = 800  # fixed value: length of a displayed description
CHUNK_CHARS = 50  # fixed value: size of one streamed slice
TAG = r"<[^>]+>"


def clean_ticker(name: Column) -> Column:
    """Upper case without the quote currency, dashes and blanks."""
    return F.regexp_replace(F.upper(name), "USDT|-| ", "")


def strip_html(html: Column) -> Column:
    return F.regexp_replace(html, TAG, "")


def description(html: Column, chars: int = DESCRIPTION_CHARS) -> Column:
    """Opening of the tag-free text, for display; tags are removed from the whole page first."""
    return F.substring(strip_html(html), 1, chars)


def humanize_age(iso: Column, now: Column) -> Column:
    """``Ns/Nm/Nh/Nd ago``; nothing for an empty text, the first ten characters of an unreadable one."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.try_to_timestamp(iso))
    age = F.when(micros >= 0, F.floor(micros / 1_000_000)).otherwise(F.ceil(micros / 1_000_000))

    def unit(seconds: int, mark: str) -> Column:
        return F.concat(F.floor(age / seconds).cast("string"), F.lit(f"{mark} ago"))

    ladder = (
        F.when(age < 60, unit(1, "s"))
        .when(age < 3600, unit(60, "m"))
        .when(age < 86400, unit(3600, "h"))
        .otherwise(unit(86400, "d"))
    )
    return F.when(F.coalesce(iso, F.lit("")) == "", F.lit("")).otherwise(
        F.coalesce(ladder, F.substring(iso, 1, 10))
    )


def keyword_filter(df: DataFrame, column: str, keyword: str, category: Column | None = None) -> DataFrame:
    """Rows whose text contains the keyword in any case, optionally within a category."""
    hit = F.contains(F.lower(column), F.lit(keyword.lower()))
    return df.filter(hit if category is None else hit & category)


def chunk_text(df: DataFrame, column: str, chars: int = CHUNK_CHARS) -> DataFrame:
    """Consecutive slices of a text as rows ``chunk_no, chunk``; one linear pass over each text."""
    pieces = F.regexp_extract_all(F.col(column), F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.posexplode(pieces).alias("chunk_no", "chunk"))


def containment_lookup(query: Column, categories: list[str], default: str) -> Column:
    """First category, in list order, that contains the query or is contained in it; otherwise the default.

    The categories are a fixed list of the caller, so they become constants of the expression and no join is needed.
    """
    asked = F.lower(query)
    found = F.lit(None).cast("string")
    for name in reversed(categories):
        low = F.lit(name.lower())
        found = F.when(F.contains(asked, low) | F.contains(low, asked), F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit(default))
