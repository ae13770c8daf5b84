"""Numbers and codes as display text. Values are rounded to the shown places before formatting, so that the result
does not depend on how a formatter treats halves. ``fixed`` rounds the number itself, not its shortest decimal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tiers of abbreviated amounts, bands of the sentiment index, words for directions.
MONEY_TIERS = [(1e12, "T"), (1e9, "B"), (1e6, "M")]
SENTIMENT_BANDS = [(20, "Extreme Fear"), (40, "Fear"), (60, "Neutral"), (80, "Greed")]
TOP_BAND = "Extreme Greed"
SIGNAL_WORDS = {"UP": "BUY", "DOWN": "SELL", "NEUTRAL": "HOLD"}
HOT_VOTES = 2


def nearest(value: Column, places: int) -> Column:
    """The multiple of ``10 ** -places`` (6 at most) nearest to the double itself, a tie going to the even one.

    ``round`` starts from the shortest decimal form, which may be a tie that the double lies below: 2.275 is
    2.27499999999999991. Here the fraction is cut into pieces of 26 bits, whose products with the scale are exact.
    """
    scale, size = F.lit(10.0**places), F.abs(value)
    whole = F.floor(size).cast("double")
    part = size - whole
    high = F.floor(part * 2.0**26) / F.lit(2.0**26)
    middle = F.floor((part - high) * 2.0**52) / F.lit(2.0**52)
    low = part - high - middle
    steps = F.floor(high * scale).cast("double")
    beyond = (high * scale - steps) + middle * scale  # exact; from the step below, without the lowest bits
    more = F.floor(beyond)
    steps, over = steps + more, (beyond - more - 0.5) + low * scale
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(steps % 2)
    sized = (whole * scale + steps + up) / scale
    # numbers too large for exact steps, and those that are none, are left to round
    return F.when(size * scale < 2.0**53, F.signum(value) * sized).otherwise(F.round(value, places))


def fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", nearest(value, places))


def grouped(value: Column, places: int) -> Column:
    """Fixed places with thousands separators."""
    return F.format_number(F.round(value, places), places)


def abbrev_money(value: Column, tiers: tuple[str, ...] = ("T", "B", "M")) -> Column:
    """``$x.xxT`` and so on down the requested tiers, plain with separators below them."""
    text = F.concat(F.lit("$"), grouped(value, 0))
    for unit, mark in reversed([t for t in MONEY_TIERS if t[1] in tiers]):
        text = F.when(value >= unit, F.concat(F.lit("$"), fixed(value / unit, 2), F.lit(mark))).otherwise(text)
    return text


def tiered_price_text(price: Column) -> Column:
    """Two places from a thousand up, four from one up, six below."""
    return F.concat(
        F.lit("$"),
        F.when(price >= 1000, grouped(price, 2)).when(price >= 1, fixed(price, 4)).otherwise(fixed(price, 6)),
    )


def signed_pct_text(change: Column) -> Column:
    value = F.coalesce(change, F.lit(0.0))
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(sign, fixed(F.abs(value), 2), F.lit("%"))


def sentiment_band(index: Column) -> Column:
    band = F.lit(TOP_BAND)
    for limit, name in reversed(SENTIMENT_BANDS):
        band = F.when(index <= limit, F.lit(name)).otherwise(band)
    return F.when(index.isNotNull(), band)


def vote_sentiment(positive: Column, negative: Column) -> Column:
    up, down = F.coalesce(positive, F.lit(0)), F.coalesce(negative, F.lit(0))
    return F.when(up > down, F.lit("bullish")).when(down > up, F.lit("bearish")).otherwise(F.lit("neutral"))


def hot_flag(important: Column) -> Column:
    return F.coalesce(important, F.lit(0)) > HOT_VOTES


def signal_text(signal: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in SIGNAL_WORDS.items() for x in pair])
    return F.try_element_at(words, signal)


def array_field(items: Column, field: str) -> Column:
    return F.transform(items, lambda item: item[field])


def exp_decay(step: Column, scale: float = 180.0) -> Column:
    return F.exp(-step / F.lit(scale))


def percent_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename shares for display and show them as percent with one place."""
    shown = {old: F.round(F.col(old) * 100, 1).alias(new) for old, new in names.items()}
    return df.select(*[shown.get(c, F.col(c)) for c in df.columns])
