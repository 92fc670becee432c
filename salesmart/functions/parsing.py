"""Column expressions that type the text columns of retail records; all give null instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Accepted date formats, day first; one H accepts one and two digits.
DATE_FORMATS = ("yyyy-MM-dd H:mm:ss", "yyyy-MM-dd H:mm", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm")


def blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.trim(c) == "")


# Texts in full shape, which a cast reads many times faster than a format does; what isn't goes by the formats.
_ISO = r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2} [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\z"
_DMY = r"^([0-9]{1,2})/([0-9]{1,2})/([1-9][0-9]{3}) ([0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)\z"


def parse_invoice_ts(c: Column | str) -> Column:
    """Timestamp by the one format that can fit the trimmed text, told by its slashes and colons; failed tries are slow."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    turned = F.regexp_replace(c, _DMY, "$3-$2-$1 $4")
    return F.when(c.rlike(_ISO), c.try_cast("timestamp")).when(c.rlike(_DMY), turned.try_cast("timestamp")).otherwise(_by_format(c))


def _by_format(c: Column) -> Column:
    iso_s, iso, dmy_s, dmy = [F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]
    slashes, seconds = c.contains("/"), c.like("%:%:%")
    return F.when(slashes & seconds, dmy_s).when(slashes, dmy).when(seconds, iso_s).otherwise(iso)


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with ``columns`` beside its own (or its own alone), computed once a row: filters above don't repeat their expressions.

    A row of a generator stops Catalyst from moving filters, and the expressions in them, below it.
    """
    if columns:
        return df.select("*", F.inline(F.array(F.struct(*columns))))
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def parse_quantity(c: Column | str) -> Column:
    """Whole numbers with an optional sign as long; anything else, or an overflow, is null."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("long"))


def parse_price(c: Column | str) -> Column:
    """Plain decimal numbers as decimal(10,2), half up; anything else, or an overflow, is null."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(c.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), c.try_cast("decimal(10,2)"))


def normal_customer(c: Column | str) -> Column:
    """Trimmed customer id, without the .0 after an all-digit one."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.regexp_replace(c, r"^([0-9]+)\.0$", "$1")


def packed(key: str) -> Column:
    """A key that stays as different as it was: 32 small hex digits as 16 bytes, other texts as longer ones, null as null."""
    text = F.col(key).cast("string")
    return F.when(text.rlike(r"^[0-9a-f]{32}\z"), F.unhex(text)).otherwise(F.encode(F.concat(F.lit("-" * 16), text, F.lit("-")), "UTF-8"))


def unpacked(key: str) -> Column:
    """The text that was ``packed``."""
    c = F.col(key)
    text = F.decode(c, "UTF-8")
    return F.when(F.octet_length(c) == 16, F.lower(F.hex(c))).otherwise(F.substr(text, F.lit(17), F.length(text) - 17))


def ratio(n: Column, d: Column, times: int = 1, kind: str = "decimal(18,2)") -> Column:
    """n * times / d rounded half up to two places, in decimals; null where d is 0 or null."""
    n, d = n.cast("decimal(24,2)"), d.cast("decimal(24,2)")
    return F.when(d != 0, F.round((n * times).cast("decimal(24,2)") / d, 2)).cast(kind)
