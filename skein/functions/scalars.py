"""Scalar functions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what ends a word under the cursor.
WORD_DELIMITERS = " \"':,{}[]()"
_DELIMITER_CLASS = r"[ \"':,{}\[\]()]"
_NOT_DELIMITER = r"[^ \"':,{}\[\]()]"
#: A date, a time and a zone; a bare date isn't an instant.
_INSTANT = r"^[+-]?\d{4,}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?([Zz]|[+-]\d{2}(:?\d{2})?)$"


def iso_millis(text: Column) -> Column:
    """Epoch milliseconds (floored) of an ISO-8601 instant, null for anything else."""
    return F.when(text.rlike(_INSTANT), F.unix_millis(F.try_to_timestamp(text)))


def millis_iso(ms: Column) -> Column:
    """The instant as ISO text in UTC, without a zero fraction."""
    ts = F.timestamp_millis(ms)
    return F.when(F.pmod(ms, F.lit(1000)) == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def clock(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "HH:mm:ss")


def day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def days_before(now_ms: Column, days: Column) -> Column:
    """``days`` (0 at least) before, in milliseconds of whole seconds."""
    return (F.floor(now_ms / 1000) - F.greatest(days, F.lit(0)) * 86_400) * 1000


def thousands(n: Column) -> Column:
    """12.345.678"""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit("."))


def byte_unit(n: Column) -> Column:
    """Bytes, a long or a decimal, as B, KB, MB, GB or TB with two decimals; whole bytes below 1 KB."""
    power = F.lit(0)
    for k in (1, 2, 3, 4):
        power = F.when(n >= 1024**k, F.lit(k)).otherwise(power)
    hundredths = (n / F.pow(F.lit(1024.0), power) * 100 + 0.5).cast("long")
    value = F.concat(F.call_function("div", hundredths, F.lit(100)).cast("string"), F.lit("."), F.lpad(F.pmod(hundredths, F.lit(100)).cast("string"), 2, "0"))
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), power + 1)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat_ws(" ", value, unit))


def round_to(x: Column, multiple: Column) -> Column:
    """The magnitude of x rounded to a multiple, half up; 0 where that is 0."""
    whole = multiple * F.floor(F.abs(x.cast("double") / F.nullif(multiple, F.lit(0))) + 0.5)
    return F.coalesce(whole.cast("long"), F.lit(0).cast("long"))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def after_last_colon(text: Column) -> Column:
    """An image's tag; the whole text where there is no colon."""
    return F.substring_index(text, ":", -1)


def words(text: Column) -> Column:
    """The runs between delimiters."""
    return F.filter(F.split(text, _DELIMITER_CLASS), lambda w: w != "")


def word_at(text: Column, index: Column) -> Column:
    """The word around the character at ``index`` (from 0; the text's length means its last), null on a delimiter or outside."""
    at = F.when(index == F.length(text), index - 1).otherwise(index)
    left = F.regexp_extract(F.substring(text, F.lit(1), at + 1), f"{_NOT_DELIMITER}*$", 0)
    right = F.regexp_extract(F.substring(text, at + 2, F.length(text)), f"^{_NOT_DELIMITER}*", 0)
    return F.when((index >= 0) & (index <= F.length(text)) & (left != ""), F.concat(left, right))


def squeezed(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", "")


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once, however often ``make`` uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def running(values: Column, both: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The running totals of an array under ``both``, which takes a total and a value, or two totals. A step
    copies what is there so far, so parts of about the root of the size come first, and what stands before
    each part is added to it."""
    last = lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), zero)
    grown = lambda acc, x: F.concat(acc, F.array(both(last(acc), x)))
    none = F.slice(F.array(zero), 1, 0)

    def parts(size: Column) -> Column:
        starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), size)).otherwise(F.array().cast("array<int>"))
        each = F.transform(starts, lambda i: F.aggregate(F.slice(values, i, size), none, grown))
        before = lambda e: F.aggregate(e, F.array(zero), lambda acc, p: grown(acc, last(p)))
        return bound(each, lambda e: F.flatten(F.zip_with(e, before(e), lambda p, b: F.transform(F.coalesce(p, none), lambda x: both(b, x)))))

    return bound(F.greatest(F.lit(1), F.sqrt(F.size(values)).cast("int")), parts)


def _trigrams(text: Column) -> Column:
    """All trigrams, by a match of no width at each character; where characters take two units of the JVM's text, from three shifted slices."""
    matched = F.regexp_extract_all(text, F.lit("(?=(.{3}))"), F.lit(1))
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), bound(F.split(text, F.lit("")), _zipped)).otherwise(matched)


def _zipped(chars: Column) -> Column:
    n = F.size(chars) - 2
    joined = lambda a, b: F.concat(a, b)
    return F.zip_with(F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), joined), F.slice(chars, 3, n), joined)


def grams(text: Column) -> Column:
    """The distinct trigrams of the squeezed text; one shorter gram below three characters, none for an empty one."""
    few = lambda s: F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) < 3, F.array(s))
    return bound(squeezed(text), lambda s: few(s).otherwise(F.array_distinct(_trigrams(s))))


def next_power_of_two(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double")))).cast("long")


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over characters, as an unsigned number in a long."""
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(_codes(text), F.lit(0x811C9DC5).cast("long"), step)


def colour_index(text: Column, colours: int = 40) -> Column:
    """A stable colour: the magnitude of the 31-multiplier string hash, modulo the number of colours."""
    h = F.aggregate(_codes(text), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    signed = F.when(h >= 2**31, h - 2**32).otherwise(h)
    return F.pmod(F.abs(signed), F.lit(colours)).cast("int")


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-x.bitwiseAND(F.lit(1)))


def density(words_: Column) -> Column:
    """Set bits of an array of longs, as a share."""
    bits = F.aggregate(words_, F.lit(0), lambda n, w: n + F.bit_count(w))
    return bits / (F.size(words_) * 64)
