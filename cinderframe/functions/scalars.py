"""Typed values of recorded traces."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from cinderframe.functions.frames import let

EXACT = "decimal(38,0)"
RADIX_PATTERN = r"^[+-]?(?:0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$"
DECIMAL_PATTERN = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"

# Ranges of the integral result types, as exact decimals in text.
INTEGRAL_RANGES = (
    ("int8", "-128", "127"),
    ("uint8", "0", "255"),
    ("int16", "-32768", "32767"),
    ("uint16", "0", "65535"),
    ("int32", "-2147483648", "2147483647"),
    ("uint32", "0", "4294967295"),
    ("int64", "-9223372036854775808", "9223372036854775807"),
    ("uint64", "0", "18446744073709551615"),
)


def resize_payload(payload: Column, wanted: Column) -> Column:
    """Zero-pad or cut a binary payload; a NULL or negative size keeps it whole."""
    resized = F.call_function("rpad", payload, wanted.cast("int"), F.unhex(F.lit("00")))
    return F.when(wanted.isNull() | (wanted < 0), payload).otherwise(resized)


def clamp(value: Column, low: Column, high: Column) -> Column:
    """Clamp to a type's range and drop the fraction.

    The bounds are whole, so the fraction can go first; that keeps all three in one decimal type.
    """
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast(EXACT)
    return F.least(F.greatest(whole, low), high)


def parse_integer(text: Column) -> Column:
    """Base-0 integer as DECIMAL(38,0): 0x, 0o, 0b or decimal without leading zeros; NULL otherwise.

    Radix forms are exact up to 120 bits, whatever zeros lead them, decimal forms up to 38 digits; beyond
    that the result is NULL, and `integer_digits` has the number.
    """

    def radix(body: Column, base: int, half: int) -> Column:
        # each half holds 60 bits, so that no conversion can overflow
        digits = F.regexp_replace(F.substring(body, 3, 2**31 - 1), "^0+", "")

        def folded(d: Column) -> Column:
            size = F.length(d)
            number = lambda part: F.coalesce(F.conv(part, base, 10), F.lit("0")).cast("decimal(19,0)")
            upper = number(d.substr(F.lit(1), F.greatest(size - half, F.lit(0))))
            lower = number(d.substr(F.greatest(size - half, F.lit(0)) + 1, F.lit(half)))
            return F.when(size <= 2 * half, (upper * F.lit(Decimal(1 << 60)) + lower).cast(EXACT))

        return let(digits, folded)

    def magnitude(body: Column) -> Column:
        second = F.lower(F.substring(body, 2, 1))
        return (
            F.when(second == "x", radix(body, 16, 15))
            .when(second == "o", radix(body, 8, 20))
            .when(second == "b", radix(body, 2, 60))
        )

    # Plain decimals carry their sign into the cast; only radix forms need it put back.
    body = F.regexp_replace(text, r"^[+-]", "")
    radix_value = let(body, magnitude)
    # a difference, because a negated decimal is rounded to 34 digits
    signed = F.when(text.startswith("-"), F.lit(Decimal(0)) - radix_value).otherwise(radix_value).cast(EXACT)
    return F.when(text.rlike(r"^[+-]?(?:[1-9][0-9]*|0+)$"), text.try_cast(EXACT)).when(
        text.rlike(RADIX_PATTERN), signed
    )


# Digits of a radix literal that one step of the fold takes in, and their bits. A limb times 2 ** 33 still fits a long.
_STEPS = {"x": (16, 8, 32), "o": (8, 11, 33), "b": (2, 32, 32)}
_LIMB = 10**9


def _radix_digits(body: Column) -> Column:
    """Decimal digits of an unsigned `0x`, `0o` or `0b` literal of any length.

    The number is an array of limbs of base 10^9, lowest first. Chunks of the literal are taken in one after another: every limb is
    multiplied by the chunk's weight, and what does not fit moves on to the next.
    """
    long = lambda c: c.cast("long")

    def folded(base: int, width: int, bits: int) -> Column:
        digits = F.regexp_replace(F.substring(body, 3, 2**31 - 1), "^0+", "")
        steps = long(F.ceil(F.length(digits) / F.lit(width)))
        padded = F.lpad(digits, (steps * width).cast("int"), "0")

        def limbs(text: Column) -> Column:
            chunk = lambda i: long(F.conv(text.substr((i * width + 1).cast("int"), F.lit(width)), base, 10))
            chunks = F.transform(F.sequence(F.lit(0).cast("long"), steps - 1), chunk)
            return F.aggregate(chunks, F.array().cast("array<bigint>"), lambda number, c: times_plus(number, c, bits))

        def joined(groups: Column) -> Column:
            rest = F.transform(F.slice(groups, F.lit(2), F.greatest(F.size(groups) - 1, F.lit(0))), lambda limb: F.lpad(limb.cast("string"), 9, "0"))
            return F.concat(F.get(groups, F.lit(0)).cast("string"), F.array_join(rest, ""))

        return F.when(digits == "", "0").otherwise(let(F.reverse(let(padded, limbs)), joined))

    def times_plus(number: Column, more: Column, bits: int) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("limbs"), more.alias("carry"))

        def step(state: Column, limb: Column) -> Column:
            return let(
                limb * F.lit(1 << bits) + state["carry"],
                lambda sum_: F.struct(
                    F.array_append(state["limbs"], sum_ % _LIMB).alias("limbs"), whole_limbs(sum_).alias("carry")
                ),
            )

        def closed(state: Column) -> Column:
            upper = whole_limbs(state["carry"])
            return F.when(state["carry"] == 0, state["limbs"]).when(upper == 0, F.array_append(state["limbs"], state["carry"])).otherwise(
                F.concat(state["limbs"], F.array(state["carry"] % _LIMB, upper))
            )

        return let(F.aggregate(number, start, step), closed)

    def whole_limbs(number: Column) -> Column:
        return F.call_function("div", number, F.lit(_LIMB).cast("long"))

    second = F.lower(F.substring(body, 2, 1))
    found = None
    for mark, kind in _STEPS.items():
        found = F.when(second == mark, folded(*kind)) if found is None else found.when(second == mark, folded(*kind))
    return found


def integer_digits(text: Column) -> Column:
    """Canonical decimal text of an integer of any length; NULL for anything else.

    Reads the same forms as `parse_integer`, and integral decimal or scientific literals of up to a million digits.
    """
    short = F.coalesce(parse_integer(text), exact_integer(text)).cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    signed = lambda digits: F.when(digits == "0", digits).otherwise(F.concat(sign, digits))
    bare = F.regexp_replace(text, r"^[+-]", "")
    wide = (
        F.when(text.rlike(RADIX_PATTERN), let(bare, lambda body: let(_radix_digits(body), signed)))
        .when(text.rlike(r"^[+-]?[1-9][0-9]*$"), F.concat(sign, bare))
        .otherwise(let(_literal_digits(bare), signed))
    )
    return F.coalesce(short, wide)


def compare_digits(digits: Column, bound: int) -> Column:
    """Whether an integer, as canonical decimal text, is at most `bound`: signs, lengths, then digits."""
    size, minus = F.length(digits), digits.startswith("-")
    wanted = str(bound)
    if bound >= 0:
        return minus | (size < len(wanted)) | ((size == len(wanted)) & (digits <= wanted))
    return minus & ((size > len(wanted)) | ((size == len(wanted)) & (digits >= wanted)))


def scalar_fields(text: Column) -> Column:
    """`struct<kind, whole, real, digits>` of a recorded scalar, each part NULL when it does not apply.

    `kind` is `int` or `decimal`. Integral scientific notation counts as an integer. A signed zero
    stays a decimal, since an integer cannot carry it; so do infinities and NaN. `digits` is the exact decimal text of an
    integer, of any length; `whole` has it as a number where 38 digits are enough. `text` is computed once.
    """
    return let(text, lambda bound: let(integer_digits(bound), lambda digits: _fields(bound, digits)))


def _fields(text: Column, digits: Column) -> Column:
    is_int = digits.isNotNull() & ~((digits == "0") & text.startswith("-"))
    number = is_int | text.rlike(DECIMAL_PATTERN)
    number = number | F.lower(text).rlike(r"^[+-]?(?:inf|infinity|nan)$")
    return F.struct(
        F.when(is_int, "int").when(number | digits.isNotNull(), "decimal").alias("kind"),
        F.when(is_int, digits.try_cast(EXACT)).alias("whole"),
        F.coalesce(text.try_cast("double"), digits.try_cast("double")).alias("real"),
        F.when(is_int, digits).alias("digits"),
    )


def _literal_parts(text: Column) -> Column:
    """`struct<sign, digits, shift>` of a decimal or scientific literal: its digits without the point, and the powers of ten behind them."""
    shape = r"^([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$"
    fraction = F.regexp_extract(text, shape, 3)
    exponent = F.coalesce(F.regexp_extract(text, shape, 4).try_cast("int"), F.lit(0))
    return F.struct(
        F.regexp_extract(text, shape, 1).alias("sign"),
        F.concat(F.regexp_extract(text, shape, 2), fraction).alias("digits"),
        (exponent - F.length(fraction)).alias("shift"),
    )


def _shifted(parts: Column, most: int) -> Column:
    """The digits of a literal with its powers of ten; NULL if a fraction is left, or for over `most` zeros."""
    digits, shift = parts["digits"], parts["shift"]
    zeros = F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))
    return (
        F.when(digits.rlike("^0+$"), F.lit("0"))
        .when((shift >= 0) & (shift <= most), F.concat(digits, F.repeat(F.lit("0"), shift)))
        .when((shift < 0) & (zeros >= -shift), F.substring(digits, F.lit(1), F.length(digits) + shift))
    )


def _literal_digits(bare: Column) -> Column:
    """Canonical digits of an unsigned integral literal."""
    found = let(_literal_parts(bare), lambda parts: _shifted(parts, 1_000_000))
    return F.when(bare.rlike(DECIMAL_PATTERN), let(found, lambda d: F.when(d.rlike("^0*$"), "0").otherwise(F.regexp_replace(d, "^0+", ""))))


def exact_integer(text: Column) -> Column:
    """Integral value of a decimal or scientific literal as DECIMAL(38,0); NULL if it has a fraction.

    Worked on the digits, so no rounding can make a fraction look whole.
    """
    value = lambda p: F.concat(p["sign"], _shifted(p, 38)).try_cast(EXACT)
    return F.when(text.rlike(DECIMAL_PATTERN), let(_literal_parts(text), value))


def range_bound(type_name: Column, upper: bool) -> Column:
    """Lower or upper bound of an integral type by name; NULL for other types."""
    bounds = F.create_map(
        *[
            part
            for name, low, high in INTEGRAL_RANGES
            for part in (F.lit(name), F.lit(high if upper else low).cast(EXACT))
        ]
    )
    return F.try_element_at(bounds, type_name)
