"""Readers of single tokens: clocks, money, dates, months.

All are Column -> Column and stay in generated code. Digits are ``[0-9]`` and
letters ``\\p{L}``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgrid import fixed
from inkgrid.functions.text import normalize_text

_MARK = "?"


def _mark_non_digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", _MARK)


def _clock_part(part: Column, highest: int) -> Column:
    number = part.try_cast("int")
    return F.when(number <= highest, F.lpad(part, 2, "0")).otherwise(F.lit(_MARK * 2))


def read_clock(token: Column) -> Column:
    """``[+]H[H]:MM[x]`` to ``struct(raw, norm, uncertain)``, or NULL.

    Every illegible position becomes ``?`` in ``raw``; an impossible or illegible
    hour or minute becomes ``??`` in ``norm``.
    """
    plus = F.when(F.startswith(token, F.lit("+")), F.lit("+")).otherwise(F.lit(""))
    body = F.when(F.startswith(token, F.lit("+")), F.substr(token, F.lit(2))).otherwise(token)
    colon = F.instr(body, ":")
    hour = F.substr(body, F.lit(1), colon - 1)
    rest = F.substr(body, colon + 1)
    minute = F.substr(rest, F.lit(1), F.lit(2))
    suffix = F.substr(rest, F.lit(3), F.lit(1))
    fits = (
        colon.isin(2, 3)
        & F.char_length(rest).isin(2, 3)
        & ~F.contains(minute, F.lit(":"))
    )
    hour_read, minute_read = _mark_non_digits(hour), _mark_non_digits(minute)
    suffix_read = F.when((suffix == "") | suffix.rlike(r"^\p{L}$"), suffix).otherwise(F.lit(_MARK))
    raw = F.concat(plus, hour_read, F.lit(":"), minute_read, suffix_read)
    norm = F.concat_ws(":", _clock_part(hour_read, 23), _clock_part(minute_read, 59))
    return F.when(
        fits,
        F.struct(
            raw.alias("raw"),
            norm.alias("norm"),
            (F.contains(raw, F.lit(_MARK)) | F.contains(norm, F.lit(_MARK))).alias("uncertain"),
        ),
    )


def read_money(token: Column) -> Column:
    """Brazilian amount to ``struct(raw, norm, uncertain)``, or NULL when it is something else."""
    comma = F.instr(token, ",")
    whole = F.substr(token, F.lit(1), comma - 1)
    cents = F.substr(token, comma + 1)
    sign = F.when(F.startswith(whole, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    body = F.when(F.startswith(whole, F.lit("-")), F.substr(whole, F.lit(2))).otherwise(whole)
    digits = F.char_length(F.regexp_replace(F.concat(body, cents), "[^0-9]", ""))
    places = F.char_length(F.replace(body, F.lit("."), F.lit(""))) + 2
    share = Fraction(str(fixed.MONEY_MIN_DIGIT_SHARE))  # compared with integers, so nothing is rounded
    fits = (
        (comma > 1)
        & (F.char_length(cents) == 2)
        & ~F.contains(cents, F.lit(","))
        & (F.char_length(body) > 0)
        & (digits * share.denominator >= places * share.numerator)
    )
    raw = F.concat(
        sign, F.regexp_replace(body, r"[^0-9.]", _MARK), F.lit(","), _mark_non_digits(cents)
    )
    return F.when(
        fits,
        F.struct(
            raw.alias("raw"), raw.alias("norm"), F.contains(raw, F.lit(_MARK)).alias("uncertain")
        ),
    )


def is_money(token: Column) -> Column:
    """Strict amount, fully legible."""
    return token.rlike(fixed.MONEY)


def is_money_shaped(token: Column) -> Column:
    """An amount, damaged or not: enough digits in the places of an amount."""
    return F.contains(token, F.lit(",")) & read_money(token).isNotNull()


def marked_money(token: Column) -> Column:
    """The amount with illegible positions marked; any other text unchanged."""
    return F.coalesce(read_money(token)["raw"], token)


def money_to_decimal(token: Column) -> Column:
    """Numeric view of an amount; NULL when a position is illegible."""
    plain = F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(is_money(token), plain.try_cast("decimal(18,2)"))


def read_month_year(text: Column, two_digits: bool = False) -> Column:
    """First ``m/yyyy`` in a text to ``struct(month, year)`` of strings; NULL if absent or impossible."""
    pattern = fixed.MONTH_TWO if two_digits else fixed.MONTH_ONE_OR_TWO
    month = F.regexp_extract(text, pattern, 1)
    year = F.regexp_extract(text, pattern, 2)
    return F.when(
        month.try_cast("int").between(1, 12), F.struct(month.alias("month"), year.alias("year"))
    )


def read_month_abbreviated(text: Column) -> Column:
    """``abr-17`` to ``struct('04', '2017')``; NULL when the name is unknown."""
    name = normalize_text(F.regexp_extract(text, fixed.MONTH_ABBREVIATED, 1))
    year = F.regexp_extract(text, fixed.MONTH_ABBREVIATED, 2)
    number = F.array_position(F.array(*[F.lit(m) for m in fixed.MONTH_ABBREVIATIONS]), name)
    full = F.when(F.char_length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.when(
        number > 0,
        F.struct(F.lpad(number.cast("string"), 2, "0").alias("month"), full.alias("year")),
    )


def compose_date(day: Column, month_year: Column) -> Column:
    """``dd/mm/yyyy`` when the month is known, else the day number alone."""
    full = F.concat_ws(
        "/",
        F.lpad(day.cast("string"), 2, "0"),
        F.lpad(month_year["month"].cast("int").cast("string"), 2, "0"),
        month_year["year"].cast("int").cast("string"),
    )
    return F.when(month_year.isNull(), day.cast("string")).otherwise(full)


def date_shape(text: Column) -> Column:
    return text.rlike(fixed.DATE_SHAPE)


def parse_date(text: Column) -> Column:
    """``d/m/y`` to DATE; NULL when the shape is wrong or the calendar has no such day."""
    part = lambda n: F.split_part(text, F.lit("/"), F.lit(n)).try_cast("int")
    day, month, year = part(1), part(2), part(3)
    iso = F.concat_ws(
        "-",
        F.lpad(year.cast("string"), 4, "0"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(day.cast("string"), 2, "0"),
    )
    sound = date_shape(text) & year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    return F.when(sound, iso.try_cast("date"))


def next_day(day: Column) -> Column:
    return F.date_add(day, 1)


def next_month(month: Column, year: Column) -> Column:
    """``struct(year, month)`` of the month after; both NULL if illegible."""
    after = month_index(month, year)  # months from year 0, January being 1, so this is the next one's from 0
    return F.struct(F.floor(after / 12).alias("year"), (after % 12 + 1).alias("month"))


def month_index(month: Column, year: Column) -> Column:
    """Months since year 0, so that December and January are neighbours; NULL if illegible."""
    legible = month.rlike("^[0-9]+$") & year.rlike("^[0-9]+$")
    number = month.try_cast("int")
    return F.when(
        legible & number.between(1, 12), year.try_cast("bigint") * 12 + number.cast("bigint")
    )


def split_interval(text: Column) -> Column:
    """Both clocks of ``09:52-16:07``; empty pieces dropped."""
    pieces = F.transform(F.split(text, fixed.DASHES), lambda p: F.trim(p))
    return F.filter(pieces, lambda p: p != "")


def day_digits(text: Column) -> Column:
    """A day number printed alone."""
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.when(number.between(1, 31), number)


def day_prefix(text: Column) -> Column:
    """A day number that may be glued to the weekday, as in ``18QUA``."""
    number = F.regexp_extract(text, "^([0-9]{1,2})", 1).try_cast("int")
    return F.when(number.between(1, 31), number)


def split_code(text: Column) -> Column:
    """``40Reembolso`` or ``290`` to ``struct(code, rest)``."""
    digits = text.rlike("^[0-9]+$")
    glued = text.rlike(fixed.GLUED_CODE)
    code = (
        F.when(digits, text)
        .when(glued, F.regexp_extract(text, fixed.GLUED_CODE, 1))
        .otherwise(F.lit(""))
    )
    rest = (
        F.when(digits, F.lit(""))
        .when(glued, F.regexp_extract(text, fixed.GLUED_CODE, 2))
        .otherwise(text)
    )
    return F.struct(code.alias("code"), rest.alias("rest"))


def is_total_label(label: Column) -> Column:
    plain = F.replace(normalize_text(label), F.lit(" "), F.lit(""))
    hit = F.lit(False)
    for prefix in fixed.TOTAL_PREFIXES:
        hit = hit | F.startswith(plain, F.lit(prefix))
    return hit


def total_kinds(ntext: Column) -> Column:
    """Labels of the totals named on a line, in the configured order.

    The key without its first character is enough: readers often lose that one.
    """
    return F.array_compact(
        F.array(
            *[
                F.when(F.contains(ntext, F.lit(key[1:])), F.lit(label))
                for key, label in fixed.TOTALS
            ]
        )
    )


def px_to_points(px: Column, dpi: Column) -> Column:
    return px / (dpi / F.lit(fixed.POINTS_PER_INCH))
