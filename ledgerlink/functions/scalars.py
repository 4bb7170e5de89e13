"""Column expressions shared by all operators. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import AMOUNT_DECIMALS, CENTS, RESERVED_COLUMNS

_BLANKS = " \t\r\n\f\x0b"
_LARGEST = 1.7976931348623157e308


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def number_or_null(c: Column | str) -> Column:
    """Text to double: blanks off, comma read as decimal point, anything else unreadable is NULL.

    The JVM parser would also take ``1d``, ``2f``, hexadecimal floats, ``NaN`` and ``Infinity``.
    Every such text holds one of the letters that are turned into a mark it cannot read. A number
    beyond the range of a double is unreadable, too.
    """
    plain = F.translate(F.btrim(_text(c), F.lit(_BLANKS)), ",dDfFxXnNiI", ".??????????")
    n = plain.try_cast("double")
    return F.when(F.abs(n) <= _LARGEST, n)


def number_or_zero(c: Column | str) -> Column:
    return F.coalesce(number_or_null(c), F.lit(0.0))


def amount(df: DataFrame, name: str) -> Column:
    """Amount column of a ledger, 0 where there is none; a numeric column is not parsed again."""
    c = _column(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return number_or_zero(c)


def composite_key(cols: Sequence[Column | str]) -> Column:
    """Key text; a NULL part counts as the empty text and still takes its separator."""
    if not cols:
        raise ValueError("a composite key needs at least one column")
    return F.concat_ws("_", *[F.coalesce(_text(c), F.lit("")) for c in cols])


def round_amount(c: Column) -> Column:
    """Six decimals, halves away from zero; negative zero becomes zero."""
    return F.round(c, AMOUNT_DECIMALS) + F.lit(0.0)


def exact_sum(v: Column) -> Column:
    """Sum of amounts, rounded once to six decimals, that does not depend on the order of the rows.

    Two ledgers that hold the same amounts must give the same sum, to the last bit, or a large key
    would differ by rounding alone. So whole parts, millionths and what is below them (to 1e-12, finer
    than any amount is told apart) are summed as integers, and only the sum is rounded, halves away
    from zero. Only a total beyond 8e18, which no integer holds, is the plain sum.
    """
    million = F.lit(1_000_000)
    fits = F.abs(v) < 1e18
    whole = F.when(fits, v).cast("long")
    millionths = (v - whole) * million
    full = millionths.cast("long")
    below = (millionths - full) * million
    wholes = F.try_sum(F.when(v.isNotNull(), F.coalesce(whole, F.lit(2**63 - 1))))
    rest = F.sum((below + F.signum(below) * F.lit(0.5)).cast("long"))
    carried = F.sum(full) + F.floor(rest / million).cast("long")
    rest = F.pmod(rest, million)
    units = wholes + F.floor(carried / million).cast("long")
    up = (rest > 500_000) | ((rest == 500_000) & (units >= 0))
    part = F.pmod(carried, million) + up.cast("long")
    # Both terms get the sign of the sum, so that none of its digits is lost.
    below_zero = (units < 0) & (part > 0)
    exact = F.when(below_zero, units + 1).otherwise(units).cast("double") + F.when(below_zero, part - million).otherwise(part) / million
    bound = 8 * 10**18
    return F.when(wholes.between(-bound, bound), exact).otherwise(F.sum(v))


def signed(c: Column, invert: bool) -> Column:
    return F.lit(-1.0) * c if invert else c


def cents_index(c: Column) -> Column:
    """Whole cents, halves towards plus infinity."""
    return F.floor(c * F.lit(float(CENTS)) + F.lit(0.5)).cast("long")


def cancels_in_cents(a: Column, b: Column) -> Column:
    return (cents_index(a) + cents_index(b)) == 0


def is_empty(c: Column | str) -> Column:
    """NULL, blank, ``null`` in any case, ``0`` or ``0.00``. ``0.0`` is a value."""
    t = F.trim(_text(c))
    return t.isNull() | F.lower(t).isin("", "null", "0", "0.00")


def import_value(c: Column | str) -> Column:
    return F.when(is_empty(c), F.lit("NULL")).otherwise(F.trim(_text(c)))


def clean_key_value(c: Column | str) -> Column:
    t = F.trim(_text(c))
    return F.when(t.isNull() | (F.lower(t) == "null"), F.lit("")).otherwise(t)


def normalize_nulls(df: DataFrame, monetary: Sequence[str]) -> DataFrame:
    """Monetary columns become numbers with 0 for the unreadable; other empty texts become NULL."""
    wanted = set(monetary)
    out = []
    for f in df.schema.fields:
        c = _column(f.name)
        if f.name in RESERVED_COLUMNS:
            out.append(c)
        elif f.name in wanted:
            out.append(number_or_zero(c).alias(f.name, metadata=f.metadata))
        elif f.dataType.typeName() == "string":
            out.append(F.when(c != "", c).alias(f.name, metadata=f.metadata))
        else:
            out.append(c)
    return df.select(*out)


_DERIVED = {"ABS": F.abs, "INVERTER": lambda n: F.lit(0.0) - n}


def derive(df: DataFrame, source: str, op: str) -> DataFrame:
    """Add (or replace) ``abs_<source>`` or ``inverter_<source>``, flagged monetary."""
    name = op.upper()
    if name not in _DERIVED:
        raise ValueError(f"unknown operation {op}: use ABS or INVERTER")
    target = f"{name.lower()}_{source}"
    value = _DERIVED[name](number_or_null(_column(source)))
    meta = {"source_name": target, "monetary": True}
    if target in df.columns:
        return df.select(
            *[value.alias(target, metadata=meta) if c == target else _column(c) for c in df.columns]
        )
    return df.select("*", value.alias(target, metadata=meta))


def row_payload(named: Sequence[tuple[str, Column]]) -> Column:
    """JSON text of the given columns, with NULL fields kept."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in named]), {"ignoreNullFields": "false"})


def parse_money_br(c: Column | str) -> Column:
    """Opt-in reading of ``12.345,67``: points are thousands marks when a comma follows."""
    t = F.btrim(_text(c), F.lit(_BLANKS))
    return number_or_null(
        F.when(F.contains(t, F.lit(",")), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    )


def money_text(c: Column | str) -> Column:
    """Amount with thousands marks and two decimals; text that is no number is left as it is."""
    n = number_or_null(c)
    return F.when(n.isNull(), _text(c)).otherwise(F.format_number(n, 2))
