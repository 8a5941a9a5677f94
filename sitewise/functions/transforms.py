"""Numbers, dates, elapsed time and units from text columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.schema import UNIT_ALIASES, UNITS

# grammar of a number: optional sign, digits with at most one point somewhere, optional exponent
_SIGN, _DIGITS = "[-+]?", "[0-9]"
_MANTISSA = rf"(?=\.?{_DIGITS}){_DIGITS}*\.?{_DIGITS}*"
NUMBER = f"{_SIGN}{_MANTISSA}(?:[Ee]{_SIGN}{_DIGITS}+)?"


@dataclass(frozen=True)
class Conversion:
    """How a text column becomes numeric."""

    mode: str = "number"          # number, date or measurement
    date_unit: str = "years"      # days, months or years
    date_origin: str = ""         # blank: the earliest date of the column
    quantity: str = "length"      # length, mass or temperature
    target_unit: str = "m"
    bare_unit: str = "m"          # unit of a measurement without suffix


def text(col: Column) -> Column:
    return F.coalesce(F.regexp_replace(col.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def plain_number(col: Column) -> Column:
    """Finite number from strictly numeric text, else NULL."""
    t = text(col)
    value = F.when(t.rlike(f"^{NUMBER}$"), t.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def is_meaningful(col: Column) -> Column:
    return F.coalesce(plain_number(col) != 0.0, F.lit(False))


def parse_date(col: Column) -> Column:
    """Date from ISO dates and times, Y-m-d, Y/m/d, Y.m.d, year-month and year text."""
    t = text(col)
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    parsed = [F.when(t.rlike(iso), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")),
              F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))]
    for mark, pattern in (("-", "-"), ("/", "/"), (r"\.", ".")):
        parsed.append(F.when(t.rlike(rf"^\d{{4}}{mark}\d{{1,2}}{mark}\d{{1,2}}$"),
                             F.try_to_date(t, f"yyyy{pattern}M{pattern}d")))
        parsed.append(F.when(t.rlike(rf"^\d{{4}}{mark}\d{{1,2}}$"),
                             F.try_to_date(F.concat(t, F.lit(pattern + "1")), f"yyyy{pattern}M{pattern}d")))
    parsed.append(F.when(t.rlike(r"^\d{4}$"), F.try_to_date(F.concat(t, F.lit("-1-1")), "yyyy-M-d")))
    return F.coalesce(*parsed)


def _forward_months(start: Column, end: Column) -> Column:
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    whole = F.when(F.add_months(start, months) > end, months - 1).otherwise(months)
    anchor, following = F.add_months(start, whole), F.add_months(start, whole + 1)
    return whole + F.coalesce(F.datediff(end, anchor) / F.nullif(F.datediff(following, anchor), F.lit(0)), F.lit(0.0))


def elapsed_months(origin: Column, current: Column) -> Column:
    """Calendar months with an anchored fraction, negative before the origin."""
    return (F.when(current == origin, 0.0)
            .when(current > origin, _forward_months(origin, current))
            .when(current < origin, -_forward_months(current, origin)))


def elapsed(origin: Column, current: Column, unit: str) -> Column:
    if unit == "days":
        return F.datediff(current, origin).cast("double")
    if unit == "months":
        return elapsed_months(origin, current)
    if unit == "years":
        return elapsed_months(origin, current) / 12.0
    raise ValueError(f"unknown elapsed-time unit {unit!r}")


def _spellings(quantity: str) -> dict[str, tuple[float, float]]:
    units = UNITS[quantity]
    return units | {alias: units[u] for alias, u in UNIT_ALIASES.items() if u in units}


def measurement(col: Column, quantity: str, target_unit: str, bare_unit: str) -> Column:
    """Value in the target unit from text such as ``1.5m`` or ``120 cm``; NULL if unreadable."""
    if quantity not in UNITS:
        raise ValueError(f"unknown measurement type {quantity!r}")
    table = _spellings(quantity)
    for unit in (target_unit, bare_unit):
        if unit.lower() not in table:
            raise ValueError(f"unit {unit!r} is not valid for {quantity}")
    pattern = rf"^({NUMBER})\s*([^\d\s]+)?$"
    t = text(col)
    unit = F.translate(F.lower(F.regexp_extract(t, pattern, 2)), "μµ", "uu")
    unit = F.when(unit == "", F.lit(bare_unit.lower())).otherwise(unit)
    scales = F.create_map(*[F.lit(x) for k, (s, _) in table.items() for x in (k, s)])
    offsets = F.create_map(*[F.lit(x) for k, (_, o) in table.items() for x in (k, o)])
    to_scale, to_offset = table[target_unit.lower()]
    number = F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1).try_cast("double"))
    base = number * F.try_element_at(scales, unit) + F.try_element_at(offsets, unit)
    return (base - F.lit(to_offset)) / F.lit(to_scale)


def convert_column(df: DataFrame, column: str, rule: Conversion, out: str) -> DataFrame:
    """Add ``out`` (double) and ``out_error`` (a non-blank cell that cannot be converted)."""
    source = F.col(column)
    readable = F.col(out)
    if rule.mode == "number":
        value = plain_number(source)
    elif rule.mode == "date":
        if rule.date_origin.strip():
            origin = parse_date(F.lit(rule.date_origin))
        else:
            origin = df.agg(F.min(parse_date(source))).scalar()
        df = df.withColumn("__date", parse_date(source)).withColumn("__origin", origin)
        value = elapsed(F.col("__origin"), F.col("__date"), rule.date_unit)
        readable = F.col("__date")
    elif rule.mode == "measurement":
        value = measurement(source, rule.quantity, rule.target_unit, rule.bare_unit or rule.target_unit)
    else:
        raise ValueError(f"unknown conversion mode {rule.mode!r}")
    tiny = F.when(F.abs(value) < 5e-13, 0.0).otherwise(value)
    return (df.withColumn(out, tiny)
            .withColumn(f"{out}_error", (text(source) != "") & readable.isNull())
            .drop("__date", "__origin"))


def conversion_errors(df: DataFrame, column: str, out: str, row: str) -> DataFrame:
    return df.where(f"{out}_error").select(F.col(row).alias("row"), F.col(column).alias("value"))


def viewer_id(col: Column) -> Column:
    """Non-word characters to ``_``; a leading digit gets an ``L``."""
    safe = F.regexp_replace(F.coalesce(col, F.lit("")), r"[^A-Za-z0-9_]", "_")
    return F.when(safe.rlike("^[0-9]"), F.concat(F.lit("L"), safe)).otherwise(safe)


def edge_change_value(col: Column) -> Column:
    """A finite scalar clamped at zero, else the number of listed mutation tokens."""
    t = text(col)
    scalar = plain_number(t)
    tokens = F.size(F.filter(F.split(t, r"[\s,;]+"), lambda x: x != "")).cast("double")
    return F.when(t == "", 0.0).when(scalar.isNotNull(), F.greatest(scalar, F.lit(0.0))).otherwise(tokens)
