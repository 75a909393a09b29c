"""SWRL built-ins as Columns: 79 names in a table of functions.

A test gives a boolean Column; any other gives the value for its first argument.
Months are integers (Spark's year-month intervals cannot be collected), times of
day are seconds, day-time durations are intervals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TESTS = {
    "equal", "notEqual", "lessThan", "lessThanOrEqual", "greaterThan", "greaterThanOrEqual", "stringEqualIgnoreCase", "containsIgnoreCase",
    "contains", "startsWith", "endsWith", "matches", "member", "empty",
}
DAY = 86_400


def _months(ts: Column, months: Column) -> Column:
    return F.timestamp_add("MONTH", months.cast("int"), ts)


def _date_months(d: Column, months: Column) -> Column:
    return F.add_months(d, months.cast("int"))


def _seconds(interval: Column) -> Column:
    return (F.extract(F.lit("DAY"), interval) * DAY + F.extract(F.lit("HOUR"), interval) * 3600 + F.extract(F.lit("MINUTE"), interval) * 60 + F.extract(F.lit("SECOND"), interval)).cast("long")


def _before(x: Column, mark: Column) -> Column:
    return F.when(F.contains(x, mark), F.substring(x, F.lit(1), F.instr(x, mark) - 1)).otherwise("")


def _after(x: Column, mark: Column) -> Column:
    return F.when(F.contains(x, mark), F.substring(x, F.instr(x, mark) + F.length(mark), F.length(x))).otherwise("")


def _whole(x: Column, pattern: Column) -> Column:
    return F.regexp_like(x, F.concat(F.lit("^(?:"), pattern, F.lit(")$")))


def _substring(x: Column, start: Column, length: Column | None = None) -> Column:
    return F.substring(x, start.cast("int"), F.length(x) if length is None else length.cast("int"))


BUILTINS: dict[str, Callable[..., Column]] = {
    "equal": lambda a, b: a == b,
    "notEqual": lambda a, b: a != b,
    "lessThan": lambda a, b: a < b,
    "lessThanOrEqual": lambda a, b: a <= b,
    "greaterThan": lambda a, b: a > b,
    "greaterThanOrEqual": lambda a, b: a >= b,
    "add": lambda *x: reduce(lambda a, b: a + b, x),
    "subtract": lambda a, b: a - b,
    "multiply": lambda *x: reduce(lambda a, b: a * b, x),
    "divide": lambda a, b: F.try_divide(a, b),
    "integerDivide": lambda a, b: F.floor(F.abs(F.try_divide(a, b))) * F.signum(a) * F.signum(b),
    "mod": lambda a, b: F.try_mod(a, b),
    "pow": lambda a, b: F.pow(a, b),
    "unaryPlus": lambda a: a,
    "unaryMinus": lambda a: -a,
    "abs": lambda a: F.abs(a),
    "ceiling": lambda a: F.ceil(a),
    "floor": lambda a: F.floor(a),
    "round": lambda a: F.floor(a + 0.5),
    "roundHalfToEven": lambda a: F.bround(a),
    "sin": lambda a: F.sin(a),
    "cos": lambda a: F.cos(a),
    "tan": lambda a: F.tan(a),
    "booleanNot": lambda a: ~a,
    "stringEqualIgnoreCase": lambda a, b: F.lower(a) == F.lower(b),
    "containsIgnoreCase": lambda a, b: F.contains(F.lower(a), F.lower(b)),
    "contains": lambda a, b: F.contains(a, b),
    "startsWith": lambda a, b: F.startswith(a, b),
    "endsWith": lambda a, b: F.endswith(a, b),
    "matches": _whole,
    "stringConcat": lambda *x: F.concat(*x),
    "substring": _substring,
    "stringLength": lambda a: F.length(a),
    "upperCase": lambda a: F.upper(a),
    "lowerCase": lambda a: F.lower(a),
    "normalizeSpace": lambda a: F.trim(F.regexp_replace(a, "\\s+", " ")),
    "translate": lambda a, b, c: F.call_function("translate", a, b, c),
    "replace": lambda a, b, c: F.regexp_replace(a, b, c),
    "tokenize": lambda a, b: F.explode(F.call_function("split", a, b)),
    "substringBefore": _before,
    "substringAfter": _after,
    "yearMonthDuration": lambda years, months: (years * 12 + months).cast("int"),
    "dayTimeDuration": lambda d, h, m, s: F.make_dt_interval(d.cast("int"), h.cast("int"), m.cast("int"), s),
    "dateTime": lambda y, mo, d, h, mi, s: F.make_timestamp_ntz(y.cast("int"), mo.cast("int"), d.cast("int"), h.cast("int"), mi.cast("int"), s),
    "date": lambda y, m, d: F.make_date(y.cast("int"), m.cast("int"), d.cast("int")),
    "time": lambda h, m, s: (h * 3600 + m * 60 + s).cast("long"),
    "addYearMonthDurations": lambda *x: reduce(lambda a, b: a + b, x),
    "subtractYearMonthDurations": lambda a, b: a - b,
    "multiplyYearMonthDuration": lambda a, b: F.round(a * b).cast("int"),
    "divideYearMonthDurations": lambda a, b: F.try_divide(a, b),
    "addDayTimeDurations": lambda *x: reduce(lambda a, b: a + b, x),
    "subtractDayTimeDurations": lambda a, b: a - b,
    "multiplyDayTimeDurations": lambda a, b: a * b,
    "divideDayTimeDuration": lambda a, b: a / b,
    "subtractDates": lambda a, b: F.datediff(a, b).cast("long"),
    "subtractTimes": lambda a, b: a - b,
    "addYearMonthDurationToDateTime": _months,
    "addDayTimeDurationToDateTime": lambda a, b: a + b,
    "subtractYearMonthDurationFromDateTime": lambda a, b: _months(a, -b),
    "subtractDayTimeDurationFromDateTime": lambda a, b: a - b,
    "addYearMonthDurationToDate": _date_months,
    "addDayTimeDurationToDate": lambda a, b: (a.cast("timestamp_ntz") + b).cast("date"),
    "subtractYearMonthDurationFromDate": lambda a, b: _date_months(a, -b),
    "subtractDayTimeDurationFromDate": lambda a, b: (a.cast("timestamp_ntz") - b).cast("date"),
    "addDayTimeDurationToTime": lambda a, b: F.pmod(a + _seconds(b), F.lit(DAY)),
    "subtractDayTimeDurationFromTime": lambda a, b: F.pmod(a - _seconds(b), F.lit(DAY)),
    "subtractDateTimesYieldingYearMonthDuration": lambda a, b: F.months_between(a, b).cast("int"),
    "subtractDateTimesYieldingDayTimeDuration": lambda a, b: a - b,
    "resolveURI": lambda a, b: F.when(F.regexp_like(a, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), a).otherwise(F.concat(F.regexp_replace(b, "[^/]*$", ""), a)),
    "anyURI": lambda *x: F.concat(*x),
    "listConcat": lambda *x: F.concat(*x),
    "listIntersection": lambda a, b: F.array_intersect(a, b),
    "listSubtraction": lambda a, b: F.array_except(a, b),
    "member": lambda a, b: F.array_contains(b, a),
    "length": lambda a: F.size(a),
    "first": lambda a: F.get(a, F.lit(0)),
    "rest": lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))),
    "sublist": lambda a, b: F.exists(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: F.slice(a, i, F.size(b)) == b),
    "empty": lambda a: F.size(a) == 0,
}
