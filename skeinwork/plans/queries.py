"""One query for each operator or family of functions, with the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from .. import sources
from ..functions import hashing
from ..session import ensure_checkpoint_dir
from ..types import BOOL, DATETIME, DOUBLE, INT32, INT64, STRING, UINT32, Attribute, Schema, schema_of
from . import serde

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


a = fn.NamedAttribute


def scaled(e):
    """Doubles as whole millionths, so that engines' last digits do not matter."""
    return fn.RoundToInt(fn.Multiply(e, fn.ConstDouble(1e6)))


def sql_scaled(x: str) -> str:
    return f"CAST(round(({x}) * 1e6) AS BIGINT)"


def scalar_query(name: str, source: str, key: list[str], derived: dict[str, str], columns: list[tuple]):
    """``derived``: input columns in SQL that both engines read alike; ``columns``:
    (name, expression, SQL)."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, source).selectExpr(*key, *(f"{x} AS {n}" for n, x in derived.items()))
        return op.compute(df, fn.Flat(*map(a, key), *(fn.Alias(n, e) for n, e, _ in columns)))

    QUERIES[name] = run
    inner = ", ".join([*key, *(f"{x} AS {n}" for n, x in derived.items())])
    ORACLE_SQL[name] = f"SELECT {', '.join([*key, *(f'{x} AS {n}' for n, _, x in columns)])} FROM (SELECT {inner} FROM {source})"


# --------------------------------------------------------------------------
# scalar functions

_KEY = ["o_orderkey"]
_INTS = {
    "x": "CAST(o_orderkey % 11 - 5 AS INT)",
    "y": "CAST(o_custkey % 7 - 3 AS INT)",
    "n": "CAST(NULLIF(o_orderkey % 9, 4) AS INT)",
    "big": "CAST(o_orderkey * 1000003 AS BIGINT)",
    "d": "o_totalprice",
    "z": "CAST(o_custkey % 5 AS DOUBLE)",
}

scalar_query(
    "fn_arithmetic", "orders", _KEY, _INTS,
    [
        ("plus", fn.Plus(a("x"), a("y")), "CAST(x + y AS INT)"),
        ("minus", fn.Minus(a("x"), a("big")), "x - big"),
        ("multiply", fn.Multiply(a("n"), a("big")), "n * big"),
        ("negate", fn.Negate(a("x")), "CAST(-x AS INT)"),
        ("wrapped", fn.Multiply(a("x"), fn.ConstInt32(2**30)), "CAST((((x::BIGINT * 1073741824 + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648 AS INT)"),
        ("div_nulling", scaled(fn.DivideNulling(a("x"), a("y"))), f"CASE WHEN y <> 0 THEN {sql_scaled('x::DOUBLE / y')} END"),
        ("div_signaling", scaled(fn.DivideSignaling(a("x"), fn.Plus(fn.Multiply(a("y"), a("y")), fn.ConstInt32(1)))), sql_scaled("x::DOUBLE / (y * y + 1)")),
        ("div_plain", scaled(fn.Divide(a("d"), fn.ConstInt32(7))), sql_scaled("d / 7")),
        ("div_quiet_inf", fn.IsInf(fn.DivideQuiet(a("d"), a("z"))), "z = 0 AND d <> 0"),
        ("cpp_nulling", fn.CppDivideNulling(a("x"), a("y")), "CAST(CASE WHEN y <> 0 THEN trunc(x::DOUBLE / y) END AS INT)"),
        ("cpp_signaling", fn.CppDivideSignaling(a("big"), fn.ConstInt64(7)), "CAST(big // 7 AS BIGINT)"),
        ("cpp_plain", fn.CppDivide(a("x"), fn.ConstInt32(2)), "CAST(trunc(x / 2.0) AS INT)"),
        ("mod_nulling", fn.ModulusNulling(a("x"), a("y")), "CAST(CASE WHEN y <> 0 THEN x % y END AS INT)"),
        ("mod_signaling", fn.ModulusSignaling(a("x"), fn.ConstInt32(3)), "CAST(x % 3 AS INT)"),
        ("mod_plain", fn.Modulus(a("big"), fn.ConstInt64(10)), "big % 10"),
        ("is_odd", fn.IsOdd(a("x")), "x % 2 <> 0"),
        ("is_even", fn.IsEven(a("n")), "n % 2 = 0"),
    ],
)

_B = {"p": "o_orderkey % 2 = 0", "q": "NULLIF(o_custkey % 3, 1) = 0"} | _INTS
scalar_query(
    "fn_logic_control", "orders", _KEY, _B,
    [
        ("and_", fn.And(a("p"), a("q")), "p AND q"),
        ("and_not", fn.AndNot(a("p"), a("q")), "(NOT p) AND q"),
        ("or_", fn.Or(a("p"), a("q")), "p OR q"),
        ("xor_", fn.Xor(a("p"), a("q")), "p <> q"),
        ("not_", fn.Not(a("q")), "NOT q"),
        ("is_null", fn.IsNull(a("q")), "q IS NULL"),
        ("if_null", fn.IfNull(a("n"), a("x")), "coalesce(n, x)"),
        ("if_", fn.If(a("q"), a("x"), a("y")), "CASE WHEN q THEN x ELSE y END"),
        ("nulling_if", fn.NullingIf(a("q"), a("x"), a("y")), "CASE WHEN q THEN x WHEN NOT q THEN y END"),
        ("case_", fn.Case([a("n"), fn.ConstInt32(-1), fn.ConstInt32(1), fn.ConstInt32(10), fn.ConstInt32(2), a("x")]), "CASE n WHEN 1 THEN 10 WHEN 2 THEN x ELSE -1 END"),
        ("null_", fn.Null(INT32), "CAST(NULL AS INT)"),
        ("c_int64", fn.ConstInt64(2**40), "1099511627776"),
        ("c_uint32", fn.ConstUint32(4000000000), "4000000000"),
        ("c_double", fn.ConstDouble(0.5), "0.5::DOUBLE"),
        ("c_bool", fn.ConstBool(True), "TRUE"),
        ("c_string", fn.ConstString("it"), "'it'"),
        ("c_date", fn.ConstDate(365), "DATE '1971-01-01'"),
        ("c_datetime", fn.ConstDateTime("2001/02/03-04:05:06"), "TIMESTAMP '2001-02-03 04:05:06'"),
    ],
)

scalar_query(
    "fn_compare", "orders", _KEY, _INTS,
    [
        ("eq", fn.Equal(a("x"), a("y")), "x = y"),
        ("ne", fn.NotEqual(a("x"), a("n")), "x <> n"),
        ("lt", fn.Less(a("x"), a("big")), "x < big"),
        ("le", fn.LessOrEqual(a("n"), a("y")), "n <= y"),
        ("gt", fn.Greater(a("d"), a("big")), "d > big"),
        ("ge", fn.GreaterOrEqual(a("x"), a("z")), "x >= z"),
        ("in_constants", fn.In(a("n"), [fn.ConstInt32(1), fn.ConstInt32(2), fn.ConstInt32(8)]), "n IN (1, 2, 8)"),
        ("in_columns", fn.In(a("x"), [a("y"), a("n")]), "x IN (y, n)"),
    ],
)

scalar_query(
    "fn_bits", "orders", _KEY, _INTS,
    [
        ("b_not", fn.BitwiseNot(a("x")), "CAST(-x - 1 AS INT)"),
        ("b_and", fn.BitwiseAnd(a("x"), a("y")), "CAST(x & y AS INT)"),
        ("b_and_not", fn.BitwiseAndNot(a("x"), a("y")), "CAST((~x) & y AS INT)"),
        ("b_or", fn.BitwiseOr(a("big"), a("x")), "big | x::BIGINT"),
        ("b_xor", fn.BitwiseXor(a("x"), a("n")), "CAST(xor(x, n) AS INT)"),
        ("s_left", fn.ShiftLeft(fn.Abs(a("x")), fn.ConstInt32(3)), "abs(x)::BIGINT * 8"),
        ("s_right", fn.ShiftRight(a("x"), fn.ConstInt32(1)), "CAST(floor(x / 2.0) AS INT)"),
        ("b_not_unsigned", fn.BitwiseNot(fn.CastTo(UINT32, a("x"))), "(4294967296 + (-x - 1)::BIGINT) % 4294967296"),
    ],
)

_TEXT = {
    "s": "o_orderpriority",
    "t": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('  ', o_orderstatus, '-', CAST(o_custkey AS VARCHAR(20)), ' ') END",
    "pos": "CAST(o_orderkey % 13 - 6 AS INT)",
    "len": "CAST(o_custkey % 6 - 1 AS INT)",
}
_START = "(CASE WHEN pos > 0 THEN pos ELSE greatest(pos + strlen(s) + 1, 1) END)"
scalar_query(
    "fn_strings", "orders", _KEY, _TEXT,
    [
        ("length", fn.Length(a("t")), "strlen(t)"),
        ("ltrim_", fn.Ltrim(a("t")), "ltrim(t)"),
        ("rtrim_", fn.Rtrim(a("t")), "rtrim(t)"),
        ("trim_", fn.Trim(a("t")), "trim(t)"),
        ("upper_", fn.ToUpper(a("s")), "upper(s)"),
        ("lower_", fn.ToLower(a("s")), "lower(s)"),
        ("trailing", fn.TrailingSubstring(a("s"), a("pos")), f"substring(s, CAST({_START} AS INT), 1000)"),
        ("part", fn.Substring(a("s"), a("pos"), a("len")), f"substring(s, CAST({_START} AS INT), greatest(len, 0))"),
        ("at_", fn.StringOffset(a("s"), fn.ConstString("I")), "CAST(instr(s, 'I') AS INT)"),
        ("has", fn.StringContains(a("s"), fn.ConstString("EDI")), "contains(s, 'EDI')"),
        ("has_ci", fn.StringContainsCI(a("s"), fn.ConstString("edi")), "contains(lower(s), 'edi')"),
        ("replaced", fn.StringReplace(a("s"), fn.ConstString("I"), fn.ConstString("$1")), "replace(s, 'I', '$1')"),
        ("joined", fn.Concat([a("s"), a("pos"), a("t")]), "CASE WHEN t IS NOT NULL THEN s || pos::VARCHAR || t END"),
    ],
)

scalar_query(
    "fn_to_string_parse", "orders", _KEY,
    {
        "i": "CAST(o_orderkey % 100 - 50 AS INT)", "ok": "o_orderkey % 2 = 0", "whole": "CAST(o_orderkey - 700 AS DOUBLE)", "half": "o_orderkey / 4.0e0", "ts": "o_orderdate",
        "raw": "CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN ' NO ' WHEN 2 THEN '12' WHEN 3 THEN '-3.5' ELSE '2001/02/03-04:05:06' END",
    },
    [
        ("s_int", fn.ToString(a("i")), "i::VARCHAR"),
        ("s_bool", fn.ToString(a("ok")), "CASE WHEN ok THEN 'TRUE' ELSE 'FALSE' END"),
        ("s_whole", fn.ToString(a("whole")), "whole::BIGINT::VARCHAR"),
        ("s_half", fn.ToString(a("half")), "CASE WHEN half = floor(half) THEN half::BIGINT::VARCHAR ELSE half::VARCHAR END"),
        ("s_ts", fn.ToString(a("ts")), "strftime(ts, '%Y/%m/%d-%H:%M:%S')"),
        ("p_bool", fn.ParseStringNulling(BOOL, a("raw")), "CASE lower(trim(raw)) WHEN 'yes' THEN TRUE WHEN 'no' THEN FALSE END"),
        ("p_int", fn.ParseStringNulling(INT32, a("raw")), "CASE WHEN raw = '12' THEN 12 END"),
        ("p_double", fn.ParseStringQuiet(DOUBLE, a("raw")), "CASE raw WHEN '12' THEN 12.0::DOUBLE WHEN '-3.5' THEN -3.5::DOUBLE END"),
        ("p_ts", fn.ParseStringNulling(DATETIME, a("raw")), "CASE WHEN raw LIKE '2001%' THEN TIMESTAMP '2001-02-03 04:05:06' END"),
        ("cast_double", fn.CastTo(DOUBLE, a("i")), "i::DOUBLE"),
        ("cast_uint", fn.CastTo(UINT32, a("i")), "(i::BIGINT + 4294967296) % 4294967296"),
    ],
)

scalar_query(
    "fn_regexps", "orders", _KEY, {"s": "o_orderpriority", "new": "concat('<', o_orderstatus, '$', CHR(92), '1>')"},
    [
        ("partial_", fn.RegexpPartialMatch(a("s"), "[A-Z]{4,}"), "regexp_matches(s, '[A-Z]{4,}')"),
        ("full_", fn.RegexpFullMatch(a("s"), r"\d-[A-Z ]+"), r"regexp_full_match(s, '\d-[A-Z ]+')"),
        ("extract_", fn.RegexpExtract(a("s"), r"-(H\w+)"), r"NULLIF(regexp_extract(s, '-(H\w+)', 1), '')"),
        ("replace_", fn.RegexpReplace(a("s"), "([AEIOU])", a("new")), r"regexp_replace(s, '([AEIOU])', new, 'g')"),
    ],
)

_T = {"ts": "o_orderdate", "k": "CAST(o_orderkey % 40 - 20 AS INT)", "secs": "o_orderkey * 86399", "yy": "CAST(1990 + o_orderkey % 60 AS INT)", "mm": "CAST(o_custkey % 20 + 1 AS INT)"}
_ROLLED = "(make_date(yy + (mm - 1) // 12, (mm - 1) % 12 + 1, 1)::TIMESTAMP + INTERVAL 30 DAY)"
scalar_query(
    "fn_dates", "orders", _KEY, _T,
    [
        ("year_", fn.Year(a("ts")), "CAST(year(ts) AS INT)"),
        ("quarter_", fn.Quarter(a("ts")), "CAST(quarter(ts) AS INT)"),
        ("month_", fn.Month(a("ts")), "CAST(month(ts) AS INT)"),
        ("day_", fn.Day(a("ts")), "CAST(day(ts) AS INT)"),
        ("weekday_", fn.Weekday(a("ts")), "CAST(isodow(ts) - 1 AS INT)"),
        ("yearday_", fn.YearDay(a("ts")), "CAST(dayofyear(ts) AS INT)"),
        ("hour_", fn.Hour(fn.AddMinutes(a("ts"), a("k"))), "CAST(hour(ts + to_minutes(k)) AS INT)"),
        ("minute_", fn.Minute(fn.AddMinute(a("ts"))), "CAST(minute(ts + INTERVAL 1 MINUTE) AS INT)"),
        ("second_", fn.Second(fn.FromUnixTime(a("secs"))), "CAST(secs % 60 AS INT)"),
        ("micro_", fn.Microsecond(a("ts")), "CAST(epoch_us(ts) % 1000000 AS INT)"),
        ("local_hour", fn.HourLocal(a("ts"), "Asia/Kolkata"), "CAST(hour(ts + INTERVAL 330 MINUTE) AS INT)"),
        ("local_day", fn.DayLocal(a("ts"), "Asia/Kolkata"), "CAST(day(ts + INTERVAL 330 MINUTE) AS INT)"),
        ("unix_", fn.UnixTimestamp(a("ts")), "epoch_us(ts) // 1000000"),
        ("from_unix", fn.FromUnixTime(a("secs")), "make_timestamp(secs * 1000000)"),
        ("plus_days", fn.AddDays(a("ts"), a("k")), "ts + to_days(k)"),
        ("plus_day", fn.AddDay(a("ts")), "ts + INTERVAL 1 DAY"),
        ("plus_months", fn.AddMonths(a("ts"), a("k")), "date_trunc('month', ts) + to_months(k) + to_days(CAST(day(ts) - 1 AS INT)) + (ts - date_trunc('day', ts))"),
        ("plus_month", fn.AddMonth(a("ts")), "date_trunc('month', ts) + INTERVAL 1 MONTH + to_days(CAST(day(ts) - 1 AS INT)) + (ts - date_trunc('day', ts))"),
        ("made", fn.MakeDate(a("yy"), a("mm"), fn.ConstInt32(31)), _ROLLED),
        ("made_time", fn.MakeDatetime(a("yy"), a("mm"), fn.ConstInt32(31), fn.ConstInt32(23), fn.ConstInt32(59), fn.ConstInt32(61)), f"{_ROLLED} + INTERVAL 86401 SECOND"),
        ("text_", fn.DateFormat(a("ts"), "%Y-%m-%d %H:%M"), "strftime(ts, '%Y-%m-%d %H:%M')"),
        ("long_text", fn.DateFormat(a("ts"), "%Y %Y %Y %Y %Y %Y %Y"), "''"),
        ("local_text", fn.DateFormatLocal(a("ts"), "%H:%M:%S", "Asia/Kolkata"), "strftime(ts + INTERVAL 330 MINUTE, '%H:%M:%S')"),
    ],
)

_M = {"d": "o_totalprice / 1.0e4", "u": "(o_orderkey % 2000 - 1000) / 1.0e3", "g": "CAST(o_custkey % 9 - 4 AS DOUBLE)", "i": "CAST(o_orderkey % 21 - 10 AS INT)", "e": "CAST(o_orderkey % 4 AS INT)"}


def _pair(name, make, sql):
    return (name, scaled(make), sql_scaled(sql))


def _guarded(name, make, sql, guard):
    return (name, scaled(make), f"CASE WHEN {guard} THEN {sql_scaled(sql)} END")


scalar_query(
    "fn_math_transcendental", "orders", _KEY, _M,
    [
        _pair("exp_", fn.Exp(a("u")), "exp(u)"),
        _guarded("ln_nulling", fn.LnNulling(a("g")), "ln(CASE WHEN g > 0 THEN g END)", "g > 0"),
        ("ln_quiet_inf", fn.IsInf(fn.LnQuiet(a("g"))), "g = 0"),
        ("ln_quiet_nan", fn.IsNaN(fn.LnQuiet(a("g"))), "g < 0"),
        _guarded("log10_nulling", fn.Log10Nulling(a("g")), "log10(CASE WHEN g > 0 THEN g END)", "g > 0"),
        ("log10_quiet", fn.IsFinite(fn.Log10Quiet(a("g"))), "g > 0"),
        _guarded("log2_nulling", fn.Log2Nulling(a("g")), "log2(CASE WHEN g > 0 THEN g END)", "g > 0"),
        ("log2_quiet", fn.IsNormal(fn.Log2Quiet(a("g"))), "g > 1"),
        _guarded("log_nulling", fn.LogNulling(a("g"), a("d")), "ln(d) / ln(CASE WHEN g > 1 THEN g END)", "g > 1 AND d > 0"),
        ("log_quiet", fn.IsFinite(fn.LogQuiet(a("g"), a("d"))), "g > 1 OR g = 0"),
        _pair("sin_", fn.Sin(a("d")), "sin(d)"),
        _pair("cos_", fn.Cos(a("d")), "cos(d)"),
        _pair("tan_", fn.Tan(a("u")), "tan(u)"),
        _guarded("cot_", fn.NullingIf(fn.NotEqual(a("u"), fn.ConstDouble(0)), fn.Cot(a("u")), fn.Null(DOUBLE)), "1 / tan(u)", "u <> 0"),
        _pair("asin_", fn.Asin(a("u")), "asin(u)"),
        _pair("acos_", fn.Acos(a("u")), "acos(u)"),
        _pair("atan_", fn.Atan(a("d")), "atan(d)"),
        _pair("atan2_", fn.Atan2(a("u"), a("g")), "atan2(u, g)"),
        _pair("sinh_", fn.Sinh(a("u")), "sinh(u)"),
        _pair("cosh_", fn.Cosh(a("u")), "cosh(u)"),
        _pair("tanh_", fn.Tanh(a("u")), "tanh(u)"),
        _pair("asinh_", fn.Asinh(a("u")), "asinh(u)"),
        _pair("acosh_", fn.Acosh(fn.Plus(a("d"), fn.ConstDouble(1))), "acosh(d + 1)"),
        _pair("atanh_", fn.Atanh(fn.Divide(a("u"), fn.ConstDouble(2))), "atanh(u / 2)"),
        _pair("degrees_", fn.ToDegrees(a("u")), "degrees(u)"),
        _pair("radians_", fn.ToRadians(a("d")), "radians(d)"),
        _pair("pi_", fn.Pi(), "pi()"),
    ],
)

scalar_query(
    "fn_math_rounding", "orders", _KEY, _M,
    [
        ("abs_int", fn.Abs(a("i")), "abs(i)::BIGINT"),
        ("abs_double", fn.Abs(a("u")), "abs(u)"),
        ("round_", fn.Plus(fn.Round(fn.Multiply(a("u"), fn.ConstDouble(10))), fn.ConstDouble(0)), "round(u * 10) + 0.0"),
        ("ceil_", fn.Plus(fn.Ceil(a("u")), fn.ConstDouble(0)), "ceil(u) + 0.0"),
        ("floor_", fn.Floor(a("u")), "floor(u)"),
        ("trunc_", fn.Plus(fn.Trunc(a("d")), fn.ConstDouble(0)), "trunc(d) + 0.0"),
        ("round_to_int", fn.RoundToInt(a("d")), "round(d)::BIGINT"),
        ("ceil_to_int", fn.CeilToInt(a("d")), "ceil(d)::BIGINT"),
        ("floor_to_int", fn.FloorToInt(a("d")), "floor(d)::BIGINT"),
        _pair("round_precision", fn.RoundWithPrecision(a("d"), a("e")), "round(d * power(10.0::DOUBLE, e)) / power(10.0::DOUBLE, e)"),
        _guarded("sqrt_nulling", fn.SqrtNulling(a("u")), "sqrt(CASE WHEN u >= 0 THEN u END)", "u >= 0"),
        ("sqrt_quiet", fn.IsNaN(fn.SqrtQuiet(a("u"))), "u < 0"),
        _pair("sqrt_signaling", fn.SqrtSignaling(a("d")), "sqrt(d)"),
        _guarded("power_nulling", fn.PowerNulling(a("g"), fn.Divide(a("e"), fn.ConstDouble(2))), "power(CASE WHEN g >= 0 OR e % 2 = 0 THEN g END, e / 2.0)", "g >= 0 OR e % 2 = 0"),
        ("power_quiet", fn.IsNaN(fn.PowerQuiet(a("g"), fn.ConstDouble(0.5))), "g < 0"),
        _pair("power_signaling", fn.PowerSignaling(a("d"), a("e")), "power(d, e)"),
        ("finite", fn.IsFinite(a("u")), "TRUE"),
        ("normal", fn.IsNormal(a("g")), "g <> 0"),
        ("nan_", fn.IsNaN(fn.DivideQuiet(a("g"), a("g"))), "g = 0"),
        ("text_", fn.Format(a("d"), fn.ConstInt32(1)), "printf('%.1f', d)"),
    ],
)


def _hash_sql(data: str, size: str, seed: str) -> str:
    """The hash of ``size`` bytes; ``data`` gives the byte at place ``i`` (from 0)."""
    primes = "[" + ", ".join(map(str, hashing.PRIMES)) + "]"
    low = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    chunk = f"list_sum(list_transform(range(4 * t, least(4 * t + 4, {size})), lambda i: ({data})::UBIGINT << (8 * (i - 4 * t))::UBIGINT))"
    terms = f"list_transform(range(({size} + 3) // 4), lambda t: {{'p': {primes}[t % 16 + 1]::UHUGEINT, 'c': {low(f'{chunk}::UHUGEINT * {primes}[(t + 8) % 16 + 1]::UHUGEINT')}}})"
    step = f"lambda s, x: {{'p': 0::UHUGEINT, 'c': xor({low('s.c::UHUGEINT * x.p')}, x.c)}}"
    return f"CAST((list_reduce({terms}, {step}, {{'p': 0::UHUGEINT, 'c': {seed}::UBIGINT}})).c AS DECIMAL(20, 0))"


@query(
    "fn_hashing",
    f"""SELECT c_custkey, {_hash_sql("ascii(substr(c_name, i::INT + 1, 1))", "strlen(c_name)", str(hashing.FINGERPRINT_SEED))} AS fingerprint,
    {_hash_sql("(c_custkey >> (8 * i)) & 255", "8", "7")} AS hash, {_hash_sql("ascii(substr(c_name, i::INT + 1, 1))", "strlen(c_name)", "18446744073709551615")} AS large_seed FROM customer""",
)
def _hashing(spark, sf_dir):
    """64-bit fingerprints and hashes of plain text and numbers."""
    df = table(spark, sf_dir, "customer")
    fingerprint = fn.Alias("fingerprint", fn.Fingerprint(a("c_name")))
    hashed = fn.Alias("hash", fn.Hash(a("c_custkey"), fn.ConstUint64(7)))
    return op.compute(df, fn.Flat(a("c_custkey"), fingerprint, hashed, fn.Alias("large_seed", fn.Hash(a("c_name"), fn.ConstUint64(2**64 - 1)))))


@query("fn_random", "SELECT o_orderkey, TRUE AS seeded_repeats, TRUE AS whole FROM orders")
def _random(spark, sf_dir):
    """What holds of every draw: a seed repeats it, and an INT32 comes out, seeded or not."""
    r = fn.RandInt32(3)
    whole = fn.And(fn.LessOrEqual(fn.ConstInt64(-(2**31)), fn.RandInt32()), fn.Less(r, fn.ConstInt64(2**31)))
    return op.compute(table(spark, sf_dir, "orders"), fn.Flat(a("o_orderkey"), fn.Alias("seeded_repeats", fn.Equal(r, fn.RandInt32(3))), fn.Alias("whole", whole)))


scalar_query(
    "fn_constants", "orders", _KEY, {"v": "o_orderstatus"},
    [
        ("c_uint64", fn.CastTo(INT64, fn.ConstUint64(2**62)), "4611686018427387904"),
        ("c_float", fn.ConstFloat(0.5), "0.5::FLOAT"),
        ("c_binary", fn.CastTo(STRING, fn.ConstBinary(b"ab")), "'ab'"),
        ("c_data_type", fn.ToString(fn.ConstDataType(INT32)), "'INT32'"),
        ("c_micros", fn.ConstDateTimeFromMicrosecondsSinceEpoch(1_500_000), "TIMESTAMP '1970-01-01 00:00:01.5'"),
        ("c_seconds", fn.ConstDateTimeFromSecondsSinceEpoch(86400.25), "TIMESTAMP '1970-01-02 00:00:00.25'"),
        ("is_later", fn.Greater(fn.Now(), fn.ConstDateTime("2020/01/01-00:00:00")), "TRUE"),
        ("first_column", fn.AttributeAt(0), "o_orderkey"),
    ],
)

_INDIA = "ts + INTERVAL 330 MINUTE"
scalar_query(
    "fn_dates_local", "orders", _KEY, {"ts": "o_orderdate"},
    [
        (name, make(a("ts"), "Asia/Kolkata"), f"CAST({sql} AS INT)")
        for name, make, sql in (
            ("l_year", fn.YearLocal, f"year({_INDIA})"), ("l_quarter", fn.QuarterLocal, f"quarter({_INDIA})"), ("l_month", fn.MonthLocal, f"month({_INDIA})"),
            ("l_weekday", fn.WeekdayLocal, f"isodow({_INDIA}) - 1"), ("l_yearday", fn.YearDayLocal, f"dayofyear({_INDIA})"), ("l_hour", fn.HourLocal, f"hour({_INDIA})"),
            ("l_minute", fn.MinuteLocal, f"minute({_INDIA})"), ("l_second", fn.SecondLocal, f"second({_INDIA})"), ("l_micro", fn.MicrosecondLocal, f"epoch_us({_INDIA}) % 1000000"),
        )
    ],
)

scalar_query(
    "fn_log_defaults", "orders", _KEY, _M,
    [
        _guarded("ln_", fn.Ln(a("g")), "ln(CASE WHEN g > 0 THEN g END)", "g > 0"),
        _guarded("log10_", fn.Log10(a("g")), "log10(CASE WHEN g > 0 THEN g END)", "g > 0"),
        _guarded("log_", fn.Log(a("g"), a("d")), "ln(d) / ln(CASE WHEN g > 1 THEN g END)", "g > 1 AND d > 0"),
        _pair("sqrt_", fn.Sqrt(a("d")), "sqrt(d)"),
        ("sqrt_nan", fn.IsNaN(fn.Sqrt(a("u"))), "u < 0"),
    ],
)


# --------------------------------------------------------------------------
# relational operators


@query(
    "slice_join_group_sort",
    """SELECT o_orderpriority, CAST(round(sum(l_quantity)) AS BIGINT) AS quantity, count(*) AS rows_, min(l_quantity) AS least, max(l_extendedprice) AS most,
    count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 10 GROUP BY o_orderpriority ORDER BY o_orderpriority""",
)
def flagship(spark, sf_dir):
    both = op.CompoundMultiSourceProjector().add(0, fn.ProjectNamedAttributes(["l_quantity", "l_extendedprice", "l_suppkey"])).add(1, a("o_orderpriority"))
    joined = op.hash_join(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), op.INNER, a("l_orderkey"), a("o_orderkey"), both, op.UNIQUE)
    kept = op.filter_rows(joined, fn.Greater(a("l_quantity"), fn.ConstInt32(10)))
    spec = op.AggregationSpecification().add(op.SUM, "l_quantity", "quantity").add(op.COUNT, "", "rows_").add(op.MIN, "l_quantity", "least").add(op.MAX, "l_extendedprice", "most").add_distinct(op.COUNT, "l_suppkey", "suppliers")
    grouped = op.group_aggregate(kept, ["o_orderpriority"], spec)
    named = fn.Flat(a("o_orderpriority"), fn.Alias("quantity", fn.RoundToInt(a("quantity"))), fn.ProjectNamedAttributes(["rows_", "least", "most", "suppliers"]))
    return op.sort(op.project(grouped, named), op.SortOrder().add(a("o_orderpriority")))


@query("op_project", "SELECT o_custkey, o_orderkey AS key_, o_orderstatus AS p_o_orderstatus, o_orderkey AS again FROM orders")
def _project(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    prefixed = fn.ProjectRename(["p_o_orderstatus"], a("o_orderstatus"))
    return op.project(df, fn.Flat(fn.ProjectAttributeAt(1), fn.ProjectNamedAttributeAs("o_orderkey", "key_"), prefixed, fn.ProjectRenameSingle("again", fn.ProjectAttributesAt([0]))))


@query("op_project_all", "SELECT r_regionkey, r_name, r_regionkey AS p_r_regionkey, r_name AS p_r_name, r_name AS second, r_regionkey AS first FROM region")
def _project_all(spark, sf_dir):
    named = fn.CompoundSingleSourceProjector().add(fn.ProjectAttributeAtAs(1, "second")).add_as("first", fn.ProjectNamedAttribute("r_regionkey"))
    all_ = fn.InputAttributeProjection(fn.ProjectAllAttributes())
    return op.project(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), fn.Projection(all_, fn.ProjectAllAttributes("p_"), named))


@query("op_table_scan", "SELECT * FROM (VALUES (1::BIGINT, 'one'), (2, NULL), (1, 'one')) AS t(k, v)")
def _table_scan(spark, sf_dir):
    held = sources.Table(spark, Schema([Attribute("k", INT64, False), Attribute("v", STRING, True)]))
    return sources.scan_view(held.append(1, "one").append(2, None).append(1, "one").scan())


@query("op_file_roundtrip", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _roundtrip(spark, sf_dir):
    """Written as a file and by a writer into a sink, and read back, by its schema too."""
    path = f"{ensure_checkpoint_dir(spark)}/roundtrip-{uuid.uuid4().hex}"
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sources.file_output(df, f"{path}/file")
    sources.Writer(df).write_all(sources.FileSink(f"{path}/sink"))
    return sources.file_input(spark, f"{path}/file").unionByName(sources.file_input(spark, f"{path}/sink", schema_of(df)))


@query("op_compute", "SELECT CAST(o_orderkey * 2 AS BIGINT) AS twice, o_totalprice > 100000 AS dear FROM orders")
def _compute(spark, sf_dir):
    e = fn.CompoundExpression().add_as("twice", fn.Multiply(a("o_orderkey"), fn.ConstInt64(2))).add_as_multi(["dear"], fn.Greater(a("o_totalprice"), fn.ConstDouble(1e5)))
    return op.compute(table(spark, sf_dir, "orders"), e)


@query("op_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1e5")
def _filter(spark, sf_dir):
    p = fn.And(fn.Equal(a("o_orderstatus"), fn.ConstString("F")), fn.Greater(a("o_totalprice"), fn.ConstDouble(1e5)))
    return op.filter_rows(table(spark, sf_dir, "orders"), p, fn.ProjectNamedAttributes(["o_orderkey", "o_totalprice"]))


@query("op_foreign_filter", "WITH f AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer WHERE c_mktsegment = 'BUILDING') SELECT place AS o_custkey, o_orderkey FROM orders JOIN f ON o_custkey = c_custkey")
def _foreign(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return op.foreign_filter(keys, "c_custkey", "o_custkey", table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"))


def _sides(left, right):
    return op.CompoundMultiSourceProjector().add(0, fn.ProjectNamedAttributes(left)).add(1, fn.ProjectNamedAttributes(right))


@query("op_hash_join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _inner(spark, sf_dir):
    return op.hash_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), op.INNER, a("o_custkey"), a("c_custkey"), _sides(["o_orderkey"], ["c_name"]))


@query("op_hash_join_left", "WITH o AS (SELECT *, NULLIF(o_custkey % 40, 3) AS k FROM orders), n AS (SELECT *, n_nationkey::BIGINT AS nk FROM nation) SELECT o_orderkey, n_name FROM o LEFT JOIN n ON k = nk")
def _left(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "NULLIF(o_custkey % 40, 3) AS k")
    n = table(spark, sf_dir, "nation").selectExpr("n_name", "CAST(n_nationkey AS BIGINT) AS nk")
    return op.hash_join(o, n, op.LEFT_OUTER, a("k"), a("nk"), _sides(["o_orderkey"], ["n_name"]))


@query("op_hash_join_unique", "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _unique(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return op.hash_join(table(spark, sf_dir, "customer"), o, op.INNER, a("c_custkey"), a("o_custkey"), _sides(["c_custkey"], ["o_orderkey"]), op.UNIQUE, [F.col("o_orderkey")])


@query("op_hash_join_two_keys", "SELECT l.l_orderkey, l.l_linenumber, r.l_suppkey AS other FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) l JOIN (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem) r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber")
def _two(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    r = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey AS other")
    keys = fn.ProjectNamedAttributes(["l_orderkey", "l_linenumber"])
    return op.hash_join(l, r, op.INNER, keys, keys, _sides(["l_orderkey", "l_linenumber"], ["other"]))


@query("op_rowid_merge_join", "WITH r AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS id FROM nation) SELECT o_orderkey, n_name FROM orders JOIN r ON o_custkey % 25 = id")
def _rowid(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 25 AS k")
    return op.rowid_merge_join(o, "k", table(spark, sf_dir, "nation"), [F.col("n_nationkey")], _sides(["o_orderkey"], ["n_name"]))


@query("op_scan_selection", "WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS id FROM nation) SELECT n_name, n_regionkey FROM region r JOIN n ON id = (r_regionkey * 2) % 6")
def _selection(spark, sf_dir):
    ids = table(spark, sf_dir, "region").selectExpr("r_regionkey AS position", "CAST((r_regionkey * 2) % 6 AS BIGINT) AS row_id")
    return op.scan_with_selection(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), [F.col("n_nationkey")], ids).select("n_name", "n_regionkey")


_AGGREGATES = """count(*) AS n, count(v) AS c, sum(v)::INT AS s, min(v) AS lo, max(v) AS hi, string_agg(v::VARCHAR, ',' ORDER BY event_id) AS l,
    min_by(v, event_id) FILTER (v IS NOT NULL) AS f, max_by(v, event_id) FILTER (v IS NOT NULL) AS z, count(DISTINCT v) AS dc, sum(DISTINCT v)::BIGINT AS ds, min(DISTINCT v) AS dm, max(DISTINCT v) AS dx"""


def _all_aggregates():
    s = op.AggregationSpecification()
    s.add(op.COUNT, "", "n").add(op.COUNT, "v", "c").add(op.SUM, "v", "s").add(op.MIN, "v", "lo").add(op.MAX, "v", "hi").add(op.CONCAT, "v", "l").add(op.FIRST, "v", "f").add(op.LAST, "v", "z")
    return s.add_distinct(op.COUNT, "v", "dc").add_distinct(op.SUM, "v", "ds", INT64).add_distinct(op.MIN, "v", "dm").add_distinct(op.MAX, "v", "dx")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "user_id", "CAST(NULLIF(user_id % 10, 3) AS INT) AS v", "value", "ts")


_EVENTS = "(SELECT event_id, event_type, user_id, CAST(NULLIF(user_id % 10, 3) AS INT) AS v, value, ts FROM events)"


def by(*names):
    return [F.col(n) for n in names]


@query("op_group_aggregate", f"SELECT user_id, {_AGGREGATES} FROM {_EVENTS} GROUP BY user_id")
def _group(spark, sf_dir):
    return op.group_aggregate(_events(spark, sf_dir), ["user_id"], _all_aggregates(), by("event_id"))


@query("op_group_null_keys", f"SELECT v, event_type, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS s FROM {_EVENTS} GROUP BY 1, 2")
def _null_keys(spark, sf_dir):
    g = op.group_aggregate(_events(spark, sf_dir), ["v", "event_type"], op.AggregationSpecification().add(op.COUNT, "", "n").add(op.SUM, "value", "s"))
    return op.project(g, fn.Flat(fn.ProjectNamedAttributes(["v", "event_type", "n"]), fn.Alias("s", fn.RoundToInt(fn.Multiply(a("s"), fn.ConstDouble(100))))))


@query("op_group_no_keys", "SELECT * FROM (SELECT count(*) AS n, sum(user_id)::BIGINT AS s FROM events) WHERE n > 0")
def _no_keys(spark, sf_dir):
    return op.group_aggregate(_events(spark, sf_dir), [], op.AggregationSpecification().add(op.COUNT, "", "n").add(op.SUM, "user_id", "s"))


@query("op_scalar_aggregate", "SELECT count(*) AS n, sum(user_id)::BIGINT AS s, max(event_type) AS m FROM events")
def _scalar(spark, sf_dir):
    return op.scalar_aggregate(_events(spark, sf_dir), op.AggregationSpecification().add(op.COUNT, "", "n").add(op.SUM, "user_id", "s").add(op.MAX, "event_type", "m"))


@query("op_group_hybrid", f"SELECT user_id, v, {_AGGREGATES} FROM {_EVENTS} GROUP BY user_id, v")
def _hybrid(spark, sf_dir):
    """Nearly as many groups as rows, plain and DISTINCT aggregates mixed."""
    return op.hybrid_group_aggregate(_events(spark, sf_dir), ["user_id", "v"], _all_aggregates(), by("event_id"))


@query("op_group_best_effort", f"SELECT user_id, count(*) AS n, sum(v)::INT AS s, max(v) AS hi FROM {_EVENTS} GROUP BY user_id")
def _best_effort(spark, sf_dir):
    """A task's groups, merged again."""
    some = op.best_effort_group_aggregate(_events(spark, sf_dir), ["user_id"], op.AggregationSpecification().add(op.COUNT, "", "n").add(op.SUM, "v", "s").add(op.MAX, "v", "hi"))
    return op.group_aggregate(some, ["user_id"], op.AggregationSpecification().add(op.SUM, "n", "n").add(op.SUM, "s", "s").add(op.MAX, "hi", "hi"))


@query("op_distinct", "SELECT DISTINCT event_type, user_id FROM events")
def _distinct(spark, sf_dir):
    return op.group_aggregate(_events(spark, sf_dir), ["event_type", "user_id"], op.AggregationSpecification())


@query(
    "op_group_limited_keys",
    f"""WITH k AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) AS r FROM events GROUP BY 1), m AS (SELECT CASE WHEN r <= 20 THEN user_id ELSE (SELECT user_id FROM k WHERE r = 21) END AS u, e.v FROM {_EVENTS} e JOIN k USING (user_id))
    SELECT u AS user_id, count(*) AS n, sum(v)::INT AS s FROM m GROUP BY 1""",
)
def _limited(spark, sf_dir):
    return op.group_aggregate(_events(spark, sf_dir), ["user_id"], op.AggregationSpecification().add(op.COUNT, "", "n").add(op.SUM, "v", "s"), by("event_id"), max_unique_keys=20)


@query(
    "op_aggregate_clusters",
    f"""WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS s FROM {_EVENTS}), g AS (SELECT *, sum(s) OVER (ORDER BY event_id) AS k FROM c)
    SELECT event_type, count(*) AS n, sum(v)::INT AS t FROM g GROUP BY k, event_type""",
)
def _clusters(spark, sf_dir):
    return op.aggregate_clusters(_events(spark, sf_dir), ["event_type"], op.AggregationSpecification().add(op.COUNT, "", "n").add(op.SUM, "v", "t"), by("event_id"))


@query("op_sort", "SELECT event_id, v FROM " + _EVENTS + " ORDER BY v ASC NULLS FIRST, event_id DESC")
def _sort(spark, sf_dir):
    return op.sort(_events(spark, sf_dir), op.SortOrder().add(a("v")).add(a("event_id"), op.DESCENDING), fn.ProjectNamedAttributes(["event_id", "v"]))


@query("op_extended_sort_top", "SELECT c_custkey, upper(c_name) AS c_name FROM customer ORDER BY upper(c_name) DESC, c_custkey LIMIT 50")
def _top(spark, sf_dir):
    spec = op.ExtendedSortSpecification().add("c_name", op.DESCENDING, False).add("c_custkey").set_limit(50)
    return op.extended_sort(table(spark, sf_dir, "customer"), spec, fn.Flat(a("c_custkey"), fn.Alias("c_name", fn.ToUpper(a("c_name")))))


@query("op_sort_permutation", "SELECT row_number() OVER (ORDER BY c_acctbal, id) - 1 AS position, id AS row_id FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer)")
def _permutation(spark, sf_dir):
    return op.sort_permutation(table(spark, sf_dir, "customer"), op.SortOrder().add(a("c_acctbal")), by("c_custkey"))


@query("op_limit", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100 OFFSET 50")
def _limit(spark, sf_dir):
    return op.limit(_events(spark, sf_dir).select("event_id", "event_type"), 50, 100, by("event_id"))


@query("op_merge_union_all", "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def _union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_nationkey AS nation")
    s = table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "s_nationkey AS nation")
    return op.merge_union_all([c, s], op.SortOrder().add(a("name")))


@query("op_coalesce", "SELECT n_name, c_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) JOIN (SELECT c_name, row_number() OVER (ORDER BY c_custkey DESC) AS i FROM customer) USING (i)")
def _coalesce(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return op.coalesce([(n, by("n_nationkey")), (c, [F.col("c_custkey").desc()])]).select("n_name", "c_name")


@query("op_splitter", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM orders")
def _splitter(spark, sf_dir):
    one, two = op.split(table(spark, sf_dir, "orders"), 2)
    spec = op.AggregationSpecification().add(op.COUNT, "", "n")
    return op.group_aggregate(one, ["o_orderstatus"], spec).unionByName(op.scalar_aggregate(two, spec).withColumn("o_orderstatus", F.lit("all")))


@query("op_generate", "SELECT 7 AS seven FROM range(1000)")
def _generate(spark, sf_dir):
    return op.compute(sources.generate(spark, 1000), fn.Alias("seven", fn.ConstInt32(7)))


@query("op_repeating_block", "SELECT (range % 5)::INT AS r_regionkey FROM range(23)")
def _repeating(spark, sf_dir):
    return sources.repeating_block(table(spark, sf_dir, "region").select("r_regionkey"), 23, by("r_regionkey"))


# running functions


@query("fn_sequence", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events")
def _sequence(spark, sf_dir):
    return op.sequence(table(spark, sf_dir, "events").select("event_id", "ts"), by("ts", "event_id"), "k").select("event_id", "k")


@query("fn_running_sum", f"SELECT event_id, sum(v) OVER (ORDER BY event_id)::INT AS r FROM {_EVENTS}")
def _running_sum(spark, sf_dir):
    return op.running_sum(_events(spark, sf_dir), "v", by("event_id"), "r").select("event_id", "r")


@query(
    "fn_running_sum_wrapped",
    """WITH t AS (SELECT event_id, sum((event_id % 7 - 2)::HUGEINT * 400000000) OVER w AS i, sum((event_id % 4)::HUGEINT * 3000000000000000000) OVER w AS b FROM events WINDOW w AS (ORDER BY event_id))
    SELECT event_id, (((i + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::INT AS r32, ((b + 9223372036854775808) % 18446744073709551616 - 9223372036854775808)::BIGINT AS r64 FROM t""",
)
def _running_sum_wrapped(spark, sf_dir):
    """Sums that leave their type wrap."""
    df = table(spark, sf_dir, "events").selectExpr("event_id", "CAST((event_id % 7 - 2) * 400000000 AS INT) AS i", "CAST((event_id % 4) * 3000000000000000000 AS BIGINT) AS b")
    one = op.running_sum(df, "i", by("event_id"), "r32")
    return op.running_sum(one, "b", by("event_id"), "r64").select("event_id", "r32", "r64")


@query("fn_smudge", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS r FROM {_EVENTS}")
def _smudge(spark, sf_dir):
    return op.smudge(_events(spark, sf_dir), "v", by("event_id"), "r").select("event_id", "r")


@query("fn_changed", "SELECT event_id, coalesce(event_type <> lag(event_type) OVER (ORDER BY event_id), TRUE) AS r FROM events")
def _changes(spark, sf_dir):
    return op.changed(_events(spark, sf_dir), "event_type", by("event_id"), "r").select("event_id", "r")


@query(
    "fn_running_min_with_flush",
    f"WITH f AS (SELECT *, event_id % 17 = 0 AS fl FROM {_EVENTS}), s AS (SELECT *, lag(fl, 1, FALSE) OVER (ORDER BY event_id) AS b FROM f), g AS (SELECT *, sum(b::INT) OVER (ORDER BY event_id) AS k FROM s) SELECT event_id, min(v) OVER (PARTITION BY k ORDER BY event_id) AS r FROM g",
)
def _running_min(spark, sf_dir):
    return op.running_min_with_flush(_events(spark, sf_dir).withColumn("fl", F.col("event_id") % 17 == 0), "fl", "v", by("event_id"), "r").select("event_id", "r")


@query(
    "fn_smudge_if",
    f"WITH f AS (SELECT *, event_type = 'click' AS c FROM {_EVENTS}), g AS (SELECT *, sum((NOT c)::INT) OVER (ORDER BY event_id) AS k FROM f) SELECT event_id, first_value(v) OVER (PARTITION BY k ORDER BY event_id) AS r FROM g",
)
def _smudge_if(spark, sf_dir):
    return op.smudge_if(_events(spark, sf_dir).withColumn("c", F.col("event_type") == "click"), "v", "c", by("event_id"), "r").select("event_id", "r")


@query("plan_serialized", "SELECT o_orderkey, CASE WHEN o_totalprice > 2e5 THEN o_orderkey * 2 ELSE o_custkey END AS picked, o_orderstatus || '!' AS loud FROM orders")
def _serialized(spark, sf_dir):
    v = lambda n: {"variable": n}
    c = lambda x, t: {"constant": x, "type": t}
    picked = {"operation": "IF", "arguments": [{"operation": "GREATER", "arguments": [v("o_totalprice"), c(2e5, "DOUBLE")]}, {"operation": "MULTIPLY", "arguments": [v("o_orderkey"), c(2, "INT64")]}, v("o_custkey")], "alias": "picked"}
    loud = {"operation": "CONCATENATE", "arguments": [v("o_orderstatus"), c("!", "STRING")], "alias": "loud"}
    return op.compute(table(spark, sf_dir, "orders"), serde.build({"tuple": [v("o_orderkey"), picked, loud]}))


