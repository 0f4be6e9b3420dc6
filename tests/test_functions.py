"""Golden values of the scalar functions, null rules and bind errors."""

import math
from datetime import date, datetime

import pytest

from skeinwork import functions as fn
from skeinwork import operators as op
from skeinwork.errors import EngineError, ReturnCode
from skeinwork.functions.hashing import hash_bytes
from skeinwork.types import BINARY, BOOL, DATE, DATETIME, DOUBLE, FLOAT, INT32, INT64, STRING, UINT32, UINT64, Attribute, DataType, Schema, common_type, enum_definition, schema_of

a = fn.NamedAttribute


def values(spark, e, rows=None, ddl=None):
    df = spark.createDataFrame(rows, ddl) if rows is not None else spark.range(1)
    return [r[0] for r in op.compute(df, e).collect()]


def one(spark, e):
    return values(spark, e)[0]


def code_of(f):
    with pytest.raises(EngineError) as x:
        f()
    return x.value.code


def test_common_types():
    assert common_type(INT32, UINT32) == INT64
    assert common_type(UINT64, UINT32) == UINT64
    assert common_type(INT64, UINT64) == INT64
    assert common_type(FLOAT, INT32) == FLOAT
    assert common_type(FLOAT, INT64) == DOUBLE
    assert common_type(DATE, DATETIME) == DATETIME
    assert code_of(lambda: common_type(STRING, INT32)) == ReturnCode.ERROR_ATTRIBUTE_TYPE_MISMATCH


def test_casts(spark):
    assert one(spark, fn.CastTo(UINT32, fn.ConstInt32(-1))) == 2**32 - 1
    assert one(spark, fn.CastTo(INT32, fn.ConstUint32(2**32 - 1))) == -1
    assert int(one(spark, fn.CastTo(UINT64, fn.ConstInt64(-1)))) == 2**64 - 1
    assert one(spark, fn.CastTo(INT64, fn.ConstUint64(2**64 - 1))) == -1
    assert one(spark, fn.CastTo(INT32, fn.ConstInt64(2**32 + 5))) == 5
    assert bytes(one(spark, fn.CastTo(BINARY, fn.ConstString("ab")))) == b"ab"
    schema = schema_of(spark.range(1))
    for bad in (fn.CastTo(INT32, fn.ConstDouble(1.5)), fn.CastTo(BOOL, fn.ConstInt32(1)), fn.CastTo(STRING, fn.ConstInt32(1))):
        assert code_of(lambda: bad.one(schema)) == ReturnCode.ERROR_ATTRIBUTE_TYPE_MISMATCH


def test_unsigned_types_survive_a_plan(spark):
    df = op.compute(spark.range(1), fn.Alias("u", fn.ConstUint32(7)))
    assert schema_of(df)["u"].type == UINT32
    assert schema_of(op.compute(df, fn.Alias("v", fn.Minus(a("u"), fn.ConstUint32(8)))))["v"].type == UINT32
    assert op.compute(df, fn.Alias("v", fn.Minus(a("u"), fn.ConstUint32(8)))).first()[0] == 2**32 - 1


@pytest.mark.parametrize(
    "make, kind, x, y, result",
    [
        (fn.Plus, fn.ConstInt32, 2**31 - 1, 1, -(2**31)),
        (fn.Plus, fn.ConstInt64, 2**63 - 1, 1, -(2**63)),
        (fn.Minus, fn.ConstInt64, -(2**63), 1, 2**63 - 1),
        (fn.Multiply, fn.ConstInt64, 2**62, 4, 0),
        (fn.Multiply, fn.ConstInt64, 3037000500, 3037000500, 3037000500**2 - 2**64),
        (fn.Multiply, fn.ConstUint64, 2**63, 3, 2**63),
        (fn.Multiply, fn.ConstUint64, 2**64 - 1, 2**64 - 1, 1),
        (fn.CppDivideSignaling, fn.ConstInt32, -7, 2, -3),
        (fn.CppDivideNulling, fn.ConstInt64, -(2**63), -1, -(2**63)),
        (fn.CppDivideNulling, fn.ConstInt32, 7, 0, None),
        (fn.CppDivideNulling, fn.ConstUint64, 2**64 - 1, 10, (2**64 - 1) // 10),
        (fn.ModulusNulling, fn.ConstInt32, -7, 3, -1),
        (fn.ModulusNulling, fn.ConstInt32, 5, 0, None),
    ],
)
def test_integer_arithmetic(spark, make, kind, x, y, result):
    got = one(spark, make(kind(x), kind(y)))
    assert (None if got is None else int(got)) == result


def test_division_policies(spark):
    d = fn.ConstDouble
    assert one(spark, fn.DivideNulling(d(1), d(0))) is None
    assert one(spark, fn.DivideQuiet(d(1), d(0))) == math.inf
    assert one(spark, fn.DivideQuiet(d(-1), d(0))) == -math.inf
    assert math.isnan(one(spark, fn.DivideQuiet(d(0), d(0))))
    for bad in (fn.DivideSignaling(d(1), d(0)), fn.CppDivideSignaling(fn.ConstInt32(1), fn.ConstInt32(0)), fn.ModulusSignaling(fn.ConstInt32(1), fn.ConstInt32(0)), fn.SqrtSignaling(d(-1)), fn.PowerSignaling(d(-1), d(0.5)), fn.FromUnixTime(fn.ConstInt64(-1))):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO|ERROR_EVALUATION_ERROR"):
            one(spark, bad)


def test_three_valued_logic(spark):
    rows = [(x, y) for x in (True, False, None) for y in (True, False, None)]
    got = {
        name: values(spark, make(a("x"), a("y")), rows, "x boolean, y boolean") for name, make in (("and", fn.And), ("or", fn.Or), ("xor", fn.Xor), ("and_not", fn.AndNot))
    }
    assert got["and"] == [True, False, None, False, False, False, None, False, None]
    assert got["or"] == [True, True, True, True, False, None, True, None, None]
    assert got["xor"] == [False, True, None, True, False, None, None, None, None]
    assert got["and_not"] == [False, False, False, True, False, None, None, False, None]


def test_control(spark):
    rows = [(True,), (False,), (None,)]
    one_, two = fn.ConstInt32(1), fn.ConstInt32(2)
    assert values(spark, fn.If(a("c"), one_, two), rows, "c boolean") == [1, 2, 2]
    assert values(spark, fn.NullingIf(a("c"), one_, two), rows, "c boolean") == [1, 2, None]
    assert values(spark, fn.IfNull(a("n"), fn.ConstInt64(9)), [(1,), (None,)], "n int") == [1, 9]
    assert values(spark, fn.Case([a("n"), two, one_, fn.ConstInt32(10)]), [(1,), (3,), (None,)], "n int") == [10, 2, 2]
    assert code_of(lambda: fn.Case([one_])) == ReturnCode.ERROR_ATTRIBUTE_COUNT_MISMATCH


def test_comparison_of_floats_and_unsigned(spark):
    nan = fn.ConstDouble(math.nan)
    assert one(spark, fn.Equal(nan, nan)) is False
    assert one(spark, fn.NotEqual(nan, nan)) is True
    assert one(spark, fn.Less(fn.ConstDouble(1), nan)) is False
    assert one(spark, fn.GreaterOrEqual(nan, fn.ConstDouble(1))) is False
    assert one(spark, fn.Less(fn.ConstInt32(-1), fn.ConstUint64(2**64 - 1))) is True
    assert one(spark, fn.Equal(fn.ConstInt32(16777217), fn.ConstFloat(16777216.0))) is True  # as floats
    schema = schema_of(spark.range(1))
    assert code_of(lambda: fn.Equal(fn.ConstDate(1), fn.ConstDateTime(1)).one(schema)) == ReturnCode.ERROR_ATTRIBUTE_TYPE_MISMATCH
    assert values(spark, fn.In(a("n"), [fn.ConstInt32(1), fn.Null(INT32)]), [(1,), (2,), (None,)], "n int") == [True, None, None]


def test_bits(spark):
    assert one(spark, fn.BitwiseNot(fn.ConstUint32(0))) == 2**32 - 1
    assert int(one(spark, fn.BitwiseNot(fn.ConstUint64(0)))) == 2**64 - 1
    assert int(one(spark, fn.BitwiseXor(fn.ConstUint64(2**63 + 1), fn.ConstUint64(1)))) == 2**63
    assert one(spark, fn.ShiftRight(fn.ConstInt32(-8), fn.ConstInt32(1))) == -4
    assert int(one(spark, fn.ShiftRight(fn.ConstUint64(2**63), fn.ConstInt32(63)))) == 1
    assert one(spark, fn.ShiftLeft(fn.ConstUint32(2**31), fn.ConstInt32(1))) == 0


@pytest.mark.parametrize(
    "text, pos, length, result",
    [("Mountains", 0, 1, ""), ("Turquoise", -10, 2, "Tu"), ("Cow", 1, 2, "Co"), ("Cow", -2, 1, "o"), ("Cow", 2, -1, ""), ("Cow", 9, 2, ""), (None, 1, 1, None), ("Cow", 1, None, None)],
)
def test_substring(spark, text, pos, length, result):
    assert values(spark, fn.Substring(a("s"), a("p"), a("n")), [(text, pos, length)], "s string, p int, n int") == [result]


def test_strings(spark):
    s = fn.ConstString
    assert one(spark, fn.Length(s("zażółć"))) == 10
    assert one(spark, fn.ToUpper(s("ażb"))) == "AżB"
    assert one(spark, fn.Trim(s(" \tx "))) == "\tx"
    assert one(spark, fn.StringOffset(s("żab"), s("b"))) == 4
    assert one(spark, fn.StringOffset(s("ab"), s(""))) == 1
    assert one(spark, fn.StringReplace(s("aXaX"), s("X"), s("$1"))) == "a$1a$1"
    assert one(spark, fn.Concat([s("a"), fn.ConstInt32(1), fn.ConstBool(False)])) == "a1FALSE"
    assert one(spark, fn.Concat([s("a"), fn.Null(STRING)])) is None
    assert one(spark, fn.TrailingSubstring(s("abc"), fn.ConstInt32(-2))) == "bc"


@pytest.mark.parametrize("x, text", [(-1.0, "-1"), (0.1, "0.1"), (0.1 + 0.2, "0.30000000000000004"), (1e20, "1e+20"), (-0.0, "-0"), (123456789012345.0, "123456789012345"), (math.nan, "nan"), (math.inf, "inf"), (None, None)])
def test_double_text(spark, x, text):
    assert values(spark, fn.ToString(a("x")), [(x,)], "x double") == [text]


def test_parse(spark):
    rows = [("true",), (" Yes ",), ("NO",), ("1",), (None,)]
    assert values(spark, fn.ParseStringNulling(BOOL, a("s")), rows, "s string") == [True, True, False, None, None]
    rows = [("12",), ("-2147483649",), ("1.5",), ("x",), ("",)]
    assert values(spark, fn.ParseStringNulling(INT32, a("s")), rows, "s string") == [12, None, None, None, None]
    rows = [("2001/2/3-4:05:06",), ("1969/1/1-00:00:00",), ("2039/1/1-00:00:00",), ("junk",)]
    assert values(spark, fn.ParseStringNulling(DATETIME, a("s")), rows, "s string") == [datetime(2001, 2, 3, 4, 5, 6), None, None, None]
    assert values(spark, fn.ParseStringNulling(DATE, a("s")), [("2001/2/3",), ("9999/9/9",)], "s string") == [date(2001, 2, 3), None]


def test_regexps(spark):
    s = fn.ConstString
    assert one(spark, fn.RegexpFullMatch(s("ab\n"), "ab")) is False
    assert one(spark, fn.RegexpPartialMatch(s("xaby"), "ab")) is True
    assert one(spark, fn.RegexpExtract(s("key=7"), r"key=(\d)")) == "7"
    assert one(spark, fn.RegexpExtract(s("none"), r"key=(\d)")) is None
    assert one(spark, fn.RegexpExtract(s("key"), "key")) is None
    assert one(spark, fn.RegexpReplace(s("a1b2"), r"([0-9])", s(r"<\1$>"))) == "a<1$>b<2$>"
    # Groups: 0 is the whole match; a constant that names more than there are is refused.
    assert one(spark, fn.RegexpReplace(s("ab"), "(a)(b)", s(r"\2\0\1"))) == "baba"
    for pattern, new in ((r"(a)", r"\9"), ("a", r"x\1"), ("(a)(b)", r"\3")):
        assert code_of(lambda: one(spark, fn.RegexpReplace(s("ab"), pattern, s(new)))) == ReturnCode.ERROR_INVALID_ARGUMENT_VALUE
    e = fn.RegexpReplace(s("ab"), "(a)", a("n"))
    assert values(spark, e, [(r"<\1>",), (None,)], "n string") == ["<a>b", None]
    with pytest.raises(Exception, match="ERROR_EVALUATION_ERROR"):
        values(spark, e, [(r"\1",), (r"\2",)], "n string")
    for bad in ("(", "(?=x)", r"(a)\1"):
        assert code_of(lambda: fn.RegexpPartialMatch(s("x"), bad)) == ReturnCode.ERROR_INVALID_ARGUMENT_VALUE


def test_dates(spark):
    i = fn.ConstInt32
    t = fn.ConstDateTime("2011/01/31-10:20:30")
    assert one(spark, fn.AddMonth(t)) == datetime(2011, 3, 3, 10, 20, 30)
    assert one(spark, fn.MakeDate(i(2000), i(14), i(31))) == datetime(2001, 3, 3)
    assert one(spark, fn.MakeDatetime(i(1969), i(12), i(31), i(23), i(59), i(59))) is None
    with pytest.raises(Exception, match="ERROR_EVALUATION_ERROR"):
        one(spark, fn.MakeDate(i(1969), i(1), i(1)))
    assert one(spark, fn.UnixTimestamp(fn.ConstDateTime(1_500_000))) == 1
    assert one(spark, fn.Weekday(fn.ConstDateTime("2011/01/31-00:00:00"))) == 0
    assert one(spark, fn.Microsecond(fn.ConstDateTime(1_000_007))) == 7
    assert one(spark, fn.DateFormat(t, "%d/%m/%y")) == "31/01/11"
    assert values(spark, fn.DateFormat(fn.ConstDateTime("2011/01/31-10:20:30"), a("f")), [("%Y",), ("%j",), (None,), ("x" * 40,)], "f string") == ["2011", "031", None, ""]
    assert one(spark, fn.ConstDateTime("no date")) is None
    assert one(spark, fn.Year(fn.ConstDate(0))) == 1970


def test_dates_in_another_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, fn.UnixTimestamp(fn.FromUnixTime(fn.ConstInt64(86400 * 200)))) == 86400 * 200
        assert one(spark, fn.Hour(fn.ConstDateTime(3_600_000_000))) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_maths(spark):
    d, i = fn.ConstDouble, fn.ConstInt32
    assert one(spark, fn.Abs(i(-(2**31)))) == 2**31
    assert [one(spark, fn.Round(d(x))) for x in (0.5, -0.5, 2.5, 0.49999999999999994)] == [1.0, -1.0, 3.0, 0.0]
    assert one(spark, fn.Ceil(d(1e300))) == 1e300
    assert one(spark, fn.Trunc(d(-1.7))) == -1.0
    assert one(spark, fn.RoundToInt(d(2.5))) == 3
    assert one(spark, fn.RoundWithPrecision(d(0.285), i(2))) == 0.28
    assert one(spark, fn.RoundWithPrecision(d(1234.0), i(-2))) == 1200.0
    assert one(spark, fn.Format(d(1.005), i(2))) == "1.00"
    assert one(spark, fn.LnQuiet(d(0))) == -math.inf
    assert math.isnan(one(spark, fn.LnQuiet(d(-1))))
    assert one(spark, fn.LnNulling(d(0))) is None
    assert one(spark, fn.LogNulling(d(1), d(8))) is None
    assert one(spark, fn.PowerNulling(d(-1), d(0.5))) is None
    assert one(spark, fn.PowerQuiet(d(0), d(-1))) == math.inf
    assert one(spark, fn.SqrtNulling(d(-1))) is None
    assert [one(spark, fn.IsNaN(x)) for x in (d(math.nan), d(1), fn.Null(DOUBLE))] == [True, False, None]
    assert [one(spark, fn.IsNormal(d(x))) for x in (1e-310, 1.0, math.inf)] == [False, True, False]


def test_hashes(spark):
    assert hash_bytes(b"", 42) == 42
    first, second = 4294967311, 4294967497
    assert hash_bytes(b"abcd", 42) == (42 * first % 2**64) ^ (int.from_bytes(b"abcd", "little") * second % 2**64)
    assert int(one(spark, fn.Fingerprint(fn.ConstString("abcd")))) == hash_bytes(b"abcd", 42)
    assert int(one(spark, fn.Hash(fn.ConstInt32(-1), fn.ConstUint64(9)))) == hash_bytes(b"\xff" * 8, 9)
    assert one(spark, fn.Fingerprint(fn.Null(STRING))) is None
    schema = schema_of(spark.range(1))
    assert code_of(lambda: fn.Fingerprint(fn.ConstDouble(1)).one(schema)) == ReturnCode.ERROR_ATTRIBUTE_TYPE_MISMATCH


def test_schema_errors_and_enums(spark):
    df = spark.createDataFrame([(1, "x")], "n int, s string")
    schema = schema_of(df)
    assert code_of(lambda: a("zz").one(schema)) == ReturnCode.ERROR_ATTRIBUTE_MISSING
    assert code_of(lambda: fn.AttributeAt(5).one(schema)) == ReturnCode.ERROR_ATTRIBUTE_MISSING
    assert code_of(lambda: fn.Flat(a("n"), a("n")).bind(schema)) == ReturnCode.ERROR_ATTRIBUTE_EXISTS
    assert code_of(lambda: fn.ProjectRename(["p"], fn.ProjectAllAttributes()).bind(schema)) == ReturnCode.ERROR_ATTRIBUTE_COUNT_MISMATCH
    assert [b.name for b in fn.ProjectAllAttributes("p_").bind(schema)] == ["p_n", "p_s"]
    assert code_of(lambda: enum_definition({"a": 1, "b": 1})) == ReturnCode.ERROR_DUPLICATE_ENUM_VALUE_NUMBER
    kind = Attribute("e", DataType.ENUM, True, enum_definition({"RED": 1, "BLUE": 2}))
    named = spark.createDataFrame([(2,), (None,), (1,)], Schema([kind]).spark())
    assert [r[0] for r in op.compute(named, fn.ToString(a("e"))).collect()] == ["BLUE", None, "RED"]


def test_not_null_results_say_so(spark):
    schema = schema_of(spark.range(1))
    assert not fn.IsNull(fn.Null(INT32)).one(schema).nullable
    assert not fn.IfNull(fn.Null(INT32), fn.ConstInt32(1)).one(schema).nullable
    assert fn.DivideNulling(fn.ConstInt32(1), fn.ConstInt32(1)).one(schema).nullable


def test_random_numbers_repeat_by_seed(spark):
    df = spark.range(50)
    draws = [[r[0] for r in op.compute(df, fn.RandInt32(5)).collect()] for _ in range(2)]
    assert draws[0] == draws[1] and len(set(draws[0])) > 40
