"""Expressions from plain dicts (or JSON) and back to plans.

A node is one of ``{"constant": value, "type": name}``, ``{"variable": name}``,
``{"operation": name, "arguments": [...]}``, ``{"tuple": [...]}``; any may have an
``"alias"``. Operations that are named but not supported fail with
ERROR_NOT_IMPLEMENTED, unknown ones with ERROR_BAD_PROTO.
"""

from __future__ import annotations

import json

from .. import functions as fn
from ..errors import fail
from ..functions.core import Expr
from ..types import DataType

_CONSTANTS = {
    "INT32": fn.ConstInt32, "INT64": fn.ConstInt64, "UINT32": fn.ConstUint32, "UINT64": fn.ConstUint64, "FLOAT": fn.ConstFloat, "DOUBLE": fn.ConstDouble,
    "BOOL": fn.ConstBool, "STRING": fn.ConstString, "DATE": fn.ConstDate, "DATETIME": fn.ConstDateTime,
}

# The names that stored plans use.
_PLAIN = {
    "ADD": fn.Plus, "MULTIPLY": fn.Multiply, "SUBTRACT": fn.Minus, "DIVIDE": fn.Divide, "CPP_DIVIDE": fn.CppDivide,
    "DIVIDE_SIGNALING": fn.DivideSignaling, "DIVIDE_NULLING": fn.DivideNulling, "DIVIDE_QUIET": fn.DivideQuiet, "NEGATE": fn.Negate,
    "AND": fn.And, "OR": fn.Or, "NOT": fn.Not, "AND_NOT": fn.AndNot, "XOR": fn.Xor,
    "EQUAL": fn.Equal, "NOT_EQUAL": fn.NotEqual, "GREATER": fn.Greater, "GREATER_OR_EQUAL": fn.GreaterOrEqual, "LESS": fn.Less, "LESS_OR_EQUAL": fn.LessOrEqual,
    "IS_NULL": fn.IsNull, "IF": fn.If, "IFNULL": fn.IfNull, "MODULUS": fn.Modulus, "IS_ODD": fn.IsOdd, "IS_EVEN": fn.IsEven,
    "BITWISE_AND": fn.BitwiseAnd, "BITWISE_OR": fn.BitwiseOr, "BITWISE_NOT": fn.BitwiseNot, "BITWISE_XOR": fn.BitwiseXor, "SHIFT_LEFT": fn.ShiftLeft, "SHIFT_RIGHT": fn.ShiftRight,
    "ROUND_TO_INT": fn.RoundToInt, "ROUND": fn.Round, "TRUNC": fn.Trunc, "CEIL_TO_INT": fn.CeilToInt, "CEIL": fn.Ceil, "FLOOR_TO_INT": fn.FloorToInt, "FLOOR": fn.Floor,
    "EXP": fn.Exp, "LN": fn.Ln, "LOG": fn.Log, "LOG10": fn.Log10, "SQRT": fn.Sqrt, "SQRT_SIGNALING": fn.SqrtSignaling, "SQRT_NULLING": fn.SqrtNulling, "SQRT_QUIET": fn.SqrtQuiet,
    "IS_FINITE": fn.IsFinite, "IS_INF": fn.IsInf, "IS_NAN": fn.IsNaN, "IS_NORMAL": fn.IsNormal, "SIN": fn.Sin, "COS": fn.Cos, "TAN": fn.Tan, "PI": fn.Pi,
    "POWER_SIGNALING": fn.PowerSignaling, "POWER_NULLING": fn.PowerNulling, "POWER_QUIET": fn.PowerQuiet,
    "LENGTH": fn.Length, "LTRIM": fn.Ltrim, "RTRIM": fn.Rtrim, "TRIM": fn.Trim, "TOUPPER": fn.ToUpper, "TOLOWER": fn.ToLower, "TOSTRING": fn.ToString,
    "STRING_OFFSET": fn.StringOffset, "REPLACE": fn.StringReplace, "UNIXTIMESTAMP": fn.UnixTimestamp, "FROMUNIXTIME": fn.FromUnixTime, "MAKEDATE": fn.MakeDate, "MAKEDATETIME": fn.MakeDatetime,
    "YEAR_LOCAL": fn.YearLocal, "MONTH_LOCAL": fn.MonthLocal, "DAY_LOCAL": fn.DayLocal, "WEEKDAY_LOCAL": fn.WeekdayLocal, "YEARDAY_LOCAL": fn.YearDayLocal, "HOUR_LOCAL": fn.HourLocal,
    "MINUTE_LOCAL": fn.MinuteLocal, "QUARTER_LOCAL": fn.QuarterLocal, "SECOND": fn.Second, "MICROSECOND": fn.Microsecond,
    "YEAR_UTC": fn.Year, "MONTH_UTC": fn.Month, "DAY_UTC": fn.Day, "WEEKDAY_UTC": fn.Weekday, "YEARDAY_UTC": fn.YearDay, "HOUR_UTC": fn.Hour, "MINUTE_UTC": fn.Minute, "QUARTER_UTC": fn.Quarter,
    "FORMAT": fn.Format, "DATE_FORMAT_UTC": fn.DateFormat, "DATE_FORMAT_LOCAL": fn.DateFormatLocal, "RANDOM_INT32": fn.RandInt32,
}
_REFUSED = {
    "COPY", "DATEDIFF", "DATETIMEDIFF", "ADD_WEEK", "ADD_YEAR", "TRUNC_TO_SECOND", "TRUNC_TO_MINUTE", "TRUNC_TO_HOUR", "TRUNC_TO_DAY", "TRUNC_TO_MONTH",
    "TRUNC_TO_QUARTER", "TRUNC_TO_YEAR", "SEQUENCE",
}


def _text(node: dict) -> str:
    if node.get("type") != "STRING":
        fail("ERROR_BAD_PROTO", "a constant string is wanted")
    return node["constant"]


def _operation(name: str, nodes: list[dict]) -> Expr:
    if name in _REFUSED:
        fail("ERROR_NOT_IMPLEMENTED", f"{name} is not supported")
    if name in ("REGEXP_PARTIAL", "REGEXP_FULL", "REGEXP_EXTRACT"):
        make = {"REGEXP_PARTIAL": fn.RegexpPartialMatch, "REGEXP_FULL": fn.RegexpFullMatch, "REGEXP_EXTRACT": fn.RegexpExtract}[name]
        return make(build(nodes[0]), _text(nodes[1]))
    if name == "REGEXP_REPLACE":
        return fn.RegexpReplace(build(nodes[0]), _text(nodes[1]), build(nodes[2]))
    if name in ("CAST", "PARSE_STRING"):
        return (fn.CastTo if name == "CAST" else fn.ParseStringNulling)(DataType[_text(nodes[0])], build(nodes[1]))
    arguments = [build(n) for n in nodes]
    if name == "IN":
        return fn.In(arguments[0], arguments[1:])
    if name == "CASE":
        return fn.Case(arguments)
    if name == "CONCATENATE":
        return fn.Concat(arguments)
    if name == "SUBSTRING":
        return (fn.TrailingSubstring if len(arguments) == 2 else fn.Substring)(*arguments)
    if name in ("ADD_MINUTE", "ADD_DAY", "ADD_MONTH"):
        one, many = {"ADD_MINUTE": (fn.AddMinute, fn.AddMinutes), "ADD_DAY": (fn.AddDay, fn.AddDays), "ADD_MONTH": (fn.AddMonth, fn.AddMonths)}[name]
        return (one if len(arguments) == 1 else many)(*arguments)
    if name not in _PLAIN:
        fail("ERROR_BAD_PROTO", f"no operation {name!r}")
    try:
        return _PLAIN[name](*arguments)
    except TypeError:
        fail("ERROR_BAD_PROTO", f"{name} does not take {len(arguments)} arguments")


def build(node: dict | str) -> Expr:
    """The expression that a node describes."""
    if isinstance(node, str):
        node = json.loads(node)
    kinds = [k for k in ("constant", "variable", "operation", "tuple", "custom_function") if k in node]
    if len(kinds) != 1:
        fail("ERROR_BAD_PROTO", f"one kind of node is wanted in {node}")
    match kinds[0]:
        case "constant":
            name = node.get("type")
            if name not in _CONSTANTS:
                fail("ERROR_BAD_PROTO", f"no constants of type {name!r}")
            out = fn.Null(DataType[name]) if node["constant"] is None else _CONSTANTS[name](node["constant"])
        case "variable":
            out = fn.NamedAttribute(node["variable"])
        case "tuple":
            out = fn.Flat(*map(build, node["tuple"]))
        case "custom_function":
            fail("ERROR_NOT_IMPLEMENTED", "custom functions are not supported")
        case _:
            out = _operation(node["operation"], node.get("arguments", []))
    return fn.Alias(node["alias"], out) if "alias" in node else out
