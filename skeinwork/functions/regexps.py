"""Regular expressions, in the syntax that RE2 and Java share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import fail
from ..types import BOOL, STRING
from .core import Bound, Expr, evaluation_error, single, unary, want

#: Only ``\n`` ends a line.
_FLAGS = "(?d)"


def checked(pattern: str) -> str:
    """The pattern for Java; what RE2 lacks, or nobody reads, is refused."""
    if re.search(r"\(\?<?[=!]|\\[1-9]", re.sub(r"\\\\", "", pattern)):
        fail("ERROR_INVALID_ARGUMENT_VALUE", f"look-around and back-references are not supported: {pattern!r}")
    try:
        re.compile(pattern.replace(r"\z", r"\Z"))
    except re.error as e:
        fail("ERROR_INVALID_ARGUMENT_VALUE", f"malformed pattern {pattern!r}: {e}")
    return pattern.replace("(?P<", "(?<")


def RegexpPartialMatch(e: Expr, pattern: str) -> Expr:
    p = _FLAGS + checked(pattern)
    return unary("REGEXP_PARTIAL", {STRING}, BOOL, lambda x: x.rlike(p))(e)


def RegexpFullMatch(e: Expr, pattern: str) -> Expr:
    p = rf"{_FLAGS}\A(?:{checked(pattern)})\z"
    return unary("REGEXP_FULL", {STRING}, BOOL, lambda x: x.rlike(p))(e)


def _java_replacement(new: Column, groups: int) -> Column:
    r"""``\1`` becomes ``$1``; ``$`` is a plain character. A number beyond the pattern's
    groups fails the query with the engine's own error."""
    beyond = rf"\\[{groups + 1}-9]" if groups < 9 else "(?!)"
    java = F.regexp_replace(F.replace(new, F.lit("$"), F.lit(r"\$")), r"\\([0-9])", r"\$$1")
    return F.when(new.rlike(beyond), evaluation_error(f"the replacement names a group beyond the pattern's {groups}", "string")).otherwise(java)


def RegexpReplace(e: Expr, pattern: str, new: Expr) -> Expr:
    r"""All matches replaced. ``\0`` to ``\9`` in ``new`` stand for groups: a constant that
    names more than the pattern has is refused when it is bound, a column's value fails
    the query."""
    p, groups = _FLAGS + checked(pattern), re.compile(pattern).groups

    def resolve(s):
        x, y = want(e.one(s), {STRING}, "REGEXP_REPLACE"), want(new.one(s), {STRING}, "REGEXP_REPLACE")
        if y.constant is not None and any(int(n) > groups for n in re.findall(r"\\([0-9])", y.constant)):
            fail("ERROR_INVALID_ARGUMENT_VALUE", f"{y.constant!r} names a group beyond the pattern's {groups}")
        return Bound(f"REGEXP_REPLACE({x.name}, {y.name})", STRING, x.nullable or y.nullable, F.regexp_replace(x.col, F.lit(p), _java_replacement(y.col, groups)))

    return single(resolve)


def RegexpExtract(e: Expr, pattern: str) -> Expr:
    """The first group; null without a match or a group."""
    p = _FLAGS + checked(pattern)
    grouped = re.compile(pattern).groups > 0
    return unary("REGEXP_EXTRACT", {STRING}, STRING, lambda x: F.when(x.rlike(p), F.regexp_extract(x, p, 1)) if grouped else F.lit(None).cast("string"), nullable=lambda n: True)(e)


def RegexpRewrite(*arguments) -> Expr:
    fail("ERROR_NOT_IMPLEMENTED", "REGEXP_REWRITE is declared only")
