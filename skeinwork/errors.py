"""Return codes and the exceptions that carry them."""

from __future__ import annotations

from enum import IntEnum


class ReturnCode(IntEnum):
    # Names and numbers of the codes that callers test for.
    OK = 0
    END_OF_INPUT = 1
    BEFORE_INPUT = 2
    WAITING_ON_BARRIER = 3
    ERROR_UNKNOWN_ERROR = 100
    ERROR_GENERAL_IO_ERROR = 101
    ERROR_MEMORY_EXCEEDED = 102
    ERROR_NOT_IMPLEMENTED = 103
    ERROR_EVALUATION_ERROR = 104
    ERROR_BAD_PROTO = 105
    ERROR_TEMP_FILE_CREATION_ERROR = 106
    ERROR_TOO_FEW_ROWS = 301
    ERROR_TOO_MANY_ROWS = 302
    ERROR_TOO_FEW_COLUMNS = 303
    ERROR_TOO_MANY_COLUMNS = 304
    ERROR_DUPLICATED_UNIQUE_KEY = 305
    ERROR_GENERIC_SCHEMA_ERROR = 400
    ERROR_ATTRIBUTE_COUNT_MISMATCH = 401
    ERROR_ATTRIBUTE_TYPE_MISMATCH = 402
    ERROR_ATTRIBUTE_MISSING = 403
    ERROR_ATTRIBUTE_EXISTS = 404
    ERROR_INVALID_ARGUMENT_TYPE = 405
    ERROR_ATTRIBUTE_IS_NULLABLE = 406
    ERROR_INVALID_ARGUMENT_VALUE = 407
    ERROR_ATTRIBUTE_AMBIGUOUS = 408
    ERROR_DUPLICATE_ENUM_VALUE_NUMBER = 420
    ERROR_DUPLICATE_ENUM_VALUE_NAME = 421
    ERROR_UNDEFINED_ENUM_VALUE_NUMBER = 422
    ERROR_UNDEFINED_ENUM_VALUE_NAME = 423
    ERROR_FOREIGN_KEY_INVALID = 501
    INTERRUPTED = 1000


class EngineError(Exception):
    """An error found while a plan is built."""

    def __init__(self, code: ReturnCode, message: str):
        super().__init__(f"{code.name}: {message}")
        self.code = code


def fail(code: str, message: str) -> None:
    raise EngineError(ReturnCode[code], message)
