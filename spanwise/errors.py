"""The error that every failing decision raises."""

from __future__ import annotations

#: The codes.
CODES = ("invalid_request", "input_too_large", "request_failed", "aborted")


class DecideError(Exception):
    """``code`` is one of CODES; ``chunk`` and ``status`` tell which chunk failed and how."""

    def __init__(self, code: str, message: str, chunk: int | None = None, status: int | None = None, cause: BaseException | None = None):
        super().__init__(message)
        self.code, self.message, self.chunk, self.status, self.cause = code, message, chunk, status, cause

    def __reduce__(self):
        return DecideError, (self.code, self.message, self.chunk, self.status, None)


def invalid(message: str) -> DecideError:
    return DecideError("invalid_request", message)
