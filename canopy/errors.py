"""The one exception of the query surface."""

from __future__ import annotations


class QueryError(ValueError):
    """A refused request: ``code``, ``message``, extra fields and how to recover."""

    def __init__(self, code: str, message: str, recovery: str = "", **extras) -> None:
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.recovery, self.extras = code, message, recovery, extras

    def as_dict(self) -> dict:
        return {"error": {"code": self.code, "message": self.message, **self.extras, "recovery": self.recovery}}
