"""Errors with a stable code."""


class QueryError(ValueError):
    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}")
        self.code, self.details = code, details
