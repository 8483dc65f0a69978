"""A module's queries and their SQL, by function name."""

from __future__ import annotations

from reportmill.functions.building import light


class Register:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = light(f)
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
