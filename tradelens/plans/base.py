"""Registration of queries with their SQL."""

from __future__ import annotations

from ..binding import SQL


class Queries:
    """Queries and SQL of one module; SQL may go on after the common views with ``, name AS (...)``."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = f"WITH {SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
            return f

        return keep


def local(instant: str, zone: str = "America/Sao_Paulo") -> str:
    """SQL for the wall-clock time of a UTC instant."""
    return f"timezone('{zone}', timezone('UTC', {instant}))"


def local_days(earlier: str, later: str) -> str:
    """SQL for civil days between two instants, never negative."""
    return f"greatest(0, date_diff('day', CAST({local(earlier)} AS DATE), CAST({local(later)} AS DATE)))"
