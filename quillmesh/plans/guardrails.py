"""Checks of SQL text before it may run."""

from __future__ import annotations

import re


class Refused(ValueError):
    """SQL that the rules do not let through."""


_LITERAL = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"|--[^\n]*|/\*.*?\*/", re.DOTALL)
_CHANGES = re.compile(r"\b(?:insert|update|delete|merge|drop|create|alter|truncate|grant|revoke|call|execute)\b", re.IGNORECASE)


def check_sql(sql: str, date_column: str | None = None, tables: list[str] | None = None) -> str:
    """``sql``, if it is one bounded read: no star, no change, a WHERE with the date column, known tables only."""
    bare = _LITERAL.sub(" ", sql).strip().rstrip(";")
    if ";" in bare:
        raise Refused("several statements")
    if not re.match(r"(?:with|select)\b", bare, re.IGNORECASE):
        raise Refused("not a query")
    if _CHANGES.search(bare):
        raise Refused("changes data")
    if re.search(r"\bselect\s+(?:distinct\s+)?(?:\w+\.)?\*", bare, re.IGNORECASE):
        raise Refused("selects every column")
    where = re.search(r"\bwhere\b(.*)", bare, re.IGNORECASE | re.DOTALL)
    if not where:
        raise Refused("no WHERE")
    if date_column and not re.search(rf"\b{re.escape(date_column)}\b", where[1], re.IGNORECASE):
        raise Refused(f"no bound on {date_column}")
    if tables is not None:
        named = {m.lower() for m in re.findall(r"\b(?:from|join)\s+([\w.]+)", bare, re.IGNORECASE)}
        inner = {m.lower() for m in re.findall(r"(?:\bwith(?:\s+recursive)?|,)\s*(\w+)\s+as\s*\(", bare, re.IGNORECASE)}
        unknown = named - inner - {t.lower() for t in tables}
        if unknown:
            raise Refused(f"reads {sorted(unknown)}")
    return sql
