"""The same views as common table expressions for the check SQL."""

from __future__ import annotations

import re

from .text import DUCK, VIEWS, render
from .views import needed


def with_views(sql: str) -> str:
    sql = sql.strip().rstrip(";")
    ctes = [f"{name} AS ({render(VIEWS[name], DUCK)})" for name in needed(sql, VIEWS)]
    if not ctes:
        return sql
    match = re.match(r"(?is)WITH\s+(RECURSIVE\s+)?", sql)
    if match:
        head, tail = match.group(0), sql[match.end():]
        return f"{head}{', '.join(ctes)}, {tail}"
    return f"WITH {', '.join(ctes)} {sql}"
