"""Query registry: Spark callables and, where SQL can say it, the reference SQL text."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def cte(name: str, text: str) -> None:
    CTES[name] = text.strip()


def _needs(text: str, seen: list[str], me: str = "") -> None:
    for w in _WORD.findall(text):
        if w in CTES and w != me and w not in seen:
            _needs(CTES[w], seen, w)
            seen.append(w)


def with_ctes(body: str) -> str:
    """Prefix a SELECT with the shared CTEs it mentions, in dependency order."""
    order: list[str] = []
    _needs(body, order)
    if not order:
        return body.strip()
    rec = "RECURSIVE " if any("/*recursive*/" in CTES[n] for n in order) else ""
    return f"WITH {rec}" + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body.strip()


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return deco
