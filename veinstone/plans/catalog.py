"""All registered queries that are not part of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from veinstone.plans import checks, cochange, evolution, graphs, ledgers, people, prose, sequences, stored, texts, updates

_MODULES = (cochange, graphs, sequences, texts, ledgers, updates, people, prose, checks, stored, evolution)


def queries() -> dict[str, Callable]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
