"""Limits and budgets: plain numbers that a plan is built with. Out of range is an error, never clamped."""

from __future__ import annotations

RESULTS, RESULTS_MOST = 10, 500
BUDGET, BUDGET_MOST = 2_000, 200_000
PROJECTS_MOST = 100


def results(limit: int | None = None) -> int:
    limit = RESULTS if limit is None else limit
    if not 1 <= limit <= RESULTS_MOST:
        raise ValueError(f"a result limit lies between 1 and {RESULTS_MOST}")
    return limit


def budget(tokens: int | None = None) -> int:
    tokens = BUDGET if tokens is None else tokens
    if not 1 <= tokens <= BUDGET_MOST:
        raise ValueError(f"a token budget lies between 1 and {BUDGET_MOST}")
    return tokens


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(high, x))


def search_pool(limit: int) -> int:
    """Candidates to fetch for ``limit`` results."""
    return min(500, max(20, 3 * limit))


def symbol_pool(limit: int) -> int:
    return clamp(20 * limit, 100, 2000)


def local_pool(limit: int) -> int:
    """Candidates of each project for ``limit`` federated results."""
    return 500 if limit >= 125 else clamp(4 * limit, 20, 500)


def context_pool(tokens: int) -> int:
    return clamp(tokens // 40, 20, 100)


def budget_split(tokens: int, instructions: bool = True, skills: bool = True, history: bool = True) -> dict[str, int]:
    """A context budget's parts: what's asked for in order, tasks get the rest."""
    left = budget(tokens)
    parts = {"instructions": 0, "skills": 0, "history": 0}
    if instructions:
        parts["instructions"] = min(left, min(600, max(24, tokens // 4)))
        left -= parts["instructions"]
    if skills:
        parts["skills"] = min(left, min(2000, max(64, tokens // 5)))
        left -= parts["skills"]
    if history and tokens >= 500:
        parts["history"] = min(left, min(500, max(64, tokens * 15 // 100)))
        left -= parts["history"]
    return parts | {"tasks": left}


def fair_share(tokens: int, projects: int, place: int) -> tuple[int, int]:
    """(fair part, candidate budget) of the project at ``place`` of ``projects``."""
    if not 1 <= projects <= PROJECTS_MOST or tokens < projects:
        raise ValueError(f"1 to {PROJECTS_MOST} projects, and a token for each")
    fair = tokens // projects + (1 if place < tokens % projects else 0)
    return fair, min(tokens, 3 * fair)


def full_file_threshold(tokens: int) -> int:
    return max(120, min(800, tokens // 4))
