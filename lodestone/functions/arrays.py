"""SQL text for work on arrays: small macros around ``transform`` and ``filter``.

Expressions of many nested lambdas are written as SQL text, which the session
parses in one go; building them operator by operator from Python costs about a
millisecond per operator.
"""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature
from itertools import count

_names = count()


def _fresh() -> str:
    return f"v{next(_names)}"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def word_list(words: list[str]) -> str:
    return ", ".join(quoted(w) for w in words)


def _lambda(body: Callable[..., str]) -> str:
    names = [_fresh() for _ in signature(body).parameters]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {body(*names)}"


def each(items: str, body: Callable[..., str]) -> str:
    """``transform`` with the entry, or the entry and its 0-based position."""
    return f"transform({items}, {_lambda(body)})"


def those(items: str, test: Callable[..., str]) -> str:
    """``filter``."""
    return f"filter({items}, {_lambda(test)})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return f"{each(f'array({value})', body)}[0]"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def picked(items: str, test: Callable[[str, str], str], value: Callable[[str, str], str]) -> str:
    """``value(entry, position)`` of the entries for which ``test`` holds."""
    return those(each(items, lambda x, i: f"CASE WHEN {test(x, i)} THEN {value(x, i)} END"),
                 lambda v: f"{v} IS NOT NULL")


def positions(items: str, test: Callable[[str, str], str]) -> str:
    return picked(items, test, lambda x, i: i)


def first_index(items: str, test: Callable[[str, str], str]) -> str:
    """0-based position of the first entry for which ``test(entry, position)`` holds."""
    return f"get({positions(items, test)}, 0)"


def last_index(items: str, test: Callable[[str, str], str]) -> str:
    return f"array_max({positions(items, test)})"


def split_where(items: str, is_cut: Callable[[str], str]) -> str:
    """Split an array at the entries where ``is_cut`` holds (they are dropped)."""
    marks = positions(items, lambda x, i: is_cut(x))
    bounds = f"concat(array(-1), {marks}, array(size({items})))"
    return let(bounds, lambda b: each(
        f"sequence(0, size({b}) - 2)",
        lambda k: f"slice({items}, get({b}, {k}) + 2, get({b}, {k} + 1) - get({b}, {k}) - 1)"))
