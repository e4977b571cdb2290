"""Plug-in points for models. Implementations are created once per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol


class Embedder(Protocol):
    """Texts to vectors; an entry is None where that text failed."""

    name: str
    max_batch: int

    def embed(self, texts: Sequence[str]) -> list[Sequence[float] | None]: ...


class Completer(Protocol):
    """Prompts to texts; an entry is None where that prompt failed."""

    name: str

    def complete(self, prompts: Sequence[str], max_tokens: int) -> list[str | None]: ...


class Scorer(Protocol):
    """Relevance of passages to one query, on the scale named by ``kind``."""

    kind: str  # "ten" (0..10), "logit" or "unit"

    def score(self, query: str, passages: Sequence[str]) -> list[float]: ...


def in_calls(call: Callable[[Sequence], Sequence], items: Sequence, size: int) -> tuple[list, list[str | None]]:
    """(results, errors) of ``call`` on at most ``size`` items at a time.

    A call that raises, or returns another number of results, is made once more;
    if that fails too, only its own items have no result.
    """
    results: list = []
    errors: list[str | None] = []
    for at in range(0, len(items), size):
        some = items[at : at + size]
        made, error = None, None
        for _ in range(2):
            try:
                made = list(call(some))
            except Exception as problem:  # whatever a plug-in raises
                made, error = None, str(problem) or type(problem).__name__
                continue
            if len(made) == len(some):
                break
            made, error = None, f"{len(some)} items, another number of results"
        results += made if made is not None else [None] * len(some)
        errors += [error if made is None else "no answer" if r is None else None for r in results[at:]]
    return results, errors


EmbedderFactory = Callable[[], Embedder]
CompleterFactory = Callable[[], Completer]
ScorerFactory = Callable[[], Scorer]
