"""The catalogue of scheduling components.

A component class enters the catalogue when it is defined: ``class Softmax(Reweighter, name="softmax")``. Its kind is
that of its contract. Factories that are no classes of a contract are put in with ``CATALOGUE.add``.
"""

from __future__ import annotations

import inspect
from collections import ChainMap
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any


def options_of(factory: Callable) -> frozenset[str] | None:
    """The options that a factory can be given by name; None if it takes any.

    A constructor that hands further options on to its base class takes the base's as well.
    """
    chain = [vars(c)["__init__"] for c in inspect.getmro(factory) if c is not object and "__init__" in vars(c)] if inspect.isclass(factory) else [factory]
    names: set[str] = set()
    for step in chain:
        takes = inspect.signature(step).parameters
        names.update(n for n, p in takes.items() if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY) and n != "self")
        if all(p.kind is not p.VAR_KEYWORD for p in takes.values()):
            return frozenset(names)
    return None if chain else frozenset()


@dataclass(frozen=True)
class Entry:
    """One component: its kind, name, factory and the options that the factory takes."""

    kind: str
    name: str
    factory: Callable[..., Any]
    options: frozenset[str] | None

    def make(self, *layers: Mapping[str, Any] | None) -> Any:
        """An instance. The first layer that has an option decides on it; options that the factory doesn't take are left out."""
        given = ChainMap(*[dict(layer) for layer in layers if layer])
        return self.factory(**{k: v for k, v in given.items() if self.options is None or k in self.options})


class Catalogue:
    def __init__(self) -> None:
        self.entries: list[Entry] = []

    def names(self, kind: str) -> list[str]:
        return sorted(e.name for e in self.entries if e.kind == kind)

    def add(self, kind: str, name: str, factory: Callable[..., Any]) -> Entry:
        if name in self.names(kind):
            raise ValueError(f"there is a {kind} {name!r} already")
        self.entries.append(Entry(kind, name, factory, options_of(factory)))
        return self.entries[-1]

    def find(self, kind: str, name: str) -> Entry:
        for e in self.entries:
            if (e.kind, e.name) == (kind, name):
                return e
        raise KeyError(f"{name!r} is no {kind}; known: {', '.join(self.names(kind)) or 'none'}")


CATALOGUE = Catalogue()
