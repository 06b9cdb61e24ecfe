"""Extensions of the library: named sets of queries with dependencies, the services that they share, and events between them.

All of it lives on the driver, where plans are made; nothing of it goes to executors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

from lodeframe.plans.registry import Query


class Events:
    """Listeners by the type of what they hear; they are called in the order in which they subscribed."""

    def __init__(self):
        self._listeners: dict[int, tuple[type, Callable[[Any], None]]] = {}
        self._next = 1

    def subscribe(self, kind: type, listener: Callable[[Any], None]) -> int:
        """A number by which to unsubscribe."""
        number, self._next = self._next, self._next + 1
        self._listeners[number] = (kind, listener)
        return number

    def unsubscribe(self, number: int) -> bool:
        return self._listeners.pop(number, None) is not None

    def publish(self, event: object) -> int:
        """How many listeners heard it. One that leaves meanwhile isn't called any more, and one that joins not yet."""
        heard = 0
        for number, (kind, _) in list(self._listeners.items()):
            if isinstance(event, kind) and number in self._listeners:
                self._listeners[number][1](event)
                heard += 1
        return heard


class Context:
    """What extensions see of each other: events, and one service a type."""

    def __init__(self):
        self.events = Events()
        self._services: dict[type, object] = {}

    def offer(self, kind: type, service: object) -> None:
        if not isinstance(service, kind):
            raise TypeError(f"not a {kind.__name__}")
        self._services[kind] = service

    def service(self, kind: type) -> Any:
        """None if nobody offers it."""
        return self._services.get(kind)


@dataclass
class Extension:
    """Queries under a name; ``needs`` names the extensions that must be there first."""

    name: str
    queries: dict[str, Query] = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    on_load: Callable[[Context], None] = lambda context: None
    on_unload: Callable[[Context], None] = lambda context: None


class Extensions:
    """The loaded extensions, in the order in which they were loaded."""

    def __init__(self):
        self.context = Context()
        self._loaded: dict[str, Extension] = {}

    @property
    def names(self) -> list[str]:
        return list(self._loaded)

    def load(self, *wanted: Extension) -> list[str]:
        """Load all of them, each behind what it needs; nothing is loaded if a need is missing, or needs or names clash."""
        by_name = {x.name: x for x in wanted}
        if len(by_name) < len(wanted) or by_name.keys() & self._loaded.keys():
            raise ValueError("an extension is loaded once")
        missing = sorted({n for x in wanted for n in x.needs} - by_name.keys() - self._loaded.keys())
        if missing:
            raise LookupError(f"missing extensions: {', '.join(missing)}")
        taken = [q for x in (*self._loaded.values(), *wanted) for q in x.queries]
        if len(set(taken)) < len(taken):
            raise ValueError("two extensions have a query of one name")
        try:
            order = [n for n in TopologicalSorter({x.name: x.needs for x in wanted}).static_order() if n in by_name]
        except CycleError as cycle:
            raise ValueError(f"extensions need each other: {' > '.join(cycle.args[1])}") from None
        for name in order:
            by_name[name].on_load(self.context)
            self._loaded[name] = by_name[name]
        return order

    def unload(self, name: str) -> None:
        if name not in self._loaded:
            raise LookupError(name)
        users = [x.name for x in self._loaded.values() if name in x.needs]
        if users:
            raise ValueError(f"{name} is needed by {', '.join(users)}")
        self._loaded.pop(name).on_unload(self.context)

    def close(self) -> None:
        """Unload all, the last loaded first."""
        for name in reversed(self.names):
            self.unload(name)

    def queries(self) -> dict[str, Query]:
        return {k: q for x in self._loaded.values() for k, q in x.queries.items()}
