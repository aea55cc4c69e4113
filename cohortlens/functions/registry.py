"""Name → implementation registries: the extension surface of the library."""

from __future__ import annotations

from typing import Generic, TypeVar

T = TypeVar("T")


class Registry(Generic[T]):
    def __init__(self, kind: str):
        self.kind = kind
        self._entries: dict[str, T] = {}

    def register(self, *names: str):
        cleaned = [str(n).strip().lower() for n in names]
        if not cleaned or not all(cleaned):
            raise ValueError(f"a {self.kind} needs at least one non-empty name")

        def keep(entry: T) -> T:
            for name in cleaned:
                self._entries[name] = entry
            return entry

        return keep

    def __getitem__(self, name: str) -> T:
        key = str(name).strip().lower()
        if key not in self._entries:
            raise ValueError(f"unknown {self.kind}: {name!r}; known: {', '.join(self._entries)}")
        return self._entries[key]

    def names(self) -> tuple[str, ...]:
        return tuple(self._entries)
