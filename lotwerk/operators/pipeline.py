"""Steps that depend on each other, run in order or not at all."""

from __future__ import annotations

from collections.abc import Callable, Sequence


class Pipeline:
    """Named steps with what they require. A run is refused before its first step if a required step is neither among the
    steps asked for, in order, nor done already."""

    def __init__(self) -> None:
        self._steps: dict[str, tuple[tuple[str, ...], Callable[[], object]]] = {}

    def step(self, name: str, requires: Sequence[str] = ()) -> Callable:
        def put(f: Callable[[], object]) -> Callable[[], object]:
            if name in self._steps:
                raise ValueError(f"step {name} exists")
            if unknown := [r for r in requires if r not in self._steps]:
                raise ValueError(f"step {name} requires {unknown}, not known before it")
            self._steps[name] = tuple(requires), f
            return f

        return put

    def run(self, names: Sequence[str] | None = None, done: Sequence[str] = ()) -> dict[str, object]:
        """Run the steps names, all without it, and return what each gave."""
        names = list(self._steps) if names is None else list(names)
        ready = set(done)
        for n in names:
            if n not in self._steps:
                raise ValueError(f"no step {n}")
            if lacks := [r for r in self._steps[n][0] if r not in ready]:
                raise ValueError(f"{n} before {', '.join(lacks)}: nothing was run")
            ready.add(n)
        return {n: self._steps[n][1]() for n in names}
