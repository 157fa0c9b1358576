"""Plugins: named sets of generator functions, keywords and statements that descriptions may use.

A generator takes a call's arguments (syntax nodes) and the scope of the row and returns a ``Value``, a Spark column with
its type. ``columns`` makes one of a plain function of columns. Nothing is global: a registry is given to whoever parses
or generates.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

from .functions.compiler import compiled
from .functions.values import Value


@dataclass(frozen=True)
class Plugin:
    name: str
    generators: dict[str, Callable] = field(default_factory=dict)
    #: By keyword, functions of the parser that read a statement and return a node.
    statements: dict[str, Callable] = field(default_factory=dict)


def columns(f: Callable, kind: T.DataType) -> Callable:
    """A generator of ``f(draw, *columns)``, where ``draw()`` is a column of numbers in [0, 1)."""

    def call(args, scope) -> Value:
        return Value(f(lambda: scope.uniform(f.__name__), *[compiled(a, scope).column for a in args]), kind)

    return call


class Registry:
    """The plugins in use. A generator answers to ``plugin.name`` and, where that is unambiguous, to its bare name."""

    def __init__(self, *plugins: Plugin):
        self._plugins: dict[str, Plugin] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin: Plugin) -> None:
        if plugin.name in self._plugins:
            raise ValueError(f"a plugin {plugin.name!r} is registered")
        if taken := set(plugin.statements) & set(self.statements()):
            raise ValueError(f"plugin {plugin.name!r}: statements {sorted(taken)} are taken")
        self._plugins[plugin.name] = plugin

    def unregister(self, name: str) -> bool:
        return self._plugins.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self._plugins)

    def functions(self) -> dict[str, Callable]:
        return {f"{p.name}.{n}": f for p in self._plugins.values() for n, f in p.generators.items()}

    def statements(self) -> dict[str, Callable]:
        return {k: f for p in self._plugins.values() for k, f in p.statements.items()}

    def load(self, path: str | Path) -> list[str]:
        """Registers what a Python file names ``plugin`` or lists as ``plugins``; for a folder, each of its files. Returns
        the names."""
        path, found = Path(path), []
        files = sorted(f for f in path.glob("*.py") if not f.name.startswith("_")) if path.is_dir() else [path]
        for f in files:
            spec = importlib.util.spec_from_file_location(f"loomwork_plugin_{f.stem}", f)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            for p in [*getattr(module, "plugins", []), *([module.plugin] if hasattr(module, "plugin") else [])]:
                self.register(p)
                found.append(p.name)
        return found
