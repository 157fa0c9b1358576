"""Functions of the language; importing this package registers all of them."""

from . import builtins, domains  # noqa: F401
