"""Libraries that only some features need."""

from __future__ import annotations

import importlib
from types import ModuleType


def require(module: str, purpose: str) -> ModuleType:
    """The module, or an ImportError that says what it is wanted for and how to do without."""
    try:
        return importlib.import_module(module)
    except ImportError as error:
        raise ImportError(f"{purpose} needs the package {module.split('.')[0]}, which is not installed; answers work without it, from terms alone") from error
