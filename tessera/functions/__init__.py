"""Column functions (built-in expressions only; no Python UDFs)."""

from tessera.functions.memory import parse_memory_mb

__all__ = ["parse_memory_mb"]
