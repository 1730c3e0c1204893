"""Expressions in Spark SQL text: built-in functions only, except `decoders`.

They are text because one parsed string costs the driver a single call, where
the same nested lambdas as Column objects cost hundreds, on every search.
Arguments named `x`, `left` and so on are SQL expressions.
"""


def quoted(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(values: list[str]) -> str:
    return ", ".join(quoted(value) for value in values)


def strings(values: list[str]) -> str:
    """SQL array of string literals."""
    return f"cast(array({listed(values)}) AS array<string>)"
