"""The numeric helpers as SQL text, for expressions built by the feature planner."""

from __future__ import annotations


def num(x: float) -> str:
    """Double literal (a bare decimal literal would be a DECIMAL)."""
    return f"{float(x)!r}D"


def div(a: str, b: str) -> str:
    """``a / b`` with ``x/0 = +-inf`` and ``0/0`` (or a missing part) missing."""
    return (f"(CASE WHEN ({b}) <> 0 THEN ({a}) / double({b}) "
            f"WHEN ({b}) = 0 AND ({a}) > 0 THEN double('Infinity') "
            f"WHEN ({b}) = 0 AND ({a}) < 0 THEN double('-Infinity') END)")


def finite(x: str) -> str:
    """NaN and +-inf become NULL."""
    return f"(CASE WHEN NOT isnan({x}) AND abs({x}) <> double('Infinity') THEN {x} END)"


def above(x: str, bound: float) -> str:
    """Lower clip that leaves NULL alone."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, {num(bound)}) END"


def below(x: str, bound: float) -> str:
    """Upper clip that leaves NULL alone."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN least({x}, {num(bound)}) END"


def flag(condition: str) -> str:
    """Condition as 0/1; an unknown condition is 0."""
    return f"int(coalesce({condition}, false))"


def rounded(x: str, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"round(double({x}), {digits}) + 0D"
