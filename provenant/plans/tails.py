"""Tails of distributions in SQL: integrals by Simpson's rule, as DuckDB has none of these functions."""

from __future__ import annotations

from provenant.operators.statistics import ERFC

_N = 4000


def _integral(upper: str, f: str) -> str:
    """Integral from 0 of f, in which {u} stands for the variable."""
    at = f.replace("{u}", f"(i * ({upper}) / {_N})")
    return f"(({upper}) / {3 * _N} * list_sum(list_transform(range({_N + 1}), lambda i: CASE WHEN i = 0 OR i = {_N} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({at}))))"


def t_tail(t: str, df: str) -> str:
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * " + _integral(f"atan(abs({t}) / sqrt({df}))", f"power(cos({{u}}), ({df}) - 1)") + ")"


def f_tail(f: str, a: str, b: str) -> str:
    return f"(1 - 2 * exp(lgamma((({a}) + ({b})) / 2.0) - lgamma(({a}) / 2.0) - lgamma(({b}) / 2.0)) * " + _integral(f"atan(sqrt(({a}) * ({f}) / ({b})))", f"power(cos({{u}}), ({b}) - 1) * power(sin({{u}}), ({a}) - 1)") + ")"


def chi2_tail(x: str, df: str) -> str:
    return f"(1 - 2 * exp(-lgamma(({df}) / 2.0) - ({df}) / 2.0 * ln(2.0)) * " + _integral(f"sqrt({x})", f"power({{u}}, ({df}) - 1) * exp(-({{u}}) * ({{u}}) / 2)") + ")"


def normal_tail(z: str) -> str:
    """The polynomial of the engine, for z >= 0."""
    t = f"(1 / (1 + 0.5 * ({z}) / sqrt(2.0)))"
    poly = "0.0"
    for c in ERFC[::-1]:
        poly = f"({poly} * {t} + {c})"
    return f"least(1.0, {t} * exp(-({z}) * ({z}) / 2 + {poly}))"
