"""Functions of one row."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.feature import (TINY, Feature, as_feature, clip, finite, flag, ratio, row,
                                         safe_div, where)
from quantloom.functions.registry import function, register


def _both(a, b, value):
    return F.when(a.isNotNull() & b.isNotNull(), value)


@function("math")
def abs_(x) -> Feature:
    return row("abs", F.abs, x)


@function("math")
def log(x) -> Feature:
    return row("log", lambda a: F.when(a > TINY, F.log(a)), x, uses=2)


@function("math")
def sqrt(x) -> Feature:
    return row("sqrt", lambda a: F.sqrt(F.when(a < 0, 0.0).otherwise(a)), x, uses=2)


@function("math")
def sign(x) -> Feature:
    return row("sign", F.signum, x)


@function("math")
def exp(x) -> Feature:
    return row("exp", lambda a: F.exp(clip(a, -50.0, 50.0)), x, uses=3)


@function("math")
def tanh(x) -> Feature:
    return row("tanh", F.tanh, x)


@function("math")
def sigmoid(x) -> Feature:
    return row("sigmoid", lambda a: 1.0 / (1.0 + F.exp(-clip(a, -500.0, 500.0))), x, uses=3)


@function("math")
def relu(x) -> Feature:
    return row("relu", lambda a: F.when(a < 0, 0.0).otherwise(a), x, uses=2)


@function("math")
def neg(x) -> Feature:
    return -as_feature(x)


@function("math")
def sin(x) -> Feature:
    return row("sin", F.sin, x)


@function("math")
def cos(x) -> Feature:
    return row("cos", F.cos, x)


@function("math")
def gauss(x) -> Feature:
    return row("gauss", lambda a: F.exp(-a * a), x, uses=2)


@function("math")
def p4(x) -> Feature:
    return row("p4", lambda a: F.exp(-(a * a) * (a * a)), x, uses=4)


@function("math")
def softsign(x) -> Feature:
    return row("softsign", lambda a: a / (1.0 + F.abs(a)), x, uses=2)


@function("math")
def square_sigmoid(x) -> Feature:
    return row("square_sigmoid", lambda a: a * a / (1.0 + a * a), x, uses=4)


@function("math")
def square(x) -> Feature:
    return row("square", lambda a: a * a, x, uses=2)


@function("math")
def signed_power(x, e=2) -> Feature:
    return row("signed_power", lambda a, p: finite(F.signum(a) * F.pow(F.abs(a), p)), x, e, uses=2)


@function("math", "safe_max")
def max_(x, y) -> Feature:
    return row("max", lambda a, b: _both(a, b, F.greatest(a, b)), x, y, uses=2)


@function("math", "safe_min")
def min_(x, y) -> Feature:
    return row("min", lambda a, b: _both(a, b, F.least(a, b)), x, y, uses=2)


# Two-argument forms of the older function set. Truth there means |x| > 1e-10.
@function("binary")
def add(x, y) -> Feature:
    return as_feature(x) + y


@function("binary")
def sub(x, y) -> Feature:
    return as_feature(x) - y


@function("binary")
def mul(x, y) -> Feature:
    return as_feature(x) * y


@function("binary")
def div(x, y) -> Feature:
    return as_feature(x) / y


@function("binary")
def gt(x, y) -> Feature:
    return as_feature(x) > y


@function("binary")
def lt(x, y) -> Feature:
    return as_feature(x) < y


@function("binary")
def ge(x, y) -> Feature:
    return as_feature(x) >= y


@function("binary")
def le(x, y) -> Feature:
    return as_feature(x) <= y


@function("binary")
def eq(x, y) -> Feature:
    return as_feature(x).eq(y)


@function("binary")
def ne(x, y) -> Feature:
    return as_feature(x).ne(y)


@function("binary")
def and_(x, y) -> Feature:
    return row("truthy_and", lambda a, b: flag((F.abs(a) > TINY) & (F.abs(b) > TINY)), x, y)


@function("binary")
def or_(x, y) -> Feature:
    return row("truthy_or", lambda a, b: flag((F.abs(a) > TINY) | (F.abs(b) > TINY)), x, y)


register("ifelse", where, "math")


def guarded_ratio(x, y) -> Feature:
    """x / y, NULL unless the divisor is positive."""
    return row("guarded_ratio", lambda a, b: F.when(b > 0, a / b), x, y, uses=2)


def plain_ratio(x, y) -> Feature:
    return row("plain_ratio", ratio, x, y, uses=2)


def ratio_or_zero(x, y) -> Feature:
    return row("div", safe_div, x, y, uses=2)


def coalesce0(x) -> Feature:
    """Missing values become 0."""
    return row("coalesce0", lambda a: F.coalesce(finite(a), F.lit(0.0)), x, uses=2)
