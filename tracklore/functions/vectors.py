"""Array expressions that stay in the JVM: softmax, distances, argmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def total(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(ZERO), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """Bind a value once for ``body``.  Catalyst copies a plain sub-expression into
    every lambda call that uses it; a lambda variable is computed a single time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def logsumexp(v: Column | str, temperature: float = 1.0) -> Column:
    v = F.transform(_c(v), lambda x: x / temperature) if temperature != 1.0 else _c(v)
    return let(F.array_max(v), lambda top: top + F.log(
        F.aggregate(v, F.lit(ZERO), lambda a, x: a + F.exp(x - top))))


def softmax(v: Column | str) -> Column:
    def scaled(top):
        e = F.transform(_c(v), lambda x: F.exp(x - top))
        return let(e, lambda w: let(total(w), lambda n: F.transform(w, lambda x: x / n)))

    return let(F.array_max(_c(v)), scaled)


def ranked(v: Column | str) -> Column:
    """Array of (np, c): negated value and index, best first, ties by index."""
    v = _c(v)
    return F.array_sort(
        F.transform(v, lambda x, i: F.struct((-x).alias("np"), i.alias("c")))
    )


def argmax(v: Column | str) -> Column:
    v = _c(v)
    return F.array_position(v, F.array_max(v)).cast("int") - 1


def entropy(p: Column | str) -> Column:
    def term(a, x):
        q = F.greatest(x, F.lit(1e-8))
        return a - q * F.log(q)

    return F.aggregate(_c(p), F.lit(ZERO), term)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(ZERO), lambda a, x: a + x * x))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))
