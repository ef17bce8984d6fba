"""Columns of a batch as NumPy arrays, under the rules that Spark's columns follow: null is passed on, NaN is the largest value and equal to
itself. A rule written with the functions below holds for both."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


class Values:
    """Numbers or truths ``x``, of which those where ``ok`` is false are null; without ``ok`` none is. Where one is null, ``x`` says nothing."""

    def __init__(self, x: np.ndarray, ok: np.ndarray | None = None, taken: np.ndarray | None = None):
        self.x, self.ok, self.taken = x, ok, taken

    def arrow(self) -> pa.Array:
        return pa.array(self.x.astype("f8", copy=False), mask=None if self.ok is None else ~self.ok)

    def at(self, there: np.ndarray):
        """Where ``there`` holds."""
        return self if there.all() else Values(self.x[there], None if self.ok is None else self.ok[there])

    def true(self) -> np.ndarray:
        return self.x if self.ok is None else self.x & self.ok

    def __add__(self, other):
        return _both(np.add, self, other)

    def __radd__(self, other):
        return _both(np.add, other, self)

    def __sub__(self, other):
        return _both(np.subtract, self, other)

    def __rsub__(self, other):
        return _both(np.subtract, other, self)

    def __mul__(self, other):
        return _both(np.multiply, self, other)

    def __rmul__(self, other):
        return _both(np.multiply, other, self)

    def __truediv__(self, other):
        return _both(np.divide, self, other)

    def __lt__(self, other):
        return _both(_less, self, other)

    def __gt__(self, other):
        return _both(_less, other, self)

    def __le__(self, other):
        return _not(_both(_less, other, self))

    def __ge__(self, other):
        return _not(_both(_less, self, other))

    def __eq__(self, other):
        return _both(_same, self, other)

    def __ne__(self, other):
        return _not(_both(_same, self, other))

    __hash__ = None

    def __and__(self, other):
        if self.ok is None and other.ok is None:
            return Values(self.x & other.x)
        a, b = _known(self), _known(other)
        return Values((self.x | ~a) & (other.x | ~b), (a & b) | (a & ~self.x) | (b & ~other.x))

    def __or__(self, other):
        if self.ok is None and other.ok is None:
            return Values(self.x | other.x)
        a, b = _known(self), _known(other)
        return Values((self.x & a) | (other.x & b), (a & b) | (a & self.x) | (b & other.x))

    def isNull(self):
        return Values(~_known(self))

    def isNotNull(self):
        return Values(_known(self))

    def cast(self, kind: str):
        """Truths as numbers; numbers stay, as nothing here is cut to whole ones."""
        return Values(self.x.astype("f8", copy=False), self.ok)

    def when(self, test, value):
        return self._taking(test.true() & ~self.taken, value)

    def otherwise(self, value):
        return self._taking(~self.taken, value)

    def _taking(self, hit: np.ndarray, value):
        value = _lifted(value, self)
        return Values(np.where(hit, value.x, self.x), np.where(hit, _known(value), _known(self)), self.taken | hit)


def _known(v: Values) -> np.ndarray:
    return np.ones(len(v.x), bool) if v.ok is None else v.ok


def _lifted(value, like: Values) -> Values:
    return value if isinstance(value, Values) else Values(np.full(len(like.x), value))


def _not(v: Values) -> Values:
    return Values(~v.x, v.ok)


def _both(f, a, b) -> Values:
    x, m = (a.x, a.ok) if isinstance(a, Values) else (a, None)
    y, n = (b.x, b.ok) if isinstance(b, Values) else (b, None)
    with np.errstate(all="ignore"):
        return Values(f(x, y), m if n is None else n if m is None else m & n)


def _less(x, y) -> np.ndarray:
    nan = np.isnan(y)
    return (x < y) | (nan & ~np.isnan(x)) if nan.any() else x < y


def _same(x, y) -> np.ndarray:
    nan = np.isnan(x)
    return (x == y) | (nan & np.isnan(y)) if nan.any() else x == y


def _extreme(f, a: Values, b: Values) -> Values:
    if a.ok is None and b.ok is None:
        return Values(f(a.x, b.x))
    m, n = _known(a), _known(b)
    return Values(np.where(m & n, f(a.x, b.x), np.where(m, a.x, b.x)), m | n)


def _like(values) -> Values | None:
    return next((v for v in values if isinstance(v, Values)), None)


def _columns(values) -> list:
    return [F.lit(v) if isinstance(v, (bool, int, float)) else v for v in values]


def when(test, value):
    if not isinstance(test, Values):
        return F.when(test, value)
    value, none = _lifted(value, test), np.zeros(len(test.x), bool)
    return Values(np.zeros_like(value.x), none, none).when(test, value)


def coalesce(*values):
    if (like := _like(values)) is None:
        return F.coalesce(*_columns(values))

    def first(a: Values, b: Values) -> Values:
        return a if a.ok is None else Values(np.where(a.ok, a.x, b.x), None if b.ok is None else a.ok | b.ok)

    return reduce(first, [_lifted(v, like) for v in values])


def greatest(*values):
    """The largest that isn't null."""
    if (like := _like(values)) is None:
        return F.greatest(*_columns(values))
    return reduce(lambda a, b: _extreme(np.maximum, a, b), [_lifted(v, like) for v in values])


def least(*values):
    """The smallest that isn't null."""
    if (like := _like(values)) is None:
        return F.least(*_columns(values))
    return reduce(lambda a, b: _extreme(np.fmin, a, b), [_lifted(v, like) for v in values])


def size(v):
    return Values(np.abs(v.x), v.ok) if isinstance(v, Values) else F.abs(v)


def signum(v):
    return Values(np.sign(v.x), v.ok) if isinstance(v, Values) else F.signum(v)


def nullif(v, other):
    if not isinstance(v, Values):
        return F.nullif(v, *_columns([other]))
    return Values(v.x, _known(v) & ~_both(_same, v, other).true())
