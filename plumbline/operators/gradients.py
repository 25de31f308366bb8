"""Derivatives of the arrays that fusion heads compute: numpy's own operators on :class:`Var` keep how a value came about."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np

from .fusion import _erf, erf, gelu, relu, same


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum a gradient over the axes along which a value was repeated."""
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for axis, n in enumerate(shape):
        if n == 1 and g.shape[axis] != 1:
            g = g.sum(axis=axis, keepdims=True)
    return g


#: For each operator the derivatives by its arguments, from the gradient g, the result r and the arguments a and b.
_SLOPES: dict[object, tuple[Callable, ...]] = {
    np.add: (lambda g, r, a, b: g, lambda g, r, a, b: g),
    np.subtract: (lambda g, r, a, b: g, lambda g, r, a, b: -g),
    np.multiply: (lambda g, r, a, b: g * b, lambda g, r, a, b: g * a),
    np.divide: (lambda g, r, a, b: g / b, lambda g, r, a, b: -g * a / b**2),
    np.matmul: (lambda g, r, a, b: g @ b.T, lambda g, r, a, b: a.T @ g),
    np.maximum: (lambda g, r, a, b: g * (a > b), lambda g, r, a, b: g * (a <= b)),
    np.logaddexp: (lambda g, r, a, b: g * np.exp(a - r), lambda g, r, a, b: g * np.exp(b - r)),
    np.negative: (lambda g, r, a: -g,),
    np.exp: (lambda g, r, a: g * r,),
    np.sqrt: (lambda g, r, a: g / (2 * r),),
    _erf: (lambda g, r, a: g * 2 / math.sqrt(math.pi) * np.exp(-a * a),),
}


def _normed(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, Callable]:
    """Normalised rows, and the slopes by x, scale and shift."""
    share = np.full((x.shape[1], 1), 1 / x.shape[1])  # a product with it is the mean of a row
    off = x - x @ share
    inverse = 1 / np.sqrt((off * off) @ share + 1e-5)
    plain = off * inverse

    def back(g: np.ndarray) -> list[np.ndarray]:
        by, along, ones = g * scale, g * plain, np.ones(len(g))
        return [(by - by @ share - plain * ((along * scale) @ share)) * inverse, ones @ along, ones @ g]

    return plain * scale + shift, back


def _together(sources: list[Var], back: Callable) -> tuple:
    """Pairs of a value and its slope, where one call gives the slopes of all."""
    got: list[np.ndarray] = []

    def part(k: int) -> Callable:
        def slope(g: np.ndarray) -> np.ndarray:
            if not got:
                got.extend(back(g))
            return got[k]

        return slope

    return tuple((v, part(k)) for k, v in enumerate(sources))


_COUNT = itertools.count()


class Var(np.lib.mixins.NDArrayOperatorsMixin):
    """An array whose gradient is wanted."""

    def __init__(self, value: np.ndarray, back: tuple = ()):
        self.value, self.back, self.grad, self.number = np.asarray(value, float), back, None, next(_COUNT)

    shape = property(lambda self: self.value.shape)

    def __len__(self) -> int:
        return len(self.value)

    def __array_ufunc__(self, ufunc, method, *args, **kwargs):
        if method != "__call__" or kwargs or ufunc not in _SLOPES:
            return NotImplemented
        raw = [np.asarray(a.value if isinstance(a, Var) else a) for a in args]
        result = np.asarray(ufunc(*raw), float)
        return Var(result, tuple((a, lambda g, f=f, s=a.value.shape: _fit(f(g, result, *raw), s)) for a, f in zip(args, _SLOPES[ufunc], strict=True) if isinstance(a, Var)))

    def __array_function__(self, func, types, args, kwargs):
        if func is np.hstack:
            parts = [a if isinstance(a, Var) else Var(a) for a in args[0]]
            ends = np.cumsum([p.shape[1] for p in parts])
            return Var(np.hstack([p.value for p in parts]), tuple((p, lambda g, a=e - p.shape[1], e=e: g[:, a:e]) for p, e in zip(parts, ends, strict=True)))
        if func is np.clip:
            x, lo, hi = args
            return Var(np.clip(x.value, lo, hi), ((x, lambda g: g * ((x.value > lo) & (x.value < hi))),))
        if func is np.where and isinstance(args[1], Var):
            on, x, other = args
            return Var(np.where(on, x.value, other), ((x, lambda g: np.where(on, g, 0.0)),))
        return NotImplemented

    # Small arrays cost by the operation, so the larger steps of a head are operations of their own.

    def softmax(self) -> Var:
        e = np.exp(self.value - np.maximum.reduce(self.value, axis=1, keepdims=True))
        p = e / np.add.reduce(e, axis=1, keepdims=True)
        return Var(p, ((self, lambda g: p * (g - np.add.reduce(g * p, axis=1, keepdims=True))),))

    def mix(self, parts: list[Var]) -> Var:
        """The sum of the parts, each times its column of these weights."""
        w, values = self.value, [p.value for p in parts]
        out = sum(w[:, i : i + 1] * v for i, v in enumerate(values))
        own = lambda g: np.stack([np.add.reduce(g * v, axis=1) for v in values], axis=1)
        return Var(out, ((self, own), *((p, lambda g, i=i: g * w[:, i : i + 1]) for i, p in enumerate(parts))))

    def normed(self, scale: Var, shift: Var) -> Var:
        out, back = _normed(self.value, scale.value, shift.value)
        return Var(out, _together([self, scale, shift], back))

    def layer(self, x: np.ndarray | Var, bias: Var, scale: Var | None, shift: Var | None, act: Callable) -> Var:
        """A whole layer of a head with these weights."""
        if act not in (same, relu, gelu):
            raise ValueError("a layer's activation has no slope here")
        follow, raw = isinstance(x, Var), x.value if isinstance(x, Var) else x
        z, norm = raw @ self.value + bias.value, None
        if scale is not None:
            z, norm = _normed(z, scale.value, shift.value)
        share = 0.5 * (1 + erf(z / math.sqrt(2))) if act is gelu else None

        def back(g: np.ndarray) -> list[np.ndarray]:
            if act is gelu:
                g = g * (share + z * np.exp(z * z * -0.5) * (1 / math.sqrt(2 * math.pi)))
            elif act is relu:
                g = g * (z > 0)
            g, *rest = norm(g) if norm else (g,)
            return [raw.T @ g, np.ones(len(g)) @ g, *rest, *([g @ self.value.T] if follow else [])]

        sources = [self, bias, *([] if scale is None else [scale, shift]), *([x] if follow else [])]
        return Var(z * share if act is gelu else np.maximum(z, 0) if act is relu else z, _together(sources, back))

    def __getitem__(self, at) -> Var:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.value)
            out[at] = g
            return out

        return Var(self.value[at], ((self, back),))

    def sum(self, axis: int, keepdims: bool = False) -> Var:
        return Var(self.value.sum(axis=axis, keepdims=keepdims), ((self, lambda g: np.broadcast_to(g if keepdims else np.expand_dims(g, axis), self.shape)),))

    def mean(self, axis: int, keepdims: bool = False) -> Var:
        return self.sum(axis, keepdims) / float(self.shape[axis])

    def max(self, axis: int, keepdims: bool = False) -> np.ndarray:
        """A shift that cancels out: its own slope is not followed."""
        return self.value.max(axis=axis, keepdims=keepdims)

    def astype(self, _) -> Var:
        return self


def pull(last: Var, grad: np.ndarray) -> None:
    """Set ``grad`` of all values that ``last`` came from."""
    order, seen, stack = [], {id(last)}, [last]
    while stack:
        order.append(v := stack.pop())
        for child, _ in v.back:
            if id(child) not in seen:
                seen.add(id(child))
                stack.append(child)
    order.sort(key=lambda v: -v.number)  # what a value came from is older
    last.grad = grad
    for v in order:
        for child, f in v.back:
            step = f(v.grad)
            child.grad = step if child.grad is None else child.grad + step
