"""Optimizers over lists of arrays, updated in place; state is made at the first step."""

from __future__ import annotations

import numpy as np


class _Optimizer:
    def __init__(self, lr: float, **limits):
        if lr <= 0:
            raise ValueError("lr must be positive")
        for name, (value, low, high, closed) in limits.items():
            if not (low <= value < high if closed else low < value < high):
                raise ValueError(f"{name} is out of range")
        self.lr, self._state = lr, None

    def _slots(self, params, n):
        if self._state is None:
            self._state = [[np.zeros_like(p) for p in params] for _ in range(n)]
        return self._state


class SGD(_Optimizer):
    def __init__(self, lr: float = 0.01):
        super().__init__(lr)

    def step(self, params, grads) -> None:
        for p, g in zip(params, grads, strict=True):
            p -= self.lr * g


class Momentum(_Optimizer):
    """v = momentum v - lr g; p += v."""

    def __init__(self, lr: float = 0.01, momentum: float = 0.9):
        super().__init__(lr, momentum=(momentum, 0, 1, True))
        self.momentum = momentum

    def step(self, params, grads) -> None:
        (velocity,) = self._slots(params, 1)
        for p, g, v in zip(params, grads, velocity, strict=True):
            v *= self.momentum
            v -= self.lr * g
            p += v


class Nesterov(Momentum):
    """The velocity's lookahead: p += (1 + momentum) v - momentum (v before)."""

    def step(self, params, grads) -> None:
        (velocity,) = self._slots(params, 1)
        for p, g, v in zip(params, grads, velocity, strict=True):
            before = v.copy()
            v *= self.momentum
            v -= self.lr * g
            p += (1 + self.momentum) * v - self.momentum * before


class RMSprop(_Optimizer):
    def __init__(self, lr: float = 0.001, beta: float = 0.9, eps: float = 1e-8):
        super().__init__(lr, beta=(beta, 0, 1, False), eps=(eps, 0, np.inf, False))
        self.beta, self.eps = beta, eps

    def step(self, params, grads) -> None:
        (square,) = self._slots(params, 1)
        for p, g, s in zip(params, grads, square, strict=True):
            s *= self.beta
            s += (1 - self.beta) * g * g
            p -= self.lr * g / (np.sqrt(s) + self.eps)


class Adam(_Optimizer):
    def __init__(self, lr: float = 0.001, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8):
        super().__init__(lr, beta1=(beta1, 0, 1, False), beta2=(beta2, 0, 1, False), eps=(eps, 0, np.inf, False))
        self.beta1, self.beta2, self.eps, self.t = beta1, beta2, eps, 0

    def step(self, params, grads) -> None:
        first, second = self._slots(params, 2)
        self.t += 1
        for p, g, m, s in zip(params, grads, first, second, strict=True):
            m += (1 - self.beta1) * (g - m)
            s += (1 - self.beta2) * (g * g - s)
            p -= self.lr * (m / (1 - self.beta1**self.t)) / (np.sqrt(s / (1 - self.beta2**self.t)) + self.eps)
