"""Neural layers with their own backward passes, as array kernels for one minibatch, and a trainer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.base import check_random_state
from quillon.tensor.autodiff import init_weights, logistic


class Module:
    training = True

    def train(self):
        self.training = True
        return self

    def eval(self):
        self.training = False
        return self

    def forward(self, x):
        raise NotImplementedError

    def backward(self, grad_output):
        raise NotImplementedError

    def parameters(self) -> list[np.ndarray]:
        return []

    def grads(self) -> list[np.ndarray]:
        return []


class _Weighted(Module):
    """Parameters by name; backward fills the gradients of the same names with d_ before them."""

    names: tuple[str, ...] = ()

    def parameters(self):
        return [getattr(self, n) for n in self.names]

    def grads(self):
        return [getattr(self, f"d_{n}") for n in self.names]


class Linear(_Weighted):
    names = ("W", "b")

    def __init__(self, in_features: int, out_features: int, weight_init: str = "he", random_state=None):
        self.W, self.b = init_weights(weight_init, in_features, out_features, check_random_state(random_state)), np.zeros(out_features)

    def forward(self, x):
        self.x = x
        return x @ self.W + self.b

    def backward(self, grad_output):
        self.d_W, self.d_b = self.x.T @ grad_output, grad_output.sum(0)
        return grad_output @ self.W.T


class ReLU(Module):
    def forward(self, x):
        self.on = x > 0
        return np.where(self.on, x, 0.0)

    def backward(self, grad_output):
        return grad_output * self.on


class Sigmoid(Module):
    def forward(self, x):
        self.y = logistic(x)
        return self.y

    def backward(self, grad_output):
        return grad_output * self.y * (1 - self.y)


class Tanh(Module):
    def forward(self, x):
        self.y = np.tanh(x)
        return self.y

    def backward(self, grad_output):
        return grad_output * (1 - self.y**2)


class Softmax(Module):
    def forward(self, x):
        e = np.exp(x - x.max(-1, keepdims=True))
        self.y = e / e.sum(-1, keepdims=True)
        return self.y

    def backward(self, grad_output):
        return self.y * (grad_output - (grad_output * self.y).sum(-1, keepdims=True))


class MSELoss:
    def forward(self, y_pred, y_true):
        self.d = y_pred - y_true
        return float((self.d**2).mean())

    def backward(self):
        return 2 * self.d / self.d.size


class BCEWithLogitsLoss:
    def forward(self, z, y):
        self.z, self.y = z, y
        return float((np.logaddexp(0, z) - y * z).mean())

    def backward(self):
        return (logistic(self.z) - self.y) / self.z.size


class CrossEntropyLoss:
    """Of logits against one-hot rows."""

    def forward(self, Z, y_true):
        shifted = Z - Z.max(1, keepdims=True)
        log_p = shifted - np.log(np.exp(shifted).sum(1, keepdims=True))
        self.p, self.y = np.exp(log_p), y_true
        return float(-(y_true * log_p).sum() / len(Z))

    def backward(self):
        return (self.p * self.y.sum(1, keepdims=True) - self.y) / len(self.y)


class Dropout(Module):
    def __init__(self, p: float = 0.5, random_state=None):
        if not 0 <= p < 1:
            raise ValueError("p must lie in [0, 1)")
        self.p, self._rng, self.mask = p, check_random_state(random_state), None

    def forward(self, x):
        self.mask = (self._rng.random(x.shape) >= self.p) / (1 - self.p) if self.training and self.p else None
        return x if self.mask is None else x * self.mask

    def backward(self, grad_output):
        return grad_output if self.mask is None else grad_output * self.mask


class BatchNorm1d(_Weighted):
    names = ("gamma", "beta")

    def __init__(self, num_features: int, eps: float = 1e-5, momentum: float = 0.1):
        self.gamma, self.beta, self.eps, self.momentum = np.ones(num_features), np.zeros(num_features), eps, momentum
        self.running_mean, self.running_var = np.zeros(num_features), np.ones(num_features)

    def forward(self, x):
        self.batch = self.training
        if self.batch:
            if len(x) < 2:
                raise ValueError("a batch of one has no variance")
            mean, var = x.mean(0), x.var(0)
            self.running_mean += self.momentum * (mean - self.running_mean)
            self.running_var += self.momentum * (var * len(x) / (len(x) - 1) - self.running_var)
        else:
            mean, var = self.running_mean, self.running_var
        self.std = np.sqrt(var + self.eps)
        self.x_hat = (x - mean) / self.std
        return self.gamma * self.x_hat + self.beta

    def backward(self, grad_output):
        """Of the mode that the last forward had."""
        g, h = grad_output, self.x_hat
        self.d_gamma, self.d_beta = (g * h).sum(0), g.sum(0)
        if self.batch:
            g = g - g.mean(0) - h * (g * h).mean(0)
        return self.gamma * g / self.std


def _pair(value, least: int) -> tuple[int, int]:
    out = (value, value) if isinstance(value, int) else tuple(value)
    if len(out) != 2 or any(not isinstance(v, (int, np.integer)) or v < least for v in out):
        raise ValueError(f"bad size {value!r}")
    return out


def patches(x: np.ndarray, kernel, stride, padding, fill: float = 0.0) -> np.ndarray:
    """(n, c, oh, ow, kh, kw) view of the padded images."""
    (kh, kw), (sh, sw), (ph, pw) = kernel, stride, padding
    x = np.pad(x, ((0, 0), (0, 0), (ph, ph), (pw, pw)), constant_values=fill)
    if x.shape[2] < kh or x.shape[3] < kw:
        raise ValueError("the kernel is larger than the padded input")
    return np.lib.stride_tricks.sliding_window_view(x, (kh, kw), axis=(2, 3))[:, :, ::sh, ::sw]


def fold(cols: np.ndarray, shape, stride, padding) -> np.ndarray:
    """Add patches (n, c, oh, ow, kh, kw) back where they came from."""
    (sh, sw), (ph, pw) = stride, padding
    n, c, oh, ow, kh, kw = cols.shape
    out = np.zeros((n, c, shape[2] + 2 * ph, shape[3] + 2 * pw))
    for a in range(kh):
        for b in range(kw):
            out[:, :, a : a + sh * oh : sh, b : b + sw * ow : sw] += cols[..., a, b]
    return out[:, :, ph : ph + shape[2], pw : pw + shape[3]]


class Conv2d(_Weighted):
    def __init__(self, in_channels: int, out_channels: int, kernel_size, stride=1, padding=0, bias: bool = True, weight_init: str = "he", random_state=None):
        self.kernel, self.stride, self.padding = _pair(kernel_size, 1), _pair(stride, 1), _pair(padding, 0)
        area = self.kernel[0] * self.kernel[1]
        self.W = init_weights(weight_init, in_channels * area, out_channels * area, check_random_state(random_state), (out_channels, in_channels, *self.kernel))
        self.b = np.zeros(out_channels) if bias else None
        self.names = ("W", "b") if bias else ("W",)

    def forward(self, x):
        self.shape, self.cols = x.shape, patches(x, self.kernel, self.stride, self.padding)
        out = np.einsum("nchwij,ocij->nohw", self.cols, self.W, optimize=True)
        return out if self.b is None else out + self.b[:, None, None]

    def backward(self, grad_output):
        self.d_W = np.einsum("nohw,nchwij->ocij", grad_output, self.cols, optimize=True)
        if self.b is not None:
            self.d_b = grad_output.sum((0, 2, 3))
        return fold(np.einsum("nohw,ocij->nchwij", grad_output, self.W, optimize=True), self.shape, self.stride, self.padding)


class MaxPool2d(Module):
    def __init__(self, kernel_size, stride=None, padding=0):
        self.kernel = _pair(kernel_size, 1)
        self.stride, self.padding = self.kernel if stride is None else _pair(stride, 1), _pair(padding, 0)
        if any(p > k // 2 for p, k in zip(self.padding, self.kernel)):
            raise ValueError("padding is more than half the kernel")

    def forward(self, x):
        cols = patches(x, self.kernel, self.stride, self.padding, -np.inf)
        self.shape, flat = x.shape, cols.reshape(*cols.shape[:4], -1)
        self.best = flat.argmax(-1)
        return np.take_along_axis(flat, self.best[..., None], -1)[..., 0]

    def backward(self, grad_output):
        cols = np.zeros((*grad_output.shape, self.kernel[0] * self.kernel[1]))
        np.put_along_axis(cols, self.best[..., None], grad_output[..., None], -1)
        return fold(cols.reshape(*grad_output.shape, *self.kernel), self.shape, self.stride, self.padding)


class Flatten(Module):
    def forward(self, x):
        self.shape = x.shape
        return x.reshape(len(x), -1)

    def backward(self, grad_output):
        return grad_output.reshape(self.shape)


class _Recurrent(_Weighted):
    gates = 1

    def __init__(self, input_size: int, hidden_size: int, bias: bool = True, weight_init: str = "xavier", random_state=None):
        if input_size < 1 or hidden_size < 1 or weight_init not in ("xavier", "zeros"):
            raise ValueError("sizes must be positive, weight_init 'xavier' or 'zeros'")
        rng, wide = check_random_state(random_state), self.gates * hidden_size
        self.input_size, self.hidden_size = input_size, hidden_size
        self.W_ih = init_weights(weight_init, input_size, wide, rng)
        self.W_hh = init_weights(weight_init, hidden_size, wide, rng)
        self.b = np.zeros(wide) if bias else None
        self.names = ("W_ih", "W_hh", "b") if bias else ("W_ih", "W_hh")

    def _pre(self, x, h):
        z = x @ self.W_ih + h @ self.W_hh
        return z if self.b is None else z + self.b

    def _reset(self):
        self.d_W_ih, self.d_W_hh, self.d_b = np.zeros_like(self.W_ih), np.zeros_like(self.W_hh), np.zeros(self.W_ih.shape[1])

    def _collect(self, x, h, dz):
        self.d_W_ih += x.T @ dz
        self.d_W_hh += h.T @ dz
        self.d_b += dz.sum(0)
        return dz @ self.W_ih.T, dz @ self.W_hh.T

    def _start(self, x, h):
        if x.ndim not in (2, 3) or x.shape[-1] != self.input_size:
            raise ValueError("bad input shape")
        return np.zeros((len(x), self.hidden_size)) if h is None else h

    def _rnn(self, x, h):
        return np.tanh(self._pre(x, h))

    def _lstm(self, x, h, c):
        z = self._pre(x, h).reshape(len(x), 4, -1)
        i, f, o, g = logistic(z[:, 0]), logistic(z[:, 1]), logistic(z[:, 3]), np.tanh(z[:, 2])
        c_new = f * c + i * g
        return o * np.tanh(c_new), c_new, (x, h, c, c_new, i, f, g, o)

    def _lstm_back(self, step, dh, dc):
        x, h, c, c_new, i, f, g, o = step
        t = np.tanh(c_new)
        dc = dc + dh * o * (1 - t * t)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g * g), dh * t * o * (1 - o)], 1)
        return *self._collect(x, h, dz), dc * f


class RNNCell(_Recurrent):
    def forward(self, x, h_prev=None):
        self.x, self.h_prev = x, self._start(x, h_prev)
        self.h = self._rnn(x, self.h_prev)
        return self.h

    def backward(self, grad_h):
        self._reset()
        return self._collect(self.x, self.h_prev, grad_h * (1 - self.h**2))


class RNN(_Recurrent):
    """(batch, time, features) to all hidden states and the last."""

    def forward(self, x, h0=None):
        h, self.steps, out = self._start(x, h0), [], []
        for t in range(x.shape[1]):
            new = self._rnn(x[:, t], h)
            self.steps.append((x[:, t], h, new))
            out.append(new)
            h = new
        return np.stack(out, 1), h

    def backward(self, grad_output, grad_h_n=None):
        self._reset()
        dh, dx = np.zeros_like(grad_output[:, 0]) if grad_h_n is None else grad_h_n, []
        for t in reversed(range(len(self.steps))):
            x, h, new = self.steps[t]
            step, dh = self._collect(x, h, (dh + grad_output[:, t]) * (1 - new**2))
            dx.append(step)
        return np.stack(dx[::-1], 1), dh


class LSTMCell(_Recurrent):
    """Gates in the order input, forget, cell, output."""

    gates = 4

    def forward(self, x, state=None):
        h, c = (None, None) if state is None else state
        h_new, c_new, self.step = self._lstm(x, self._start(x, h), self._start(x, c))
        return h_new, c_new

    def backward(self, grad_h, grad_c=None):
        self._reset()
        return self._lstm_back(self.step, grad_h, np.zeros_like(grad_h) if grad_c is None else grad_c)


class LSTM(_Recurrent):
    gates = 4

    def forward(self, x, state=None):
        h, c = (None, None) if state is None else state
        h, c, self.steps, out = self._start(x, h), self._start(x, c), [], []
        for t in range(x.shape[1]):
            h, c, step = self._lstm(x[:, t], h, c)
            self.steps.append(step)
            out.append(h)
        return np.stack(out, 1), (h, c)

    def backward(self, grad_output, grad_h_n=None, grad_c_n=None):
        self._reset()
        none = np.zeros_like(grad_output[:, 0])
        dh, dc, dx = none if grad_h_n is None else grad_h_n, none if grad_c_n is None else grad_c_n, []
        for t in reversed(range(len(self.steps))):
            step, dh, dc = self._lstm_back(self.steps[t], dh + grad_output[:, t], dc)
            dx.append(step)
        return np.stack(dx[::-1], 1), (dh, dc)


class Trainer:
    """Minibatch training on the driver, or data-parallel: gradients summed over partitions, one job a step."""

    def __init__(self, layers, loss_fn, optimizer):
        self.layers, self.loss_fn, self.optimizer = list(layers), loss_fn, optimizer

    def _forward(self, x):
        for layer in self.layers:
            x = layer.forward(x)
        return x

    def _backward(self, grad):
        for layer in reversed(self.layers):
            grad = layer.backward(grad)
        return grad

    def _mode(self, training: bool):
        for layer in self.layers:
            layer.train() if training else layer.eval()

    def parameters(self):
        return [p for layer in self.layers for p in layer.parameters()]

    def fit(self, X, y, epochs: int, batch_size: int, X_val=None, y_val=None, metric=None, shuffle: bool = True, random_state=None, verbose: bool = False) -> dict[str, list[float]]:
        """History by epoch; losses and metrics of batches are weighted by their sizes, and the last may be small."""
        if epochs < 1 or batch_size < 1 or len(X) != len(y) or not len(X):
            raise ValueError("epochs and batch_size must be positive, X and y of one length")
        rng, history = check_random_state(random_state), {"train_loss": [], **({"train_metric": []} if metric else {})}
        for epoch in range(epochs):
            self._mode(True)
            order, loss, score = rng.permutation(len(X)) if shuffle else np.arange(len(X)), 0.0, 0.0
            for at in range(0, len(X), batch_size):
                own = order[at : at + batch_size]
                out = self._forward(X[own])
                loss += self.loss_fn.forward(out, y[own]) * len(own)
                score += metric(out, y[own]) * len(own) if metric else 0
                self._backward(self.loss_fn.backward())
                self.optimizer.step(self.parameters(), [g for layer in self.layers for g in layer.grads()])
            history["train_loss"].append(loss / len(X))
            if metric:
                history["train_metric"].append(score / len(X))
            if X_val is not None:
                self._mode(False)
                out = self._forward(X_val)
                history.setdefault("val_loss", []).append(self.loss_fn.forward(out, y_val))
                if metric:
                    history.setdefault("val_metric", []).append(metric(out, y_val))
                self._mode(True)
            if verbose:
                print(f"epoch {epoch + 1}: " + ", ".join(f"{k} {v[-1]:.6f}" for k, v in history.items()))
        return history

    def fit_distributed(self, df: DataFrame, steps: int, features: str = "features", target: str = "target") -> list[float]:
        """Full-batch steps over a DataFrame: each task returns its gradient sum, the driver steps. The mean loss at each.

        For layers whose rows do not influence one another; a BatchNorm in training mode is refused.
        """
        if any(isinstance(x, BatchNorm1d) for x in self.layers):
            raise ValueError("batch normalisation couples the rows of a batch")
        from quillon.functions.stats import sums

        sizes = [p.size for p in self.parameters()]
        losses = []
        for _ in range(steps):
            model = self

            def kernel(x, y):
                out = model._forward(x)
                loss = model.loss_fn.forward(out, y) * len(x)
                model._backward(model.loss_fn.backward())
                return np.concatenate([[loss, len(x)], *[g.ravel() * len(x) for layer in model.layers for g in layer.grads()]])

            got = sums(df, kernel, 2 + sum(sizes), [F.col(features), F.col(target)])
            grads, at = [], 2
            for p in self.parameters():
                grads.append((got[at : at + p.size] / got[1]).reshape(p.shape))
                at += p.size
            self.optimizer.step(self.parameters(), grads)
            losses.append(got[0] / got[1])
        return losses


