"""A small convolutional network for 29 x 29 images, in numpy, and its training by train-and-merge.

Layers: six 5 x 5 filters with stride two (13 x 13), fifty more over all six maps (5 x 5), a hundred
units, ten outputs; each with a bias and a scaled tanh. Trained by gradient steps whose size for each
weight follows a running mean of squared gradients, which stands in for the curvature's diagonal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .train_merge import Node, TrainMergeJob, pairwise_mean

Weights = dict[str, np.ndarray]
#: name: (inputs of a unit, units)
SHAPES = {"c1": (25, 6), "c2": (150, 50), "f3": (1250, 100), "f4": (100, 10)}
SIDE = 29


def scaled_tanh(x: np.ndarray) -> np.ndarray:
    return 1.7159 * np.tanh(2 / 3 * x)


def scaled_tanh_slope(y: np.ndarray) -> np.ndarray:
    """Derivative, from the value: y = scaled_tanh(x)."""
    return 2 / 3 / 1.7159 * (1.7159 - y) * (1.7159 + y)


def initial(seed: int = 42) -> Weights:
    r = np.random.default_rng(seed)
    return {k: r.uniform(-1, 1, (n + 1, m)) / np.sqrt(n + 1) for k, (n, m) in SHAPES.items()}


def _patches(maps: np.ndarray) -> np.ndarray:
    """(n, channels, h, w) -> (n, places, channels * 25): 5 x 5 windows, two apart."""
    view = np.lib.stride_tricks.sliding_window_view(maps, (5, 5), axis=(2, 3))[:, :, ::2, ::2]
    n, c, h, w = view.shape[:4]
    return view.transpose(0, 2, 3, 1, 4, 5).reshape(n, h * w, c * 25)


def _unpatched(d: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of what each place of the maps was used for."""
    n, c, h, w = shape
    side = (h - 5) // 2 + 1
    out, d = np.zeros(shape), d.reshape(n, side, side, c, 5, 5)
    for i in range(5):
        for j in range(5):
            out[:, :, i : i + 2 * side : 2, j : j + 2 * side : 2] += d[..., i, j].transpose(0, 3, 1, 2)
    return out


def _layer(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return scaled_tanh(x @ w[:-1] + w[-1])


def forward(w: Weights, images: np.ndarray) -> list[np.ndarray]:
    """Inputs of each layer and the outputs (n, 10) for images (n, 29, 29) from -1 to 1."""
    a = _patches(images[:, None])
    one = _layer(a, w["c1"])
    b = _patches(one.transpose(0, 2, 1).reshape(len(images), 6, 13, 13))
    two = _layer(b, w["c2"])
    c = two.transpose(0, 2, 1).reshape(len(images), 1250)
    three = _layer(c, w["f3"])
    return [a, one, b, two, c, three, _layer(three, w["f4"])]


def gradients(w: Weights, images: np.ndarray, targets: np.ndarray) -> tuple[float, Weights]:
    """Mean over images of half the squared error, and its gradients; targets (n, 10)."""
    a, one, b, two, c, three, out = forward(w, images)
    n, g = len(images), {}

    def back(name: str, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        flat, grad = x.reshape(-1, x.shape[-1]), d.reshape(-1, d.shape[-1])
        g[name] = np.vstack([flat.T @ grad, grad.sum(axis=0)])
        return d @ w[name][:-1].T

    d = (out - targets) / n
    loss = float(((out - targets) ** 2).sum() / 2 / n)
    d = back("f4", three, d * scaled_tanh_slope(out))
    d = back("f3", c, d * scaled_tanh_slope(three))
    d = d.reshape(n, 50, 25).transpose(0, 2, 1)
    d = back("c2", b, d * scaled_tanh_slope(two))
    d = _unpatched(d, (n, 6, 13, 13)).reshape(n, 6, 169).transpose(0, 2, 1)
    back("c1", a, d * scaled_tanh_slope(one))
    return loss, g


def one_hot(labels: np.ndarray) -> np.ndarray:
    """1 for the right digit and -1 for others."""
    out = np.full((len(labels), 10), -1.0)
    out[np.arange(len(labels)), labels] = 1.0
    return out


def images_of(column: pa.Array) -> np.ndarray:
    """Bytes of 28 x 28 or 29 x 29 images as numbers from -1 to 1, the smaller ones with an empty last row and column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    side = int(round(flat.shape[1] ** 0.5))
    out = np.zeros((len(column), SIDE, SIDE))
    out[:, :side, :side] = flat.reshape(-1, side, side)
    return out / 127.5 - 1


def save_lines(w: Weights) -> Iterator[str]:
    """A line `name rows columns` for each layer, then a line for each of its rows."""
    for name, m in w.items():
        yield f"{name} {m.shape[0]} {m.shape[1]}"
        yield from (" ".join(map(repr, row)) for row in m.tolist())


def load_lines(lines: Iterable[str]) -> Weights:
    out, lines = {}, iter(lines)
    for head in lines:
        name, rows, _ = head.split()
        out[name] = np.array([[float(x) for x in next(lines).split()] for _ in range(int(rows))])
    return out


class NetworkJob(TrainMergeJob):
    """Rows (label, bytes). Every `threshold` images the model goes to the next node of the ring, which averages it with its own."""

    def __init__(self, rate: float = 0.02, batch: int = 16, threshold: int = 256):
        self.rate, self.batch, self.threshold = rate, batch, threshold

    def process(self, node: Node, batches: Iterator[pa.RecordBatch], model: Weights) -> Weights:
        model, square = {k: v.copy() for k, v in model.items()}, {k: np.full_like(v, 1e-4) for k, v in model.items()}
        for rows in batches:
            images, targets = images_of(rows.column("bytes")), one_hot(rows.column("label").to_numpy(zero_copy_only=False).astype(int))
            for k in range(0, len(images), self.batch):
                _, g = gradients(model, images[k : k + self.batch], targets[k : k + self.batch])
                for name, d in g.items():
                    square[name] += 0.05 * (d * d - square[name])
                    model[name] -= self.rate * d / (np.sqrt(square[name]) + 1e-3)
                before, node.seen = node.seen, node.seen + len(images[k : k + self.batch])
                if before // self.threshold < node.seen // self.threshold:
                    node.send_around(model)
        return model

    def receive(self, node: Node, source: int, message: Weights, model: Weights) -> Weights:
        return {k: pairwise_mean([model[k], message[k]]) for k in model}


def predict(w: Weights, images: np.ndarray) -> np.ndarray:
    return forward(w, images)[-1].argmax(axis=1)
