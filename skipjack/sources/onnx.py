"""Networks from ONNX files: the weights of the Gemm nodes, read from the file's protocol buffers.

Only what a feed-forward ReLU network needs is understood: field numbers and types are fixed by the public format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from skipjack.functions.mlp import Mlp

#: Fixed values of the format: fields of a model, graph, node, attribute and tensor.
MODEL_GRAPH = 7
GRAPH_NODE, GRAPH_INITIALIZER = 1, 5
NODE_INPUT, NODE_OUTPUT, NODE_TYPE, NODE_ATTRIBUTE = 1, 2, 4, 5
ATTRIBUTE_NAME, ATTRIBUTE_INT = 1, 3
TENSOR_DIMS, TENSOR_TYPE, TENSOR_FLOATS, TENSOR_NAME, TENSOR_RAW, TENSOR_DOUBLES = 1, 2, 4, 8, 9, 10
FLOAT, DOUBLE = 1, 11


def _number(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        shift += 7
        if b < 128:
            return out, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: numbers as they are, all else as bytes."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(data, at)
        elif kind == 2:
            size, at = _number(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("not an ONNX file")
        yield key >> 3, value


def _tensor(data: bytes) -> tuple[str, np.ndarray]:
    dims, kind, name, raw, floats, doubles = [], FLOAT, "", None, [], []
    for k, v in fields(data):
        if k == TENSOR_DIMS:
            if isinstance(v, bytes):
                at = 0
                while at < len(v):
                    n, at = _number(v, at)
                    dims.append(n)
            else:
                dims.append(v)
        elif k == TENSOR_TYPE:
            kind = v
        elif k == TENSOR_NAME:
            name = v.decode()
        elif k == TENSOR_RAW:
            raw = v
        elif k == TENSOR_FLOATS:
            floats += struct.unpack(f"<{len(v) // 4}f", v)
        elif k == TENSOR_DOUBLES:
            doubles += struct.unpack(f"<{len(v) // 8}d", v)
    if kind not in (FLOAT, DOUBLE):
        return name, np.zeros(0)
    values = np.frombuffer(raw, "<f4" if kind == FLOAT else "<f8") if raw is not None else np.array(floats or doubles)
    return name, values.astype(float).reshape(dims)


def read_onnx(data: bytes, features: list[str], classes: int = 0) -> Mlp:
    """The network of the file's Gemm nodes, in the order of the graph; every other node must be a ReLU or keep the values."""
    graph = next(v for k, v in fields(data) if k == MODEL_GRAPH)
    tensors = dict(_tensor(v) for k, v in fields(graph) if k == GRAPH_INITIALIZER)
    layers = []
    for k, node in fields(graph):
        if k != GRAPH_NODE:
            continue
        own = list(fields(node))
        kind = next((v.decode() for n, v in own if n == NODE_TYPE), "")
        inputs = [v.decode() for n, v in own if n == NODE_INPUT]
        if kind == "Gemm":
            turned = any({n: v for n, v in fields(a)}.get(ATTRIBUTE_NAME) == b"transB" and dict(fields(a)).get(ATTRIBUTE_INT) == 1 for n, a in own if n == NODE_ATTRIBUTE)
            w = tensors[inputs[1]]
            w = w if turned else w.T
            layers.append((w, tensors[inputs[2]].ravel() if len(inputs) > 2 else np.zeros(len(w))))
        elif kind not in ("Relu", "Identity", "Flatten", "Squeeze", "Reshape", "Constant"):
            raise ValueError(f"cannot read a {kind} node")
    if not layers:
        raise ValueError("no Gemm node")
    return Mlp(layers, features, classes)
