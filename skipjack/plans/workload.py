"""Filter workloads: spans of a prediction's range, or one filter per class."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

#: Filters aimed at per template, and the least number per width.
AIM, LEAST = 150, 5


@dataclass(frozen=True)
class FilterSpec:
    name: str
    table: str
    model: str
    lo: float | None = None
    hi: float | None = None
    target: int | None = None
    grid_depth: int | None = None
    kind: str | None = None

    def sql(self, prediction: str) -> str:
        return f"{prediction} = {self.target}" if self.target is not None else f"{prediction} BETWEEN {self.lo:.12g} AND {self.hi:.12g}"

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}


def widths(span: float, alpha: float) -> list[float]:
    """Powers of alpha below the span, then the span."""
    if alpha <= 1:
        raise ValueError("alpha must be above 1")
    out, w = [], alpha
    while w < span:
        out.append(w)
        w *= alpha
    return [*out, span]


def per_width(samples: int, n_widths: int) -> int:
    return min(samples, max(LEAST, AIM // n_widths))


def starts(low: float, high: float, width: float, count: int) -> list[float]:
    """Evenly spaced from low to the last start that fits, rounded half to even, held to that span."""
    last = high - width
    if last <= low or count <= 1:
        return [float(low)]
    step = (last - low) / (count - 1)
    return [float(max(low, min(round(low + step * k), last))) for k in range(count)]


def regressor_filters(table: str, model: str, low: float, high: float, alpha: float = 2.0, samples: int = 10) -> list[FilterSpec]:
    span = high - low
    if span <= 0:
        return [FilterSpec(f"{model}_w0_s0", table, model, low, high)]
    all_widths, out = widths(span, alpha), []
    count = per_width(samples, len(all_widths))
    for i, w in enumerate(all_widths):
        for j, s in enumerate(starts(low, high, w, 1 if w == span else count)):
            out.append(FilterSpec(f"{model}_w{i}_s{j}", table, model, s, s + w))
    return out


def sorted_filters(filters: list[FilterSpec], counts: dict[str, int]) -> list[FilterSpec]:
    """By matching rows, width, start and name."""
    width = lambda f: 0.0 if f.lo is None else f.hi - f.lo
    return sorted(filters, key=lambda f: (counts[f.name], width(f), f.lo or 0.0, f.name))


def one_per_template(filters: list[FilterSpec]) -> list[FilterSpec]:
    """The first filter of each (table, model), in the order met."""
    seen: dict[tuple[str, str], FilterSpec] = {}
    for f in filters:
        seen.setdefault((f.table, f.model), f)
    return list(seen.values())


def grouped(filters: list[FilterSpec]) -> dict[tuple[str, str], list[FilterSpec]]:
    """Filters by (table, model), groups and members in the order met."""
    out: dict[tuple[str, str], list[FilterSpec]] = {}
    for f in filters:
        out.setdefault((f.table, f.model), []).append(f)
    return out


def workload_digest(table: str, model: str, alpha: float, samples: int, seed: int, low: float, high: float) -> str:
    """Name part of a generated workload: another parameter, another file."""
    return hashlib.sha1(json.dumps([table, model, alpha, samples, seed, low, high]).encode()).hexdigest()[:12]


def classifier_filters(table: str, model: str, classes: list[int]) -> list[FilterSpec]:
    return [FilterSpec(f"{model}_class{c}", table, model, target=c) for c in sorted(classes)]
