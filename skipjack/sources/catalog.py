"""Function and filter catalogs: JSON in, dataclasses out, expressions mapped to Spark's dialect."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from skipjack.plans.workload import FilterSpec

TASKS = ("regressor", "classifier")


def to_spark(expression: str) -> str:
    """Dialect mapping: epoch(x) and isfinite(x); the rest is the same in both."""
    expression = re.sub(r"\bepoch\(", "__epoch(", expression)
    out = _calls(expression, "__epoch", lambda x: f"unix_seconds(CAST({x} AS TIMESTAMP))")
    return _calls(out, "isfinite", lambda x: f"(NOT isnan({x}) AND abs({x}) < double('infinity'))")


def _calls(text: str, name: str, put) -> str:
    """Rewrite name(...) with balanced brackets, innermost last."""
    while (at := text.find(f"{name}(")) >= 0:
        depth, end = 0, at + len(name)
        for end in range(at + len(name), len(text)):
            depth += (text[end] == "(") - (text[end] == ")")
            if not depth:
                break
        text = text[:at] + put(text[at + len(name) + 1 : end]) + text[end + 1 :]
    return text


@dataclass(frozen=True)
class FunctionSpec:
    name: str
    table: str
    task: str
    target: str
    features: dict[str, str] = field(default_factory=dict)
    num_classes: int = 0

    def __post_init__(self):
        if self.task not in TASKS:
            raise ValueError(f"unknown task {self.task}")

    def spark_features(self) -> dict[str, str]:
        return {k: to_spark(v) for k, v in self.features.items()}


@dataclass(frozen=True)
class DatabaseSetup:
    name: str
    tables: list[str]
    path: str
    training_rows: int = 2000

    def training_blocks(self, size: int) -> int:
        return -(-self.training_rows // size)


def _files(where: str | Path | list) -> list[Path]:
    if isinstance(where, list):
        return [f for w in where for f in _files(w)]
    p = Path(where)
    return sorted(p.rglob("*.json")) if p.is_dir() else [p]


def load_setup(path: str | Path) -> DatabaseSetup:
    return DatabaseSetup(**json.loads(Path(path).read_text()))


def load_functions(where, names: list[str] | None = None) -> list[FunctionSpec]:
    return _chosen([FunctionSpec(**x) for f in _files(where) for x in json.loads(f.read_text())], names)


def load_filters(where, names: list[str] | None = None) -> list[FilterSpec]:
    rows = [x for f in _files(where) for x in json.loads(f.read_text())]
    return _chosen([FilterSpec(**{k: v for k, v in x.items() if k != "filter_id"}) for x in rows], names)


def _chosen(specs: list, names: list[str] | None) -> list:
    if names is None:
        return specs
    known = {s.name: s for s in specs}
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"unknown names: {', '.join(missing)}")
    return [known[n] for n in names]


def save_filters(filters: list[FilterSpec], path: str | Path) -> None:
    """Without nulls, numbered from 1."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps([{"filter_id": k, **f.to_dict()} for k, f in enumerate(filters, 1)], indent=1))


def save_functions(functions: list[FunctionSpec], path: str | Path) -> None:
    Path(path).write_text(json.dumps([asdict(f) for f in functions], indent=1))


def missing_tables(spark, root: str, tables: list[str], ending: str = "parquet") -> list[str]:
    """The tables without a file or folder root/<table>.<ending>."""
    from skipjack.storage import exists

    return [t for t in tables if not exists(spark, f"{root}/{t}.{ending}")]


def check_tables(spark, root: str, tables: list[str], ending: str = "parquet") -> None:
    if missing := missing_tables(spark, root, tables, ending):
        raise FileNotFoundError(f"no {ending} files for: {', '.join(missing)}")


def table_exists(spark, name: str) -> bool:
    return spark.catalog.tableExists(name)


#: The functions whose inputs the supplied tables hold, with their target and feature expressions.
STAR_FUNCTIONS = [
    FunctionSpec("discounted_price", "lineitem", "regressor", "l_extendedprice * (1 - l_discount)", {"price": "CAST(l_extendedprice AS DOUBLE)", "discount": "CAST(l_discount AS DOUBLE)"}),
    FunctionSpec("charge", "lineitem", "regressor", "l_extendedprice * (1 - l_discount) * (1 + l_tax)", {"price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}),
    FunctionSpec("customer_segment", "customer", "classifier", "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END", {"acctbal": "c_acctbal", "nation": "c_nationkey"}, 5),
    FunctionSpec("nation_region", "nation", "classifier", "n_regionkey", {"nation": "n_nationkey"}, 5),
    FunctionSpec("order_priority", "orders", "classifier", "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END", {"price": "o_totalprice", "month": "EXTRACT(MONTH FROM o_orderdate)"}, 5),
    FunctionSpec("supplier_balance", "supplier", "classifier", "CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal < 3000 THEN 1 WHEN s_acctbal < 6000 THEN 2 ELSE 3 END", {"acctbal": "s_acctbal"}, 4),
]
