"""One call from source tables to a written report, for any registered protocol."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.heads import score_in_batches
from ..sources.sinks import write_run
from ..storage import materialise
from . import protocols


@dataclass(frozen=True)
class Protocol:
    """``prepare`` makes rows of source tables, ``score`` a table of results of scored rows."""

    prepare: Callable[..., Any]
    score: Callable[..., Any]


@dataclass(frozen=True)
class Run:
    """``report`` has ``protocol, scope, metric, value``; ``scored`` the test rows with scores and reasons; ``excluded`` the rows that the protocol left out."""

    report: DataFrame
    scored: DataFrame
    excluded: DataFrame | None = field(default=None)


_PROTOCOLS: dict[str, Protocol] = {}


def register(name: str, prepare: Callable[..., Any], score: Callable[..., Any]) -> None:
    """Add a protocol; a name is never replaced."""
    if name in _PROTOCOLS:
        raise ValueError(f"the protocol {name} is registered already")
    _PROTOCOLS[name] = Protocol(prepare, score)


def registered() -> Mapping[str, Protocol]:
    return dict(_PROTOCOLS)


for _name in ("fitness_split", "regression", "small_molecules", "sequence_classes", "variant_assays", "pairs", "grouped_binary"):
    register(_name.replace("_", "-"), getattr(protocols, f"prepare_{_name}"), getattr(protocols, f"score_{_name}"))


def run(
    protocol: str,
    sources: Sequence[DataFrame],
    adapter: Callable[..., Any],
    prepare: Mapping[str, Any] | None = None,
    score: Mapping[str, Any] | None = None,
    limit: int | None = None,
    fit: Callable[[DataFrame], Callable[..., Any]] | None = None,
    folder: str | None = None,
) -> Run:
    """Prepare, predict and score; with ``folder`` also write the run, if nothing is there.

    ``adapter`` gets frames of ``id`` and the inputs of test rows, never a
    target, and gives (id, score, reason).  With ``fit`` the adapter is what that
    makes of ``adapter`` and the training and validation rows (``id, split,
    target`` and the inputs).  ``limit`` takes the first rows of each split,
    which makes a smoke run.
    """
    if protocol not in _PROTOCOLS:
        raise ValueError(f"unknown protocol {protocol}; registered are {sorted(_PROTOCOLS)}")
    made = _PROTOCOLS[protocol].prepare(*sources, **(prepare or {}))
    prepared, excluded = made if isinstance(made, tuple) else (made, None)
    if limit is not None:
        prepared = prepared.limited(limit)
    test = prepared.rows.filter("split = 'test'").select("id", "inputs.*")
    if fit is not None:
        adapter = fit(prepared.rows.filter("split <> 'test'").select("id", "split", "target", "inputs.*"))
    found = materialise(score_in_batches(test, "id", [c for c in test.columns if c != "id"], adapter))
    scored = materialise(prepared.scored(found))
    results = _PROTOCOLS[protocol].score(scored, **(score or {}))
    tables = results if isinstance(results, tuple) else (results,)
    report = tables[-1] if {"metric", "value"} <= set(tables[-1].columns) else _long(tables[-1])
    report = report.select(F.lit(protocol).alias("protocol"), F.lit(prepared.scope).alias("scope"), *report.columns)
    if folder is not None:
        write_run(folder, report, scored)
    return Run(report, scored, excluded)


def _long(wide: DataFrame) -> DataFrame:
    """``metric, value`` of the numeric columns of one row."""
    numeric = [c for c, kind in wide.dtypes if kind.split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in numeric])).alias("m")).select("m.*")
