"""Pipelines of transform steps: validated, put in order, and composed into one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from lodestream.operators.transform import OPERATORS, execute

#: Steps that may read other frames besides their own input, and the configuration keys that name them.
REFERENCES = {"join": ("right_input", "right"), "union": ("inputs",)}
PREVIEW_ROWS, RESPONSE_ROWS = 100, 20


@dataclass(frozen=True)
class Step:
    """``input_source`` names a source frame or an earlier step; empty: the step before, or the first source."""

    id: str
    operation_type: str
    config: Mapping[str, Any] = field(default_factory=dict)
    input_source: str = ""
    sequence_order: int = 0

    @property
    def reads(self) -> list[str]:
        found = [self.input_source] if self.input_source else []
        for key in REFERENCES.get(self.operation_type, ()):
            value = self.config.get(key)
            found += [value] if isinstance(value, str) else list(value or ())
        return found


class Pipeline:
    def __init__(self, steps: Sequence[Step | Mapping[str, Any]]):
        made = [s if isinstance(s, Step) else Step(**s) for s in steps]
        self.steps = self._ordered(sorted(made, key=lambda s: s.sequence_order))

    @staticmethod
    def _ordered(steps: list[Step]) -> list[Step]:
        """By dependency, then by sequence; a cycle or a repeated or unknown name is an error."""
        ids = [s.id for s in steps]
        if len(set(ids)) < len(ids):
            raise ValueError("step ids repeat")
        if unknown := {s.operation_type for s in steps} - OPERATORS.keys():
            raise ValueError(f"unknown operations: {sorted(unknown)}")
        # A step without an input reads the one before it in sequence.
        waiting = {s.id: {r for r in s.reads if r in ids} | ({ids[i - 1]} if i and not s.input_source else set()) for i, s in enumerate(steps)}
        out: list[Step] = []
        while waiting:
            ready = [s for s in steps if s.id in waiting and not waiting[s.id]]
            if not ready:
                raise ValueError(f"steps read each other in a circle: {sorted(waiting)}")
            out.append(ready[0])
            del waiting[ready[0].id]
            for needs in waiting.values():
                needs.discard(ready[0].id)
        return out

    def outputs(self, sources: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Every step's frame, lazily; all share one plan, and no job runs."""
        if not sources:
            raise ValueError("a pipeline needs a source")
        frames = dict(sources)
        by_sequence = sorted(self.steps, key=lambda s: s.sequence_order)
        for step in self.steps:
            at = by_sequence.index(step)
            name = step.input_source or (by_sequence[at - 1].id if at else next(iter(sources)))
            if name not in frames:
                raise ValueError(f"step {step.id!r} reads {name!r}, which does not exist")
            frames[step.id] = execute(step.operation_type, frames[name], step.config, frames)
        return {s.id: frames[s.id] for s in self.steps}

    def run(self, sources: Mapping[str, DataFrame]) -> DataFrame:
        """The frame of the last step in sequence."""
        last = max(self.steps, key=lambda s: s.sequence_order)
        return self.outputs(sources)[last.id]

    def preview(self, sources: Mapping[str, DataFrame], rows: int = RESPONSE_ROWS) -> dict[str, Any]:
        """Columns and the first rows of the result, at most ``PREVIEW_ROWS``, as plain values."""
        out = self.run(sources)
        found = out.limit(min(rows, PREVIEW_ROWS)).collect()
        return {"columns": out.columns, "rows": [list(r) for r in found]}
