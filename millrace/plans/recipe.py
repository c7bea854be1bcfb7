"""Recipes: ordered steps, their JSON, folding, snapshots, editing with undo and redo."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce

from ..functions import formula
from ..operators.steps import ROW, STEPS, apply
from .table import Table

# Fixed values of the file format.
VERSION = 1


@dataclass(frozen=True)
class Op:
    type: str
    params: dict = field(default_factory=dict)
    label: str = ""
    enabled: bool = True
    id: str = ""


@dataclass(frozen=True)
class Recipe:
    """Steps, and the steps before each edit: every edit gives a new recipe."""

    ops: tuple[Op, ...] = ()
    name: str = "recipe"
    past: tuple[tuple[Op, ...], ...] = ()
    future: tuple[tuple[Op, ...], ...] = ()
    made: int = 0

    # -- editing ---------------------------------------------------------------------------

    def _with(self, ops, made: int | None = None) -> Recipe:
        return replace(self, ops=tuple(ops), past=(*self.past, self.ops), future=(), made=self.made if made is None else made)

    def add(self, type: str, label: str = "", **params) -> Recipe:
        return self._with([*self.ops, Op(type, params, label or type, True, f"op_{self.made + 1}")], self.made + 1)

    def update(self, id: str, **params) -> Recipe:
        return self._with(replace(o, params=o.params | params) if o.id == id else o for o in self.ops)

    def remove(self, id: str) -> Recipe:
        return self._with(o for o in self.ops if o.id != id)

    def toggle(self, id: str) -> Recipe:
        return self._with(replace(o, enabled=not o.enabled) if o.id == id else o for o in self.ops)

    def move(self, id: str, by: int) -> Recipe:
        at = next((i for i, o in enumerate(self.ops) if o.id == id), None)
        if at is None or not 0 <= at + by < len(self.ops):
            return self
        left = [o for o in self.ops if o.id != id]
        return self._with([*left[: at + by], self.ops[at], *left[at + by :]])

    def set_ops(self, ops) -> Recipe:
        return self._with(ops)

    def undo(self) -> Recipe:
        return replace(self, ops=self.past[-1], past=self.past[:-1], future=(self.ops, *self.future)) if self.past else self

    def redo(self) -> Recipe:
        return replace(self, ops=self.future[0], past=(*self.past, self.ops), future=self.future[1:]) if self.future else self

    # -- files -----------------------------------------------------------------------------

    def to_json(self, app: str = "millrace", created: datetime | None = None) -> str:
        at = (created or datetime.now(UTC)).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        ops = [{"id": o.id, "type": o.type, "label": o.label, "enabled": o.enabled, "params": o.params} for o in self.ops]
        return json.dumps({"app": app, "version": VERSION, "name": self.name, "createdAt": at, "ops": ops}, indent=2, ensure_ascii=False)

    @staticmethod
    def from_json(raw: str) -> Recipe:
        data = json.loads(raw)
        if not isinstance(data, dict) or not data.get("app") or not isinstance(data.get("ops"), list):
            raise ValueError("not a recipe file")
        ops = tuple(Op(o["type"], dict(o.get("params") or {}), o.get("label", ""), bool(o.get("enabled", True)), o.get("id") or f"op_{i + 1}") for i, o in enumerate(data["ops"]))
        return Recipe(ops, data.get("name") or "recipe", made=len(ops))

    # -- running ----------------------------------------------------------------------------

    def problems(self) -> list[str]:
        """What will make a step pass unapplied, as far as can be told without a table."""
        out = []
        for o in self.ops:
            if o.type not in STEPS:
                out.append(f"{o.id}: unknown step {o.type}")
            elif o.type == "expression" and (error := formula.check(o.params.get("expr", ""))):
                out.append(f"{o.id}: {error}")
        return out

    def streamable(self) -> bool:
        """Whether all enabled steps are row by row."""
        return all(STEPS.get(o.type, (ROW,))[0] == ROW for o in self.ops if o.enabled)

    def fold(self, source: Table, upto: int | None = None) -> Table:
        """The table after the enabled steps (the first upto of all)."""
        return reduce(lambda t, o: apply(t, o.type, o.params) if o.enabled else t, self.ops[:upto], source)

    def fold_all(self, source: Table) -> list[Table]:
        """The source and the table after each step; a disabled step repeats the one before.
        All are lazy: nothing is computed until one is read."""
        out = [source]
        for o in self.ops:
            out.append(apply(out[-1], o.type, o.params) if o.enabled else out[-1])
        return out
