"""Parameters of a task, parsed once on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any


def _values(value: Any) -> tuple[str, ...] | None:
    """A list, a comma separated string or a list holding one; None if there is nothing in it."""
    if value is None:
        return None
    items = value if isinstance(value, list) else [value]
    parts = [p.strip() for item in items if item is not None for p in str(item).split(",")]
    return tuple(p for p in parts if p) or None


def _single(value: Any) -> str | None:
    found = _values(value)
    return found[0] if found else None


def _whole(value: Any) -> int | None:
    found = _single(value)
    return int(found) if found is not None else None


@dataclass(frozen=True)
class TaskParams:
    """What a task filters by; a parameter that is None lets everything pass."""

    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] | None = None
    cities: tuple[str, ...] | None = None
    sex: str | None = None
    keywords: tuple[str, ...] | None = None
    category_ids: tuple[str, ...] | None = None
    target_page_flow: tuple[int, ...] | None = None

    @classmethod
    def from_json(cls, text: str | None) -> "TaskParams":
        given = json.loads(text) if text else {}
        flow = _values(given.get("targetPageFlow"))
        return cls(
            start_date=_single(given.get("startDate")), end_date=_single(given.get("endDate")),
            start_age=_whole(given.get("startAge")), end_age=_whole(given.get("endAge")),
            professionals=_values(given.get("professionals")), cities=_values(given.get("cities")), sex=_single(given.get("sex")),
            keywords=_values(given.get("keywords")), category_ids=_values(given.get("categoryIds")),
            target_page_flow=tuple(int(p) for p in flow) if flow else None,
        )


def task_params(tasks, task_id: int) -> TaskParams:
    """The parameters of one task from a table of task_id and task_param."""
    row = tasks.where(tasks["task_id"] == task_id).select("task_param").first()
    if row is None:
        raise LookupError(f"no task {task_id}")
    return TaskParams.from_json(row["task_param"])
