"""Typed plan queries: which evidence, which predicates, which window of time, how many rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from enum import Enum

LONGEST_LIMIT, LONGEST_OFFSET = 1_000, 100_000


class Target(str, Enum):
    messages = "messages"
    calls = "calls"
    contacts = "contacts"
    media = "media"
    artifacts = "artifacts"


class Field(str, Enum):
    text = "text"
    participant = "participant"
    app = "app"
    category = "category"
    media_type = "media_type"


class Op(str, Enum):
    contains = "contains"
    equals = "equals"
    isin = "in"


class Match(str, Enum):
    any = "any"
    all = "all"


class Sort(str, Enum):
    ascending = "asc"
    descending = "desc"


@dataclass(frozen=True)
class Predicate:
    field: Field
    op: Op
    values: tuple[str, ...]

    def __post_init__(self):
        object.__setattr__(self, "field", Field(self.field))
        object.__setattr__(self, "op", Op(self.op))
        values = tuple(v.strip() for v in self.values)
        if not values or not all(values):
            raise ValueError("a predicate needs values that are not blank")
        object.__setattr__(self, "values", values)


@dataclass(frozen=True)
class QueryPlan:
    targets: tuple[Target, ...]
    predicates: tuple[Predicate, ...] = ()
    match: Match = Match.all
    start: datetime | None = None
    end: datetime | None = None
    sort: Sort = Sort.descending
    limit: int = 100
    offset: int = 0
    question: str = field(default="", compare=False)

    def __post_init__(self):
        object.__setattr__(self, "targets", tuple(dict.fromkeys(map(Target, self.targets))))
        object.__setattr__(self, "predicates", tuple(self.predicates))
        object.__setattr__(self, "match", Match(self.match))
        object.__setattr__(self, "sort", Sort(self.sort))
        if not self.targets:
            raise ValueError("a plan needs a target")
        if not 1 <= self.limit <= LONGEST_LIMIT or not 0 <= self.offset <= LONGEST_OFFSET:
            raise ValueError("limit or offset out of bounds")
        if self.start is not None and self.end is not None and self.start > self.end:
            raise ValueError("the window of time is reversed")

    def to_json(self) -> str:
        """The same text for equal plans."""
        return json.dumps(asdict(self), sort_keys=True, default=str)

    @classmethod
    def from_json(cls, text: str) -> QueryPlan:
        raw = json.loads(text)
        if extra := set(raw) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown parts of a plan: {sorted(extra)}")
        predicates = tuple(Predicate(p["field"], p["op"], tuple(p["values"])) for p in raw.pop("predicates", ()))
        times = {k: iso_time(raw.pop(k)) for k in ("start", "end") if raw.get(k)}
        return cls(predicates=predicates, **{k: v for k, v in raw.items() if v is not None} | times)


def iso_time(text: str) -> datetime:
    """An ISO time in UTC, without a zone: one with Z or an offset is moved there. What is none raises."""
    found = datetime.fromisoformat(text)
    return found if found.tzinfo is None else found.astimezone(timezone.utc).replace(tzinfo=None)
