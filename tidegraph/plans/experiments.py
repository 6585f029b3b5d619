"""Typed run specifications, their registry, a metrics log that can be resumed, and a Markdown summary."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame

from tidegraph.operators import learn, ranking


@dataclass
class Spec:
    """What to run over an edge stream. Unknown keys of a file end up in `extra`."""

    name: str = "run"
    model: str = "heuristics"
    negatives: int = 20
    max_queries: int = 50_000
    fraction: float = 1.0
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, values: dict) -> Spec:
        own = {f.name for f in fields(cls)} - {"extra"}
        return cls(**{k: v for k, v in values.items() if k in own}, extra={**values.get("extra", {}), **{k: v for k, v in values.items() if k not in own | {"extra"}}})

    @classmethod
    def load(cls, path: str) -> Spec:
        """JSON, or YAML where a parser is installed."""
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.from_dict(yaml.safe_load(text) or {})
        return cls.from_dict(json.loads(text))

    def dump(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2, sort_keys=True))


Runner = Callable[[DataFrame, Spec], DataFrame]
RUNNERS: dict[str, Runner] = {
    "heuristics": lambda edges, spec: ranking.heuristic_ranking(edges, spec.negatives, spec.max_queries),
    "pairwise": lambda edges, spec: learn.pairwise_ranking(edges, spec.negatives, spec.max_queries),
    **{kind: (lambda edges, spec, kind=kind: learn.learned_ranking(edges, kind, spec.negatives, spec.max_queries)) for kind in learn.MODELS},
}


def launch(edges: DataFrame, spec: Spec, folder: str, dry: bool = False) -> list[dict]:
    """Run a specification and log its metric rows; a finished run of that name is read back instead."""
    if spec.model not in RUNNERS:
        raise ValueError(f"unknown model {spec.model!r}; there are {sorted(RUNNERS)}")
    log = Path(folder) / f"{spec.name}.jsonl"
    if dry:
        return []
    if log.exists():
        return [json.loads(line) for line in log.read_text().splitlines()]
    rows = [r.asDict() for r in RUNNERS[spec.model](edges, spec).collect()]  # a few metric rows
    log.parent.mkdir(parents=True, exist_ok=True)
    part = log.with_suffix(".part")
    part.write_text("".join(json.dumps(r) + "\n" for r in rows))
    part.rename(log)
    return rows


def summary(folder: str) -> str:
    """All logged runs as one Markdown table."""
    rows = [{"run": p.stem} | json.loads(line) for p in sorted(Path(folder).glob("*.jsonl")) for line in p.read_text().splitlines()]
    names = list(dict.fromkeys(k for r in rows for k in r))
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *(line([r.get(k, "") for k in names]) for r in rows)])


def missing_dates(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of wanted (date) whose date is not in done (date) yet."""
    return wanted.join(done.select("date").distinct(), "date", "left_anti")
