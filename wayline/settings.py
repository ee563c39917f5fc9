"""Settings of a run, from a text file that any of Spark's stores may hold."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .schema import Box


@dataclass(frozen=True)
class Settings:
    """``name = value`` pairs; names are dotted, values are text until asked for by kind."""

    values: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Settings:
        """Lines of ``name = value``, ``name: value`` or ``name {`` ... ``}``; ``#`` and ``//`` begin comments, quotes around values go, later ones win."""
        values: dict[str, str] = {}
        inside: list[str] = []
        for number, raw in enumerate(text.splitlines(), 1):
            line = raw.split("#", 1)[0].split(" //", 1)[0].strip()
            if not line or line.startswith("//"):
                continue
            if line == "}":
                if not inside:
                    raise ValueError(f"line {number}: nothing to close")
                inside.pop()
            elif line.endswith("{"):
                inside.append(line[:-1].strip().rstrip("=:").strip())
            else:
                at = min((i for i in (line.find("="), line.find(":")) if i > 0), default=0)
                if not at:
                    raise ValueError(f"line {number}: no value")
                value = line[at + 1 :].strip().rstrip(",").strip()
                values[".".join([*inside, line[:at].strip().strip('"')])] = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
        if inside:
            raise ValueError(f"{inside[-1]} is not closed")
        return cls(values)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Settings:
        rows = spark.read.text(path, wholetext=True).collect()
        return cls.parse("\n".join(r["value"] for r in rows))

    def text(self, name: str, default: str | None = None) -> str:
        if name in self.values:
            return self.values[name]
        if default is None:
            raise KeyError(f"no setting {name}")
        return default

    def number(self, name: str, default: float | None = None) -> float:
        return float(self.text(name, None if default is None else repr(default)))

    def integer(self, name: str, default: int | None = None) -> int:
        return int(self.text(name, None if default is None else str(default)))

    def flag(self, name: str, default: bool | None = None) -> bool:
        told = self.text(name, None if default is None else str(default)).lower()
        if told not in ("true", "false"):
            raise ValueError(f"{name}: {told} is neither true nor false")
        return told == "true"

    def box(self, name: str) -> Box:
        """The box whose sides are ``name.x0`` to ``name.t1``."""
        return Box(*[(self.integer if side[0] == "t" else self.number)(f"{name}.{side}") for side in ("x0", "y0", "t0", "x1", "y1", "t1")])
