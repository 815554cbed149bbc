"""Tools by name, and column functions among them registered with Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.functions.messages import CATALOGUE, correct_summary, format_message
from skein.plans.model import EngineError


@dataclass
class Tool:
    name: str
    execute: Callable[..., Any]
    parameters: dict = field(default_factory=dict)
    description: str = ""


class Registry:
    """Plugins are lists of tools; a plugin may also give a correct_summary hook, applied in order."""

    def __init__(self):
        self.plugins: dict[str, list[Tool]] = {}
        self.hooks: list[Callable[[str], str]] = []

    def add(self, plugin: str, tools: list[Tool], hook: Callable[[str], str] | None = None) -> None:
        if plugin in self.plugins:
            raise EngineError("ERR_VALIDATION", f"plugin {plugin} is there already")
        taken = {t.name for ts in self.plugins.values() for t in ts}
        if any(t.name in taken for t in tools):
            raise EngineError("ERR_VALIDATION", "tool name taken")
        self.plugins[plugin] = tools
        self.hooks += [hook] if hook else []

    def tools(self) -> list[Tool]:
        return [t for ts in self.plugins.values() for t in ts]

    def run(self, name: str, **arguments: Any) -> Any:
        tool = next((t for t in self.tools() if t.name == name), None)
        if tool is None:
            raise EngineError("ERR_VALIDATION", f"no tool {name}")
        missing = [k for k in tool.parameters.get("required", []) if k not in arguments]
        if missing:
            raise EngineError("ERR_VALIDATION", f"missing {', '.join(missing)}")
        return tool.execute(**arguments)

    def corrected(self, message: str) -> str:
        for h in self.hooks:
            message = h(message)
        return message

    def register_function(self, spark: SparkSession, name: str, kind: str) -> None:
        """Make a tool of one argument a SQL function, which gets whole Arrow batches; equal values of a batch are worked out once."""
        tool = next(t for t in self.tools() if t.name == name)

        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            done = {x: tool.execute(x) for x in s.dropna().unique()}
            return s.map(lambda x: done.get(x))

        spark.udf.register(name, run)


BUILT_IN = {
    "messages": [
        Tool("format_message", lambda code, **v: format_message(code, **v), {"required": ["code"]}),
        Tool("correct_summary", lambda message, **v: correct_summary(message, **v), {"required": ["message"]}),
        Tool("list_codes", lambda: sorted(CATALOGUE)),
    ]
}


def load(names: str | None = None) -> Registry:
    """A registry of the built-in plugins named in a comma list; all for None."""
    r = Registry()
    for n in BUILT_IN if names is None else [x.strip() for x in names.split(",") if x.strip()]:
        if n in BUILT_IN:
            r.add(n, BUILT_IN[n], correct_summary if n == "messages" else None)
    return r
