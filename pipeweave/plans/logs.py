"""Structured log events, written by the driver apart from the result."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

# The levels in their order.
LEVELS = ("trace", "debug", "info", "warn", "error")


@dataclass(frozen=True)
class Event:
    level: str
    logger: str
    message: str
    data: dict = field(default_factory=dict)

    def text(self) -> str:
        tail = f" {{{', '.join(f'{k}: {json.dumps(v, default=str)}' for k, v in self.data.items())}}}" if self.data else ""
        return f"{self.level.upper()} {self.logger} {self.message}{tail}"

    def json(self) -> str:
        return json.dumps({"level": self.level.capitalize(), "logger": self.logger, "message": self.message, "data": self.data}, default=str)


def to_stderr(line: str) -> None:
    print(line, file=sys.stderr)


def to_file(path: str) -> Callable[[str], None]:
    """Append lines to a file of the driver."""

    def write(line: str) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(line + "\n")

    return write


@dataclass(frozen=True)
class Logger:
    """Passes events at least as severe as ``level`` to ``to``: as lines of ``format`` (text or json),
    or as they are (``event``), for instance to a list's ``append``."""

    name: str
    to: Callable = to_stderr
    format: str = "text"
    level: str = "info"

    def log(self, level: str, message: str, **data) -> None:
        if LEVELS.index(level) >= LEVELS.index(self.level):
            event = Event(level, self.name, message, data)
            self.to(event if self.format == "event" else getattr(event, self.format)())

    def trace(self, message: str, **data) -> None:
        self.log("trace", message, **data)

    def debug(self, message: str, **data) -> None:
        self.log("debug", message, **data)

    def info(self, message: str, **data) -> None:
        self.log("info", message, **data)

    def warn(self, message: str, **data) -> None:
        self.log("warn", message, **data)

    def error(self, message: str, **data) -> None:
        self.log("error", message, **data)
