"""JSON-lines logging on the driver: stderr and a rotating file."""

from __future__ import annotations

import json
import logging
import logging.handlers
import sys
from datetime import UTC, datetime

_KNOWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


def cut(text: str | None, most: int = 120) -> str:
    """The text in one line of at most so many characters, the last one a mark of what is left out."""
    line = " ".join((text or "").split())
    return line if len(line) <= most else line[: most - 1] + "…"


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        extra = {k: v for k, v in vars(record).items() if k not in _KNOWN}
        line = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line | extra, default=str)


def get_logger(name: str, level: str = "INFO", path: str = "") -> logging.Logger:
    """A logger below 'tessera'; handlers are set up once."""
    root = logging.getLogger("tessera")
    if not root.handlers:
        root.setLevel(level)
        root.propagate = False
        targets: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
        if path:
            targets.append(logging.handlers.RotatingFileHandler(path, maxBytes=10_000_000, backupCount=3))
        for h in targets:
            h.setFormatter(JsonLines())
            root.addHandler(h)
    return root.getChild(name)
