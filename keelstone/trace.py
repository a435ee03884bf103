"""Traces: one log record per event, start and end for operations that change something."""

from __future__ import annotations

import logging
from collections.abc import Callable

LOG = logging.getLogger("keelstone")


class Tracer:
    """Passes events (kind, identifier, name, details) to a function, and to the log."""

    def __init__(self, to: Callable[[str, int, str, dict], None] | None = None) -> None:
        self.to = to

    def __call__(self, kind: str, ident: int, name: str, **details) -> None:
        LOG.debug("%s %s %s %s", kind, ident, name, details)
        if self.to:
            self.to(kind, ident, name, details)
