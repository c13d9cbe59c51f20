"""A log file of the driver that starts anew when it is full."""

from __future__ import annotations

import logging
import os
from logging.handlers import RotatingFileHandler


def logger(folder: str, name: str = "linkloom", most_bytes: int = 5 << 20, older: int = 3) -> logging.Logger:
    """The logger of a name, writing to ``folder/name.log``; asked for again, it is the same with the same file."""
    out = logging.getLogger(name)
    path = os.path.abspath(os.path.join(folder, f"{name}.log"))
    if not any(isinstance(h, RotatingFileHandler) and h.baseFilename == path for h in out.handlers):
        os.makedirs(folder, exist_ok=True)
        handler = RotatingFileHandler(path, maxBytes=most_bytes, backupCount=older, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        out.addHandler(handler)
        out.setLevel(logging.INFO)
    return out
