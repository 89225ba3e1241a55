"""A personal store's file on this machine: a regular file of its owner that nobody else reads."""

from __future__ import annotations

import os
import stat
from pathlib import Path


def prepare_private(path: str) -> Path:
    """The file, made with mode 0600 where it is missing; refused if it is a link, no regular file, another's or open to others."""
    at = Path(path)
    flags = os.O_RDWR | os.O_CREAT | getattr(os, "O_NOFOLLOW", 0)
    try:
        handle = os.open(at, flags, 0o600)
    except OSError as e:
        raise PermissionError(f"{path} can't be opened as a private file") from e
    try:
        s = os.fstat(handle)
        if not stat.S_ISREG(s.st_mode):
            raise PermissionError(f"{path} is no regular file")
        if s.st_uid != os.geteuid():
            raise PermissionError(f"{path} belongs to another user")
        if stat.S_IMODE(s.st_mode) & 0o077:
            raise PermissionError(f"{path} is open to other users")
    finally:
        os.close(handle)
    return at
