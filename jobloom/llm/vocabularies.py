"""Where the public vocabulary files are; they are never copied into the repository."""

from __future__ import annotations

import os


def path(name: str, folder: str | None = None) -> str:
    """``folder``, or the installed ``public_tokenizers`` package, or /opt/tokenizers."""
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
    return public_tokenizers.path(name)
