"""Where the public vocabulary files lie: a folder given by setting, else the installed package of public tokenizers."""

from __future__ import annotations

import os

FOLDER = "VOCALGRID_TOKENIZERS"


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file; every executor has it at the same place."""
    folder = folder or os.environ.get(FOLDER)
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
