"""Where tokenizer files lie. They belong to an installed package of public vocabularies; none is copied here."""

from __future__ import annotations

import os


def path(name: str, folder: str | None = None) -> str:
    """The file's place: in `folder` if given, else in the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """The pattern that splits text before the merges of the rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN
