"""Word lists given as parameters."""

from __future__ import annotations

from pathlib import Path

# The followed terms.
TERMS = ["zika", "flu", "ebola", "measles", "diarrhea"]


def read_words(path: str | Path) -> list[str]:
    """Words of a text file, without the lines that begin with ``#``.

    Long word lists (the stop words) live in a text file, not in code; callers pass them on as
    a parameter.
    """
    lines = Path(path).read_text(encoding="utf-8").splitlines()
    return [word for line in lines if not line.startswith("#") for word in line.split()]
