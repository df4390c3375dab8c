"""Header normalisation."""

from __future__ import annotations

import re
import unicodedata

# Characters with a spelled-out replacement.
SPELLED_OUT = {"'": "", '"': "", "%": "_percent_", "#": "_number_"}

_WORD_START = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def _snake_case(header: str) -> str:
    text = unicodedata.normalize("NFKD", header).encode("ascii", "ignore").decode()
    for mark, spelled in SPELLED_OUT.items():
        text = text.replace(mark, spelled)
    text = _WORD_START.sub("_", text)
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()
    return text if text and not text[0].isdigit() else f"x{text}"


def snake_case_names(headers: list[str]) -> list[str]:
    """snake_case every header; repeats get ``_2``, ``_3`` ... so the result is unique."""
    names: list[str] = []
    for header in headers:
        stem = name = _snake_case(header)
        copy = 1
        while name in names:
            copy += 1
            name = f"{stem}_{copy}"
        names.append(name)
    return names
