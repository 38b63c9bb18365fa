"""The few text functions that Python code needs beside their column forms."""

from __future__ import annotations

import html
import re

# Fixed values, as in ``functions.text``.
REFERENCE = re.compile(r"\[[0-9]+(?:-[0-9]+)?\]")
BLANKS = re.compile(r"[ \t\r\f\v]+")


def clean_text(text: str | None, decoded: bool = False) -> str:
    """No character references (unless they are ``decoded`` already) or reference marks, blank runs as one space, lines trimmed and blank lines dropped."""
    text = REFERENCE.sub("", ((text or "") if decoded else html.unescape(text or "")).translate({0xA0: " ", 0x3000: " "}))
    lines = (BLANKS.sub(" ", line).strip() for line in text.splitlines())
    return "\n".join(line for line in lines if line)
