"""Words as the contracts define them, the slow way."""

from __future__ import annotations

import re


def words(text, lowered=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text) if lowered else text)
