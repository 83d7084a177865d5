"""Words of a text, whatever its case, punctuation, spacing, markup and character form."""

from __future__ import annotations

import html
import re
import unicodedata

#: Characters that show nothing: soft hyphen, zero-width, direction and byte order marks.
INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁩︀-️﻿]")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Without markup and marks, in compatibility form and folded case."""
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in text if c.isascii() or unicodedata.category(c) != "Mn")


def words(text: str | None) -> list[str]:
    return WORD.findall(plain(text)) if text else []
