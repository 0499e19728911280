"""Regular expressions in Java form.

``(?imuUd)`` gives Java case folding, word boundaries, digits, white space and
line starts over Unicode, and ``\\n`` as the only line end.
"""

from __future__ import annotations

FLAGS = "(?imuUd)"
#: White space as in Unicode, with the four separators that Java's class lacks.
SPACE = r"[\s\x1c-\x1f]"

# Patterns of page numbers, of headings that stay, of placeholders and of chat phrases.
PAGE_NUMBERS = [
    r"^\s*(?:page|pág\.?|p\.)?\s*\d+\s*(?:/\s*\d+|of\s*\d+)?\s*$",
    r"^\s*[-—–]\s*\d+\s*[-—–]\s*$",
    r"^\s*\[\s*\d+\s*\]\s*$",
]
HEADING_EXEMPT = r"^\s*(?:chapter|capítulo|section|seção|part|parte)\b"
HYPHENATED = r"(\b[a-zA-Z]+)-\s*(?:\r?\n)\s*([a-zA-Z]+)\b"
INLINE_CODE = r"`[^`\n]+`"
URL = r"https?://[^\s)\]>\"'`]+"
FILE_PATH = (
    r"(?:(?:~|\.{1,2})/(?:[a-zA-Z0-9_.\-]+/?)+"
    r"|/(?:[a-zA-Z0-9_.\-]+/)+[a-zA-Z0-9_.\-]+"
    r"|[a-zA-Z0-9_.\-]+/(?:[a-zA-Z0-9_.\-]+/)*[a-zA-Z0-9_\-]+\.[a-zA-Z0-9]{1,6})"
)
PLACEHOLDER = r"(?:__\s*PH_\d+\s*__|§§[A-Z0-9_]+§§)"
CHAT = [
    r"^\s*(?:aqui está|segue|abaixo está|esta é)\s+(?:a\s+)?tradução",
    r"^\s*tradução:\s*$",
    r"^\s*(?:here is|here's|below is|sure, here is|certainly, here is)\s+(?:the\s+)?translation",
    r"^\s*translation:\s*$",
    r"\b(?:espero que (?:isso\s+)?ajude|se precisar de mais|qualquer dúvida|à disposição)\b",
    r"\b(?:hope this helps|let me know if you need|feel free to ask|as an ai language model)\b",
    r"^\s*nota(?: do tradutor)?:\s*",
    r"^\s*translator's note:\s*",
    r"^\s*com certeza,\s*",
    r"^\s*sure,\s*i\s+(?:have\s+)?translated",
]
HEADING = r"^#{1,6}\s+"
LIST_ITEM = r"^\s*(?:[-*+]|\d+[.)])\s+"


def java(pattern: str, flags: str = FLAGS) -> str:
    return flags + pattern
