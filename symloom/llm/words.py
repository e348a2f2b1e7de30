"""Words of a text, independent of how it is typed, laid out or marked up."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ո": "n",
    "А": "A", "Е": "E", "О": "O", "Р": "P", "С": "C", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "К": "K", "М": "M", "Т": "T", "В": "B", "Н": "H",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "ε": "e",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
}
# Characters without width, removed within words.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u180e\u034f"

_ODD = LOOKALIKES | dict.fromkeys(INVISIBLE, "")
_ODD_ONE = re.compile("[" + "".join(_ODD) + "]")
_COMBINING = re.compile("[\u0300-\u036f]+")
# a short tag of any form, or one of any length that consists of attributes with values
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,200}>|<[A-Za-z][\w:.-]*(?:\s+[\w:.@-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))+\s*/?>")
_ENTITY = re.compile(r"&#?\w{1,31};")
_BROKEN = re.compile(r"(?<=[A-Za-z])-[ \t]*\r?\n[ \t]*(?=[a-z])")
_EDGE = re.compile(rb"(?<![0-9a-z])_+|_+(?![0-9a-z])")
# bytes to lower-case letters, digits and underscores; all else separates words
_TABLE = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def fold(text: str) -> str:
    """Plain Latin letters: compatibility forms, look-alikes, accents and invisible characters removed."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", _ODD_ONE.sub(lambda m: _ODD[m[0]], text))
    return _COMBINING.sub("", text)


def words(text: str | None) -> list[bytes]:
    """Lower-case words; null gives none. Tags and entities are undone, words broken over lines joined.

    Underscores count within a word only. A lone surrogate separates words.
    """
    if not text:
        return []
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(html.unescape(text))
    text = fold(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-\n" in text or "-\r" in text or "- \n" in text or "-\t" in text:
        text = _BROKEN.sub("", text)
    plain = text.encode("utf-8", "replace").translate(_TABLE)
    if b"_" in plain and (b" _" in plain or b"_ " in plain or plain[:1] == b"_" or plain[-1:] == b"_"):
        plain = _EDGE.sub(b" ", plain)
    return plain.split()
