"""Text normalisation with offsets: case, punctuation, layout, markup, escapes, invisible and look-alike letters."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones (lower case, after NFKD).
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ɡ": "g", "ɑ": "a", "ı": "i",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}

_INLINE = "a|abbr|b|big|cite|code|em|font|i|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|var|wbr"


def _escape(match: re.Match) -> str:
    text = match.group()
    return chr(int(text[2:], 16)) if text[1] in "ux" else " "


#: (pattern, replacement, a substring without which the pattern can't match)
STAGES = (
    (re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"), lambda m: html.unescape(m.group()), "&"),
    (re.compile(r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[nrt]"), _escape, "\\"),
    (re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]"), lambda m: "", None),
    (re.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>", re.IGNORECASE), lambda m: "", "<"),
    (re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.DOTALL), lambda m: " ", "<"),
    (re.compile(r"\]\([^()\s]*\)"), lambda m: "", "]("),
    (re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>*#|/]*(?=[^\W\d_])"), lambda m: "", "-"),
    (re.compile(r"[‒-―…]|--+|\.\.\.+"), lambda m: " ", None),
)
_LOOK_ALIKES = {ord(a): b for a, b in LOOK_ALIKES.items()}
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_PUNCTUATION = re.compile(r"[^\w\s]|_")
_ASCII_PUNCTUATION = {ord(c): None for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}


def fold(text: str) -> str:
    """Lower case without accents, compatibility forms and look-alikes."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.lower())).translate(_LOOK_ALIKES)


def words_of(text: str) -> list[str]:
    """The normalised words of a text: pieces between white space, letters and digits only."""
    for pattern, replacement, needed in STAGES:
        if needed in text if needed else not text.isascii() or "--" in text or "..." in text:
            text = pattern.sub(replacement, text)
    folded = fold(text)
    if folded.isascii():
        return folded.translate(_ASCII_PUNCTUATION).split()
    return _PUNCTUATION.sub("", folded).split()


def words_with_offsets(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The same words as words_of, each with its (start, end) in the original text."""
    origin = list(range(len(text)))
    for pattern, replacement, _ in STAGES:
        pieces, places, at = [], [], 0
        for match in pattern.finditer(text):
            new = replacement(match)
            pieces += [text[at : match.start()], new]
            places += origin[at : match.start()] + [origin[match.start()]] * len(new)
            at = match.end()
        if at:
            text, origin = "".join([*pieces, text[at:]]), places + origin[at:]
    chars, places = [], []
    for char, place in zip(text, origin):
        new = _PUNCTUATION.sub("", fold(char))
        chars.append(new)
        places += [place] * len(new)
    words, spans, at = [], [], 0
    joined = "".join(chars)
    for match in re.finditer(r"\S+", joined):
        words.append(match.group())
        spans.append((places[match.start()], places[match.end() - 1] + 1))
    return words, spans
