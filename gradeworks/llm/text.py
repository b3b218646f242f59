"""Text normalisation that several operators share."""

from __future__ import annotations

import html
import re
import unicodedata

#: Characters that are invisible in print.
INVISIBLE = "­​‌‍⁠﻿"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n\s*(?=[^\W\d_])")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|\[([^\[\]]*)\]\([^()\s]*\)")
_WORD = re.compile(r"[^\W_]+")
_INNER = re.compile(r"(?<=[^\W_])[-‐‑'’](?=[^\W_])|(?<=\d)[.,](?=\d)")


def normalise(text: str) -> str:
    """One spelling of a text: compatibility forms, case, markup, entities and line breaks in words.

    Words broken by a hyphen at the end of a line are joined, tags and link targets are dropped, and
    so are hyphens and apostrophes in words, and points and commas in numbers.
    """
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "](" in text:
        text = _MARKUP.sub(lambda m: m.group(1) or " ", text)
    if "\n" in text and ("-" in text or not text.isascii()):
        text = _BROKEN.sub("", text)
    return _INNER.sub("", text.lower())


def words(text: str | None) -> list[str]:
    """The words of a text after :func:`normalise`: runs of letters and digits."""
    return _WORD.findall(normalise(text)) if text else []


_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_ANY = re.compile(r"[^\W\d_]")
_JAMO = range(0x1100, 0x1200)


class _Placed:
    """A text in which every character knows the part of the raw text that it comes from."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def sub(self, pattern: re.Pattern, make) -> None:
        """Replace matches by what ``make`` gives: a text, or the number of a group to keep."""
        text, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = make(m)
            keep = m.span(new) if isinstance(new, int) else None
            text += [self.text[at : m.start()], self.text[slice(*keep)] if keep else new]
            start += self.start[at : m.start()] + (self.start[slice(*keep)] if keep else [self.start[m.start()]] * len(new))
            end += self.end[at : m.start()] + (self.end[slice(*keep)] if keep else [self.end[m.end() - 1]] * len(new))
            at = m.end()
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = start + self.start[at:], end + self.end[at:]

    def compose(self) -> None:
        """Compatibility forms, cluster by cluster."""
        whole, text, start, end, at = self.text, [], [], [], 0
        while at < len(whole):
            to = at + 1
            while to < len(whole) and (unicodedata.combining(whole[to]) or (ord(whole[to]) in _JAMO and ord(whole[to - 1]) in _JAMO)):
                to += 1
            new = unicodedata.normalize("NFKC", whole[at:to])
            text.append(new)
            start += [self.start[at]] * len(new)
            end += [self.end[to - 1]] * len(new)
            at = to
        self.text, self.start, self.end = "".join(text), start, end


def word_places(text: str) -> list[tuple[int, int]]:
    """Where each of the :func:`words` stands in the raw text: start and end.

    Follows :func:`normalise` with the origin of every character.  A text whose characters compose across
    clusters gives its places by proportion.
    """
    p = _Placed(text)
    if not text.isascii():
        p.compose()
        p.sub(_INVISIBLE, lambda m: "")
    if "&" in p.text:
        p.sub(_ENTITY, lambda m: html.unescape(m.group()))
    if "<" in p.text or "](" in p.text:
        p.sub(_MARKUP, lambda m: 1 if m.group(1) else " ")
    if "\n" in p.text and ("-" in p.text or not p.text.isascii()):
        p.sub(_BROKEN, lambda m: "")
    low = p.text.lower()
    if len(low) != len(p.text):
        p.sub(_ANY, lambda m: m.group().lower())
    else:
        p.text = low
    p.sub(_INNER, lambda m: "")
    spans = [m.span() for m in _WORD.finditer(p.text)]
    want = words(text)
    if [p.text[a:b] for a, b in spans] == want or len(spans) == len(want):
        return [(p.start[a], p.end[b - 1]) for a, b in spans]
    cuts = [round(k * len(text) / max(1, len(want))) for k in range(len(want) + 1)]
    return list(zip(cuts, cuts[1:], strict=False))
