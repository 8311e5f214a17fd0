"""Chunks of one text in plain Python, which tests hold the plans against."""

from __future__ import annotations

import re
from array import array

from factloom.operators.chunks import ENDS, OVERLAP, SEPARATORS, SIZE, SPACE

HEADER = re.compile(f"(#{{1,3}})[{SPACE}]+([^{ENDS}]+)")
ANY_HEADER = re.compile(f"(?:\\A|(?<=[{ENDS}]))#{{1,3}}[{SPACE}]")


def units(text: str) -> str:
    """A character for each UTF-16 code unit of the text: characters beyond the basic plane become two."""
    return text if text.isascii() or max(text) < "\U00010000" else "".join(map(chr, array("H", text.encode("utf-16-le", "surrogatepass"))))


def characters(text: str) -> str:
    """The text of UTF-16 code units; halves that lost their other half become U+FFFD."""
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def sections(text: str) -> list[tuple[str, str, str, str]]:
    """(h1, h2, h3, body) between headers, blank ones too; a header clears those below it."""
    lines = text.split("\n")
    marks = [(i, m) for i, x in enumerate(lines) if x.startswith("#") and (m := HEADER.fullmatch(x))]
    cuts = [i for i, _ in marks] + [len(lines)]
    out, heads = [("", "", "", "\n".join(lines[: cuts[0]]))] if cuts[0] else [], ["", "", ""]
    for (i, m), end in zip(marks, cuts[1:], strict=True):
        level = len(m[1]) - 1
        heads = [*heads[:level], m[2].strip(SPACE), *[""] * (2 - level)]
        out.append((*heads, "\n".join(lines[i:end])))
    return out


def boundary(text: str, start: int, most: int) -> int:
    """Where a run from start ends: after the last of the most preferred separator that stands in its second half."""
    end = start + most
    if end >= len(text):
        return len(text)
    found = (text.rfind(s, start, end) + len(s) for s in SEPARATORS if text.rfind(s, start, end) - start > most / 2)
    return next(found, end)


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Runs of at most 4 * size units. The next run begins overlap tokens before the end of the last one, if that lies
    beyond the length of the last piece that was kept, else at its end, so the first boundary has no overlap."""
    out, start, end = [], 0, 0
    while end < len(text):
        end = boundary(text, start, 4 * size)
        piece = text[start:end].strip(SPACE)
        out += [piece] if piece else []
        back = end - 4 * overlap
        start = back if back > (len(out[-1]) if out else 0) else end
    return out


def chunk_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[dict]:
    """None of blank text, one of text without headers, else those of each section; lengths are UTF-16 units."""
    if not text.strip(SPACE):
        return []
    text = units(re.sub(r"\A---\n.*?\n---\n+", "", text, count=1, flags=re.S))
    if not ANY_HEADER.search(text):
        return [_chunk(("", "", ""), text.strip(SPACE))]
    out = []
    for *heads, body in sections(text):
        body = body.strip(SPACE)
        for piece in [body] if len(body) <= 4 * size else windows(body, size, overlap):
            out.append(_chunk(heads, piece))
    return out


FIELDS = ("h1", "h2", "h3", "content", "preview")


def _chunk(heads, piece: str) -> dict:
    """With what F25 shows of it: its first 200 units, trimmed."""
    return dict(zip(FIELDS, map(characters, (*heads, piece, piece[:200].strip(SPACE))), strict=True))
