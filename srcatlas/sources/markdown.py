"""Sections and fenced code of Markdown, by byte offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from srcatlas import languages

_ATX = re.compile(rb" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(rb" {0,3}(`{3,}|~{3,})[ \t]*(.*)$")
DOC_CHARS = 500


@dataclass
class Section:
    title: str
    start: int
    end: int
    signature: str
    docstring: str | None


@dataclass
class Block:
    """A fenced block that is parsed as a file of that extension."""

    extension: str
    start: int
    code: bytes


def read(content: bytes) -> tuple[list[Section], list[Block]]:
    """Sections run from a heading to the next, whatever its level, or to the end.

    Headings are lines of 1 to 6 # outside fences, with a title. A fence is closed by as
    many of its marks at least; one that never is isn't a block.
    """
    heads: list[tuple[int, str, str]] = []
    text: list[list[str]] = []
    blocks: list[Block] = []
    fence: tuple[bytes, str, int] | None = None
    at = 0
    for raw in content.splitlines(keepends=True):
        line = raw.rstrip(b"\r\n")
        mark = _FENCE.match(line)
        if fence is not None:
            if mark and mark[1].startswith(fence[0]) and not mark[2].strip():
                extension = languages.fence_extension(fence[1])
                if extension:
                    blocks.append(Block(extension, fence[2], content[fence[2] : at]))
                fence = None
        elif mark and not (mark[1][:1] == b"`" and b"`" in mark[2]):
            fence = (mark[1], mark[2].decode("utf-8", "replace"), at + len(raw))
        else:
            head = _ATX.match(line)
            title = head and (head[2] or b"").strip().rstrip(b"#").strip()
            if title:
                heads.append((at, title.decode("utf-8", "replace"), line.strip().decode("utf-8", "replace")))
                text.append([])
            elif text and line.strip():
                text[-1].append(line.strip().decode("utf-8", "replace"))
        at += len(raw)
    ends = [h[0] for h in heads[1:]] + [len(content)]
    sections = [Section(title, lo, hi, signature[:200], " ".join(body)[:DOC_CHARS] or None) for (lo, title, signature), hi, body in zip(heads, ends, text, strict=True)]
    return sections, blocks
