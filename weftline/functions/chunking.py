"""Splits texts into token-bounded chunks along headings, code blocks, paragraphs and sentences."""

from __future__ import annotations

import re

FENCE = "```"
HEADING = re.compile(r"(#{1,6})\s+(.*)")
PARAGRAPH = re.compile(r"\n\s*\n")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
CODE = re.compile(r"(```.*?```)", re.S)


def tokens(text: str) -> int:
    return max(1, (len(text) + 3) // 4)


def sections(text: str, fence_aware: bool = False) -> list[tuple[str, str]]:
    """(path of headings, body) of each part with a body."""
    out: list[tuple[str, str]] = []
    path: list[tuple[int, str]] = []
    body: list[str] = []
    fenced = False

    def flush() -> None:
        joined = "\n".join(body)
        if joined.strip():
            out.append((" > ".join(title for _, title in path), joined))
        body.clear()

    for line in text.split("\n"):
        if fence_aware and line.lstrip().startswith(FENCE):
            fenced = not fenced
        head = None if fenced else HEADING.fullmatch(line)
        if head is None:
            body.append(line)
            continue
        flush()
        level = len(head[1])
        while path and path[-1][0] >= level:
            path.pop()
        path.append((level, head[2].strip()))
    flush()
    return out or [("", text)]


def units(body: str) -> list[str]:
    """Code blocks whole; else sentences of paragraphs."""
    out = []
    for piece in CODE.split(body):
        if piece.startswith(FENCE) and piece.endswith(FENCE) and len(piece) > 2 * len(FENCE) - 1:
            out.append(piece.strip())
        else:
            out += [s.strip() for p in PARAGRAPH.split(piece) for s in SENTENCE.split(p)]
    return [u for u in out if u]


def pack(body: str, target: int, overlap: int) -> list[str]:
    """Units joined up to ``target`` tokens; the next chunk begins with the last ones, ``overlap`` tokens at most."""
    if tokens(body) <= target:
        return [body]
    chunks: list[str] = []
    now: list[str] = []
    held = 0
    for unit in units(body):
        n = tokens(unit)
        if now and held + n > target:
            chunks.append(" ".join(now))
            carry, kept = 0, len(now)
            while kept > 0 and carry + tokens(now[kept - 1]) <= overlap:
                kept -= 1
                carry += tokens(now[kept])
            now, held = now[kept:], carry
        now.append(unit)
        held += n
    return [*chunks, " ".join(now)] if now else chunks


def chunks(text: str | None, target: int = 320, overlap: int = 48, fence_aware: bool = False) -> list[str]:
    text = (text or "").strip()
    if not text:
        return []
    return [f"{path}\n{c}" if path else c for path, body in sections(text, fence_aware) for c in pack(body.strip(), target, overlap)]
