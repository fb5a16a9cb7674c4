"""Writing Markdown notes into a tree, with checks on the path and a receipt for each write.

These are single-file operations on the driver; bulk writes go through snapshots.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path


@dataclass(frozen=True)
class Written:
    """What a write did."""

    rel_path: str
    before: str | None
    after: str
    size: int


def checked_path(root: str, rel_path: str, allowed: tuple[str, ...] = ("",)) -> Path:
    """The file below root; ValueError if the path is absolute, leads out, is not Markdown or not in an allowed folder."""
    own = rel_path.replace("\\", "/")
    if not own or own.startswith("/") or re.match(r"[A-Za-z]:", own) or ".." in own.split("/"):
        raise ValueError(f"not a path inside the tree: {rel_path}")
    if not own.lower().endswith(".md"):
        raise ValueError(f"not Markdown: {rel_path}")
    if not any(a == "" or own.startswith(a.strip("/") + "/") for a in allowed):
        raise ValueError(f"not in an allowed folder: {rel_path}")
    return Path(root) / own


def put(root: str, rel_path: str, markdown: str, allowed: tuple[str, ...] = ("",)) -> Written:
    """Write a note whole, by a rename."""
    file = checked_path(root, rel_path, allowed)
    before = hashlib.sha256(file.read_bytes()).hexdigest() if file.exists() else None
    file.parent.mkdir(parents=True, exist_ok=True)
    data = markdown.replace("\x00", "�").encode()
    staged = file.with_suffix(".md.next")
    staged.write_bytes(data)
    staged.replace(file)
    return Written(rel_path, before, hashlib.sha256(data).hexdigest(), len(data))


def append(root: str, rel_path: str, text: str, heading: str | None = None, allowed: tuple[str, ...] = ("",)) -> Written:
    """Add text at the end of a note, under a heading if one is given."""
    file = checked_path(root, rel_path, allowed)
    old = file.read_text() if file.exists() else ""
    part = (f"## {heading}\n\n" if heading else "") + text.strip() + "\n"
    return put(root, rel_path, (old.rstrip() + "\n\n" if old.strip() else "") + part, allowed)


def capture(root: str, folder: str, text: str, title: str | None, now: datetime, kind: str = "note", domain: str = "general") -> Written:
    """A new note with front matter, named by day and title; a number keeps names apart."""
    head = title or next((x.strip() for x in text.splitlines() if x.strip()), "untitled")
    name = re.sub(r"-+", "-", re.sub(r"[\s_]+", "-", re.sub(r"[^a-z0-9\s_-]", "", head.lower()))).strip("-")[:80] or "untitled"
    base, n = f"{folder.strip('/')}/{now:%Y-%m-%d}-{name}", 1
    path = f"{base}.md"
    while (Path(root) / path).exists():
        n += 1
        path = f"{base}-{n}.md"
    front = f"---\ntype: {kind}\ndomain: {domain}\ncreated: {now:%Y-%m-%d}\n---\n"
    return put(root, path, f"{front}# {head}\n\n{text.strip()}\n")


#: Folder of the receipts in a tree; no note lies there.
RECEIPTS = ".receipts"
#: Types that kinds of captured text get, and the folders they go to, as fixed values.
TYPES = {"idea": "concept", "note": "note", "question": "note", "finding": "report", "report": "report", "draft": "draft"}
FOLDERS = {"idea": "Ideas", "note": "Notes", "question": "Questions", "finding": "Reports", "report": "Reports", "draft": "Inbox"}
#: Largest note that is written.
MOST_BYTES = 1_000_000


def front_matter(markdown: str) -> dict[str, str]:
    """The flat fields of a note's front matter."""
    found = re.match(r"---\n(.*?)\n---(?:\n|$)", markdown, re.S)
    lines = found[1].split("\n") if found else []
    return {k.strip(): v.strip().strip("\"'") for k, _, v in (line.partition(":") for line in lines) if _ and not k.startswith((" ", "-", "#"))}


def faults(fields: dict[str, str]) -> list[str]:
    """What is wrong with the front matter of a note that is to be written."""
    found = [f"missing {name}" for name in ("type", "domain", "created") if not fields.get(name)]
    if fields.get("created") and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", fields["created"]):
        found.append("created is no date")
    return found


def perform(operation: str, root: str, given: dict, allowed: tuple[str, ...] = ("",), now: datetime | None = None) -> Written:
    """One write; ValueError for a path, size or front matter that may not be written."""
    now = now or datetime.now()
    if any(len((v or "").encode()) > MOST_BYTES for v in given.values() if isinstance(v, str)):
        raise ValueError(f"larger than {MOST_BYTES} bytes")
    if operation == "note_put":
        wrong = faults(front_matter(given["markdown"]))
        if wrong:
            raise ValueError("; ".join(wrong))
        return put(root, given["rel_path"], given["markdown"], allowed)
    if operation == "note_append":
        return append(root, given["rel_path"], given["text"], given.get("heading"), allowed)
    if operation == "capture":
        kind = given.get("kind") or "note"
        checked_path(root, f"{FOLDERS[kind]}/x.md", allowed)
        return capture(root, FOLDERS[kind], given["text"], given.get("title"), now, TYPES[kind], given.get("domain") or "general")
    if operation == "note_propose":
        checked_path(root, "Proposals/x.md", allowed)
        return capture(root, "Proposals", given["text"], given["title"], now, "draft")
    raise ValueError(f"no such write: {operation}")
