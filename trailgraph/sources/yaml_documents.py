"""A reader for the YAML that template documents are written in: nested mappings and lists by indentation, flow lists, and
plain or quoted scalars on one line.  Anchors, tags, block scalars and flow mappings that aren't JSON are refused."""

from __future__ import annotations

import json
import re

_KEY = re.compile(r'("(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'|[^\s"\'\[{#&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*)|)$')
_ITEM = re.compile(r'\s*("(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'|[^\s,\[\]"\'][^,\[\]]*)\s*([,\]])')
_COMMENT = re.compile(r"\s+#.*$")
_WORDS = {"": None, "~": None, "null": None, "true": True, "false": False}


def scalar(text: str) -> object:
    text = text.strip()
    if text[:1] == '"':
        return json.loads(text)
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    return int(text) if re.fullmatch(r"[-+]?\d+", text) else text


def _flow(text: str, at: int) -> tuple[list, int]:
    """The list that begins at ``at``, and the place after it."""
    out: list = []
    at += 1
    while True:
        while text[at : at + 1].isspace():
            at += 1
        if text[at : at + 1] == "]":
            return out, at + 1
        if text[at : at + 1] == "[":
            inner, at = _flow(text, at)
            out.append(inner)
            at += len(text[at:]) - len(text[at:].lstrip())
            at += text[at : at + 1] == ","
        elif m := _ITEM.match(text, at):
            out.append(scalar(m[1]))
            at = m.end() - (m[2] == "]")
        else:
            raise ValueError(f"cannot read this YAML list: {text}")


def value(text: str) -> object:
    """A value that stands on its key's line."""
    if text[:1] == "[":
        found, end = _flow(text, 0)
        if text[end:].strip() and not text[end:].lstrip().startswith("#"):
            raise ValueError(f"cannot read this YAML list: {text}")
        return found
    if text[:1] == "{":
        return json.loads(text)
    if text[:1] in ('"', "'"):
        whole = re.match(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'', text)
        if whole is None:
            raise ValueError(f"cannot read this YAML text: {text}")
        return scalar(whole[0])
    if text[:1] and text[0] in "&*!|>%@`":
        raise ValueError(f"cannot read this YAML value: {text}")
    return scalar(_COMMENT.sub("", text))


class _Lines:
    def __init__(self, text: str):
        rows = [r.rstrip() for r in text.splitlines() if r.strip() and not r.lstrip().startswith("#") and r.strip() != "---"]
        self.rows = [(len(r) - len(r.lstrip(" ")), r.lstrip(" ")) for r in rows]
        self.at = 0

    def next(self) -> tuple[int, str]:
        return self.rows[self.at] if self.at < len(self.rows) else (-1, "")

    def block(self, indent: int) -> object:
        return self.items(indent) if self.next()[1].startswith("- ") or self.next()[1] == "-" else self.mapping(indent)

    def items(self, indent: int) -> list:
        out = []
        while (row := self.next())[0] == indent and (row[1].startswith("- ") or row[1] == "-"):
            rest = row[1][1:].lstrip()
            inner = indent + len(row[1]) - len(rest)
            if not rest:
                self.at += 1
                out.append(self.block(self.next()[0]) if self.next()[0] > indent else None)
            elif rest.startswith("- ") or _KEY.match(rest):
                self.rows[self.at] = (inner, rest)
                out.append(self.block(inner))
            else:
                self.at += 1
                out.append(value(rest))
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while (row := self.next())[0] == indent and (m := _KEY.match(row[1])) and not row[1].startswith("- "):
            self.at += 1
            after, text = self.next(), (m[2] or "").strip()
            if text and not text.startswith("#"):
                out[scalar(m[1])] = value(text)
            elif after[0] > indent or after[0] == indent and after[1].startswith("- "):
                out[scalar(m[1])] = self.block(after[0])
            else:
                out[scalar(m[1])] = None
        return out


def load(text: str) -> object:
    lines = _Lines(text)
    found = lines.block(lines.next()[0]) if lines.rows else None
    if lines.at < len(lines.rows):
        raise ValueError(f"cannot read this YAML line: {lines.next()[1]}")
    return found
