"""Configuration files: JSON, and the part of YAML that configurations use."""

from __future__ import annotations

import json
import re
from typing import Any

_NUMBER = re.compile(r"[-+]?(?:\d+|\d+\.\d*|\.\d+)(?:[eE][-+]?\d+)?$")
_WORDS = {"": None, "null": None, "~": None, "true": True, "false": False}
_KEY = re.compile(r"""(?P<key>"[^"]*"|'[^']*'|[^\s"'#\-\[{][^"']*?|-[^\s][^"']*?)\s*:(?:\s+(?P<value>.*))?$""")


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " [{,:"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] == " "):
            return line[:i].rstrip()
    return line.rstrip()


def _parts(text: str) -> list[str]:
    """Items of a list or map on one line, divided by commas outside quotes and brackets."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [x for x in [*out, text[start:].strip()] if x]


def scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] == "[" and text[-1:] == "]":
        return [scalar(x) for x in _parts(text[1:-1])]
    if text[:1] == "{" and text[-1:] == "}":
        return {str(scalar(k)): scalar(v) for k, _, v in (x.partition(":") for x in _parts(text[1:-1]))}
    if len(text) > 1 and text[0] == text[-1] == '"':
        return json.loads(text)
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if _NUMBER.match(text):
        return int(text) if re.fullmatch(r"[-+]?\d+", text) else float(text)
    if text[:1] in "&*|>!%@`":
        raise ValueError(f"this YAML is not supported: {text}")
    return text


def parse_yaml(text: str) -> Any:
    """Maps and lists by indentation, lists and maps on one line, quoted and plain values, comments. Anchors, tags, block texts and tabs are an error."""
    lines = [(len(raw) - len(raw.lstrip(" ")), _uncommented(raw.strip())) for raw in text.splitlines() if raw.strip() != "---"]
    lines = [(depth, line) for depth, line in lines if line]
    if any("\t" in line[:1] for _, line in lines):
        raise ValueError("tabs do not indent YAML")
    value, at = _block(lines, 0)
    if at < len(lines):
        raise ValueError(f"unexpected line: {lines[at][1]}")
    return value


def _block(lines: list[tuple[int, str]], at: int) -> tuple[Any, int]:
    """The map, list or value that begins at a line, and the line behind it."""
    if at >= len(lines):
        return None, at
    depth, line = lines[at]
    if line == "-" or line.startswith("- "):
        items = []
        while at < len(lines) and lines[at][0] == depth and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
            rest = lines[at][1][1:].lstrip()
            if not rest:
                item, at = _block(lines, at + 1) if at + 1 < len(lines) and lines[at + 1][0] > depth else (None, at + 1)
            elif _KEY.match(rest):  # a map that begins on the line of its dash
                inner = depth + len(lines[at][1]) - len(rest)
                lines = [*lines[:at], (inner, rest), *lines[at + 1 :]]
                item, at = _block(lines, at)
            else:
                item, at = scalar(rest), at + 1
            items.append(item)
        return items, at
    if not _KEY.match(line):
        return scalar(line), at + 1
    found: dict[str, Any] = {}
    while at < len(lines) and lines[at][0] == depth and (match := _KEY.match(lines[at][1])):
        key, value = str(scalar(match["key"])), match["value"]
        if key in found:
            raise ValueError(f"{key} is given twice")
        below = at + 1 < len(lines) and (lines[at + 1][0] > depth or lines[at + 1][0] == depth and lines[at + 1][1].startswith("- "))
        if value:
            found[key], at = scalar(value), at + 1
        elif below:
            found[key], at = _block(lines, at + 1)
        else:
            found[key], at = None, at + 1
    return found, at


def parse(path: str, text: str) -> Any:
    return parse_yaml(text) if path.casefold().endswith((".yaml", ".yml")) else json.loads(text)
