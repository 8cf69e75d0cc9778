"""YAML texts as JSON texts, so that what reads JSON reads both.

Block and flow collections, plain, quoted, literal and folded scalars, comments, anchors and aliases, the core
schema's types. A text with several documents, a repeated key, a tab as indentation, an explicit key (`? `) or a directive
beyond `%YAML` gives null, as does what is no YAML. Numbers that JSON lacks (.inf, .nan) become null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
INTEGER, FLOAT = re.compile(r"[-+]?[0-9]+"), re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?")
HEADER = re.compile(r"([|>])([1-9]?)([-+]?)([1-9]?)\s*(?:#.*)?$")
PROPERTY = re.compile(r"(&[^\s,\[\]{}]+|!\S*)(?:\s+|$)")


def plain_value(text: str) -> object:
    """A plain scalar by the core schema."""
    if text in ("", "~", "null", "Null", "NULL", ".nan", ".NaN", ".NAN") or re.fullmatch(r"[-+]?\.(inf|Inf|INF)", text):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text[0] in "tT"
    if INTEGER.fullmatch(text):
        return int(text)
    if re.fullmatch("0x[0-9a-fA-F]+", text) or re.fullmatch("0o[0-7]+", text):
        return int(text, 0)
    return float(text) if FLOAT.fullmatch(text) else text


def uncommented(text: str) -> str:
    """A line of plain text without its comment."""
    m = re.search(r"(^|\s)#", text)
    return (text[: m.start()] if m else text).strip()


class Parser:
    """One pass over the lines, a frame of the call stack for each open indentation."""

    def __init__(self, text: str):
        self.lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.at, self.anchors = 0, {}

    def document(self) -> object:
        line = self.peek()
        while line is not None and line[1].startswith("%YAML"):
            self.at += 1
            line = self.peek()
        if line is not None and re.match(r"---(\s|$)", self.lines[self.at]):
            self.lines[self.at] = "   " + self.lines[self.at][3:]
        out = self.block(-1)
        line = self.peek()
        if line is not None and self.lines[self.at].rstrip() == "...":
            self.at += 1
            line = self.peek()
        if line is not None:
            raise ValueError(f"line {self.at + 1}")
        return out

    def peek(self) -> tuple[int, str] | None:
        """(indentation, text) of the next line with anything on it."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            bare = line.lstrip(" ")
            if bare.strip() and not bare.startswith("#"):
                if bare[0] == "\t":
                    raise ValueError("tab")
                return len(line) - len(bare), bare.rstrip()
            self.at += 1
        return None

    def ends(self, line: tuple[int, str] | None, above: int) -> bool:
        return line is None or line[0] <= above or (line[0] == 0 and re.match(r"(---|\.\.\.)(\s|$)", line[1]) is not None)

    def block(self, above: int, dash: bool = False) -> object:
        """The value that begins on the next line, if it is further in than `above`; dash: or a list as far in."""
        line = self.peek()
        if dash and line is not None and line[0] == above and re.match(r"-(\s|$)", line[1]):
            return self.sequence(above)
        if self.ends(line, above):
            return None
        indent, text = line
        if re.match(r"-(\s|$)", text):
            return self.sequence(indent)
        if self.key(text) is not None:
            return self.mapping(indent)
        self.at += 1
        return self.value(text, above, indent)

    def sequence(self, indent: int) -> list:
        out = []
        while (line := self.peek()) is not None and line[0] == indent and re.match(r"-(\s|$)", line[1]) and not self.ends(line, indent - 1):
            rest = line[1][1:]
            inner = rest.lstrip(" ")
            # what follows the dash is a block that begins where it stands
            self.lines[self.at] = " " * (indent + 1 + len(rest) - len(inner)) + inner
            if not uncommented(inner):
                self.at += 1
                out.append(self.block(indent))
            else:
                out.append(self.block(indent))
        if (line := self.peek()) is not None and line[0] > indent:
            raise ValueError(f"line {self.at + 1}")
        return out

    def mapping(self, indent: int) -> dict:
        out: dict[str, object] = {}
        while (line := self.peek()) is not None and line[0] == indent and not self.ends(line, indent - 1):
            found = self.key(line[1])
            if found is None:
                raise ValueError(f"line {self.at + 1}")
            name, rest = found
            if name in out:
                raise ValueError(f"repeated key {name}")
            self.at += 1
            out[name] = self.value(rest, indent, indent)
        if (line := self.peek()) is not None and line[0] > indent:
            raise ValueError(f"line {self.at + 1}")
        return out

    def key(self, text: str) -> tuple[str, str] | None:
        """(key, what follows its colon) of a line of a mapping."""
        if text.startswith("? ") or text == "?":
            raise ValueError("explicit key")
        if text[0] in "[{|>%@`":
            return None
        if text[0] in "\"'":
            end = closing(text, 0)
            m = re.match(r"\s*:(\s+|$)", text[end + 1 :]) if end is not None else None
            return (unquoted(text[: end + 1]), text[end + 1 + m.end() :]) if m else None
        m = re.search(r":(\s+|$)", text)
        mark = re.search(r"\s#", text)
        if m is None or (mark and mark.start() < m.start()) or (text[0] in "&*!" and not text[0] == "*" and not re.search(r"\s", text[: m.start()])):
            return None
        name = plain_value(text[: m.start()].strip())
        name = "" if name is None else json.dumps(name) if isinstance(name, bool) else str(name)
        return name, text[m.end() :]

    def value(self, text: str, above: int, indent: int) -> object:
        """The value whose first line is `text`; its line is passed already."""
        anchor, kind = None, None
        while (m := PROPERTY.match(text)) is not None:
            anchor, kind = (m[1][1:], kind) if m[1][0] == "&" else (anchor, m[1])
            text = text[m.end() :]
        text = text.strip()
        if not uncommented(text):
            out = self.block(above, dash=indent == above)
        elif (m := HEADER.match(text)) is not None:
            out = self.literal(m[1] == "|", m[3], int(m[2] or m[4] or 0), above)
        elif text[0] == "*":
            name = uncommented(text)[1:]
            if name not in self.anchors:
                raise ValueError(f"no anchor {name}")
            out = self.anchors[name]
        elif text[0] in "[{":
            out = self.flow(text)
        elif text[0] in "\"'":
            while closing(text, 0) is None:
                if self.at >= len(self.lines):
                    raise ValueError("open quote")
                text += "\n" + self.lines[self.at].strip()
                self.at += 1
            end = closing(text, 0)
            if uncommented(text[end + 1 :]):
                raise ValueError("text behind a quote")
            out = unquoted(text[: end + 1])
        else:
            out = self.plain(text, above)
        if kind in ("!!str", "!") and not isinstance(out, (str, list, dict)):
            out = uncommented(text)
        if anchor:
            self.anchors[anchor] = out
        return out

    def plain(self, text: str, above: int) -> object:
        """A plain scalar and the lines that go on with it."""
        if text[0] in "@`%" or re.search(r":(\s|$)", uncommented(text)):
            raise ValueError("no plain scalar")
        parts, gap = [uncommented(text)], 0
        if parts[0] == text:
            at = self.at
            while at < len(self.lines):
                line = self.lines[at]
                bare = line.strip()
                if not bare:
                    gap, at = gap + 1, at + 1
                    continue
                inner = len(line) - len(line.lstrip(" "))
                if bare.startswith("#") or self.ends((inner, bare), above):
                    break
                if self.key(bare) is not None:
                    raise ValueError("key inside a scalar")
                parts.append(("\n" * gap if gap else " ") + uncommented(bare))
                gap, at = 0, at + 1
                self.at = at
                if uncommented(bare) != bare:
                    break
        return plain_value("".join(parts)) if len(parts) == 1 else "".join(parts)

    def literal(self, keep: bool, chomp: str, given: int, above: int) -> str:
        """A literal (keep) or folded block scalar."""
        rows, indent = [], max(above, 0) + given if given else None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            inner = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                if indent is None:
                    indent = inner
                if inner < indent or inner <= above:
                    break
            rows.append(line[indent:] if indent is not None else "")
            self.at += 1
        tail = 0
        while rows and not rows[-1]:
            rows.pop()
            tail += 1
        text = "\n".join(rows)
        if not keep:
            text = folded(rows)
        return text + ("" if not rows and chomp != "+" else {"": "\n", "-": "", "+": "\n" * (tail + (1 if rows else 0))}[chomp])

    def flow(self, text: str) -> object:
        """A flow collection, over as many lines as it takes."""
        while True:
            try:
                out, end = flow_value(text, 0, self.anchors)
                break
            except IndexError:  # it goes on
                if self.at >= len(self.lines):
                    raise ValueError("open collection") from None
                line = self.lines[self.at].strip()
                text += "\n" + ("" if line.startswith("#") else line)
                self.at += 1
        if uncommented(text[end:]):
            raise ValueError("text behind a collection")
        return out


def folded(rows: list[str]) -> str:
    """Lines with their breaks as spaces; empty lines and lines further in keep theirs."""
    out, k = "", 0
    while k < len(rows):
        out += rows[k]
        gap = 1
        while k + gap < len(rows) and not rows[k + gap]:
            gap += 1
        if k + gap < len(rows):
            deep = rows[k][:1] in (" ", "\t") or rows[k + gap][:1] in (" ", "\t")
            out += "\n" * gap if deep or not rows[k] else " " if gap == 1 else "\n" * (gap - 1)
        k += gap
    return out


def closing(text: str, start: int) -> int | None:
    """Where the quoted text that begins at start ends."""
    mark, k = text[start], start + 1
    while k < len(text):
        if mark == '"' and text[k] == "\\":
            k += 2
        elif text[k] == mark:
            if mark == "'" and text[k + 1 : k + 2] == "'":
                k += 2
            else:
                return k
        else:
            k += 1
    return None


def unquoted(text: str) -> str:
    body = text[1:-1]
    if "\n" in body:
        lines = body.split("\n")
        body = lines[0].rstrip() if not lines[0].endswith("\\") else lines[0]
        gap = 0
        for line in lines[1:]:
            if not line.strip():
                gap += 1
                continue
            body = body[:-1] + line.strip() if body.endswith("\\") and text[0] == '"' else body + ("\n" * gap if gap else " ") + line.strip()
            gap = 0
    if text[0] == "'":
        return body.replace("''", "'")

    def one(m: re.Match) -> str:
        if m[1] is not None:
            return chr(int(m[1][1:], 16))
        if m[2] not in ESCAPES:
            raise ValueError(f"escape {m[2]}")
        return ESCAPES[m[2]]

    return re.sub(r"\\(?:(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})|(.))", one, body, flags=re.S)


def flow_value(text: str, at: int, anchors: dict) -> tuple[object, int]:
    """(value, place behind it); an IndexError if the text ends before the value does."""
    at = skipped(text, at)
    mark = text[at]
    if mark in "[{":
        out: list | dict = [] if mark == "[" else {}
        at = skipped(text, at + 1)
        while text[at] not in "]}":
            name, at = flow_value(text, at, anchors)
            at = skipped(text, at)
            if text[at] == ":":
                value, at = (None, at + 1) if text[skipped(text, at + 1)] in ",]}" else flow_value(text, at + 1, anchors)
                key = "" if name is None else json.dumps(name) if isinstance(name, bool) else str(name)
                if mark == "{" and key in out:
                    raise ValueError(f"repeated key {key}")
                out.append({key: value}) if mark == "[" else out.update({key: value})
            elif mark == "[":
                out.append(name)
            else:
                out["" if name is None else str(name)] = None
            at = skipped(text, at)
            if text[at] == ",":
                at = skipped(text, at + 1)
            elif text[at] not in "]}":
                raise ValueError("no comma")
        if (text[at] == "]") != (mark == "["):
            raise ValueError("brackets")
        return out, at + 1
    if mark in "\"'":
        end = closing(text, at)
        if end is None:
            raise IndexError
        return unquoted(text[at : end + 1]), end + 1
    m = re.compile(r"(?:[^,\[\]{}:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)#)+", re.S).match(text, at)
    if m is None:
        if text[at] in ":,":
            return None, at
        raise ValueError("flow")
    if m.end() == len(text):
        raise IndexError
    word = m[0].strip()
    if word[0] == "*":
        if word[1:] not in anchors:
            raise ValueError(f"no anchor {word}")
        return anchors[word[1:]], m.end()
    return plain_value(word), m.end()


def skipped(text: str, at: int) -> int:
    """The next place that is neither blank nor comment."""
    while text[at] in " \t\n" or (text[at] == "#" and (at == 0 or text[at - 1] in " \t\n")):
        at = text.index("\n", at) if text[at] == "#" and "\n" in text[at:] else len(text) if text[at] == "#" else at + 1
    return at


def yaml_to_json(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(Parser(text).document(), ensure_ascii=False)
    except (ValueError, RecursionError, OverflowError):
        return None


def _each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(yaml_to_json, na_action="ignore").astype(object)


def as_json(text: Column) -> Column:
    """A JSON text as it is, a YAML text as JSON, null for neither."""
    is_json = F.try_parse_json(text).isNotNull()
    return F.when(is_json, text).otherwise(F.pandas_udf(_each, "string")(F.when(~is_json, text)))
