"""YAML of contracts and configuration: block and flow collections, scalars, comments.

Anchors, aliases, tags, merge keys, directives and several documents aren't read; text that has them, or is no
YAML, raises ValueError. Plain scalars have the types of YAML 1.1, but dates stay texts.
"""

from __future__ import annotations

import json
import re

_INT = re.compile(r"[-+]?(?:0b[01_]+|0x[0-9a-fA-F_]+|0[0-7_]*|[1-9][0-9_]*)\Z")
_FLOAT = re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?)\Z")
_SIXTIES = re.compile(r"[-+]?[1-9][0-9_]*(?::[0-5]?[0-9])+\Z")
_SPECIAL = re.compile(r"([-+]?)\.(?:inf|Inf|INF)\Z|\.(?:nan|NaN|NAN)\Z")
_WORDS = {w: v for v, names in ((True, "yes true on"), (False, "no false off"), (None, "null")) for n in names.split() for w in (n, n.capitalize(), n.upper())} | {"": None, "~": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " ", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v"}
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`].*?|[-?:](?=\S).*?)\s*:(?=\s|$)""")
#: What ends a plain scalar inside a flow collection.
_BREAK = re.compile(r"[\[\]{},]|:(?=[ ,\[\]{}]|\Z)")
_BLANKS = re.compile(r"[ \n]*")


def scalar(text: str) -> object:
    """The value of a plain scalar."""
    if text in _WORDS:
        return _WORDS[text]
    if text[0] not in "+-.0123456789":  # numbers start so
        return text
    if text[0] in "123456789" and text.isascii() and text.isdigit():
        return int(text)
    if _INT.match(text):
        sign, digits = (-1 if text[0] == "-" else 1), text.lstrip("+-").replace("_", "")
        base = {"0b": 2, "0x": 16}.get(digits[:2], 8 if len(digits) > 1 and digits[0] == "0" else 10)
        return sign * int(digits[2:] if base in (2, 16) else digits, base)
    if _SIXTIES.match(text):
        total = 0
        for part in text.lstrip("+-").replace("_", "").split(":"):
            total = 60 * total + int(part)
        return -total if text[0] == "-" else total
    if _FLOAT.match(text):
        return float(text.replace("_", ""))
    if m := _SPECIAL.match(text):
        return float(f"{m[1] or ''}{'nan' if 'n' == text.lower()[1] and text[0] == '.' and 'nan' in text.lower() else 'inf'}")
    return text


def _quoted(s: str, i: int) -> tuple[str, int]:
    """The quoted scalar that starts at i, and the place after it; line breaks inside are folded already."""
    mark, out, i = s[i], [], i + 1
    while i < len(s):
        c = s[i]
        if c == mark == "'" and s[i + 1 : i + 2] == "'":
            out.append("'")
            i += 2
        elif c == mark:
            return "".join(out), i + 1
        elif c == "\\" and mark == '"':
            e = s[i + 1 : i + 2]
            wide = {"x": 2, "u": 4, "U": 8}.get(e)
            if wide:
                out.append(chr(int(s[i + 2 : i + 2 + wide], 16)))
                i += 2 + wide
            elif e in _ESCAPES:
                out.append(_ESCAPES[e])
                i += 2
            else:
                raise ValueError(f"escape \\{e}")
        else:
            out.append(c)
            i += 1
    raise ValueError("open quote")


def _skip(s: str, i: int) -> int:
    return _BLANKS.match(s, i).end()


def _flow(s: str, i: int) -> tuple[object, int]:
    """The flow value that starts at i, and the place after it."""
    i = _skip(s, i)
    if i >= len(s):
        raise ValueError("open flow collection")
    if s[i] in "\"'":
        return _quoted(s, i)
    if s[i] not in "[{":
        end = _BREAK.search(s, i)
        end = end.start() if end else len(s)
        return _plain(s[i:end].strip()), end
    close, found, pairs = {"[": "]", "{": "}"}[s[i]], [], {}
    whole = s[i] == "{"
    i = _skip(s, i + 1)
    while s[i : i + 1] != close:
        if s[i : i + 1] in ("", ","):
            raise ValueError("flow collection")
        key, i = _flow(s, i)
        i = _skip(s, i)
        if s[i : i + 1] == ":":
            j = _skip(s, i + 1)
            value, i = (None, j) if s[j : j + 1] in (",", close) else _flow(s, j)
            i = _skip(s, i)
            if whole:
                pairs[_hashed(key)] = value
            else:
                found.append({_hashed(key): value})
        elif whole:
            pairs[_hashed(key)] = None
        else:
            found.append(key)
        if s[i : i + 1] == ",":
            i = _skip(s, i + 1)
        elif s[i : i + 1] != close:
            raise ValueError("flow collection")
    return (pairs if whole else found), i + 1


def _hashed(key: object) -> object:
    if isinstance(key, (dict, list)):
        raise ValueError("a collection as key")
    return key


def _plain(text: str) -> object:
    if text and (text[0] in "&*!%@`|>\"'[]{}" or (text[0] in "-?:," and (len(text) == 1 or text[1] == " ") and text != "-")):
        raise ValueError(f"can't start a scalar: {text[:20]}")
    if ":" in text and re.search(r":(\s|$)", text):
        raise ValueError("a mapping inside a scalar")
    return scalar(text)


def _uncommented(line: str) -> str:
    """The line without its comment; # counts after white space, outside quotes."""
    if "#" not in line:
        return line.rstrip()
    quote, before = "", " "
    for i, c in enumerate(line):
        if quote:
            if c == quote and not (quote == '"' and before == "\\"):
                quote = ""
        elif c in "\"'" and before in " [{,:-":
            quote = c
        elif c == "#" and before in " \t":
            return line[:i].rstrip()
        before = " " if quote == '"' and c == before == "\\" else c
    return line.rstrip()


class _Reader:
    def __init__(self, text: str):
        self.raw = text.split("\n")
        self.at = 0
        self.known: tuple[int, tuple[int, str]] | None = None  # where peek was last, and what it found
        self.pending: tuple[int, str] | None = None  # what follows a dash, as a line of its own

    def peek(self) -> tuple[int, str] | None:
        """Indentation and content of the next line that has any."""
        if self.pending:
            return self.pending
        if self.known and self.known[0] == self.at:
            return self.known[1]
        while self.at < len(self.raw):
            line = _uncommented(self.raw[self.at])
            if line.strip():
                indent = len(line) - len(line.lstrip(" "))
                if line[indent] == "\t":
                    raise ValueError("a tab as indentation")
                self.known = self.at, (indent, line[indent:])
                return self.known[1]
            self.at += 1
        return None

    def take(self) -> None:
        self.pending = None
        self.at += 1

    def node(self, indent: int) -> object:
        line = self.peek()[1]
        if line == "-" or line.startswith("- "):
            return self.sequence(indent)
        if _KEY.match(line):
            return self.mapping(indent)
        self.take()
        return self.inline(line, indent - 1)

    def sequence(self, indent: int) -> list:
        out = []
        while (line := self.peek()) and line[0] == indent and (line[1] == "-" or line[1].startswith("- ")):
            rest = line[1][1:].lstrip(" ")
            if not rest:
                self.take()
                out.append(self.below(indent, False))
            elif _KEY.match(rest) or rest == "-" or rest.startswith("- "):
                self.pending = (indent + len(line[1]) - len(rest), rest)
                out.append(self.node(self.pending[0]))
            else:
                self.take()
                out.append(self.inline(rest, indent))
        if line and line[0] > indent:
            raise ValueError("indentation")
        return out

    def mapping(self, indent: int) -> dict:
        out = {}
        while (line := self.peek()) and line[0] == indent and line[1] != "-" and not line[1].startswith("- "):
            m = _KEY.match(line[1])
            if not m:
                raise ValueError("no key")
            key = _quoted(m[1], 0)[0] if m[1][0] in "\"'" else _plain(m[1])
            rest = line[1][m.end() :].strip()
            self.take()
            out[key] = self.inline(rest, indent) if rest else self.below(indent, True)
        if line and line[0] > indent:
            raise ValueError("indentation")
        return out

    def below(self, indent: int, dashes: bool) -> object:
        """The block that belongs to a key or dash; dashes may stand as far left as their key."""
        line = self.peek()
        if line and (line[0] > indent or (dashes and line[0] == indent and (line[1] == "-" or line[1].startswith("- ")))):
            return self.node(line[0])
        return None

    def inline(self, text: str, indent: int) -> object:
        """A value that starts on its key's line, and goes on on deeper lines if it is open."""
        if text[0] in "|>":
            return self.block(text, indent)
        if text[0] in "[{\"'":
            while True:
                try:
                    value, end = _flow(text, 0)
                    break
                except ValueError:
                    line = self.more(indent, text[0] in "\"'")
                    if line is None:
                        raise
                    text = text.removesuffix("\\") + line[1] if text[0] == '"' and text.endswith("\\") else text + line[0] + line[1]
            if _uncommented(" " + text[end:]).strip():
                raise ValueError("text after a value")
            return value
        while line := self.more(indent, False):
            text += line[0] + line[1]
        return _plain(text)

    def more(self, indent: int, whole: bool) -> tuple[str, str] | None:
        """What joins the next deeper line to a scalar (a blank, or a break for each empty line between), and the line; None if
        there is none. whole: inside quotes, where # is no comment."""
        first = self.at
        line = self.peek()
        empty = sum(not x.strip() for x in self.raw[first : self.at])
        if not line or line[0] <= indent or (empty and empty != self.at - first):
            return None
        content = self.raw[self.at].strip(" ") if whole else line[1]
        self.take()
        return "\n" * empty or " ", content

    def block(self, head: str, indent: int) -> str:
        """A literal (|) or folded (>) text."""
        if not re.match(r"[|>][+-]?$", head):
            raise ValueError("block scalar")
        lines = []
        while self.at < len(self.raw) and (not self.raw[self.at].strip() or len(self.raw[self.at]) - len(self.raw[self.at].lstrip(" ")) > indent):
            lines.append(self.raw[self.at])
            self.at += 1
        left = next((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), 0)
        lines = [x[left:] for x in lines]
        end = len(lines)
        while end and not lines[end - 1].strip():
            end -= 1
        body = "\n".join(lines[:end])
        if head[0] == ">":
            body = re.sub(r"(?<=[^\n])\n(?=[^\n ])(?<!\n\n)", " ", body)
            body = re.sub(r"\n(\n+)(?=[^\n ])", r"\1", body)
        return body + ("" if head.endswith("-") or not body else "\n" * (1 + len(lines) - end) if head.endswith("+") else "\n")


def parse_yaml(text: str) -> object:
    """The value of a document; ValueError if it isn't one that can be read."""
    reader = _Reader(re.sub(r"\A(?:[ \t]*(?:#[^\n]*)?\n)*---[ \t]*(?=\n|\Z)", "", text))
    line = reader.peek()
    if not line:
        return None
    value = reader.node(line[0])
    if reader.peek():
        raise ValueError("text after the document")
    return value


def yaml_to_json(text: str | None) -> str | None:
    """A document as compact JSON, keys in order; None if it can't be read. Numbers that JSON lacks become texts."""

    def plain(v: object) -> object:
        if isinstance(v, dict):
            return {k if isinstance(k, str) else json.dumps(plain(k)): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return str(v) if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v

    if text is None:
        return None
    try:
        return json.dumps(plain(parse_yaml(text)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None
