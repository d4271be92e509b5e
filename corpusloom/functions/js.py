"""One pass over a JS or TS text: whether its brackets nest, and the heads of its declarations.

Whether a slash divides or opens a regex literal, and whether ``<`` compares or opens a tag, depends on the token before it, so
the pass carries that token and a stack of open brackets, templates and tags. There is no limit on depth.

A head is the text of a top-level declaration, or of a member of a top-level class, up to its body or its end, on however many
lines. Comments are gone, strings other than module names are empty, and what nests deeper than a head's own list is left out,
so the commas and brackets of a head are its own.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCAN_TYPE = "struct<ok: boolean, heads: array<struct<line: int, nth: int, text: string, owner: string>>>"
_ARROW = pa.struct(
    [
        ("ok", pa.bool_()),
        ("heads", pa.list_(pa.struct([("line", pa.int32()), ("nth", pa.int32()), ("text", pa.string()), ("owner", pa.string())]))),
    ]
)

_TOKEN = re.compile(
    r"(?P<space>[^\S\n]+)|(?P<newline>\n)|(?P<comment>//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)"
    r"|(?P<string>'(?:[^'\\\n]|\\[\s\S])*+'|\"(?:[^\"\\\n]|\\[\s\S])*+\")"
    r"|(?P<word>[\w$]+)|(?P<mark>=>|\+\+|--|\.\.\.|\?\.|/\*|[\s\S])"
)
_REGEX_PART = re.compile(r"(?:[^/\\\[\n]|\\[^\n])*+")
_REGEX_CLASS = re.compile(r"\[(?:[^\]\\\n]|\\[^\n])*+\]")
_REGEX_END = re.compile(r"/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")
_TAG_OPENS = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>]))(?!\s+extends\s)")
_TAG_PART = re.compile(r"[^\s<>{}/\"']+|\s+|\"[^\"]*\"|'[^']*'|[\s\S]")
_TAG_TEXT = re.compile(r"[^<{]+")
_TAG_CLOSES = re.compile(r"</[^>]*>")
_TYPE_MARK = re.compile(r"=>|&&|\|\||==|[<>()\[\]{};!+/%^~@#\\]")

#: Words after which a value follows, so that a slash opens a regex literal.
_OPERATORS = {"return", "typeof", "case", "do", "else", "in", "of", "instanceof", "new", "delete", "void", "throw", "yield", "await"}
#: Words with a bracket after which a statement follows.
_CLAUSES = {"if", "while", "for", "with"}
#: Words that go on with a statement on a new line.
_GO_ON = {"in", "of", "instanceof", "as", "from", "extends", "implements", "satisfies"}
_HEADS = {"import", "export", "function", "async", "class", "abstract", "var", "let", "const", "declare", "interface", "type"}
_LISTS = re.compile(r"(?:declare\s+)?(?:async\s+)?function\b|import\b")
_OWNER = re.compile(r"(?:declare\s+)?(?:abstract\s+)?class\s+([\w$]+)")
#: Declarations that go on after a function or class body.
_VALUES = re.compile(r"(?:export\s+(?:default\s+)?|declare\s+)?(?:var|let|const)\b")
_BEFORE_LISTS = {"import", "export", "type", "default", "var", "let", "const"}
_PAIRS = {")": "(", "]": "[", "}": "{"}


def _type_arguments(text: str) -> dict[int, int]:
    """Start and end of all ``<...>`` that hold nothing but types and nested brackets, from one pass with a stack."""
    ends, stack = {}, []
    for mark in _TYPE_MARK.finditer(text):
        token = mark.group()
        if token in "<([{":
            stack.append((token, mark.start()))
        elif token == ">":
            if stack and stack[-1][0] == "<":
                ends[stack.pop()[1]] = mark.end()
        elif token != "=>":
            while stack and stack[-1][0] == "<":
                stack.pop()
            if token in _PAIRS:
                if stack and stack[-1][0] == _PAIRS[token]:
                    stack.pop()
                else:
                    stack.clear()
    return ends


class _Scan:
    def __init__(self, text: str, tags: bool, types: bool):
        self.text, self.tags, self.types = text, tags, types
        self.stack: list[tuple] = []  # (opening, what the bracket is for, owner of members)
        self.prev, self.value = None, False  # the last token, and whether it ends a value
        self.line, self.fresh = 1, True  # line number, and whether a line break came after the last token
        self.on_line = 0
        self.heads: list[dict] = []
        self.head: list[str] | None = None  # pieces of the open head, and where it stands:
        self.base, self.at, self.nth, self.owner, self.lists = 0, 1, 0, None, False
        self.type_ends: dict[int, int] | None = None
        self.no_class = 0

    def run(self) -> bool:
        text, n = self.text, len(self.text)
        at = max(text.find("\n"), 0) if text.startswith("#!") else 0
        while at < n:
            top = self.stack[-1][0] if self.stack else None
            if top == "`":
                at = self._template(at)
            elif top == "<":
                at = self._tag(at)
            elif top == "<>":
                at = self._children(at)
            else:
                at = self._code(at)
            if at < 0:
                return False
        self._close()
        return not self.stack

    def _moved(self, piece: str) -> None:
        breaks = piece.count("\n")
        if breaks:
            self.line += breaks
            self.on_line = 0
            self.fresh = True

    def _template(self, at: int) -> int:
        end = _TEMPLATE.match(self.text, at).end()
        self._moved(self.text[at:end])
        if self.text.startswith("${", end):
            self.stack.append(("${", None, None))
            self.prev, self.value, self.fresh = "${", False, False
            return end + 2
        if end >= len(self.text):
            return -1
        self.stack.pop()
        self._after("`", True)
        return end + 1

    def _tag(self, at: int) -> int:
        """Inside of an opening tag."""
        part = _TAG_PART.match(self.text, at).group()
        self._moved(part)
        if part == "{":
            self.stack.append(("{", "value", None))
            self.prev, self.value = "{", False
        elif part == ">":
            self.stack[-1] = ("<>", None, None)
        elif part == "/" and self.text.startswith(">", at + 1):
            self.stack.pop()
            self._after("<", True)
            return at + 2
        return at + len(part)

    def _children(self, at: int) -> int:
        """Between an opening and its closing tag."""
        text = _TAG_TEXT.match(self.text, at)
        if text:
            self._moved(text.group())
            return text.end()
        closing = _TAG_CLOSES.match(self.text, at)
        if closing:
            self._moved(closing.group())
            self.stack.pop()
            self._after("<", True)
            return closing.end()
        if self.text[at] == "{":
            self.stack.append(("{", "value", None))
            self.prev, self.value = "{", False
            return at + 1
        opening = _TAG_OPENS.match(self.text, at)
        if not opening:
            return -1
        self._open_tag(opening.group())
        return opening.end()

    def _open_tag(self, opening: str) -> None:
        self.stack.append(("<>" if opening == "<>" else "<", None, None))
        self.fresh = False

    def _after(self, token: str, value: bool) -> None:
        self.prev, self.value, self.fresh = token, value, False
        if self.head is not None and len(self.stack) == self.base and token in "`<":
            self.head.append("0")

    def _code(self, at: int) -> int:
        found = _TOKEN.match(self.text, at)
        kind, token = found.lastgroup, found.group()
        if kind in ("space", "newline", "comment"):
            self._moved(token)
            if self.head and self.head[-1] != " ":
                self._keep(" ")
            return found.end()
        if token == "/*":
            return -1
        if self.stack and token in ("import", "export") and self.text[at - 1] == "\n" and not self.text.startswith(("(", "."), found.end()):
            return -1  # only legal at the top level
        self._start(kind, token, at)
        if kind == "string":
            self._keep(token if self.head and self.head[0] == "import" else '""')
            self.prev, self.value = token, True
            self._moved(token)
        elif kind == "word":
            self._keep(token)
            self.value = token not in _OPERATORS or self.prev in (".", "?.")
            if self.prev in (".", "?."):
                token = "." + token
            self.prev = token
        else:
            return self._mark(token, at)
        self.fresh = False
        return found.end()

    def _keep(self, piece: str) -> None:
        if self.head is None:
            return
        deep = len(self.stack) - self.base
        if deep <= (1 if self.lists else 0):
            self.head.append(piece)

    def _level(self) -> bool:
        """Whether statements of the top level or members of a class stand here."""
        return not self.stack or (self.stack[-1][1] == "class" and len(self.stack) == 1)

    def _start(self, kind: str, token: str, at: int) -> None:
        """Begin a head where a declaration or member begins."""
        if not self._level() or (kind == "mark" and token not in "#*["):
            return
        first = self.prev in (None, ";") or (self.prev == "}" and not self.value) or (bool(self.stack) and self.prev == "{")
        if not first and not (self.fresh and self.value and kind != "mark" and token not in _GO_ON):
            return
        self._close()
        member = bool(self.stack)
        if member or token in _HEADS:
            self.head, self.base, self.at, self.nth = [], len(self.stack), self.line, self.on_line
            self.owner = self.stack[0][2] if member else None
            self.lists = member or bool(_LISTS.match(self.text, at))
            self.on_line += 1

    def _close(self) -> None:
        if self.head:
            text = "".join(self.head).strip()
            if self.owner is None or (text.endswith("{") and "(" in text):
                self.heads.append({"line": self.at, "nth": self.nth, "text": text, "owner": self.owner})
        self.head = None

    def _regex(self, at: int) -> int:
        """End of the regex literal at ``at``, or 0. A class that opens before ``no_class`` is known to lead to none."""
        text, i = self.text, at + 1
        while True:
            i = _REGEX_PART.match(text, i).end()
            if text.startswith("/", i):
                return _REGEX_END.match(text, i).end() if i > at + 1 else 0
            if not text.startswith("[", i):
                return 0
            if i < self.no_class:
                return 0
            found = _REGEX_CLASS.match(text, i)
            if not found:
                end = text.find("\n", i)
                self.no_class = len(text) if end < 0 else end
                return 0
            i = found.end()
            rest = _REGEX_PART.match(text, i).end()
            if not text.startswith(("/", "["), rest):
                self.no_class = i

    def _mark(self, token: str, at: int) -> int:
        text, end = self.text, at + len(token)
        if token == "/" and not self.value:
            regex = self._regex(at)
            if regex:
                self._keep("0")
                self.prev, self.value, self.fresh = "/", True, False
                return regex
        if token == "<" and self.tags and not self.value:
            opening = _TAG_OPENS.match(text, at)
            if opening:
                self._open_tag(opening.group())
                return opening.end()
        if token == "<" and self.types and self.value and not text[at - 1 : at].isspace():
            if self.type_ends is None:
                self.type_ends = _type_arguments(text)
            arguments = self.type_ends.get(at)
            if arguments:
                self._moved(text[at:arguments])
                self.prev, self.value, self.fresh = ">", True, False
                return arguments
        if token == "`":
            self.stack.append(("`", None, None))
            return end
        if token in ("(", "[", "{"):
            self._keep(token)
            self._open(token)
        elif token in _PAIRS:
            if not self.stack:
                return -1
            opening, use, _ = self.stack[-1]
            if token == "}" and opening == "${":
                self.stack.pop()
                return end
            if opening != _PAIRS[token]:
                return -1
            if self.head is not None and len(self.stack) == self.base:
                self._close()
            self.stack.pop()
            self._keep(token)
            self.prev, self.value = token, use == "value"
        else:
            if token == ";" and self.stack and self.stack[-1][0] in "([" and self.stack[-1][1] != "clause":
                return -1
            if token == ";" and self.head is not None and len(self.stack) == self.base:
                self._close()
            else:
                self._keep(token)
            self.value = self.value if token in ("++", "--") else False
            self.prev = token
        self.fresh = False
        return end

    def _open(self, token: str) -> None:
        use, owner = "value", None
        if token == "(":
            use = "clause" if self.prev in _CLAUSES else "value"
        elif token == "{":
            listing = self.prev in _BEFORE_LISTS and self.head is not None
            if (self.value or self.prev in (None, ";", "{", "}", "else", "do", ")", ">")) and not listing:
                use = "block"
                if self.head is not None and len(self.stack) == self.base:
                    owns = _OWNER.match("".join(self.head)) if not self.base else None
                    if owns:
                        use, owner = "class", owns.group(1)
                    if not _VALUES.match("".join(self.head)):
                        self._close()
        self.stack.append((token, use, owner))
        self.prev, self.value = token, False


def scan_text(text: str, tags: bool = True, types: bool = True) -> dict:
    """``ok`` and ``heads`` of one text; ``tags`` allows markup in code, ``types`` type arguments."""
    scan = _Scan(text, tags, types)
    return {"ok": scan.run(), "heads": scan.heads}


def scan(text: Column, extension: Column) -> Column:
    """``struct<ok, heads>`` of a text, NULL for NULL. Stays where it is put: filters don't copy it."""

    @F.arrow_udf(SCAN_TYPE)
    def scanned(texts: pa.Array, extensions: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), extensions.to_pylist())
        return pa.array([None if t is None else scan_text(t, e != ".ts", e in (".ts", ".tsx")) for t, e in rows], _ARROW)

    return scanned.asNondeterministic()(text, extension)
