"""Tokens of source text: one linear scan for each file, brackets matched by a stack."""

from __future__ import annotations

import re
from bisect import bisect_left

#: Words of script languages after which an expression starts.
BEFORE_EXPRESSION = {"return", "typeof", "case", "in", "of", "delete", "void", "instanceof", "new", "do", "else", "yield", "await", "throw", "default", "extends"}
PLAIN = {
    "script": re.compile(
        r"""(?P<space>\s+)|(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z)|\A\#![^\n]*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
        r"""|(?P<number>\.?\d(?:[eE][+-]|[\w.])*)|(?P<word>\#?[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>=>|\?\.(?!\d)|\.\.\.|[=!]==?|\*\*=?|&&=?|\|\|=?|\?\?=?|\+\+|--|[-+*/%&|^]=|.)""",
        re.S,
    ),
    "go": re.compile(
        r"""(?P<space>\s+)|(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`]*`)|(?P<number>\.?\d(?:[eE][+-]|[\w.])*)|(?P<word>[^\W\d]\w*)|(?P<mark>:=|\.\.\.|<-|.)""",
        re.S,
    ),
    "c": re.compile(
        r"""(?P<space>(?:\s|\\\n)+)|(?P<note>//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z))|(?P<string>(?:u8|[uUL])?R"(?P<raw>[^()\\\s]{0,16})\(.*?\)(?P=raw)"|(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"|(?:u8|[uUL])?'(?:\\.|[^'\\\n])*')"""
        r"""|(?P<directive>(?:(?<=\n)|\A)[ \t]*\#(?:\\\n|/\*.*?\*/|[^\n])*)|(?P<number>\.?\d(?:[eEpP][+-]|'?[\w.])*)|(?P<word>[^\W\d]\w*)|(?P<mark>::|->|&&|.)""",
        re.S,
    ),
}
LINE = re.compile("\n")
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{)?", re.S)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
MARKUP = re.compile(r"<(?:[^\W\d]|[$_>])")
GENERIC = re.compile(r"<\s*(?:const\s+)?[\w$]+\s*(?:,|extends\b|=[^>])")
TAG_NAME = re.compile(r"<[\w$.:-]*")
TAG = re.compile(r"""\s+|"[^"]*"|'[^']*'|//[^\n]*|/\*.*?\*/|[\w$.:-]+|=|/>|>|\{|<""", re.S)
OPEN = {"(": ")", "[": "]", "{": "}", "${": "}"}


class Tokens:
    """A file's tokens side by side: text, kind, line, offsets, and for brackets the place of the other one, -1 where there is none.

    ``sound`` says whether all brackets and literals are closed.
    """

    def __init__(self, source: str, family: str, markup: bool = False):
        self.source = source
        self.text: list[str] = []
        self.kind: list[str] = []
        self.line: list[int] = []
        self.start: list[int] = []
        self.sound = True
        if family == "script":
            self._script(markup)
        else:
            text, kinds, starts = self.text.append, self.kind.append, self.start.append
            for m in PLAIN[family].finditer(source):
                if (kind := m.lastgroup) != "space" and kind != "note":
                    text(m[0])
                    kinds("string" if kind == "raw" else kind)
                    starts(m.start())
        self.end = [k + len(t) for k, t in zip(self.start, self.text)]
        ends = [k.start() for k in LINE.finditer(source)]
        self.line = [bisect_left(ends, k) + 1 for k in self.start] if ends else [1] * len(self.start)
        self._match()

    def _add(self, kind: str, start: int, end: int) -> None:
        self.text.append(self.source[start:end])
        self.kind.append(kind)
        self.start.append(start)

    def last_line(self, k: int) -> int:
        return self.line[k] + self.text[k].count("\n")

    def _ends_operand(self) -> bool:
        if not self.text:
            return False
        kind, text = self.kind[-1], self.text[-1]
        return kind in ("string", "number", "regex", "markup") or kind == "template" and text.endswith("`") or kind == "word" and text not in BEFORE_EXPRESSION or text in (")", "]", "}")

    def _script(self, markup: bool) -> None:
        """Templates, regular expressions and markup need to know what stands around them: ``open_`` holds what is to go on after a closing brace."""
        source, at, open_ = self.source, 0, []
        plain = PLAIN["script"].finditer
        n = len(source)
        text, kinds, starts = self.text.append, self.kind.append, self.start.append
        while at < n:
            for m in plain(source, at):  # most tokens
                at = m.start()
                kind, c = m.lastgroup, source[at]
                if c in "`}/<" and kind != "note":
                    break
                if kind != "space" and kind != "note":
                    t = m[0]
                    text(t)
                    kinds(kind)
                    starts(at)
                    if c == "{":
                        open_.append("{")
                    elif t == '"' or t == "'":
                        self.sound = False
            else:
                return
            if c == "`" or c == "}" and open_ and open_[-1] == "${":
                if c == "}":
                    open_.pop()
                    self._add("mark", at, at + 1)
                m = TEMPLATE.match(source, at + 1)
                cut = m.end() - 2 if m[1] == "${" else m.end()
                if c == "`" or cut > at + 1:
                    self._add("template", at if c == "`" else at + 1, cut)
                if m[1] == "${":
                    self._add("mark", cut, m.end())
                    open_.append("${")
                self.sound &= m[1] is not None
                at = m.end()
            elif c == "}" and open_ and isinstance(open_[-1], tuple):
                self._add("mark", at, at + 1)
                at = self._markup(at + 1, open_, *open_.pop())
            elif c == "/" and not self._ends_operand() and (literal := REGEX.match(source, at)):
                self._add("regex", at, literal.end())
                at = literal.end()
            elif c == "<" and markup and not self._ends_operand() and MARKUP.match(source, at) and not GENERIC.match(source, at):
                self._add("element", at, at + 1)
                at = self._markup(at, open_, 0, False)
            else:
                self._add(kind, at, m.end())
                if c == "}" and open_:
                    open_.pop()
                at = m.end()

    def _markup(self, at: int, open_: list, depth: int, in_tag: bool) -> int:
        """Goes on in markup, ``depth`` elements deep, up to its end or to an expression in braces."""
        source, closing = self.source, False
        while at < len(source):
            if in_tag:
                m = TAG.match(source, at)
                if not m:
                    at += 1
                    continue
                at = m.end()
                if m[0] == "{":
                    self._add("mark", at - 1, at)
                    open_.append((depth, True))
                    return at
                if m[0] in (">", "/>"):
                    depth += (m[0] == ">") - 2 * (closing and m[0] == ">")
                    in_tag = closing = False
                    if depth <= 0:
                        self._add("markup", at - 1, at)
                        return at
            else:
                k = min((x for x in (source.find("<", at), source.find("{", at)) if x >= 0), default=len(source))
                if k == len(source):
                    break
                at = k + 1
                if source[k] == "{":
                    self._add("mark", k, at)
                    open_.append((depth, False))
                    return at
                closing, in_tag = source.startswith("</", k), True
                at = TAG_NAME.match(source, k).end() + closing
        self.sound = False
        return at

    def _match(self) -> None:
        n = len(self.text)
        self.mate = [-1] * n
        stack: list[int] = []
        for k, (text, kind) in enumerate(zip(self.text, self.kind)):
            if kind != "mark":
                continue
            if text in OPEN:
                stack.append(k)
            elif text in (")", "]", "}"):
                if stack and OPEN[self.text[stack[-1]]] == text:
                    self.mate[k] = stack[-1]
                    self.mate[stack.pop()] = k
                else:
                    self.sound = False
        self.sound &= not stack
        self.unclosed = stack
