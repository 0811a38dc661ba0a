"""What a script file (JavaScript, TypeScript, with or without markup) declares and calls, as plain facts.

One walk over the tokens, without a syntax tree: expressions are told from
statements, types are passed over, and a chain of scopes says what a function
is assigned to or handed to. Which facts become rows, and of what kind, is
decided by Spark in `extract`.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from sparkstrata.sources.lexer import Tokens

#: Calls that run tests.
TEST_CALL = re.compile(r"^([xf]?(it|test|describe|suite|context|specify)|(before|after)(Each|All)?)$")
EXPORTS = re.compile(r"^(?:module\.)?exports(?:\.([\w$]+))?$")
PREFIX = {"typeof", "void", "delete", "await", "yield", "throw", "return", "case", "default"}
INFIX = {"in", "of", "instanceof"}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor", "get", "set", "export", "in", "out"}
TYPE_PREFIX = {"keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "abstract"}
TYPE_INFIX = {"extends", "is"}
#: Statements that take something in parentheses and then another statement.
HEADED = {"if", "while", "for", "switch", "with", "catch"}


class Scope(NamedTuple):
    """What holds a region: a variable, a property or an exports assignment with its name, a call with what it calls, or a function, where the search for a name stops.

    ``starts`` are tokens at which a function would be the scope's own value.
    """

    kind: str
    name: str | None = None
    above: "Scope | None" = None
    starts: frozenset[int] = frozenset()
    exports: bool = False


TOP = Scope("function")


class Script:
    """The facts of one file, in ``facts``, each a dict; functions have the texts of the calls in them."""

    def __init__(self, text: str, markup: bool):
        self.t = Tokens(text, "script", markup)
        self.text, self.kind, self.mate, self.line, self.n = self.t.text, self.t.kind, self.t.mate, self.t.line, len(self.t.text)
        self.facts: list[dict] = []
        self.inside: list[dict] = []
        self.calls: dict[tuple[int, int], dict] = {}
        self.functions: dict[int, dict] = {}
        self.exports: set[str] = set()
        self.statements(0, self.n, TOP, None, True)
        for x in self.facts:  # names that an export statement gives away
            if x.get("top") and x["name"] in self.exports and x["what"] in ("function", "interface", "type", "class"):
                x["is_exported"] = True

    # ---- small helpers

    def at(self, k: int, end: int | None = None) -> str:
        return self.text[k] if 0 <= k < (self.n if end is None else end) and self.kind[k] != "string" else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < self.n and self.kind[k] == "word"

    def close(self, k: int, end: int) -> int:
        """The bracket that closes the one at ``k``, or the region's end."""
        return self.mate[k] if k < self.n and k < self.mate[k] < end else end

    def operand_ends(self, k: int) -> bool:
        return self.kind[k] in ("string", "number", "regex", "markup", "template") or self.kind[k] == "word" and self.text[k] not in PREFIX | INFIX or self.text[k] in (")", "]", "}")

    def new_line(self, k: int) -> bool:
        return 0 < k < self.n and self.line[k] > self.t.last_line(k - 1)

    def statement_breaks(self, k: int) -> bool:
        """Whether a line end before ``k`` ends a statement."""
        return self.new_line(k) and self.operand_ends(k - 1) and (self.kind[k] in ("string", "number") or self.kind[k] == "word" and self.text[k] not in INFIX | {"as", "satisfies"} or self.text[k] in ("@", "{"))

    def slice(self, a: int, b: int) -> str:
        """The source of tokens ``a`` up to, not with, ``b``."""
        return self.t.source[self.t.start[a] : self.t.end[min(b, self.n) - 1]] if min(b, self.n) > a else ""

    def fact(self, what: str, name: str | None, a: int, b: int, **more) -> dict:
        """``b`` is the token after the last."""
        x = {"what": what, "name": name, "start_line": self.line[a], "end_line": self.t.last_line(min(max(a, b - 1), self.n - 1)), "ord": len(self.facts)} | more
        self.facts.append(x)
        return x

    # ---- types

    def skip_type(self, k: int, end: int) -> int:
        """The token after a type."""
        wanted, asked, chosen = True, 0, 0
        while k < end:
            t = self.at(k, end)
            if wanted:
                if t in ("(", "[", "{"):
                    k, wanted = self.close(k, end) + 1, False
                elif t == "<":
                    k = self.skip_angles(k, end)
                elif self.is_word(k) or self.kind[k] in ("string", "number"):
                    wanted = t in TYPE_PREFIX and (self.is_word(k + 1) or self.at(k + 1) in ("(", "[", "{"))
                    k += 1
                elif self.kind[k] == "template":
                    k += 1
                    while k < end and (self.kind[k] == "template" or self.at(k) == "${"):
                        k = self.close(k, end) + 1 if self.at(k) == "${" else k + 1
                    wanted = False
                elif t in ("|", "&", "-", "..."):
                    k += 1
                else:
                    return k
            elif t in ("|", "&", ".") or t == "=>" and self.at(k - 1) == ")" or t in TYPE_INFIX and not self.new_line(k):
                asked += t == "extends"
                k, wanted = k + 1, True
            elif t == "?" and asked:  # a type asked for with ``extends``, then two to choose from
                k, wanted, asked, chosen = k + 1, True, asked - 1, chosen + 1
            elif t == ":" and chosen:
                k, wanted, chosen = k + 1, True, chosen - 1
            elif t == "<" and not self.new_line(k):
                k = self.skip_angles(k, end)
            elif t == "[" and not self.new_line(k):
                k = self.close(k, end) + 1
            else:
                return k
        return end

    def skip_angles(self, k: int, end: int) -> int:
        """The token after the angle that closes the one at ``k``."""
        depth, at = 0, k
        while at < end:
            t = self.at(at, end)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return at + 1
            elif t in ("(", "[", "{"):
                at = self.close(at, end)
            elif t == ";":
                break
            at += 1
        return k + 1

    def type_arguments(self, k: int, end: int) -> int:
        """The token after type arguments of a call, or ``k`` if the angle compares."""
        depth, at = 0, k
        while at < end:
            t = self.at(at, end)
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return at + 1 if self.at(at + 1, end) == "(" or at + 1 < end and self.kind[at + 1] == "template" else k
            elif t in ("(", "[", "{"):
                at = self.close(at, end)
            elif not (self.is_word(at) or self.kind[at] in ("string", "number") or t in (",", ".", "|", "&", "=>", "?", ":")):
                return k
            at += 1
        return k

    # ---- functions

    def parameters(self, k: int, end: int, cls: str | None) -> list[str]:
        """Names of the parameters in the parentheses that open at ``k``; their default values are walked."""
        stop, names = self.close(k, end), []
        at = k + 1
        while at < stop:
            while self.at(at) == "@" or self.at(at) in MODIFIERS and (self.is_word(at + 1) or self.at(at + 1) in ("{", "[")):
                at = self.decorator(at, stop, TOP, cls) if self.at(at) == "@" else at + 1
            at += self.at(at) == "..."
            if at >= stop:
                break
            names.append(self.slice(at, self.close(at, stop) + 1) if self.at(at) in ("{", "[") else self.text[at])
            at = self.close(at, stop) + 1 if self.at(at) in ("{", "[") else at + 1
            at += self.at(at, stop) == "?"
            if self.at(at, stop) == ":":
                at = self.skip_type(at + 1, stop)
            if self.at(at, stop) == "=":
                at = self.expression(at + 1, stop, TOP, cls)
            at = max(at, k + 1)
            while at < stop and self.at(at) != ",":
                at = self.close(at, stop) + 1 if self.at(at) in ("(", "[", "{") else at + 1
            at += 1
        return names

    def callable(self, form: str, name: str | None, a: int, k: int, end: int, cls: str | None, scope: Scope = TOP, **more) -> int:
        """A function that begins at ``a`` and whose type parameters or parameters begin at ``k``; the token after it."""
        x = self.functions[a] = self.fact("function", name, a, k, form=form, **more)
        self.inside.append(x)
        x["texts"] = []
        if self.at(k, end) == "<":
            k = self.skip_angles(k, end)
        if self.at(k, end) == "(":
            x["params"] = self.parameters(k, end, cls)
            k = self.close(k, end) + 1
        elif self.is_word(k):
            x["params"] = [self.text[k]]
            k += 1
        if self.at(k, end) == ":":
            k = self.skip_type(k + 1, end)
        if form == "arrow":
            k += 1
            if self.at(k, end) != "{":
                k = self.expression(k, end, TOP, cls)
        if self.at(k, end) == "{" and (form != "arrow" or self.at(k - 1) == "=>"):
            stop = self.close(k, end)
            self.statements(k + 1, stop, TOP, cls, False)
            k = stop + 1
            x["body"] = True
        self.inside.pop()
        x["texts"] = [t for *_, t in sorted(x["texts"])]
        x["end_line"] = self.t.last_line(min(max(a, k - 1), self.n - 1))
        return k

    def arrow_at(self, k: int, end: int, ternary: int) -> int:
        """The parameters of an arrow function that begins at ``k``, or -1."""
        if self.at(k) == "async" and not self.new_line(k + 1):
            k += 1
        if self.is_word(k) and self.at(k + 1, end) == "=>":
            return k
        first = k
        if self.at(k) == "<":
            k = self.skip_angles(k, end)
        if self.at(k, end) == "(" and k < self.mate[k] < end:
            after = self.mate[k] + 1
            if self.at(after, end) == "=>":
                return first
            if self.at(after, end) == ":" and not ternary:
                after = self.skip_type(after + 1, end)
                if self.at(after, end) == "=>":
                    return first
        return -1

    def named(self, scope: Scope) -> str | None:
        """The name that the scopes around a function give it."""
        s: Scope | None = scope
        while s:
            if s.kind in ("variable", "property", "exports"):
                return s.name
            if s.kind in ("call", "function"):
                return s.name
            s = s.above
        return None

    def function_value(self, form: str, a: int, k: int, end: int, scope: Scope, cls: str | None, own: str | None = None) -> int:
        """A function in an expression."""
        direct = a in scope.starts
        hidden = direct and scope.kind == "call" and scope.name is None  # handed to a call that runs no tests
        exports = scope.exports and a in scope.starts
        return self.callable(
            form, None if hidden else self.named(scope), a, k, end, cls, scope, is_async=self.at(a) == "async", direct=direct and scope.kind == "property",
            exports_name=(scope.name if scope.kind == "property" else own or scope.name) if exports else None,
        )

    # ---- expressions

    def chain_start(self, k: int, low: int) -> int:
        """The first token of what is called by the parenthesis at ``k``; -1 if it makes an object."""
        at, calls = k - 1, False
        while at >= low:
            if self.at(at) == ">" and (before := self.before_angles(at + 1, low)) <= at:
                at = before - 1
                continue
            at -= self.at(at) == "!"
            if self.at(at) in (")", "]", "}") and self.mate[at] >= low:
                opening = self.mate[at]
                if self.at(opening) == "${":  # the end of a template
                    at = opening - 1
                    continue
                before = self.before_angles(opening, low) - 1
                if before >= low and self.at(opening) != "{" and self.operand_ends(before):
                    calls |= self.at(opening) == "("
                    at = before
                    continue
                at = opening
            elif self.kind[at] == "template":
                while at > low and not self.text[at].startswith("`"):
                    at = self.mate[at - 1] - 1 if self.at(at - 1) == "}" and self.mate[at - 1] > low else at - 1
                if at > low and self.operand_ends(at - 1) and not self.statement_breaks(at):
                    at -= 1
                    continue
            if at - 1 >= low and self.at(at - 1) in (".", "?."):
                at -= 2
                continue
            if at - 1 >= low and self.at(at - 1) == "new" and self.at(at - 2) != ".":
                return at - 1 if calls else -1
            return at
        return max(at, low)

    def before_angles(self, k: int, low: int) -> int:
        """The angle that opens the type arguments before ``k``, or ``k`` where there are none."""
        at, depth = k - 1, 0
        while at >= low and self.at(k - 1) == ">":
            depth += (self.at(at) == ">") - (self.at(at) == "<")
            if not depth:
                return at
            at -= 1
        return k

    def called(self, k: int, low: int, end: int) -> Scope:
        """The fact of a call by the parenthesis at ``k``, and the scope of its arguments."""
        first = self.chain_start(k, low)
        stop = self.close(k, end)
        last = self.before_angles(k, low)
        last -= self.at(last - 1) in ("?.", "!")
        first = max(first, low) if first >= 0 else first
        short = first >= 0 and self.t.end[last - 1] - self.t.start[first] <= 200
        text = self.slice(first, last) if short else ""  # longer ones name nothing
        cut = k + 1
        while cut < stop and self.at(cut) != ",":
            cut = self.close(cut, stop) + 1 if self.at(cut) in ("(", "[", "{", "${") else cut + 1
        given = self.slice(k + 1, min(cut, stop))
        name = None
        if first >= 0:
            literal = given if cut == k + 2 and self.kind[k + 1] == "string" else None
            for x in self.inside:
                x["texts"].append((first, -stop, text))  # outer calls come before those in them
            self.calls[first, stop] = self.fact("call", text, first, stop + 1, first_text=literal)
            if TEST_CALL.match(text):
                name = f"{text}({re.sub('[`\"' + chr(39) + ']', '', given)})"
        starts, at = {k + 1}, k + 1
        while at < stop:
            if self.at(at) == ",":
                starts.add(at + 1)
            at = self.close(at, stop) + 1 if self.at(at) in ("(", "[", "{", "${") else at + 1
        return Scope("call", name, None, frozenset(starts))

    def items(self, k: int, end: int, scope: Scope, cls: str | None) -> None:
        """Expressions with commas between."""
        while k < end:
            k = max(self.expression(k, end, scope, cls), k) + 1

    def expression(self, k: int, end: int, scope: Scope, cls: str | None) -> int:
        """Walks one expression; the token that ends it."""
        low, ended, ternary = k, False, 0
        while k < end:
            t, kind = self.text[k], self.kind[k]
            if kind in ("string", "number", "regex", "directive"):
                if ended and self.new_line(k):
                    return k
                k, ended = k + 1, True
            elif kind == "template":
                k += 1
                while k < end and self.at(k) == "${":
                    self.items(k + 1, self.close(k, end), self.indirect(scope), cls)
                    k = self.close(k, end) + 1
                    k += k < end and self.kind[k] == "template" and not self.text[k].startswith("`")
                ended = True
            elif kind == "element":
                k += 1
                while k < end and self.kind[k] != "markup":
                    if self.at(k) == "{":
                        self.items(k + 1, self.close(k, end), self.indirect(scope), cls)
                        k = self.close(k, end)
                    k += 1
                k, ended = k + 1, True
            elif not ended:
                params = self.arrow_at(k, end, ternary) if t in ("(", "<", "async") or self.at(k + 1, end) == "=>" else -1
                if params >= 0:
                    k, ended = self.function_value("arrow", k, params, end, scope, cls), True
                elif t == "function" or t == "async" and self.at(k + 1) == "function":
                    after = k + 1 + (t == "async")
                    after += self.at(after, end) == "*"
                    own = self.text[after] if self.is_word(after) else None
                    k, ended = self.function_value("expression", k, after + (own is not None), end, scope, cls, own), True
                elif t == "class":
                    k, ended = self.class_(k, end, scope, cls, None), True
                elif t in ("(", "["):
                    self.items(k + 1, self.close(k, end), self.indirect(scope), cls)
                    k, ended = self.close(k, end) + 1, True
                elif t == "{":
                    self.object(k, end, scope, cls)
                    k, ended = self.close(k, end) + 1, True
                elif t == "<":
                    k = self.skip_angles(k, end)
                elif t in (")", "]", "}", ",", ";", ":"):
                    return k
                elif t == "@":
                    k = self.decorator(k, end, scope, cls)
                else:
                    ended = kind == "word" and t not in PREFIX | {"new"}
                    k += 1
            elif self.statement_breaks(k):
                return k
            elif t == "(":
                self.items(k + 1, self.close(k, end), self.called(k, low, end), cls)
                k = self.close(k, end) + 1
            elif t == "[":
                self.items(k + 1, self.close(k, end), self.indirect(scope), cls)
                k = self.close(k, end) + 1
            elif t in (".", "?."):
                k += 2 if self.is_word(k + 1) else 1
            elif t == "<" and (after := self.type_arguments(k, end)) > k:
                k = after
            elif t in ("as", "satisfies") and kind == "word":
                k = self.skip_type(k + 1, end)
            elif t in ("!", "++", "--"):
                k += 1
            elif t == "?":
                k, ended, ternary = k + 1, False, ternary + 1
            elif t == ":" and ternary:
                k, ended, ternary = k + 1, False, ternary - 1
            elif t in (",", ";", ")", "]", "}", ":", "{"):
                return k
            elif t == "=":
                m = EXPORTS.match(self.slice(low, k))
                if m:
                    scope = Scope("exports" if m[1] else "other", m[1], scope, frozenset({k + 1}), True)
                k, ended = k + 1, False
            elif kind == "word" and t not in INFIX:
                return k
            else:
                k, ended = k + 1, False
        return end

    def indirect(self, scope: Scope) -> Scope:
        """The scope of what stands deeper in an expression, where a function is not the scope's own value."""
        return Scope("other", None, scope)

    def decorator(self, k: int, end: int, scope: Scope, cls: str | None) -> int:
        low = k = k + 1
        while self.is_word(k) or self.at(k, end) == ".":
            k += 1
        if self.at(k, end) == "(":
            self.items(k + 1, self.close(k, end), self.called(k, low, end), cls)
            k = self.close(k, end) + 1
        return max(k, low)

    def member(self, k: int, stop: int, scope: Scope, cls: str | None) -> tuple[int, int, str, set[str]]:
        """(first token, token after the name, name, modifiers) of a member of a class or object."""
        a, words = k, set()
        while self.at(k) == "@":
            k = self.decorator(k, stop, scope, cls)
        a = k if self.at(a) != "@" else a
        while k < stop and (self.at(k) in MODIFIERS and self.at(k + 1, stop) not in ("(", ":", "=", ",", ";", "?", "!", "<", "}", "") or self.at(k) == "*" or self.at(k) in MODIFIERS and k + 1 < stop and self.kind[k + 1] == "string"):
            words.add(self.text[k])
            k += 1
        if k >= stop:
            return a, stop, "", words
        if self.at(k) == "[":
            self.items(k + 1, self.close(k, stop), self.indirect(scope), cls)
            return a, self.close(k, stop) + 1, self.slice(k, min(self.close(k, stop) + 1, stop)), words
        return a, k + 1, self.text[k], words

    def method(self, a: int, k: int, end: int, name: str, words: set[str], cls: str | None, holder: str | None) -> int:
        form = "getter" if "get" in words else "setter" if "set" in words else "constructor" if name == "constructor" and holder == "class" else "method"
        visibility = "private" if "private" in words else "protected" if "protected" in words else "public"
        return self.callable(form, f"{cls}.{name}" if cls else name, a, k, end, cls, is_async="async" in words, parent=cls, visibility=visibility, in_exported=self.exported_class)

    exported_class = False

    def object(self, k: int, end: int, scope: Scope, cls: str | None) -> None:
        stop = self.close(k, end)
        k += 1
        while k < stop:
            if self.at(k) == "...":
                k = self.expression(k + 1, stop, self.indirect(scope), cls)
            elif self.at(k) != ",":
                a, after, name, words = self.member(k, stop, scope, cls)
                if self.at(after, stop) in ("(", "<"):
                    k = self.method(a, after, stop, name, words, cls, None)
                elif self.at(after, stop) == ":":
                    k = self.expression(after + 1, stop, Scope("property", name, None, frozenset({after + 1}), scope.exports), cls)
                elif self.at(after, stop) == "=":
                    k = self.expression(after + 1, stop, self.indirect(scope), cls)
                else:
                    k = after
            k = k + 1 if self.at(k, stop) == "," or k >= stop else k
            if k < stop and self.at(k) in (")", "]", "}", ";", ":"):
                k += 1  # not an object after all

    def class_(self, k: int, end: int, scope: Scope, cls: str | None, exported: bool | None) -> int:
        """A class; ``exported`` is None where it is an expression."""
        a, k = k, k + 1
        name = self.text[k] if self.is_word(k) and self.text[k] not in ("extends", "implements") else None
        k += name is not None
        while k < end and self.at(k) != "{":
            if self.at(k) == "<":
                k = self.skip_angles(k, end)
            elif self.at(k) == "(":
                self.items(k + 1, self.close(k, end), self.called(k, a + 1, end), cls)
                k = self.close(k, end) + 1
            else:
                k += 1
        stop = self.close(k, end)
        if exported is not None:
            self.fact("class", name, a, stop + 1, is_exported=exported, top=self.level == 0)
            cls = name
        before, self.exported_class = self.exported_class, bool(exported) if exported is not None else self.exported_class
        k += 1
        while k < stop:
            if self.at(k) in (";", ","):
                k += 1
                continue
            if self.at(k) == "static" and self.at(k + 1, stop) == "{":
                self.statements(k + 2, self.close(k + 1, stop), self.indirect(scope), cls, False)
                k = self.close(k + 1, stop) + 1
                continue
            a, after, member, words = self.member(k, stop, scope, cls)
            after += self.at(after, stop) in ("?", "!")
            if self.at(after, stop) in ("(", "<"):
                k = self.method(a, after, stop, member, words, cls, "class")
            else:
                if self.at(after, stop) == ":":
                    after = self.skip_type(after + 1, stop)
                k = self.expression(after + 1, stop, self.indirect(scope), cls) if self.at(after, stop) == "=" else max(after, k + 1)
        self.exported_class = before
        return stop + 1

    # ---- statements

    level = -1

    def statements(self, k: int, end: int, scope: Scope, cls: str | None, top: bool) -> None:
        self.level += 1
        while k < end:
            k = max(self.statement(k, end, scope, cls, top and self.level == 0), k + 1)
        self.level -= 1

    def statement(self, k: int, end: int, scope: Scope, cls: str | None, top: bool) -> int:
        while (headed := self.at(k, end) in HEADED) or self.at(k, end) in ("else", "do", "try", "finally"):
            k, top = k + 1, False
            k += headed and self.at(k, end) == "await"
            if headed and self.at(k, end) == "(":
                self.statements(k + 1, self.close(k, end), scope, cls, False)
                k = self.close(k, end) + 1
        if k >= end:
            return k
        t, a, words = self.at(k), k, set()
        while t in ("export", "default", "declare", "abstract", "async", "@") and self.at(k + 1, end) not in (":", "=", ".", "(") and not (t == "default" and "export" not in words):
            if t == "async" and self.at(k + 1) != "function":
                break
            k = self.decorator(k, end, scope, cls) if t == "@" else k + 1
            words.add(t)
            t = self.at(k, end)
        exported = "export" in words
        if t in ("import", "export") or exported and t in ("{", "*"):
            if not (t == "import" and self.at(k + 1, end) in ("(", ".")):
                return self.module(a, k, end, t == "import")
        if t == "type" and "export" in words and self.at(k + 1, end) in ("{", "*"):
            return self.module(a, k + 1, end, False, True)
        if t == "function":
            after = k + 1 + (self.at(k + 1, end) == "*")
            name = self.text[after] if self.is_word(after) else None
            return self.callable("declaration", name, a, after + (name is not None), end, cls, is_exported=exported, is_async="async" in words, top=top)
        if t == "class":
            return self.class_(k, end, scope, cls, exported)
        if t == "enum" or t == "const" and self.at(k + 1) == "enum":
            while k < end and self.at(k) != "{":
                k += 1
            return self.close(k, end) + 1
        if t in ("interface", "namespace", "module", "global") and (self.is_word(k + 1) or t == "module" and self.kind[min(k + 1, end - 1)] == "string" or t == "global" and self.at(k + 1, end) == "{") and not self.new_line(k + 1):
            opening = k
            while opening < end and self.at(opening) != "{":
                opening = self.skip_angles(opening, end) if self.at(opening) == "<" else opening + 1
            if t == "interface":
                self.fact("interface", self.text[k + 1], a, self.close(opening, end) + 1, is_exported=exported, top=top)
            else:
                self.statements(opening + 1, self.close(opening, end), scope, cls, False)
            return self.close(opening, end) + 1
        if t == "type" and self.is_word(k + 1) and self.at(k + 2, end) in ("=", "<"):
            after = self.skip_angles(k + 2, end) if self.at(k + 2) == "<" else k + 2
            after = self.skip_type(after + 1, end)
            self.fact("type", self.text[k + 1], a, after, is_exported=exported, top=top)
            return after + (self.at(after, end) == ";")
        if t in ("const", "let", "var") or t == "using" and self.is_word(k + 1):
            return self.variables(k + 1, end, scope, cls, exported, top)
        if t == "{":
            self.statements(k + 1, self.close(k, end), scope, cls, False)
            return self.close(k, end) + 1
        if t in (";", ")", "]", "}", ",", ":"):
            return k + 1
        if self.is_word(k) and self.at(k + 1, end) == ":" and t not in PREFIX:  # a label
            return k + 2
        if "default" in words and self.is_word(k) and self.at(k + 1, end) in (";", ""):
            self.exports.add(t)
        stop = k
        while stop < end:
            stop = self.expression(stop, end, scope, cls)
            if self.at(stop, end) != ",":
                break
            stop += 1
        if top and not words:
            if call := self.calls.get((k, stop - 1)):
                self.fact("statement", call["name"], k, stop + (self.at(stop, end) == ";"), first_text=call["first_text"])
        return stop + (self.at(stop, end) in (";", ",", ":"))

    def variables(self, k: int, end: int, scope: Scope, cls: str | None, exported: bool, top: bool) -> int:
        """Declarators with commas between; the token after the statement."""
        while k < end:
            a = k
            if self.at(k) in ("{", "["):
                name, after = self.slice(k, min(self.close(k, end) + 1, end)), self.close(k, end) + 1
                self.items(k + 1, self.close(k, end), TOP, cls)
            else:
                name, after = self.text[k], k + 1
            after += self.at(after, end) == "!"
            if self.at(after, end) == ":":
                after = self.skip_type(after + 1, end)
            k = after
            if self.at(after, end) == "=" or self.at(after, end) in INFIX:
                k = self.expression(after + 1, end, Scope("variable", name, None, frozenset({after + 1}), False), cls)
                if exported and (after + 1, k - 1) in self.calls:
                    self.fact("variable", name, a, k, is_exported=True)
                if top and after + 1 in self.functions:
                    self.fact("value", name, a, k)
            if self.at(k, end) != ",":
                break
            k += 1
        return k + (self.at(k, end) == ";")

    def module(self, a: int, k: int, end: int, imports: bool, typed: bool = False) -> int:
        """An import or export statement with names or a module."""
        k += imports
        if imports and self.at(k) == "type" and (self.is_word(k + 1) and self.at(k + 1) != "from" or self.at(k + 1) in ("{", "*")):
            typed, k = True, k + 1
        names: list[str] = []
        whole: list[str] = []
        first = []
        while k < end and self.kind[k] != "string":
            t = self.at(k)
            if t == "{":
                stop = self.close(k, end)
                k += 1
                while k < stop:
                    k += self.at(k) == "type" and self.is_word(k + 1) and self.at(k + 1) != "as"
                    names.append(self.text[k])
                    while k < stop and self.at(k) != ",":
                        k += 1
                    k += 1
                k = stop
            elif t == "*":
                if self.at(k + 1) == "as" and k + 2 < end:
                    whole.append(f"* as {self.text[k + 2]}" if imports else "")
                    k += 2
                else:
                    whole.append("*")
            elif t == ";" or self.new_line(k) and self.at(k - 1) == "}" and t != "from" or t == "=":
                break
            elif self.is_word(k) and t != "from":
                first.append(t)
            k += 1
        if k < end and self.kind[k] == "string":
            symbols = [*names, *first, *whole] if imports else [*names, *[x for x in whole if x]]
            self.fact("import", self.text[k][1:-1], a, k + 1, kind="static" if imports else "re-export", symbols=list(dict.fromkeys(symbols)) if imports else symbols, is_type_only=typed)
            k += 1
        elif not imports:
            self.exports.update(names)
        elif self.at(k) == "=":  # import x = require("y")
            return self.expression(k + 1, end, TOP, None)
        return k + (self.at(k, end) == ";")


def script_facts(text: str, markup: bool) -> tuple[list[dict], bool]:
    """The facts of a file, and whether its brackets and literals are all closed."""
    s = Script(text, markup)
    return s.facts, s.t.sound
