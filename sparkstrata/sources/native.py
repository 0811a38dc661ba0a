"""What Go and C or C++ files declare and call, read from their tokens declaration by declaration.

Directives are tokens of their own, so macro bodies open no brackets and code
under conditions is read like any other. Where a body is never closed the file
is broken from there on: reading takes up again at the next sound declaration at
the start of a line, and functions found on the way are marked as recovered.
"""

from __future__ import annotations

import re

from sparkstrata.sources.lexer import Tokens

#: Names that are control flow, never functions.
CONTROL = {"if", "for", "while", "switch", "return", "catch", "else", "do", "sizeof"}
GO_WORDS = {"func", "if", "for", "switch", "return", "go", "defer", "select", "range", "case", "interface", "struct", "map", "chan", "import", "type", "var", "const", "else"}
C_WORDS = CONTROL | {
    "alignof", "decltype", "defined", "static_assert", "_Static_assert", "alignas", "throw", "noexcept", "operator", "new", "delete", "co_await", "co_return", "case", "goto", "typeof", "using",
    "void", "int", "char", "bool", "float", "double", "long", "short", "signed", "unsigned", "auto", "const", "volatile", "size_t", "__attribute__", "__declspec", "requires", "asm", "__asm__", "and", "or", "not",
}
#: Words that may stand between a function's parameters and its body or end.
AFTER_PARAMETERS = {"const", "volatile", "noexcept", "override", "final", "throw", "requires", "__attribute__", "try", "mutable"}
GTEST = {"TEST", "TEST_F", "TEST_P", "TYPED_TEST"}
TEST_DIR = {"test", "tests", "testing", "unittests", "unittest"}


def in_test_dir(path: str) -> bool:
    return any(x in TEST_DIR for x in path.lower().split("/")[:-1])


class Native:
    """Shared by both languages: rows, brackets and calls of one file."""

    def __init__(self, text: str, family: str, path: str):
        self.t = Tokens(text, family)
        self.text, self.kind, self.mate, self.line, self.n = self.t.text, self.t.kind, self.t.mate, self.t.line, len(self.t.text)
        self.path = path
        self.rows: list[dict] = []

    def at(self, k: int) -> str:
        return self.text[k] if 0 <= k < self.n and self.kind[k] not in ("string", "directive") else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < self.n and self.kind[k] == "word"

    def close(self, k: int, end: int) -> int:
        return self.mate[k] if k < self.n and k < self.mate[k] < end else end

    def closed(self, k: int, end: int) -> bool:
        return k < self.n and k < self.mate[k] < end

    def leads(self, k: int) -> bool:
        """Whether a token stands at the very start of its line."""
        return self.t.start[k] == 0 or self.t.source[self.t.start[k] - 1] == "\n"

    def row(self, what: str, name: str, a: int, b: int, **more) -> dict:
        """``b`` is the last token."""
        x = {"what": what, "name": name, "start_line": self.line[a], "end_line": self.t.last_line(max(a, min(b, self.n - 1))), "analysis_confidence": "medium"} | more
        self.rows.append(x)
        return x

    def angles(self, k: int, end: int) -> int:
        """The token after the angle that closes the one at ``k``; ``k`` itself if none does before a body or an end."""
        depth, at = 0, k
        while at < end:
            t = self.at(at)
            depth += (t == "<") - (t == ">")
            if not depth:
                return at + 1
            if t in ("(", "["):
                at = self.close(at, end)
            elif t in (";", "{", "}"):
                return k
            at += 1
        return k

    def before_angles(self, k: int, low: int) -> int:
        """The angle that opens what closes at ``k``, or -1."""
        depth = 0
        for at in range(k, max(low, k - 200) - 1, -1):
            t = self.at(at)
            depth += (t == ">") - (t == "<")
            if not depth:
                return at
            if t in (";", "{", "}", "=", "&&") or self.kind[at] == "string":
                return -1
        return -1

    def calls(self, a: int, b: int, words: set[str], joints: tuple[str, ...], templates: bool) -> list[str]:
        """Names called from token ``a`` up to ``b``, outer calls before those in them, each once."""
        found = []
        k = a
        while k < b:
            if self.at(k) == "interface" and self.at(k + 1) == "{" and joints == (".",):
                k = self.close(k + 1, b)
            elif self.at(k) == "(":
                last = k - 1
                while self.at(last) == ")" and self.mate[last] >= a and self.mate[last] == last - 2:
                    last -= 1  # a name in parentheses
                if templates and self.at(last) == ">":
                    opening = self.before_angles(last, a)
                    last = opening - 1 if opening > a and self.is_word(opening - 1) else last
                if last >= a and self.is_word(last) and self.text[last] not in words:
                    first = last
                    while first - 2 >= a and self.at(first - 1) in joints:
                        first -= 2
                        while first > a and self.at(first) in (")", "]") and self.mate[first] > a:
                            first = self.mate[first] - (self.is_word(self.mate[first] - 1) or self.at(self.mate[first] - 1) in (")", "]"))
                    before = self.at(first - 1) if first > a else ""
                    if before == "]" and joints == (".",):  # a conversion to a slice or map
                        k += 1
                        continue
                    declares = templates is not None and first > a and (self.is_word(first - 1) and before not in CONTROL | {"case", "co_await", "co_return", "co_yield", "throw", "and", "or", "not", "goto", "delete"} or before in ("*", "&", ">") and self.declared(first - 1, a))
                    if before != "new" and not declares:
                        found.append((first, -self.close(k, b), self.text[last]))
            k += 1
        return list(dict.fromkeys(name for *_, name in sorted(found)))

    def declared(self, k: int, low: int) -> bool:
        """Whether a star, an ampersand or an angle before a name belongs to the type of a variable: ``Foo *x(1)`` at the start of a statement."""
        while k > low and self.at(k) in ("*", "&"):
            k -= 1
        if self.at(k) == ">":
            k = self.before_angles(k, low) - 1
        while k - 2 >= low and self.at(k - 1) == "::":
            k -= 2
        return self.is_word(k) and self.text[k] not in CONTROL and (k == low or self.at(k - 1) in (";", "{", "}"))


class Go(Native):
    def __init__(self, text: str, path: str):
        super().__init__(text, "go", path)
        self.package = ""
        self.is_test = path.endswith("_test.go") or in_test_dir(path)
        k = 0
        while k < self.n:
            k = max(self.declaration(k), k + 1)
        if self.package == "main" and (main := next((x for x in self.rows if x["what"] == "function" and x["name"] == "main"), None)):
            self.rows.append({"what": "startup", "name": "main", "start_line": main["start_line"], "analysis_confidence": main["analysis_confidence"]})

    def declaration(self, k: int) -> int:
        """Reads the declaration at ``k``; the token after it."""
        t = self.at(k)
        if t == "package":
            self.package = self.at(k + 1)
            return k + 2
        if t == "import":
            if self.at(k + 1) != "(":
                return self.import_(k + 1)
            stop, k = self.close(k + 1, self.n), k + 2
            while k < stop:
                k = max(self.import_(k), k + 1)
            return stop + 1
        if t == "type":
            if self.at(k + 1) != "(":
                return self.type_(k + 1, self.n)
            stop, k = self.close(k + 1, self.n), k + 2
            while k < stop:
                k = max(self.type_(k, stop), k + 1)
            return stop + 1
        if t == "func" and (self.is_word(k + 1) or self.at(k + 1) == "(" and self.is_word(self.close(k + 1, self.n) + 1)):
            return self.function(k)
        if t in ("(", "[", "{"):
            return self.mate[k] + 1 if self.closed(k, self.n) else k + 1
        return k + 1

    def import_(self, k: int) -> int:
        alias = []
        if self.is_word(k) or self.at(k) in (".", "_"):
            alias, k = [self.text[k]], k + 1
        if k < self.n and self.kind[k] == "string":
            self.row("import", self.text[k][1:-1], k, k, kind="static", dots=0, is_from=False, is_type_only=False, symbols=alias)
            return k + 1
        return k

    def type_(self, k: int, end: int) -> int:
        """A type specification; an alias is none."""
        a = k
        if not self.is_word(k):
            return k + 1
        alias = self.at(k + 1) == "="
        while k < end and (k == a or self.line[k] == self.t.last_line(k - 1) or self.at(k - 1) in ("|", ",", "~")) and self.at(k) != ";":
            k = self.mate[k] + 1 if self.at(k) in ("(", "[", "{") and self.closed(k, end) else k + 1
        if not alias:
            self.row("structure", self.text[a], a, k - 1, is_exported=self.exported(self.text[a]))
        return k

    @staticmethod
    def exported(name: str) -> bool:
        return "A" <= name[:1] <= "Z"

    def function(self, a: int) -> int:
        k, receiver = a + 1, None
        if self.at(k) == "(":
            stop = self.close(k, self.n)
            # the last type that the receiver names, so a type parameter where there is one
            receiver = next((self.text[x] for x in range(stop - 1, k, -1) if self.is_word(x)), None)
            k = stop + 1
        bare, k = self.text[k], k + 1
        while self.at(k) in ("[", "("):  # type parameters, parameters, several results
            k = self.close(k, self.n) + 1
        while k < self.n and self.line[k] == self.t.last_line(k - 1) and not (self.at(k) == "{" and self.at(k - 1) not in ("interface", "struct")):
            k = self.close(k, self.n) + 1 if self.at(k) in ("(", "[", "{") else k + 1
        opening, last, after, broken = k, k - 1, k, False
        if self.at(k) == "{" and self.line[k] == self.t.last_line(k - 1):
            broken = not self.closed(k, self.n)
            last = self.mate[k] if not broken else self.resumes(k + 1) - 1
            after = last + 1
        test = receiver is None and self.is_test and re.match(r"(Test|Benchmark|Fuzz|Example)[A-Z_]", bare) is not None
        self.row(
            "function", f"{receiver}.{bare}" if receiver else bare, a, last, kind="method" if receiver else "test" if test else "function", is_exported=self.exported(bare), is_async=False,
            parent=receiver, calls=self.calls(opening, last + 1, GO_WORDS, (".",), None),
            **({"is_recovered": True, "analysis_confidence": "low"} if broken else {}),
        )
        if test:
            self.row("test-case", bare, a, a)
        return after

    def resumes(self, k: int) -> int:
        """The next token that starts a declaration at the start of a line."""
        while k < self.n and not (self.leads(k) and self.at(k) in ("func", "type", "var", "const", "import")):
            k += 1
        return k


class CFamily(Native):
    def __init__(self, text: str, path: str, cpp: bool):
        super().__init__(text, "c", path)
        base = path.rpartition("/")[2].lower()
        test = in_test_dir(path) or re.search(r"(_test|_tests|\.test)\.(c|cc|cpp|cxx)$", base) or base.startswith("test_")
        self.header = not test and re.search(r"\.(h|hpp|hh|hxx)$", base) is not None
        self.cpp = cpp or base.endswith((".hpp", ".hh", ".hxx"))
        self.suites: set[str] = set()
        for k in range(self.n):  # anywhere, also under conditions and in bodies
            if self.kind[k] == "directive" and (m := re.match(r'\s*#\s*include\s*(?:"([^"]+)"|<([^>]+)>)', self.text[k])):
                self.row("import", m[1] or m[2], k, k, kind="static", dots=0, is_from=False, is_type_only=False, symbols=[])
        self.level(0, self.n, None)
        if main := next((x for x in self.rows if x["what"] == "function" and x["name"] == "main"), None):
            self.rows.append({"what": "startup", "name": "main", "start_line": main["start_line"], "analysis_confidence": main["analysis_confidence"]})

    def level(self, k: int, end: int, cls: str | None) -> None:
        """The declarations of a file, namespace or class."""
        while k < end:
            k = max(self.declaration(k, end, cls), k + 1)

    def past(self, k: int, end: int) -> int:
        """The token after the semicolon that ends a declaration."""
        while k < end and self.at(k) != ";":
            if self.at(k) in ("(", "[", "{"):
                if not self.closed(k, end):
                    return k + 1
                k = self.mate[k]
            elif self.at(k) == "}":
                return k
            k += 1
        return k + 1

    def declaration(self, k: int, end: int, cls: str | None) -> int:
        t = self.at(k)
        if t == "" or t in (";", "}", ")", "]"):
            return k + 1
        if t in ("public", "private", "protected", "signals", "slots") and self.at(k + 1) == ":":
            return k + 2
        if t == "template" and self.at(k + 1) == "<":
            return max(self.angles(k + 1, end), k + 2)
        opening = k
        while opening < end and (self.is_word(opening) or self.at(opening) in ("::", "[", "<") or self.kind[opening] == "string"):
            opening = self.close(opening, end) + 1 if self.at(opening) == "[" else max(self.angles(opening, end), opening + 1) if self.at(opening) == "<" else opening + 1
        if self.at(opening) == "{" and ("namespace" in self.text[k:opening] or t == "extern" and opening == k + 2):
            self.level(opening + 1, self.close(opening, end), cls)
            return self.close(opening, end) + 1
        if t in ("using", "friend", "static_assert", "namespace"):
            return self.past(k, end)
        if t in GTEST and self.at(k + 1) == "(" and self.closed(k + 1, end):
            names = [x.strip() for x in re.sub(r"[()]", "", self.t.source[self.t.start[k + 1] : self.t.end[self.mate[k + 1]]]).split(",")]
            if names[0] not in self.suites and names[0]:
                self.suites.add(names[0])
                self.row("test-suite", names[0], k, k)
            if names[1:] and names[1]:
                self.row("test-case", f"{names[0]}.{names[1]}", k, k)
            after = self.mate[k + 1] + 1
            return self.close(after, end) + 1 if self.at(after) == "{" else after
        return self.structure(k, end) or self.function(k, end, cls) or self.past(k, end)

    def structure(self, a: int, end: int) -> int:
        """A class, struct, union or enumeration with a body, also behind a typedef or before a variable; 0 if there is none."""
        k = a
        while self.at(k) in ("typedef", "static", "const", "extern", "volatile", "inline", "constexpr"):
            k += 1
        first, sort = k, self.at(k)
        if sort not in ("class", "struct", "union", "enum"):
            return 0
        k += 1 + (sort == "enum" and self.at(k + 1) in ("class", "struct"))
        name = None
        while k < end and self.at(k) not in ("{", ";", "=", ")", ",", "}"):
            if self.at(k) == ":":
                while k < end and self.at(k) not in ("{", ";"):  # bases, or the type of an enumeration
                    k = self.close(k, end) + 1 if self.at(k) == "(" else k + 1
                break
            if self.at(k) in ("(", "["):  # attributes
                k = self.close(k, end)
            elif self.at(k) == "<":
                k = max(self.angles(k, end), k + 1) - 1
            elif self.is_word(k) and self.text[k] not in ("final", "__attribute__", "alignas", "__declspec"):
                name = self.text[k]
            elif self.at(k) in ("*", "&"):
                return 0
            k += 1
        if self.at(k) != "{":
            return 0
        stop = self.close(k, end)
        if self.at(stop + 1) == ";" or stop == end:
            if name and first == a:
                self.row("structure", name, first, stop, is_exported=True)
                if sort != "enum":
                    self.level(k + 1, stop, name)
                return stop + 2
        after = self.past(stop + 1, end)
        if self.at(after - 1) != ";" and stop != end:
            return 0  # the type of a function's result
        if not name:
            name = next((self.text[x] for x in range(stop + 1, after) if self.is_word(x)), None)
        if name:
            self.row("structure", name, a, after - 1, is_exported=True)
        return after

    def declarator(self, a: int, end: int, cls: str | None) -> tuple[str, bool, int, int] | None:
        """(name, qualified, first token of the name, its parameters) of the function that a declaration at ``a`` declares."""
        k = a
        while k < end and self.at(k) not in (";", "{", "}", "="):
            if self.at(k) == "operator" and not (self.is_word(k + 1) and self.at(k + 2) in ("(", "*", "&")):
                opening = k + 1 if self.at(k + 1) != "(" else self.close(k + 1, end) + 1
                while opening < end and self.at(opening) != "(":
                    opening += 1
                if not self.closed(opening, end):
                    return None
                first = self.qualified(k, a)
                text = "".join(self.text[first:opening])
                parts = [x for x in text.split("::") if x][-2:]
                return ".".join(parts), first < k, first, opening
            if self.at(k) == "(":
                stop = self.close(k, end)
                after = self.at(stop + 1)
                fits = after in ("{", ";", ",", "->", ":", "=", "&", "&&") or after in AFTER_PARAMETERS or after == "" or after.isupper() and self.at(stop + 2) in ("{", ";", "(")
                if self.is_word(k - 1) and k - 1 >= a and self.text[k - 1] not in C_WORDS - CONTROL and fits and stop < end:
                    first = self.qualified(k - 1, a)
                    tilde = self.at(first - 1) == "~"
                    text = self.t.source[self.t.start[first] : self.t.end[k - 1]]
                    parts = [x for x in re.sub(r"\s+", "", text).split("::") if x][-2:]
                    name = ".".join(parts)
                    if tilde and len(parts) == 1:
                        name, first = f"destructor_{name}", first - 1
                    own_type = first > a and not all(self.text[x] in ("static", "inline", "virtual", "explicit", "extern", "constexpr", "friend") for x in range(a, first))
                    if own_type or cls or len(parts) > 1 or tilde or self.text[k - 1] == "main":
                        return name, len(parts) > 1, first, k
                    return None
                k = stop
            k += 1
        return None

    def qualified(self, k: int, low: int) -> int:
        """The first token of a qualified name that ends at ``k``."""
        k -= self.at(k - 1) == "~" and self.at(k - 2) == "::"
        while k - 1 >= low and self.at(k - 1) == "::":
            k -= 1
            if k - 1 >= low and self.at(k - 1) == ">":
                opening = self.before_angles(k - 1, low)
                k = opening - 1 if opening > low else k
            elif self.is_word(k - 1) and k - 1 >= low:
                k -= 1
        return max(k, low)

    def body(self, k: int, end: int) -> tuple[int, str]:
        """The brace that opens a body after parameters that close at ``k``, or the token that ends a declaration without one."""
        k += 1
        while k < end:
            t = self.at(k)
            if t in ("{", ";", "}", ",") or t == "=":
                return k, t
            if t == ":" and self.cpp:  # members that a constructor sets
                k += 1
                while k < end and self.at(k) not in (";", "}"):
                    if self.at(k) in ("(", "["):
                        k = self.close(k, end)
                    elif self.at(k) == "{":
                        if self.at(k - 1) in (")", "}") or not (self.is_word(k - 1) or self.at(k - 1) == ">"):
                            return k, "{"
                        k = self.close(k, end)
                    k += 1
                return k, self.at(k)
            k = self.close(k, end) + 1 if t in ("(", "[") else k + 1
        return end, ""

    def function(self, a: int, end: int, cls: str | None, recovering: bool = False) -> int:
        """A function with a body, or in a header a prototype; the token after it, 0 if there is none."""
        found = self.declarator(a, end, cls)
        if not found:
            return 0
        name, qualified, first, k = found
        bare = name.rpartition(".")[2]
        opening, t = self.body(self.close(k, end), end)
        parent = cls if cls and not qualified else name.split(".")[0] if qualified else None
        about = {
            "kind": "method" if parent else "function", "is_exported": "static" not in self.text[a:first], "is_async": False, "parent": parent,
        }
        whole = f"{cls}.{name}" if cls and not qualified else name
        typed = first > a
        if t == "=" and self.at(opening + 1) in ("default", "delete") and self.cpp:
            self.row("function", whole, a, opening + 2, calls=[], **about)
            return opening + 3
        if t != "{":
            if self.header and bare not in CONTROL and not recovering and t in (";", ",") and (not cls or not typed):
                self.row("declaration", whole, a, opening, calls=[], **about)
            return 0
        if bare in CONTROL or recovering and (not typed or self.text[a] in CONTROL):
            return 0 if recovering else self.close(opening, end) + 1
        if self.closed(opening, end):
            stop = self.mate[opening]
            calls = self.calls(opening, stop, C_WORDS, (".", "->", "::"), self.cpp)
            mark = {"is_recovered": True, "analysis_confidence": "low"} if recovering else {}
            self.row("function", whole, a, stop, calls=calls, **about, **mark)
            return stop + 1 + (self.at(stop + 1) == ";")
        return 0 if recovering else self.resumes(opening + 1, end)

    def resumes(self, k: int, end: int) -> int:
        """Behind a body that is never closed: the next sound function at the start of a line; those before it are recovered."""
        while k < end:
            if self.line[k] > self.line[k - 1] and self.kind[k] != "directive":
                if self.leads(k) and self.sound_function(k, end):
                    return k
                if not self.leads(k) and (after := self.function(k, end, None, True)):
                    k = after
                    continue
            k += 1
        return end

    def sound_function(self, k: int, end: int) -> bool:
        found = self.declarator(k, end, None)
        if not found or found[0] in CONTROL:
            return False
        opening, t = self.body(self.close(found[3], end), end)
        return t == "{" and self.closed(opening, end)


def native_facts(text: str, language: str, path: str) -> list[dict]:
    """Rows of a Go, C or C++ file in the order of their lines."""
    own = Go(text, path) if language == "go" else CFamily(text, path, language == "cpp")
    return sorted(own.rows, key=lambda x: x["start_line"])
