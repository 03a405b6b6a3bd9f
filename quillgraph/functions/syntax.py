"""Facts from the tokens of a file: declarations in their scopes, imports, exports, calls, references.

One walk over the tokens of a file; a stack of open declarations tells what a token stands in.
"""

from __future__ import annotations

from collections.abc import Iterator

from quillgraph.functions.lexer import Token, Tokens, family, tokens

#: Columns of a fact besides the file's id; those that a kind of fact does not have are null.
FIELDS = ["fact", "seq", "kind", "name", "qualified_name", "parent", "specifier", "local_name", "imported_name", "flag", "type_only", "start", "stop", "line", "line_end", "confidence"]

# Words that are no names, by language.
RESERVED = {
    "script": frozenset("async await break case catch class const continue debugger default delete do else enum export extends false finally for from function if implements import in instanceof interface let new null of private protected public return static super switch this throw true try type typeof undefined var void while with yield as".split()),
    "python": frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false".split()),
    "rust": frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()),
}
# How sure a reference is, by kind.
CONFIDENCE = {"type": 0.7, "write": 0.65, "read": 0.5}
_MODIFIERS = frozenset("export default abstract declare async const".split())
_MEMBER = frozenset("public private protected static async override readonly abstract get set declare accessor".split())
_ASSIGN = frozenset("= += -= *= /= %= **= ||= &&= ??= |= &= ^= :=".split())
_VALUE_OF = frozenset("= ( , [ ? return => || && ?? ...".split())
_GOES_ON = frozenset("| & = ? : => . , + - * / && || ?? ?. < extends keyof typeof in is".split())
# Reserved words of scripts that may still be names, and types that are no names.
CONTEXTUAL = frozenset("as async from of type".split())
PREDEFINED = frozenset("any bigint boolean never number object string symbol undefined unknown void".split())


class Walk:
    """The facts of one file."""

    def __init__(self, source: str, language: str):
        self.language, self.family = language, family(language)
        self.own: Tokens = tokens(source, language)
        self.t: list[Token] = self.own.all
        self.typed = language in ("typescript", "tsx")
        self.reserved = RESERVED[self.family]
        self.open: list[tuple[int, str | None, str, bool]] = []  # (last token, qualified name, kind, holds others); classes without a name have none
        self.declared: dict[int, str] = {}  # tokens that name what they declare, and how they count as references
        self.skipped: set[int] = set()  # words that refer to nothing
        self.typing = -1  # last token of the types that the walk is in

    # tokens

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind in "wp" else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "w" and (self.t[i].text not in self.reserved or (self.family == "script" and self.t[i].text in CONTEXTUAL))

    def string(self, i: int) -> str | None:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind == "s" else None

    def close(self, i: int) -> int:
        return self.own.match[i] if self.own.match[i] > i else i

    def ends(self, i: int) -> bool:
        """Whether a statement can end before token ``i``."""
        return i >= len(self.t) or self.text(i) in (";", "}", ")", "]") or (self.t[i].first and self.text(i) not in _GOES_ON and self.text(i - 1) not in _GOES_ON)

    def statement_end(self, i: int, stop: str = "") -> int:
        """The first token from ``i`` on that no longer belongs to the statement, or is ``stop``; brackets are jumped over."""
        while i < len(self.t):
            if self.text(i) == stop or self.ends(i):
                return i
            i = self.close(i) + 1 if self.text(i) in ("(", "[", "{") or self.t[i].kind == "t" else i + 1
        return len(self.t)

    def body(self, i: int) -> int:
        """The ``{`` of a body whose head goes on at ``i``; -1 where the head ends without one."""
        angles, start = 0, i
        while i < len(self.t):
            text = self.text(i)
            if self.family == "script" and i > start and angles <= 0 and self.t[i].first and text not in ("{", "implements", *_GOES_ON) and self.text(i - 1) not in ("implements", *_GOES_ON):
                return -1
            if text == "{":
                before = self.text(i - 1)
                if angles <= 0 and before not in (":", "|", "&", "<", ",", "=") and not (self.family == "go" and before in ("interface", "struct")):
                    return i
                i = self.close(i)
            elif text in ("(", "["):
                i = self.close(i)
            elif text in (";", "}") or (text == "=" and angles <= 0):
                return -1
            elif text == "<":
                angles += 1
            elif text == ">":
                angles -= 1
            i += 1
        return -1

    # facts

    def innermost(self, i: int) -> tuple[int, str | None, str, bool] | None:
        while self.open and self.open[-1][0] < i:
            self.open.pop()
        return self.open[-1] if self.open else None

    def inside(self, i: int, holders: bool = True) -> tuple[int, str, str, bool] | None:
        """The innermost named declaration around token ``i``: of those that hold others, or of all."""
        self.innermost(i)
        return next((o for o in reversed(self.open) if o[1] and (o[3] or not holders)), None)

    def fact(self, fact: str, at: int, last: int | None = None, **more) -> dict:
        last = at if last is None else min(last, len(self.t) - 1)
        a, b = self.t[at], self.t[last]
        end = self.own.lines if self.own.cut and last + 1 == len(self.t) else b.line + (b.text.count("\n") if b.kind in "st" else 0)
        return {"fact": fact, "seq": at, "start": a.start, "stop": b.end, "line": a.line, "line_end": end, **more}

    def symbol(self, kind: str, name_at: int, first: int, last: int, exported: bool, holds: bool, name: str | None = None) -> dict:
        name = name or self.t[name_at].text.lstrip("#")
        around = self.inside(first)
        qualified = f"{around[1]}.{name}" if around else name
        self.declared[name_at] = "type" if kind in ("interface", "type") or (kind in ("class", "enum") and self.typed) else "write"
        self.open.append((last, qualified, kind, holds))
        return self.fact("symbol", first, last, kind=kind, name=name, qualified_name=qualified, parent=around[1].rpartition(".")[2] if around else None, flag=exported)

    def binding(self, at: int, specifier: str, local: str | None, imported: str, again: bool = False, types: bool = False) -> dict:
        return self.fact("binding", at, specifier=specifier, local_name=local, imported_name=imported, flag=again, type_only=types)

    def facts(self, wanted: frozenset[str]) -> Iterator[dict]:
        calls, references = "call" in wanted, "reference" in wanted
        walk = {"script": self.script, "python": self.python, "go": self.go, "rust": self.rust}[self.family]
        for i in range(len(self.t)):
            if self.t[i].kind == "w":
                yield from walk(i, self.t[i].text)
            elif calls and self.text(i) == "(":
                yield from self.call(i)
            if references and self.t[i].kind == "w":
                yield from self.reference(i)
        yield {"fact": "status", "seq": len(self.own.errors), "name": "; ".join(self.own.errors[:5])}

    def call(self, i: int) -> Iterator[dict]:
        """A call whose arguments open at ``i``: the callee is the chain of names before."""
        at = i - 1
        if self.text(at) == "?.":
            at -= 1
        if self.family == "rust" and self.text(at) == "!":
            at -= 1
        elif self.text(at) == ">" and self.family == "script":  # type arguments
            depth, k = 1, at - 1
            while k >= 0 and depth and k > at - 64 and (self.t[k].kind == "w" or self.text(k) in (",", ".", "<", ">", "[", "]", "|")):
                depth += {">": 1, "<": -1}.get(self.text(k), 0)
                k -= 1
            if depth or not self.is_name(k):
                return
            at = k
        if at < 0 or i <= self.typing or self.t[at].kind != "w" or at in self.declared or self.text(at - 1) in ("function", "def", "func", "fn"):
            return
        if self.text(at) in self.reserved and not (self.family == "script" and self.text(at) in (*CONTEXTUAL, "super", "import")):
            return
        first, called = at, False
        while self.text(first - 1) in (".", "?.", "::"):
            k = first - 2
            while k >= 0 and self.text(k) in (")", "]") and self.own.match[k] >= 0:
                called, k = called or self.text(k) == ")", self.own.match[k]
                if self.t[k - 1].kind != "w" and self.text(k - 1) not in (")", "]") or self.text(k - 1) in self.reserved:
                    break  # a value in brackets
                k -= 1
            if k < 0 or (self.t[k].kind not in "wstrn" and self.text(k) not in ("(", "[")):
                break
            first = k
        callee = "".join(t.text for t in self.t[first : at + 1])
        new = self.family == "script" and self.text(first - 1) == "new" and not called
        kind = "constructor" if new else "macro" if self.text(i - 1) == "!" and self.family == "rust" else "method" if "." in callee or self.text(first - 1) in (".", "?.") else "direct"
        around = self.inside(first, holders=False)
        yield self.fact("call", first, self.close(i), kind=kind, name=self.t[at].text, specifier=callee, parent=around[1] if around else None)

    def reference(self, i: int) -> Iterator[dict]:
        """A name that is neither reserved nor the key of an object literal."""
        name = self.t[i].text.lstrip("#")
        if name in self.reserved or not name or i in self.skipped:
            return
        kind = "read"
        if self.family == "script":
            before, after = self.text(i - 1), self.text(i + 1)
            key = after in (":", "?") and before in ("{", ",", ";") and self.text(k := self.own.inside[i]) == "{" and self.text(k - 1) in (*_VALUE_OF, ":")
            if key and self.text(k - 1) == ":" and self.annotates(k - 1):
                kind = "type"
            elif key and after == ":":
                return
            elif i in self.declared:
                kind = self.declared[i]
            elif name in PREDEFINED and (i <= self.typing or before in (":", "|", "<", "&", "as")):
                return
            elif i <= self.typing or before in ("extends", "implements", "as", "satisfies", "keyof") or (before == ":" and self.annotates(i - 1)):
                kind = "type"
            elif (after in _ASSIGN and before not in (".", "?.")) or after in ("++", "--") or before in ("++", "--"):
                kind = "write"
        around = self.inside(i, holders=False)
        yield self.fact("reference", i, kind=kind, name=name, parent=around[1] if around else None, confidence=CONFIDENCE[kind])

    def annotates(self, i: int) -> bool:
        """Whether the colon at ``i`` comes before a type: after a parameter, a declared name or a list of parameters."""
        before = self.text(i - 2 if self.text(i - 1) in ("?", "!") else i - 1)
        if before == ")":
            return True
        around = self.own.inside[i]
        return i - 1 in self.declared or (self.typed and around >= 0 and self.text(around) == "(" and self.text(i - 2) in ("(", ",", "...", "public", "private", "protected", "readonly"))

    # scripts

    def script(self, i: int, word: str) -> Iterator[dict]:
        before, after = self.text(i - 1), self.text(i + 1)
        if i in self.skipped or before in (".", "?.") or i <= self.typing:
            return
        inside = self.own.inside[i]
        holder = self.innermost(i)
        if holder and holder[2] == "class" and inside >= 0 and self.own.match[inside] == holder[0]:
            yield from self.member(i)
            return
        if word == "import":
            yield from self.imported(i)
        elif word == "export":
            yield from self.exported(i)
        elif word == "require" and after == "(":
            yield self.required(i)
        elif word in ("module", "exports"):
            yield from self.commonjs(i)
        elif word in ("class", "function", "interface", "type", "enum", "const", "let", "var", "namespace"):
            if after == ":" or before in ("{", ",") and after in (",", "}"):
                return
            yield from self.declaration(i, word)
        elif after == "(" and word not in self.reserved and i not in self.declared:
            end = self.close(i + 1)
            if self.text(end + 1) == "{" and not self.t[end + 1].first:  # a method of an object literal
                yield self.symbol("method", i, i, self.close(end + 1), False, True)

    def declaration(self, i: int, word: str) -> Iterator[dict]:
        first = i
        while self.text(first - 1) in _MODIFIERS:
            first -= 1
        before, exported = self.text(first - 1), self.text(first) == "export"
        value = before in _VALUE_OF or before in (":", "new", "await", "yield", "throw", "typeof") or (before == "(" and word != "var")
        if word in ("const", "let", "var"):
            if word != "const" or self.text(i + 1) != "enum":
                yield from self.variables(i + 1, word, exported, before == "(")
            return
        if word == "function":
            name = i + 2 if self.text(i + 1) == "*" else i + 1
            if value or not (self.is_name(name) and self.text(name + 1) in ("(", "<")):
                return
            if (brace := self.body(name + 1)) >= 0:
                yield self.symbol("function", name, first, self.close(brace), exported, True)
        elif word == "class":
            if value or not self.is_name(i + 1):  # its members are declared all the same
                if (brace := self.body(i + 1)) >= 0:
                    self.open.append((self.close(brace), None, "class", False))
            elif (brace := self.body(i + 2)) >= 0:
                yield self.symbol("class", i + 1, first, self.close(brace), exported, True)
        elif word in ("interface", "enum"):
            if self.is_name(i + 1) and not value and (brace := self.body(i + 2)) >= 0:
                yield self.symbol(word, i + 1, first, self.close(brace), exported, False)
                if word == "interface":
                    self.typing = self.close(brace)
        elif word == "type" and self.is_name(i + 1) and not value and not self.t[i + 1].first and self.text(i + 2) in ("=", "<"):
            end = self.statement_end(i + 2) - 1
            yield self.symbol("type", i + 1, first, end, exported, False)
            self.typing = end

    def variables(self, i: int, word: str, exported: bool, in_head: bool) -> Iterator[dict]:
        """The declarators from ``i`` on; their values are walked later."""
        kind = "constant" if word == "const" else "variable"
        while i < len(self.t):
            if in_head and self.text(i + 1) in ("of", "in"):
                self.declared[i] = "write"
                return
            end = self.statement_end(i + 1 if self.is_name(i) else i, ",")
            if self.is_name(i):
                self.pending.append((kind, i, end - 1, exported))
            if self.text(end) != ",":
                break
            i = end + 1
        return
        yield

    def member(self, i: int) -> Iterator[dict]:
        """A member of a class that begins with word ``i``, if it names one."""
        first = i
        while self.text(first - 1) in _MEMBER or self.text(first - 1) in ("*",):
            first -= 1
        before, word, after = self.text(first - 1), self.t[i].text, self.text(i + 1)
        if before not in ("{", ";", "}", ")") and not self.t[first].first or self.text(first - 1) in ("@", *_GOES_ON):
            yield from self.value(i)
            return
        if word in _MEMBER and after not in ("(", "=", ";", ":", "?", "!", "}", "<") and not (i + 1 < len(self.t) and self.t[i + 1].first):
            return  # a modifier
        at = i + 2 if after in ("?", "!") else i + 1
        if self.text(at) in ("(", "<"):
            if (brace := self.body(at)) >= 0:
                yield self.symbol("method", i, first, self.close(brace), False, True)
            else:
                self.declared[i] = "write"
        elif word not in ("class", "function"):
            yield self.symbol("field", i, first, self.statement_end(at) - 1, False, False)

    def value(self, i: int) -> Iterator[dict]:
        if self.t[i].text == "require" and self.text(i + 1) == "(":
            yield self.required(i)

    def required(self, i: int) -> dict:
        specifier = self.string(i + 2) if self.text(i + 3) == ")" else None
        local = self.t[i - 2].text if self.text(i - 1) == "=" and self.is_name(i - 2) else None
        return self.fact("import", i, self.close(i + 1), kind="conditional_require" if self.conditional(i) else "require", specifier=specifier or "<dynamic-expression>", local_name=local, flag=False)

    def conditional(self, i: int) -> bool:
        """Whether token ``i`` stands in a branch."""
        if self.text(i - 1) in ("?", ":") or (self.text(i - 1) == ")" and self.own.match[i - 1] > 0 and self.text(self.own.match[i - 1] - 1) == "if"):
            return True
        at = self.own.inside[i]
        while at >= 0:
            if self.text(at) == "{" and (self.text(at - 1) == "else" or (self.text(at - 1) == ")" and self.text(self.own.match[at - 1] - 1) in ("if", "switch"))):
                return True
            at = self.own.inside[at]
        return False

    def imported(self, i: int) -> Iterator[dict]:
        after = self.text(i + 1)
        if after == "(":
            specifier = self.string(i + 2) if self.text(i + 3) == ")" else None
            local = None
            k = i - 2 if self.text(i - 1) == "await" else i - 1
            if self.text(k) == "=" and self.is_name(k - 1):
                local = self.t[k - 1].text
            yield self.fact("import", i, self.close(i + 1), kind="dynamic", specifier=specifier or "<dynamic-expression>", local_name=local, flag=False)
        elif (side := self.string(i + 1)) is not None:
            yield self.fact("import", i, i + 1, kind="side_effect", specifier=side, flag=False)
        elif after and after != ".":
            k = i + 1
            while k < len(self.t) and self.t[k].kind in "wp" and self.text(k) not in (";", "=", "(", "import", "from") or (self.text(k) == "from" and self.text(k + 1) in (",", "from")):
                k += 1
            if self.text(k) == "from" and (specifier := self.string(k + 1)) is not None:
                types = after == "type" and self.text(i + 2) not in (",", "from")
                yield self.fact("import", i, k + 1, kind="esm", specifier=specifier, flag=False, type_only=types)
                yield from self.clause(i + (2 if types else 1), k, i, specifier, False, types)

    def clause(self, a: int, b: int, at: int, specifier: str, again: bool, types: bool) -> Iterator[dict]:
        """Names between tokens ``a`` and ``b``: a default, a namespace, a list in braces."""
        while a < b:
            text = self.text(a)
            if text == "*":
                local = self.t[a + 2].text if self.text(a + 1) == "as" else None
                self.declared[a + 2] = "read"
                yield self.binding(at, specifier, local, "*", again, types)
                a += 3 if local else 1
            elif text == "{":
                end = min(self.close(a), b)
                for kind, name, local in self.listed(a + 1, end):
                    yield self.binding(at, specifier, local, name, again, types or kind)
                a = end + 1
            else:
                if self.t[a].kind == "w":
                    yield self.binding(at, specifier, text, "default", again, types)
                a += 1

    def listed(self, a: int, b: int) -> Iterator[tuple[bool, str, str]]:
        """(only a type, name, name after ``as``) of a list in braces."""
        while a < b:
            end = a
            while end < b and self.text(end) != ",":
                end += 1
            part = [t.text for t in self.t[a:end]]
            self.declared |= {k: "read" for k in range(a, end)}
            types = len(part) > 1 and part[0] == "type" and part[1:2] != ["as"] or (len(part) == 4 and part[0] == "type")
            self.declared[a + types] = "write"
            part = part[1:] if types else part
            if part:
                yield types, part[0], part[2] if len(part) > 2 and part[1] == "as" else part[0]
            a = end + 1

    def exported(self, i: int) -> Iterator[dict]:
        k = i + 1
        types = self.text(k) == "type" and self.text(k + 1) in ("{", "*")
        k += types
        word = self.text(k)
        if word in ("*", "{"):
            end = self.close(k) if word == "{" else k + (2 if self.text(k + 1) == "as" else 0)
            specifier = self.string(end + 2) if self.text(end + 1) == "from" else None
            if specifier is not None:
                yield self.fact("import", i, end + 2, kind="reexport", specifier=specifier, flag=True, type_only=types)
                yield from self.clause(k, end + 1, i, specifier, True, types)
            if word == "*":
                name = self.t[end].text if end > k else "*"
                yield self.fact("export", i, end, kind="all", name=name, local_name=None if name == "*" else name, specifier=specifier, type_only=types)
            else:
                for only, local, name in self.listed(k + 1, end):
                    yield self.fact("export", i, end, kind="list", name=name, local_name=local, specifier=specifier, type_only=types or only)
        elif word == "default":
            k += 1
            while self.text(k) in ("async", "abstract"):
                k += 1
            if self.text(k) in ("function", "class", "interface"):
                k += 2 if self.text(k + 1) == "*" else 1
                local = self.t[k].text if self.is_name(k) else None
            else:
                local = self.t[k].text if self.is_name(k) and self.ends(k + 1) else None
            yield self.fact("export", i, k, kind="default", name="default", local_name=local)
        elif word == "=":
            yield self.fact("export", i, k, kind="commonjs_default", name="default", local_name=self.t[k + 1].text if self.is_name(k + 1) else None)
        else:
            while self.text(k) in ("declare", "async", "abstract") or (self.text(k) == "const" and self.text(k + 1) == "enum"):
                k += 1
            word = self.text(k)
            if word in ("const", "let", "var"):
                k += 1
                while k < len(self.t):
                    end = self.statement_end(k + 1 if self.is_name(k) else k, ",")
                    if self.is_name(k):
                        yield self.fact("export", i, k, kind="named", name=self.t[k].text, local_name=self.t[k].text, type_only=False)
                    if self.text(end) != ",":
                        break
                    k = end + 1
            elif word in ("function", "class", "interface", "type", "enum", "namespace"):
                k += 2 if self.text(k + 1) == "*" else 1
                if self.is_name(k):
                    yield self.fact("export", i, k, kind="named", name=self.t[k].text, local_name=self.t[k].text, type_only=word in ("interface", "type"))

    def commonjs(self, i: int) -> Iterator[dict]:
        k = i
        if self.text(i) == "module":
            if self.text(i + 1) != "." or self.text(i + 2) != "exports":
                return
            k = i + 2
            self.skipped.add(k)
            if self.text(k + 1) == "=":
                local = self.t[k + 2].text if self.is_name(k + 2) and self.ends(k + 3) else None
                yield self.fact("export", i, k, kind="commonjs_default", name="default", local_name=local)
        if self.text(k + 1) == "." and self.text(k + 3) == "=" and self.t[k + 2].kind == "w":
            yield self.fact("export", i, k + 2, kind="commonjs", name=self.t[k + 2].text, local_name=self.t[k + 2].text)

    # other languages

    def python(self, i: int, word: str) -> Iterator[dict]:
        if word in ("class", "def") and self.is_name(i + 1):
            first = i - 1 if self.text(i - 1) == "async" else i
            if not self.t[first].first and self.text(first - 1) not in (":", ";"):
                return
            around = self.inside(i)
            kind = "class" if word == "class" else "method" if around and around[2] == "class" else "function"
            yield self.symbol(kind, i + 1, first, self.indented(first), not self.t[i + 1].text.startswith("_"), True)
        elif word == "import" and (self.t[i].first or self.text(i - 1) in (":", ";")):
            end = i + 1
            while end < len(self.t) and not self.t[end].first and self.text(end) != ";":
                end += 1
            for part in self.dotted(i + 1, end):
                yield self.fact("import", i, end - 1, kind="import", specifier=part[0], local_name=part[1], flag=False)
                yield self.binding(i, part[0], part[1] or part[0].split(".")[0], "*")
        elif word == "from" and (self.t[i].first or self.text(i - 1) in (":", ";")):
            k = i + 1
            while k < len(self.t) and self.text(k) != "import" and not self.t[k].first:
                k += 1
            if self.text(k) == "import":
                module = "".join(t.text for t in self.t[i + 1 : k])
                a = k + 2 if self.text(k + 1) == "(" else k + 1
                end = self.close(k + 1) if a == k + 2 else a
                while a == k + 1 and end < len(self.t) and not self.t[end].first and self.text(end) != ";":
                    end += 1
                yield self.fact("import", i, end - 1, kind="from", specifier=module, flag=False)
                for name, alias in self.dotted(a, end):
                    yield self.binding(i, module, alias or name, name)

    def dotted(self, a: int, b: int) -> list[tuple[str, str | None]]:
        """(dotted name, alias) of a list; nothing of a list that is none."""
        out = []
        while a < b:
            end = a
            while end < b and self.text(end) != ",":
                end += 1
            part = [t.text for t in self.t[a:end]]
            alias = part[-1] if len(part) > 2 and part[-2] == "as" else None
            part = part[:-2] if alias else part
            if part and any(self.t[k].kind != "w" and self.text(k) != "." and part != ["*"] for k in range(a, a + len(part))):
                return []
            if part:
                out.append(("".join(part), alias))
            a = end + 1
        return out

    def indented(self, first: int) -> int:
        """The last token of what is indented further than the line of token ``first``."""
        return self.blocks[first]

    def columns(self, source: str) -> None:
        """For the first token of each line, the last one of its block, by one stack of open indentations."""
        self.blocks: dict[int, int] = {}
        held: list[tuple[int, int]] = []
        for i, t in enumerate(self.t):
            if t.first and self.own.inside[i] < 0:
                column = t.start - source.rfind("\n", 0, t.start) - 1
                while held and held[-1][0] >= column:
                    self.blocks[held.pop()[1]] = i - 1
                held.append((column, i))
            elif not t.first and t.text in ("class", "def", "async"):
                self.blocks.setdefault(i, i)
        for _, i in held:
            self.blocks[i] = len(self.t) - 1

    def go(self, i: int, word: str) -> Iterator[dict]:
        if self.own.inside[i] >= 0 and not (word == "func" and self.text(i + 1) != "("):
            if self.text(k := self.own.inside[i]) != "(" or self.text(k - 1) != "type" or not self.t[i].first:
                return
            yield from self.go_type(i, i)
        elif word == "func":
            at, holder = i + 1, None
            if self.text(at) == "(":
                end = self.close(at)
                holder = next((t.text for t in self.t[at + 1 : end][::-1] if t.kind == "w"), None)
                at = end + 1
            if not self.is_name(at):
                return
            brace = self.body(at + 1)
            name = self.t[at].text
            yield self.symbol("method" if holder else "function", at, i, self.close(brace) if brace >= 0 else at, name[:1].isupper(), True, f"{holder}.{name}" if holder else None) | {"name": name, "parent": holder}
        elif word == "type" and self.is_name(i + 1):
            yield from self.go_type(i + 1, i)
        elif word == "import":
            ends = self.close(i + 1) if self.text(i + 1) == "(" else i + 2 + (self.string(i + 1) is None)
            for k in range(i + 1, min(ends + 1, len(self.t))):
                if (specifier := self.string(k)) is not None:
                    alias = self.t[k - 1].text if self.t[k - 1].kind == "w" and self.text(k - 1) != "import" else "." if self.text(k - 1) == "." else None
                    yield self.fact("import", k, k, kind="import", specifier=specifier, local_name=alias, flag=False)
                    yield self.binding(k, specifier, alias or specifier.rsplit("/", 1)[-1], "*")

    def go_type(self, at: int, first: int) -> Iterator[dict]:
        word = self.text(at + 1)
        kind = word if word in ("struct", "interface") else "type"
        end = self.close(at + 2) if self.text(at + 2) == "{" else at + 1
        yield self.symbol(kind, at, first, end, self.t[at].text[:1].isupper(), False)

    def rust(self, i: int, word: str) -> Iterator[dict]:
        if word in ("fn", "struct", "enum", "trait", "mod", "type") and self.is_name(i + 1):
            first = i
            while self.text(first - 1) in ("pub", "async", "unsafe", "const", "extern") or (self.text(first - 1) == ")" and self.text(self.own.match[first - 1] - 1) == "pub"):
                first = self.own.match[first - 1] if self.text(first - 1) == ")" else first - 1
            brace = self.body(i + 2)
            end = self.close(brace) if brace >= 0 else self.statement_end(i + 1, ";")
            kind = {"fn": "function", "mod": "module"}.get(word, word)
            around = self.inside(first)
            if kind == "function" and around and around[2] in ("impl", "trait"):
                kind = "method"
            yield self.symbol(kind, i + 1, first, end, self.text(first) == "pub", word in ("fn", "trait", "mod"))
        elif word == "impl" and (brace := self.body(i + 1)) >= 0:
            k = i + 1
            for j in range(i + 1, brace):
                k = j + 1 if self.text(j) == "for" else k
            angles = 0
            while k < brace and (angles or not self.is_name(k)):  # past generic parameters
                angles += {"<": 1, ">": -1}.get(self.text(k), 0)
                k += 1
            if k < brace:
                while self.text(k + 1) == "::":
                    k += 2
                self.open.append((self.close(brace), self.t[k].text, "impl", True))
        elif word == "use" and self.text(i - 1) not in (".", "::"):
            end = self.statement_end(i + 1, ";")
            yield from self.uses(i, i + 1, min(end, len(self.t)), "")

    def uses(self, at: int, a: int, b: int, before: str) -> Iterator[dict]:
        """Paths of a use tree, groups taken apart."""
        while a < b:
            path, alias = before, None
            while a < b and self.text(a) != ",":
                if self.text(a) == "{":
                    yield from self.uses(at, a + 1, self.close(a), path)
                    path, a = "", self.close(a) + 1
                elif self.text(a) == "as":
                    alias, a = self.t[a + 1].text, a + 2
                else:
                    path, a = path + self.t[a].text, a + 1
            if path.endswith("::self"):
                path = path[:-6]
            if path and path != before:
                yield self.fact("import", at, b - 1, kind="use", specifier=path, local_name=alias, flag=self.text(at - 1) == "pub")
                yield self.binding(at, path, alias or path.rsplit("::", 1)[-1], path.rsplit("::", 1)[-1], self.text(at - 1) == "pub")
            a += 1


class ScriptWalk(Walk):
    """Variables open when the walk comes to their names, so that scopes nest."""

    def __init__(self, source: str, language: str):
        super().__init__(source, language)
        self.pending: list[tuple[str, int, int, bool]] = []

    def script(self, i: int, word: str) -> Iterator[dict]:
        while self.pending and self.pending[0][1] < i:
            self.pending.pop(0)
        own = next((p for p in self.pending if p[1] == i), None)
        if own:
            kind, at, last, exported = own
            yield self.symbol(kind, at, at, last, exported, False)
            return
        yield from super().script(i, word)


def facts(source: str, language: str, wanted: frozenset[str]) -> list[dict]:
    """The wanted facts of a text in a known language, by place."""
    walk = (ScriptWalk if family(language) == "script" else Walk)(source, language)
    if walk.family == "python":
        walk.columns(source)
    return [f for f in walk.facts(wanted) if f["fact"] in wanted]
