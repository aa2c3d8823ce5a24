"""Symbols, imports, exports, endpoints and calls of one file, in the order in which they stand."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from .lexer import Source, Token

#: Methods of endpoints and calls, receivers of endpoints, built-in hooks.
VERBS = ("get", "post", "put", "delete", "patch")
RECEIVER = re.compile(r"router|app|route", re.I)
BODY_VERBS = ("post", "put", "patch")
REACT_HOOKS = frozenset("useState useEffect useContext useReducer useCallback useMemo useRef useImperativeHandle useLayoutEffect useDebugValue useDeferredValue useTransition useId useSyncExternalStore useInsertionEffect".split())
_MODIFIERS = frozenset("public private protected static async readonly abstract override declare accessor".split())
_STATEMENT_BEFORE = frozenset(("export", "default", "async", "declare", "abstract", "else", "do"))


@dataclass
class Symbol:
    id: str
    name: str
    type: str
    line: int
    column: int
    end_line: int
    parameters: list[dict] | None = None
    return_type: str | None = None
    calls: list[str] = field(default_factory=list)


@dataclass
class Function:
    """Where the parts of a function stand: parameters, type of what it returns, body."""

    params: tuple[int, int]
    returns: str | None
    body: tuple[int, int]
    end: int


class Unit:
    """What one file holds. Raises Broken for text that can't be parsed."""

    def __init__(self, path: str, text: str) -> None:
        self.path, self.s = path, Source(text, jsx=not path.endswith(".ts"))
        self.t, self.pair = self.s.tokens, self.s.pair
        self.symbols: list[Symbol] = []
        self.imports: list[dict] = []
        self.exports: list[dict] = []
        self.endpoints: list[dict] = []
        self.variables: list[dict] = []
        self.modules: list[dict] = []
        self.functions: dict[str, Function] = {}
        self.hooks: dict[str, tuple[int, int]] = {}
        for i in range(len(self.t)):
            self._visit(i)
        self.calls = self._api_calls()

    # -- helpers over tokens ------------------------------------------------------------------------------------------
    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name"

    def between(self, a: int, b: int) -> str:
        """Source text of the tokens a to b - 1."""
        return self.s.text[self.t[a].start : self.t[b - 1].end] if b > a else ""

    def string(self, i: int) -> str | None:
        t = self.t[i] if 0 <= i < len(self.t) else None
        if t and t.kind == "string":
            return re.sub(r"\\(.)", r"\1", t.text[1:-1])
        return t.text[1:-1] if t and t.kind == "template" and "${" not in t.text else None

    def parts(self, a: int, b: int, angles: bool = False) -> list[tuple[int, int]]:
        """Ranges of the tokens a to b - 1 between commas outside of brackets (and of angles, in types)."""
        out, start, i, depth = [], a, a, 0
        while i < b:
            x = self.text(i) if self.t[i].kind == "punct" else ""
            if self.t[i].kind in ("template", "jsx"):
                i = self._over(i)
                continue
            if x in ("(", "[", "{"):
                i = self.pair[i]
            elif angles and x in ("<", ">"):
                depth += 1 if x == "<" else -1
            elif x == "," and depth <= 0:
                out.append((start, i))
                start = i + 1
            i += 1
        if start < b:
            out.append((start, b))
        return out

    def _over(self, i: int) -> int:
        """The first token after a template or element that starts at i."""
        end, i = self.t[i].end, i + 1
        while i < len(self.t) and self.t[i].start < end:
            i += 1
        return i

    def find(self, a: int, b: int, what: str, stop: tuple[str, ...] = ()) -> int:
        """The first such mark among the tokens a to b - 1 outside of brackets, or -1."""
        i = a
        while i < b:
            if self.t[i].kind == "punct":
                if self.t[i].text == what:
                    return i
                if self.t[i].text in stop:
                    return -1
                if self.t[i].text in ("(", "[", "{"):
                    i = self.pair[i]
            elif self.t[i].kind in ("template", "jsx"):
                i = self._over(i) - 1
            i += 1
        return -1

    def _angles(self, i: int) -> int:
        """The token after type parameters that start at i, or i."""
        if self.text(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.t):
            depth += (self.text(j) == "<") - (self.text(j) == ">")
            if self.text(j) in ("(", "[", "{"):
                j = self.pair[j]
            j += 1
            if not depth:
                return j
        return i

    # -- functions ----------------------------------------------------------------------------------------------------
    def params(self, f: Function) -> list[dict]:
        out = []
        for a, b in self.parts(*f.params, angles=True):
            while self.name(a) and self.text(a) in _MODIFIERS and a + 1 < b and self.name(a + 1):
                a += 1
            a += self.text(a) == "..."
            default, colon = self.find(a, b, "="), self.find(a, b, ":", ("=",))
            optional = self.find(a, b, "?", ("=", ":"))
            ends = [x for x in (default, colon, optional) if x >= 0]
            kind = self.between(colon + 1, default if default > colon else b) if colon >= 0 else "any"
            out.append({"name": self.between(a, min(ends, default=b)), "type": kind, "required": default < 0 and optional < 0, "source": "query"})
        return out

    def function_at(self, i: int) -> Function | None:
        """The function expression or arrow function that starts at token i."""
        if self.text(i) == "async" and self.s.place(self.t[i].start)[0] == self.s.line(min(i + 1, len(self.t) - 1)):
            i += 1
        if self.text(i) == "function" and self.name(i):
            return self._declared(i + 1)
        if self.name(i) and self.text(i + 1) == "=>":
            return self._arrow((i, i + 1), None, i + 1)
        j = self._angles(i)
        if self.text(j) != "(" or self.t[j].kind != "punct":
            return None
        close, returns = self.pair[j], None
        k = close + 1
        if self.text(k) == ":":
            k = self.find(k + 1, min(len(self.t), k + 60), "=>", (";", "=", ","))
            if k < 0:
                return None
            returns = self.between(close + 2, k)
        return self._arrow((j + 1, close), returns, k) if self.text(k) == "=>" else None

    def _arrow(self, params: tuple[int, int], returns: str | None, arrow: int) -> Function:
        a = arrow + 1
        if self.text(a) == "{" and a in self.pair:
            return Function(params, returns, (a, self.pair[a] + 1), self.pair[a] + 1)
        end = self._expression_end(a)
        return Function(params, returns, (a, end), end)

    def _expression_end(self, i: int) -> int:
        while i < len(self.t):
            t = self.t[i]
            if t.kind == "punct" and (t.text in (",", ";", ")", "]", "}")):
                return i
            if t.kind in ("template", "jsx"):
                i = self._over(i)
                continue
            if t.kind == "punct" and t.text in ("(", "[", "{"):
                i = self.pair[i]
            i += 1
            if i < len(self.t) and self.s.line(i) > self.s.last_line(i - 1) and self.t[i].kind in ("name", "jsx") and self.t[i - 1].text not in (".", "=", "=>", "+", "&&", "||", "?", ":", "??", "(", ",") and self.text(i) not in ("as", "in", "of", "instanceof"):
                return i
        return i

    def _declared(self, i: int) -> Function | None:
        """What follows the word ``function``: a star, a name, type parameters, parameters, a type, a body."""
        i += self.text(i) == "*"
        i += self.name(i)
        return self._signature(self._angles(i))

    def _signature(self, i: int) -> Function | None:
        if self.text(i) != "(" or i not in self.pair:
            return None
        close = self.pair[i]
        j, returns = close + 1, None
        if self.text(j) == ":":
            k = j + 1
            if self.text(k) == "{" and self.text(self.pair[k] + 1) in ("{", "|", "[", "&"):
                k = self.pair[k] + 1
            k = self.find(k, len(self.t), "{", (";",)) if self.text(k) != "{" or k == j + 1 else k
            if k < 0:
                return None
            returns, j = self.between(j + 1, k), k
        if self.text(j) != "{" or j not in self.pair:
            return None
        return Function((i + 1, close), returns, (j, self.pair[j] + 1), self.pair[j] + 1)

    def _starts_statement(self, i: int) -> bool:
        if i == 0:
            return True
        t = self.t[i - 1]
        return (t.kind == "punct" and t.text in (";", "{", "}", ")")) or (t.kind == "name" and t.text in _STATEMENT_BEFORE) or (self.s.line(i) > self.s.last_line(i - 1) and not (t.kind == "punct" and t.text in ("=", "(", ",", "=>", ":", "?", "[", "&&", "||", "+")) and not (t.kind == "name" and t.text == "return"))

    def _outer(self, i: int) -> tuple[int, bool, bool]:
        """Of a declaration whose word is at i: where it starts with its modifiers, and if it's exported, by default."""
        exported = default = False
        while i > 0 and self.name(i - 1) and self.text(i - 1) in ("export", "default", "async", "declare", "abstract"):
            i -= 1
            exported |= self.text(i) == "export"
            default |= self.text(i) == "default"
        return i, exported, default

    def _has_jsx(self, a: int, b: int) -> bool:
        return any(t.kind == "jsx" for t in self.t[a:b])

    def _symbol(self, name: str, own: str, kind: str, first: int, end: int, f: Function | None) -> None:
        line, column = self.s.place(self.t[first].start)
        self.symbols.append(Symbol(f"{self.path}#{own}@{line}", name, kind, line, column, self.s.last_line(end - 1), self.params(f) if f else None, f.returns if f else None, self._called(*f.body) if f else []))

    def _called(self, a: int, b: int) -> list[str]:
        """Names called in a body, functions within it left out, each once."""
        out: dict[str, None] = {}
        i = a
        while i < b:
            inner = self.function_at(i) if i > a and (self.name(i) or self.text(i) in ("(", "<")) and self.text(i - 1) not in (".",) else None
            if inner and inner.body[1] <= b and inner.end > i:
                i = inner.end
                continue
            if self.name(i) and self.text(i + 1) in ("(",) and self.text(i) not in ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import"):
                if self.text(i - 1) not in ("function", "new"):
                    out[self.text(i)] = None
            i += 1
        return list(out)

    # -- the visit ----------------------------------------------------------------------------------------------------
    def _visit(self, i: int) -> None:
        t = self.t[i]
        if t.kind != "name" or self.text(i - 1) in (".", "?."):
            return
        if t.text in ("const", "let", "var"):
            self._variables(i)
        elif t.text == "function":
            self._function(i)
        elif t.text == "class" and self._starts_statement(i):
            self._class(i)
        elif t.text == "import" and self._starts_statement(i):
            self._import(i)
        elif t.text == "export" and self._starts_statement(i):
            self._export(i)
        elif t.text == "require" and self.text(i + 1) == "(" and (m := self.string(i + 2)) and m.startswith("."):
            self.modules.append({"source": m, "line": self.s.line(i)})
        elif t.text == "catch" and self.text(i + 1) == "(" and self.name(i + 2):
            self.variables.append({"name": self.text(i + 2), "line": self.s.line(i + 2)})
        elif self.text(i + 1) == "." and self.text(i + 2).lower() in VERBS and self.text(i + 3) == "(":
            self._endpoint(i)

    def _function(self, i: int) -> None:
        if not self._starts_statement(i) or (f := self._declared(i + 1)) is None:
            return
        first, exported, default = self._outer(i)
        at = i + 1 + (self.text(i + 1) == "*")
        name = self.text(at) if self.name(at) else "default"
        component = name[:1].isascii() and name[:1].isupper() and self._has_jsx(*f.body)
        self._symbol(name, name, "component" if component else "function", first, f.end, f)
        self.functions.setdefault(name, f)
        if re.match(r"use[A-Z]", name) and name not in REACT_HOOKS:
            self.hooks[name] = f.body
        if exported:
            self.exports.append({"name": name, "is_default": default, "line": self.s.line(first)})

    def _class(self, i: int) -> None:
        body = self.find(i + 1, len(self.t), "{", (";",))
        if body < 0:
            return
        first, exported, default = self._outer(i)
        name = self.text(i + 1) if self.name(i + 1) and self.text(i + 1) not in ("extends", "implements") else "default"
        base = re.search(r"extends\s+([\w.$]+)", self.between(i, body))
        component = name[:1].isascii() and name[:1].isupper() and (bool(base and re.search(r"(?:^|\.)(?:Pure)?Component$", base[1])) or self._has_jsx(body, self.pair[body]))
        line, column = self.s.place(self.t[first].start)
        self.symbols.append(Symbol(f"{self.path}#{name}@{line}", name, "component" if component else "class", line, column, self.s.last_line(self.pair[body])))
        if exported:
            self.exports.append({"name": name, "is_default": default, "line": line})
        j, end = body + 1, self.pair[body]
        while j < end:
            start, accessor = j, False
            while self.name(j) and self.text(j) in _MODIFIERS | {"get", "set"} and self.text(j + 1) not in ("(", "=", ";", ":", "?", "<"):
                accessor |= self.text(j) in ("get", "set")
                j += 1
            j += self.text(j) == "*"
            f = self._signature(self._angles(j + 1)) if self.name(j) else None
            if f:
                if not accessor and self.text(j) != "constructor":
                    self._symbol(self.text(j), f"{name}.{self.text(j)}", "function", start, f.end, f)
                j = f.end
            elif j in self.pair and self.text(j) in ("(", "[", "{"):
                j = self.pair[j] + 1
            else:
                j += 1

    def _variables(self, i: int) -> None:
        first, exported, _ = self._outer(i)
        in_head = self.text(i - 1) == "("
        end = self.pair[i - 1] if in_head and i - 1 in self.pair else len(self.t)
        j = i + 1
        while j < end and (self.name(j) or self.text(j) in ("{", "[")):
            at, plain = j, self.name(j)
            j = j + 1 if plain else self.pair[j] + 1
            if self.text(j) == "!" or self.text(j) == ":":
                stop = self.find(j, end, "=", (";", ","))
                j = stop if stop >= 0 else self._expression_end(j + 1)
            f = None
            if self.text(j) == "=" and self.t[j].kind == "punct":
                f = self.function_at(j + 1)
                j = f.end if f else self._expression_end(j + 1)
            elif self.text(j) in ("of", "in"):
                j = end
            if plain and f:
                name = self.text(at)
                component = name[:1].isascii() and name[:1].isupper() and self._has_jsx(*f.body)
                if not in_head:
                    self._symbol(name, name, "component" if component else "function", at, f.end, f)
                    if exported:
                        self.exports.append({"name": name, "is_default": False, "line": self.s.line(first)})
                self.functions.setdefault(name, f)
                if re.match(r"use[A-Z]", name) and name not in REACT_HOOKS:
                    self.hooks[name] = f.body
            elif plain:
                self.variables.append({"name": self.text(at), "line": self.s.line(at)})
            if self.text(j) != ",":
                break
            j += 1

    def _import(self, i: int) -> None:
        line = self.s.line(i)
        j = i + 1
        if self.text(j) in ("(", "."):
            return
        if (source := self.string(j)) is not None:
            self.imports.append({"source": source, "specifiers": [], "is_default": False, "line": line})
            return
        if self.text(j) == "type" and (self.name(j + 1) and self.text(j + 1) != "from" or self.text(j + 1) in ("{", "*")):
            j += 1
        found: list[tuple[list[str], bool]] = []
        if self.name(j) and self.text(j + 1) == "=":
            return
        if self.name(j):
            found.append(([self.text(j)], True))
            j += 1 + (self.text(j + 1) == ",")
        if self.text(j) == "*":
            found.append(([self.text(j + 2)], False))
            j += 3
        elif self.text(j) == "{" and j in self.pair:
            found.append(([self.text(b - 1) for _, b in self.parts(j + 1, self.pair[j])], False))
            j = self.pair[j] + 1
        source = self.string(j + 1) if self.text(j) == "from" else None
        if source is not None:
            self.imports.extend({"source": source, "specifiers": names, "is_default": default, "line": line} for names, default in found)
            if source.startswith("."):
                self.modules.append({"source": source, "line": line})

    def _export(self, i: int) -> None:
        line, j = self.s.line(i), i + 1
        if self.text(j) == "type" and self.text(j + 1) == "{":
            j += 1
        if self.text(j) == "{" and j in self.pair:
            self.exports.extend({"name": self.text(b - 1), "is_default": False, "line": line} for _, b in self.parts(j + 1, self.pair[j]))
            j = self.pair[j] + 1
        elif self.text(j) == "*":
            while j < len(self.t) and self.text(j) != "from" and self.text(j) != ";":
                j += 1
        elif self.text(j) == "default":
            word = self.text(j + 1 + (self.text(j + 1) in ("async", "abstract")))
            if word not in ("function", "class"):
                alone = self.name(j + 1) and (j + 2 >= len(self.t) or self.text(j + 2) in (";", "}") or self.s.line(j + 2) > self.s.line(j + 1))
                self.exports.append({"name": self.text(j + 1) if alone else "default", "is_default": True, "line": line})
        if self.text(j) == "from" and (m := self.string(j + 1)) and m.startswith("."):
            self.modules.append({"source": m, "line": line})

    # -- endpoints ----------------------------------------------------------------------------------------------------
    def _endpoint(self, i: int) -> None:
        if not RECEIVER.search(self.text(i)) or self.t[i + 4 if i + 4 < len(self.t) else i].kind != "string":
            return
        route, method, line = self.string(i + 4), self.text(i + 2).upper(), self.s.line(i)
        close = self.pair[i + 3]
        column = self.s.place(self.t[i].start)[1]
        self.symbols.append(Symbol(f"{self.path}#{method} {route}@{line}", f"{method} {route}", "endpoint", line, column, self.s.last_line(close)))
        args = self.parts(i + 4, close)
        handler = None
        if len(args) > 1:
            a, b = args[-1]
            handler = self.function_at(a) or (self._named(self.text(a)) if b == a + 1 and self.name(a) else None)
        given = [p["name"] for p in self.params(handler)] if handler else []
        req, res = (given[k] if len(given) > k and re.fullmatch(r"[\w$]+", given[k]) else word for k, word in ((0, "req"), (1, "res")))
        parameters = [{"name": n, "type": "string", "required": True, "source": "route"} for n in re.findall(r":([A-Za-z0-9_]+)", route)]
        body = response = None
        if handler:
            query, _ = self._fields(handler.body, req, "query")
            parameters += [{"name": n, "type": "string", "required": False, "source": "query"} for n in query]
            fields, whole = self._fields(handler.body, req, "body", patterns=True)
            if fields:
                body = {"type": "object", "properties": [{"name": n, "type": "any"} for n in fields], "required": fields}
            elif whole:
                body = {"type": "object", "properties": [], "required": []}
            response = self._response(handler.body, res)
        self.endpoints.append({"route": route, "method": method, "line": line, "parameters": parameters, "body": body, "response": response})

    def _named(self, name: str) -> Function | None:
        """A function of this file by its name, declared before or after."""
        if name in self.functions:
            return self.functions[name]
        for k, t in enumerate(self.t):
            if t.kind == "name" and t.text == name:
                if self.text(k - 1) == "function":
                    return self._declared(k)
                if self.text(k - 1) in ("const", "let", "var") and self.text(k + 1) == "=":
                    return self.function_at(k + 2)
        return None

    def _fields(self, body: tuple[int, int], owner: str, part: str, patterns: bool = False) -> tuple[list[str], bool]:
        """Fields of ``owner.part`` that a body reads, each once, and whether it's used at all."""
        out, used = {}, False
        for k in range(*body):
            if not (self.name(k) and self.text(k) == owner and self.text(k + 1) in (".", "?.") and self.text(k + 2) == part) or self.text(k - 1) in (".", "?."):
                continue
            used = True
            if self.text(k + 3) in (".", "?.") and self.name(k + 4):
                out[self.text(k + 4)] = None
            elif self.text(k + 3) == "[" and (n := self.string(k + 4)) is not None:
                out[n] = None
            elif patterns and self.text(k - 1) == "=" and self.text(k - 2) == "}":
                a = self.pair[k - 2]
                out.update((self.text(x), None) for x, _ in self.parts(a + 1, k - 2) if self.name(x))
        return list(out), used

    def _response(self, body: tuple[int, int], res: str) -> dict | None:
        for k in range(*body):
            if not (self.name(k) and self.text(k) == res and self.text(k + 1) == "."):
                continue
            j = k + 2
            if self.text(j) == "status" and self.text(j + 1) == "(" and self.text(self.pair[j + 1] + 1) == ".":
                j = self.pair[j + 1] + 2
            if self.text(j) in ("json", "send") and self.text(j + 1) == "(":
                args = self.parts(j + 2, self.pair[j + 1])
                if not args:
                    continue
                return self.schema(*args[0], "any") if self.text(args[0][0]) == "{" else {"type": "object"}
        return None

    # -- values -------------------------------------------------------------------------------------------------------
    def schema(self, a: int, b: int, unknown: str, nested: bool = True) -> dict:
        """The shape of a literal: its type, and of an object its fields. Spreads and computed names are left out."""
        t: Token = self.t[a]
        if t.kind == "punct" and t.text == "{" and self.pair[a] == b - 1:
            fields = []
            for x, y in self.parts(a + 1, b - 1):
                key = self.string(x) if self.t[x].kind == "string" else self.text(x) if self.name(x) else None
                if key is None:
                    continue
                if self.text(x + 1) == ":":
                    inner = self.schema(x + 2, y, unknown, nested)
                    fields.append({"name": key, **(inner if nested else {"type": inner["type"]})})
                elif y == x + 1:
                    fields.append({"name": key, "type": unknown})
            return {"type": "object", "properties": fields}
        if b == a + 1 or t.kind == "template":
            if t.kind in ("string", "template"):
                return {"type": "string"}
            if t.kind == "number":
                return {"type": "number"}
            if t.text in ("true", "false"):
                return {"type": "boolean"}
            if t.text == "null" and not nested:
                return {"type": "null"}
        if t.text == "[" and self.pair.get(a) == b - 1:
            return {"type": "array"}
        if t.text == "-" and b == a + 2 and self.t[a + 1].kind == "number":
            return {"type": "number"}
        return {"type": unknown}

    def _property(self, a: int, b: int, key: str) -> tuple[int, int] | None:
        if self.text(a) != "{" or self.pair.get(a) != b - 1:
            return None
        for x, y in self.parts(a + 1, b - 1):
            if (self.string(x) if self.t[x].kind == "string" else self.text(x)) == key and self.text(x + 1) == ":":
                return x + 2, y
        return None

    def _url(self, a: int, b: int) -> str | None:
        if self.t[a].kind == "template" and self._over(a) >= b:
            return self.t[a].text[1:-1]
        return self.string(a) if b == a + 1 else None

    # -- calls over HTTP ----------------------------------------------------------------------------------------------
    def _api_calls(self) -> list[dict]:
        """Calls within custom hooks first, hook by hook, then the others in order."""
        bodies = list(self.hooks.values())
        out = [c for a, b in bodies for k in range(a, b) if (c := self._call(k))]
        return out + [c for k in range(len(self.t)) if not any(a <= k < b for a, b in bodies) and (c := self._call(k))]

    def _call(self, i: int) -> dict | None:
        if not self.name(i) or self.text(i - 1) in (".", "?.", "function"):
            return None
        method, data, url = "GET", None, None
        if self.text(i) == "fetch" and self.text(i + 1) == "(":
            args = self.parts(i + 2, self.pair[i + 1])
            url = self._url(*args[0]) if args else None
            if len(args) > 1:
                m, body = self._property(*args[1], "method"), self._property(*args[1], "body")
                method = (m and self.string(m[0]) or "GET").upper()
                if body and self.between(body[0], min(body[0] + 3, body[1])) == "JSON.stringify":
                    inner = self.parts(body[0] + 4, self.pair[body[0] + 3])
                    data = inner[0] if inner else None
        elif self.text(i) == "axios" and self.text(i + 1) == "." and self.text(i + 2) in VERBS and self.text(i + 3) == "(":
            args = self.parts(i + 4, self.pair[i + 3])
            url, method = self._url(*args[0]) if args else None, self.text(i + 2).upper()
            data = args[1] if len(args) > 1 and self.text(i + 2) in BODY_VERBS else None
        elif self.text(i) == "axios" and self.text(i + 1) == "(":
            args = self.parts(i + 2, self.pair[i + 1])
            u = self._property(*args[0], "url") if args else None
            m = self._property(*args[0], "method") if args else None
            url, method = self._url(*u) if u else None, (m and self.string(m[0]) or "GET").upper()
            data = self._property(*args[0], "data") if args else None
        if url is None:
            return None
        sent = self.schema(*data, "unknown", nested=False) if data and self.text(data[0]) == "{" else None
        return {"url": url, "method": method, "line": self.s.line(i), "sent": sent}

    def record(self) -> dict:
        return {"symbols": [asdict(s) for s in self.symbols], "imports": self.imports, "exports": self.exports, "endpoints": self.endpoints, "calls": self.calls, "variables": self.variables, "modules": self.modules}
