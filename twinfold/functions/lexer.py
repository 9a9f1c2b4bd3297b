"""A lexer for JavaScript and TypeScript: enough structure to find functions, bindings and calls.

There is no parser here. Brackets are matched over the tokens, functions are found by their shapes, and where a
shape is unclear the answer is the careful one: not pure.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<template>`(?:\\.|[^`\\])*`)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
    r"|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)|(?P<name>#?[A-Za-z_$][\w$]*)"
    r"|(?P<op>=>|\?\?=|\*\*=|>>>=|<<=|>>=|&&=|\|\|=|===|!==|\.\.\.|\?\.|\*\*|\?\?|&&|\|\||==|!=|<=|>=|\+\+|--|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@])",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: After these an expression begins, so a slash opens a regular expression.
_BEFORE_EXPRESSION = set("( [ { } ; , = : ? ! & | ^ ~ + - * / % < > => && || ?? == === != !== += -= return typeof case in of new delete void throw".split())

# Names that a pure function may use, members that aren't deterministic, methods that change their
# receiver, and methods that make a new one.
SAFE_GLOBALS = set(
    "Object Array String Number Boolean Symbol BigInt Math JSON RegExp Map Set WeakMap WeakSet Date Intl Error TypeError RangeError SyntaxError ReferenceError EvalError URIError "
    "parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent encodeURI decodeURI Infinity NaN undefined globalThis "
    "ArrayBuffer Uint8Array Int8Array Uint16Array Int16Array Uint32Array Int32Array Float32Array Float64Array structuredClone escape unescape".split()
)
UNSTEADY = {("Math", "random"), ("Date", "now")}
MUTATING = set(
    "push pop shift unshift splice sort reverse fill copyWithin set add delete clear setDate setMonth setFullYear setHours setMinutes setSeconds setMilliseconds setTime setUTCDate setUTCFullYear setUTCHours".split()
)
COPYING = set("slice map filter concat flat flatMap split toSorted toReversed toSpliced with from of keys values entries assign parse fromEntries getOwnPropertyNames".split())
KEYWORDS = set(
    "async await break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof interface let new null of package "
    "private protected public return static super switch this throw true try type typeof var void while with yield as from get set readonly abstract declare namespace satisfies keyof infer is".split()
)
_ASSIGN = {"=", "+=", "-=", "*=", "**=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "||=", "&&=", "??="}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "with", "do", "else", "new", "typeof", "await", "super"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    line: int


def tokenize(code: str) -> list[Token]:
    """Tokens without white space and comments. An unexpected character is a token of its own."""
    out: list[Token] = []
    at, line = 0, 1
    while at < len(code):
        kind = text = None
        if code[at] == "/" and code[at : at + 2] not in ("//", "/*"):
            before = out[-1] if out else None
            if before is None or before.text in _BEFORE_EXPRESSION:
                m = _REGEX.match(code, at)
                if m:
                    kind, text = "regex", m.group()
        if kind is None:
            m = _TOKEN.match(code, at)
            kind, text = (m.lastgroup, m.group()) if m else ("op", code[at])
        if kind not in ("space", "comment"):
            out.append(Token(kind, text, at, line))
        line += text.count("\n")
        at += len(text)
    return out


def matches(tokens: list[Token]) -> dict[int, int]:
    """Positions of opening brackets to those of their closing ones."""
    pairs, stack = {}, []
    close = {")": "(", "]": "[", "}": "{"}
    for k, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text in "([{":
            stack.append(k)
        elif t.text in close:
            while stack and tokens[stack[-1]].text != close[t.text]:
                stack.pop()
            if stack:
                pairs[stack.pop()] = k
    return pairs


def opens_function(line: str) -> bool:
    """Whether a single line declares a function, binds an arrow function, or heads a method with a body."""
    tokens = tokenize(line)
    pairs, words = matches(tokens), [t.text for t in tokens]
    at = 0
    while at < len(words) and words[at] in ("export", "default", "async"):
        at += 1
    if at >= len(words):
        return False
    if words[at] == "function":
        rest = [t for t in tokens[at + 1 :] if t.text != "*"]
        return bool(rest) and rest[0].kind == "name"
    if words[at] in ("const", "let", "var"):
        depth = [k for k in range(at + 1, len(words)) if words[k] == "=" and not any(a < k < b for a, b in pairs.items())]
        if len(tokens) < at + 2 or tokens[at + 1].kind != "name" or not depth:
            return False
        k = depth[0] + 1
        k += k < len(words) and words[k] == "async"
        if k < len(words) and words[k] == "(":
            return k in pairs and "=>" in words[pairs[k] + 1 :]
        return k + 1 < len(words) and tokens[k].kind == "name" and words[k + 1] == "=>"
    if at == 0 and words[0] in ("public", "private", "protected", "static"):
        at = 1
    if at + 1 < len(words) and tokens[at].kind == "name" and words[at] not in _NOT_NAMES and words[at + 1] == "(" and at + 1 in pairs:
        after = words[pairs[at + 1] + 1 :]
        return after[:1] == ["{"] or (after[:1] == [":"] and "{" in after)
    return False


@dataclass
class Function:
    name: str
    first: int  # token of the declaration, of the text shown
    body: tuple[int, int]  # tokens of the body, braces included; or of the expression
    params: list[str]
    exported: bool
    accessor: bool = False
    is_async: bool = False
    generator: bool = False
    return_type: str = ""
    pure: bool = True
    reason: str = ""
    calls: set[str] = field(default_factory=set)
    reads: set[str] = field(default_factory=set)
    external: bool = False


@dataclass
class File:
    code: str
    tokens: list[Token]
    pairs: dict[int, int]
    imports: list[str]
    imported: set[str]
    declared: dict[str, tuple[int, int]]  # module-level bindings and the tokens of their statements
    functions: list[Function]

    def text(self, first: int, last: int) -> str:
        end = self.tokens[last]
        return self.code[self.tokens[first].at : end.at + len(end.text)]


def _parameters(tokens: list[Token], pairs: dict[int, int], opening: int) -> list[str]:
    """Top-level parameter names; a destructured one gives the names it binds."""
    names, depth_end, k, expect = [], pairs.get(opening, opening), opening + 1, True
    while k < depth_end:
        t = tokens[k]
        if expect and t.kind == "name" and t.text not in ("public", "private", "protected", "readonly"):
            names.append(t.text)
            expect = False
        elif expect and t.text in "{[":
            inner = range(k + 1, pairs.get(k, k))
            names += [tokens[i].text for i in inner if tokens[i].kind == "name" and tokens[i + 1].text in (",", "}", "]", "=")]
            k, expect = pairs.get(k, k), False
        elif t.text in "([{" and t.kind == "op":
            k = pairs.get(k, k)
        elif t.text == ",":
            expect = True
        k += 1
    return names


def _statement_end(tokens: list[Token], pairs: dict[int, int], k: int) -> int:
    """The last token of the statement that starts at ``k``: a semicolon, a closing brace, or the end of its line."""
    is_block = tokens[k].text in ("function", "class", "async", "enum", "interface")
    while k < len(tokens):
        t = tokens[k]
        if t.text in ("(", "[", "{") and t.kind == "op":
            k = pairs.get(k, len(tokens) - 1)
            if t.text == "{" and is_block:
                return k
        if t.text == ";":
            return k
        following = tokens[k + 1] if k + 1 < len(tokens) else None
        if following is None or following.text == "}":
            return min(k, len(tokens) - 1)
        if following.line > t.line and t.text not in _BEFORE_EXPRESSION and t.text not in (".", "?.") and (following.kind in ("name", "string", "template", "number") or following.text in ("{", "@")):
            return k
        k += 1
    return len(tokens) - 1


def _arrow_body(tokens: list[Token], pairs: dict[int, int], k: int) -> tuple[int, int]:
    """Tokens of what follows an arrow at ``k``."""
    if k + 1 < len(tokens) and tokens[k + 1].text == "{":
        return k + 1, pairs.get(k + 1, len(tokens) - 1)
    i = k + 1
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "op" and t.text in "([{" and i in pairs:
            i = pairs[i]
        elif t.kind == "op" and t.text in (";", ",", ")", "]", "}"):
            return k + 1, i - 1
        elif i + 1 < len(tokens) and tokens[i + 1].line > t.line and tokens[i + 1].kind == "name" and t.text not in _BEFORE_EXPRESSION and t.text not in (".", "?."):
            return k + 1, i
        i += 1
    return k + 1, len(tokens) - 1


def _after_parameters(tokens: list[Token], pairs: dict[int, int], closing: int) -> tuple[int, str]:
    """The token after parameters and an optional return type, and that type."""
    k = closing + 1
    if k < len(tokens) and tokens[k].text == ":":
        start = k + 1
        k += 1
        while k < len(tokens) and tokens[k].text not in ("{", "=>", ";", ","):
            k = pairs[k] + 1 if tokens[k].text in ("(", "[") and k in pairs else k + 1
        if k < len(tokens) and tokens[k].text == "{" and k == start:  # an object type
            k = pairs.get(k, k) + 1
        return k, " ".join(t.text for t in tokens[start:k])
    return k, ""


def _value_function(tokens, pairs, k) -> tuple[list[str], tuple[int, int], bool, bool, str] | None:
    """(params, body, async, generator, return type) if an arrow function or function expression starts at ``k``."""
    start, is_async = k, tokens[k].text == "async"
    k += is_async
    if k >= len(tokens):
        return None
    if tokens[k].text == "function":
        k += 1
        generator = tokens[k].text == "*"
        k += generator
        k += tokens[k].kind == "name"
        if k >= len(tokens) or tokens[k].text != "(" or k not in pairs:
            return None
        after, kind = _after_parameters(tokens, pairs, pairs[k])
        return (_parameters(tokens, pairs, k), (after, pairs[after]), is_async, generator, kind) if after in pairs else None
    if tokens[k].kind == "name" and k + 1 < len(tokens) and tokens[k + 1].text == "=>":
        return [tokens[k].text], _arrow_body(tokens, pairs, k + 1), is_async, False, ""
    if tokens[k].text == "(" and k in pairs:
        after, kind = _after_parameters(tokens, pairs, pairs[k])
        if after < len(tokens) and tokens[after].text == "=>":
            return _parameters(tokens, pairs, k), _arrow_body(tokens, pairs, after), is_async, False, kind
    del start
    return None


def _imports(tokens: list[Token]) -> tuple[list[str], set[str]]:
    """Module specifiers, and the names bound to imported values (types aren't values)."""
    specifiers, names = [], set()
    for k, t in enumerate(tokens):
        if t.text == "import" and t.kind == "name" and (k == 0 or tokens[k - 1].text != "."):
            if k + 1 < len(tokens) and tokens[k + 1].text == "(":
                continue
            only_types = k + 1 < len(tokens) and tokens[k + 1].text == "type" and k + 2 < len(tokens) and tokens[k + 2].text != "from"
            i, alias = k + 1, []
            while i < len(tokens) and tokens[i].kind != "string" and tokens[i].text != ";":
                if tokens[i].kind == "name" and tokens[i].text not in ("from", "as", "type"):
                    if i + 1 < len(tokens) and tokens[i + 1].text == "as":
                        i += 2
                    alias.append(tokens[i].text)
                i += 1
            if i < len(tokens) and tokens[i].kind == "string":
                specifiers.append(tokens[i].text[1:-1])
            if not only_types:
                names.update(alias)
        elif t.text == "require" and k + 2 < len(tokens) and tokens[k + 1].text == "(" and tokens[k + 2].kind == "string":
            specifiers.append(tokens[k + 2].text[1:-1])
            i = k - 1
            if i >= 1 and tokens[i].text == "=":
                i -= 1
                while i >= 0 and tokens[i].text not in ("const", "let", "var", ";"):
                    if tokens[i].kind == "name":
                        names.add(tokens[i].text)
                    i -= 1
    return list(dict.fromkeys(specifiers)), names


def read(code: str) -> File:
    tokens = tokenize(code)
    pairs = matches(tokens)
    specifiers, imported = _imports(tokens)
    depth, opens = [0] * (len(tokens) + 1), 0
    for k, t in enumerate(tokens):
        opens -= t.kind == "op" and t.text in "}])"
        depth[k] = opens
        opens += t.kind == "op" and t.text in "{[("
    declared: dict[str, tuple[int, int]] = {}
    found: list[Function] = []
    seen: set[int] = set()

    def add(name: str, first: int, value, exported: bool, accessor: bool = False) -> None:
        params, body, is_async, generator, kind = value
        if body[0] not in seen:
            seen.add(body[0])
            found.append(Function(name, first, body, params, exported, accessor, is_async, generator, kind))

    for k, t in enumerate(tokens):
        if t.kind != "name":
            continue
        before = tokens[k - 1].text if k else ""
        start = k
        while start and tokens[start - 1].text in ("export", "default", "async", "declare"):
            start -= 1
        exported = any(tokens[i].text == "export" for i in range(start, k))
        if t.text in ("function", "class", "enum") and k + 1 < len(tokens) and before not in (".", "=", "(", ",", ":", "=>", "return"):
            name_at = k + 1 + (tokens[k + 1].text == "*")
            if name_at < len(tokens) and tokens[name_at].kind == "name":
                if depth[k] == 0:
                    declared[tokens[name_at].text] = (start, _statement_end(tokens, pairs, k))
                if t.text == "function":
                    value = _value_function(tokens, pairs, k - 1 if before == "async" else k)
                    if value:
                        add(tokens[name_at].text, start, value, exported)
        elif t.text in ("const", "let", "var") and k + 1 < len(tokens):
            end = _statement_end(tokens, pairs, k)
            if tokens[k + 1].text in "{[" and k + 1 in pairs and depth[k] == 0:
                for i in range(k + 2, pairs[k + 1]):
                    if tokens[i].kind == "name" and tokens[i + 1].text in (",", "}", "]", "="):
                        declared[tokens[i].text] = (start, end)
            elif tokens[k + 1].kind == "name":
                if depth[k] == 0:
                    declared[tokens[k + 1].text] = (start, end)
                i = k + 2
                while i < end and tokens[i].text not in ("=", ";"):
                    i = pairs[i] + 1 if tokens[i].text in ("(", "[", "{") and i in pairs else i + 1
                if i < end and tokens[i].text == "=":
                    value = _value_function(tokens, pairs, i + 1)
                    if value:
                        add(tokens[k + 1].text, start, value, exported)
        elif t.text not in KEYWORDS or t.text in ("get", "set", "of", "from", "as", "is", "type"):
            following = tokens[k + 1].text if k + 1 < len(tokens) else ""
            inside = depth[k] > 0 and before in ("{", "}", ";", ",", "static", "async", "get", "set", "private", "public", "protected", "*", "readonly")
            if inside and following == "(" and t.text not in _NOT_NAMES and k + 1 in pairs:
                after, kind = _after_parameters(tokens, pairs, pairs[k + 1])
                if after in pairs and tokens[after].text == "{":
                    first = k
                    while first and tokens[first - 1].text in ("static", "async", "get", "set", "private", "public", "protected", "*", "readonly"):
                        first -= 1
                    marks = {tokens[i].text for i in range(first, k)}
                    add(t.text, first, (_parameters(tokens, pairs, k + 1), (after, pairs[after]), "async" in marks, "*" in marks, kind), False, bool(marks & {"get", "set"}))
            elif inside and following in (":", "=") and k + 2 < len(tokens):
                value = _value_function(tokens, pairs, k + 2)
                if value:
                    add(t.text, k, value, False)
    out = File(code, tokens, pairs, specifiers, imported, declared, found)
    _judge(out)
    return out


def _locals(file: File, f: Function) -> tuple[set[str], set[str]]:
    """Names bound inside the function, and those among them that hold a value made here."""
    tokens, pairs = file.tokens, file.pairs
    first, last = f.body
    bound, fresh = set(f.params), set()
    for k in range(first, last + 1):
        t = tokens[k]
        if t.text in ("const", "let", "var") and t.kind == "name" and k + 1 <= last:
            if tokens[k + 1].kind == "name":
                bound.add(tokens[k + 1].text)
                i = k + 2
                while i <= last and tokens[i].text not in ("=", ";", "of", "in"):
                    i += 1
                if i < last and tokens[i].text == "=":
                    made = tokens[i + 1].text in ("[", "{", "new") or tokens[i + 1].kind in ("string", "number", "template")
                    end = _statement_end(tokens, pairs, i)
                    copied = any(tokens[j].text in COPYING and tokens[j - 1].text in (".", "?.") and tokens[j + 1].text == "(" for j in range(i + 1, min(end, last)))
                    if made or copied:
                        fresh.add(tokens[k + 1].text)
            elif tokens[k + 1].text in "{[" and k + 1 in pairs:
                bound.update(tokens[i].text for i in range(k + 2, pairs[k + 1]) if tokens[i].kind == "name" and tokens[i + 1].text in (",", "}", "]", "="))
        elif t.text == "=>" and k > first:
            if tokens[k - 1].kind == "name":
                bound.add(tokens[k - 1].text)
            elif tokens[k - 1].text == ")":
                opening = next((a for a, b in pairs.items() if b == k - 1), None)
                if opening is not None:
                    bound.update(_parameters(tokens, pairs, opening))
        elif t.text in ("function", "class") and k + 1 <= last:
            name_at = k + 1
            if tokens[name_at].kind == "name":
                bound.add(tokens[name_at].text)
                name_at += 1
            if tokens[name_at].text == "(":
                bound.update(_parameters(tokens, pairs, name_at))
        elif t.text == "catch" and k + 2 <= last and tokens[k + 1].text == "(":
            bound.add(tokens[k + 2].text)
    return bound, fresh


def _root(tokens: list[Token], k: int) -> str | None:
    """The name at the start of the member chain whose last name is at ``k``; null if the chain starts otherwise."""
    while k >= 2 and tokens[k - 1].text in (".", "?."):
        if tokens[k - 2].kind != "name":
            return None
        k -= 2
    return tokens[k].text if tokens[k].kind == "name" else None


def _own_purity(file: File, f: Function) -> str:
    tokens = file.tokens
    first, last = f.body
    bound, fresh = _locals(file, f)
    if f.is_async:
        return "async"
    if f.generator:
        return "generator"
    returns = tokens[first].text != "{"
    f.reads |= {tokens[k].text for k in range(f.first, first) if tokens[k].text in file.declared and tokens[k - 1].text == "="}
    for k in range(first, last + 1):
        t = tokens[k]
        before = tokens[k - 1].text if k else ""
        after = tokens[k + 1].text if k + 1 < len(tokens) else ""
        if t.kind == "template" and "${" in t.text:
            for name in re.findall(r"\$\{\s*([A-Za-z_$][\w$]*)", t.text):
                if name not in bound and name in file.imported:
                    f.external = True
                    return f"uses imported {name}"
                if name not in bound and name in file.declared:
                    f.reads.add(name)
                elif name not in bound and name not in SAFE_GLOBALS and name not in KEYWORDS:
                    return f"unknown global {name}"
        if t.kind != "name":
            if t.kind == "op" and (t.text in _ASSIGN or t.text in ("++", "--")):
                target = k - 1 if tokens[k - 1].kind == "name" else (k + 1 if t.text in ("++", "--") and after and tokens[k + 1].kind == "name" else None)
                if target is not None:
                    name = _root(tokens, target)
                    simple = tokens[target - 1].text not in (".", "?.")
                    if name is None or name not in bound or (not simple and name not in fresh):
                        return f"changes {name or 'a value from outside'}"
                elif tokens[k - 1].text == "]":
                    opening = next((a for a, b in file.pairs.items() if b == k - 1), None)
                    name = _root(tokens, opening - 1) if opening else None
                    if name is not None and name not in fresh and tokens[opening - 1].text not in ("const", "let", "var", ";", "{", "}"):
                        return f"changes {name}"
            continue
        if t.text in ("this", "await", "yield"):
            return f"uses {t.text}"
        if t.text == "return" and after not in (";", "}"):
            returns = True
        if before in (".", "?."):
            owner = _root(tokens, k - 2) if k >= 2 and tokens[k - 2].kind == "name" else None
            if (owner, t.text) in UNSTEADY:
                return f"{owner}.{t.text} is not deterministic"
            if t.text in MUTATING and after == "(" and (owner is None or owner not in fresh) and owner is not None:
                return f"changes {owner} with {t.text}"
            continue
        if t.text == "Date" and before == "new" and after == "(" and tokens[k + 2].text == ")":
            return "reads the clock"
        if t.text in KEYWORDS or t.text in bound or after == ":" and before in ("{", ","):
            continue
        if t.text in file.imported:
            f.external = True
            return f"uses imported {t.text}"
        if t.text in file.declared:
            (f.calls if after == "(" else f.reads).add(t.text)
            f.reads.add(t.text)
        elif t.text not in SAFE_GLOBALS:
            return f"unknown global {t.text}"
    return "" if returns else "returns nothing"


def _judge(file: File) -> None:
    """Purity of every function: its own, then what it takes over from impure functions it calls."""
    for f in file.functions:
        f.reason = _own_purity(file, f)
        f.pure = not f.reason
    impure = {f.name for f in file.functions if not f.pure}
    changed = True
    while changed:
        changed = False
        for f in file.functions:
            hit = sorted(f.calls & impure - {f.name}) if f.pure else []
            if hit:
                f.pure, f.reason = False, f"calls {hit[0]}, which is not pure"
                impure.add(f.name)
                changed = True


def preamble(file: File, f: Function) -> str | None:
    """Same-file statements that a pure function needs to run, in order; null if none or if they can't run alone."""
    needed: dict[tuple[int, int], None] = {}
    queue, known = sorted(f.reads), set()
    while queue:
        name = queue.pop()
        if name in known or name not in file.declared or name == f.name:
            continue
        known.add(name)
        first, last = file.declared[name]
        needed[first, last] = None
        for k in range(first, last + 1):
            t = file.tokens[k]
            if t.kind != "name" or file.tokens[k - 1].text in (".", "?."):
                continue
            if t.text in file.imported:
                return None
            if t.text in file.declared:
                queue.append(t.text)
    statements = [re.sub(r"^\s*export\s+(default\s+)?", "", file.text(a, b)) for a, b in sorted(needed)]
    return "\n".join(statements) or None
