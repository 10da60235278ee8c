"""A small sandboxed template language for conversations, compiled to Python closures.

Source text is parsed to a syntax tree, constants are folded (expressions, texts side by side, branches that are decided), and each node left becomes
one closure. A template has one ``for`` over ``messages`` at its top level: what stands before is its head, what stands after its tail, so that turns
can be rendered apart from each other with a loop that knows its place in the whole.

``{{ expr }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% set name = expr %}``, ``{% for m in messages %} {% endfor %}``, ``{% generation %}
{% endgeneration %}`` (what the model is to say: the loss mask), ``{# remark #}``; a ``-`` at a tag's edge takes away the blanks there. Expressions: texts, numbers, names, ``m.role``,
``m['content']``, ``loop.index/index0/first/last/length``, ``== != in and or not``, ``~`` or ``+`` (texts put together), ``x | filter``.

Nothing of Python can be reached: names and keys are known when the template is compiled, or it is refused; filters come from a fixed table; there are no calls, and no loop
but the one, so the work follows the input's size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

MOST_SOURCE, MOST_DEPTH = 1 << 16, 32
MESSAGE_KEYS, LOOP_KEYS = ("role", "content"), ("index", "index0", "first", "last", "length")

_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[~+|.()\[\]]))", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


def escape_control(text: str) -> str:
    """No ``<|`` is left: a backslash more between the two signs."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape_control(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_line(text: str) -> str:
    """One line without control strings."""
    return escape_control(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_control(text))


FILTERS: dict[str, Callable] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str,
                                "escape_control": escape_control, "escape_line": escape_line}
_SIGNS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "~": lambda a, b: f"{a}{b}", "+": lambda a, b: a + b}


# ---- expressions -------------------------------------------------------------------------------------------------

class _Expression:
    """Recursive descent over one tag's tokens. Nodes: const, name, key, filter, not, both (and/or) and sign."""

    def __init__(self, source: str):
        self.tokens, at, end = [], 0, len(source.rstrip())
        while at < end:
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = self.depth = 0

    def next_is(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.next_is(value):
            raise TemplateError(f"{value!r} is missing")

    def take(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")
        return node

    def either(self):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("nested too deep")
        node = self.all()
        while self.next_is("or"):
            node = ("both", "or", node, self.all())
        self.depth -= 1
        return node

    def all(self):
        node = self.negated()
        while self.next_is("and"):
            node = ("both", "and", node, self.negated())
        return node

    def negated(self):
        odd = False
        while self.next_is("not"):
            odd = not odd
        return ("not", self.compared()) if odd else self.compared()

    def compared(self):
        node = self.joined()
        while sign := self.next_is("==", "!=", "in"):
            node = ("sign", sign, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while sign := self.next_is("~", "+"):
            node = ("sign", sign, node, self.filtered())
        return node

    def filtered(self):
        node = self.single()
        while True:
            if self.next_is("|"):
                name = self.take("name")
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = ("filter", name, node)
            elif self.next_is("."):
                node = ("key", node, self.take("name"))
            elif self.next_is("["):
                node = ("key", node, _text(self.take("text")))
                self.need("]")
            else:
                return node

    def single(self):
        if self.next_is("("):
            node = self.either()
            self.need(")")
            return node
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind == "text":
            return ("const", _text(value))
        if kind == "number":
            return ("const", int(value))
        if kind == "name":
            known = {"true": True, "false": False, "none": None}
            return ("const", known[value]) if value in known else ("name", value)
        raise TemplateError(f"{value!r} is no value")


def _text(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), token[1:-1], flags=re.S)


def fold(node, constants: Mapping[str, object]):
    """The same expression with all that is known worked out."""
    kind = node[0]
    if kind == "name":
        return ("const", constants[node[1]]) if node[1] in constants else node
    if kind == "key":
        return ("key", fold(node[1], constants), node[2])
    if kind == "filter":
        inner = fold(node[2], constants)
        return ("const", FILTERS[node[1]](inner[1])) if inner[0] == "const" else ("filter", node[1], inner)
    if kind == "not":
        inner = fold(node[1], constants)
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind in ("both", "sign"):
        a, b = fold(node[2], constants), fold(node[3], constants)
        if kind == "both" and a[0] == "const":
            return (b if a[1] else a) if node[1] == "and" else (a if a[1] else b)
        if kind == "sign" and a[0] == b[0] == "const":
            return ("const", _SIGNS[node[1]](a[1], b[1]))
        return (kind, node[1], a, b)
    return node


def _closure(node, names: Mapping[str, tuple[str, ...] | None]) -> Callable[[dict], object]:
    """``names``: what may be named here, with the keys it has (None: a plain value)."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name = node[1]
        if name not in names or names[name] is not None:
            raise TemplateError(f"{name!r} is not a value here")
        return lambda scope: scope[name]
    if kind == "key":
        base, key = node[1], node[2]
        if base[0] != "name" or key not in (names.get(base[1]) or ()):
            raise TemplateError(f"no key {key!r} here")
        name = base[1]
        return lambda scope: scope[name][key]
    if kind == "filter":
        apply, inner = FILTERS[node[1]], _closure(node[2], names)
        return lambda scope: apply(inner(scope))
    if kind == "not":
        inner = _closure(node[1], names)
        return lambda scope: not inner(scope)
    a, b = _closure(node[2], names), _closure(node[3], names)
    if kind == "both":
        return (lambda scope: a(scope) and b(scope)) if node[1] == "and" else (lambda scope: a(scope) or b(scope))
    apply = _SIGNS[node[1]]
    return lambda scope: apply(a(scope), b(scope))


# ---- statements --------------------------------------------------------------------------------------------------

def _pieces(source: str) -> list[tuple[str, str]]:
    """Texts, outputs and tags, blanks taken away where a tag asks for it."""
    out: list[tuple[str, str]] = []
    strip = False
    for part in _TAG.split(source):
        if not _TAG.fullmatch(part):
            out.append(("text", part.lstrip() if strip else part))
            strip = False
            continue
        inner = part[2:-2]
        if inner.startswith("-") and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1].rstrip())
        strip = inner.endswith("-")
        inner = inner.removeprefix("-").removesuffix("-").strip()
        if part[1] != "#":
            out.append(("out" if part[1] == "{" else "tag", inner))
    return out


def _block(pieces: list, ends: tuple[str, ...], depth: int = 0) -> tuple[list, str]:
    """Statements up to a tag of ``ends``, and that tag."""
    if depth > MOST_DEPTH:
        raise TemplateError("nested too deep")
    out: list = []
    while pieces:
        kind, source = pieces.pop(0)
        if kind == "text":
            out.append(("text", source))
        elif kind == "out":
            out.append(("out", _Expression(source).whole()))
        else:
            word, _, rest = source.partition(" ")
            if word in ends:
                return out, source
            if word == "if":
                branches, tag = [], source
                while tag.partition(" ")[0] in ("if", "elif"):
                    test = _Expression(tag.partition(" ")[2]).whole()
                    body, tag = _block(pieces, ("elif", "else", "endif"), depth + 1)
                    branches.append((test, body))
                if tag == "else":
                    body, tag = _block(pieces, ("endif",), depth + 1)
                    branches.append((("const", True), body))
                out.append(("if", branches))
            elif word == "set":
                name, equals, value = rest.partition("=")
                if not equals or not name.strip().isidentifier():
                    raise TemplateError("set needs a name and a value")
                out.append(("set", name.strip(), _Expression(value).whole()))
            elif word == "for":
                m = re.fullmatch(r"(\w+)\s+in\s+messages", rest.strip())
                if not m or depth:
                    raise TemplateError("the one loop runs over messages, at the top level")
                out.append(("for", m[1], _block(pieces, ("endfor",), depth + 1)[0]))
            elif word == "generation":
                out.append(("generation", _block(pieces, ("endgeneration",), depth + 1)[0]))
            else:
                raise TemplateError(f"no tag {word!r}")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return out, ""


def _folded(body: list, constants: Mapping[str, object]) -> list:
    out: list = []
    for node in body:
        if node[0] == "out":
            value = fold(node[1], constants)
            node = ("text", str(value[1])) if value[0] == "const" else ("out", value)
        elif node[0] == "set":
            node = ("set", node[1], fold(node[2], constants))
        elif node[0] == "if":
            branches = []
            for test, inner in node[1]:
                test = fold(test, constants)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, _folded(inner, constants)))
                if test[0] == "const":
                    break
            if not branches:
                continue
            if branches[0][0][0] == "const":
                out += branches[0][1]
                continue
            node = ("if", branches)
        elif node[0] in ("for", "generation"):
            node = (*node[:-1], _folded(node[-1], constants))
        out.append(node)
    merged: list = []
    for node in out:
        if node[0] == "text" and merged and merged[-1][0] == "text":
            merged[-1] = ("text", merged[-1][1] + node[1])
        elif node != ("text", ""):
            merged.append(node)
    return merged


class Sink:
    """Rendered text, and the spans of it that the model is to say."""

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _steps(body: list, names: dict) -> Callable[[dict, Sink], None]:
    steps = []
    for node in body:
        if node[0] == "text":
            steps.append(lambda scope, sink, text=node[1]: sink.write(text))
        elif node[0] == "out":
            steps.append(lambda scope, sink, value=_closure(node[1], names): sink.write(str(value(scope))))
        elif node[0] == "set":
            if names.get(node[1]) is not None:
                raise TemplateError(f"{node[1]!r} cannot be set")
            value = _closure(node[2], names)
            names[node[1]] = None
            steps.append(lambda scope, sink, name=node[1], value=value: scope.__setitem__(name, value(scope)))
        elif node[0] == "if":
            # What one branch sets is not known to be set after it.
            tests = [(_closure(t, names), _steps(b, dict(names))) for t, b in node[1]]
            steps.append(lambda scope, sink, tests=tests: next((run(scope, sink) for test, run in tests if test(scope)), None))
        else:
            def said(scope, sink, run=_steps(node[1], names)):
                start = sink.length
                run(scope, sink)
                if sink.length > start:
                    sink.spans.append((start, sink.length))
            steps.append(said)

    def run(scope: dict, sink: Sink) -> None:
        for step in steps:
            step(scope, sink)
    return run


class Template:
    """``head``, ``turn`` and ``tail`` write to a sink; ``constants`` are values known beforehand."""

    def __init__(self, source: str, constants: Mapping[str, object] | None = None):
        if len(source) > MOST_SOURCE:
            raise TemplateError("the template is too long")
        body = _folded(_block(_pieces(source), ())[0], constants or {})
        loops = [k for k, node in enumerate(body) if node[0] == "for"]
        if len(loops) != 1:
            raise TemplateError("one loop over messages is needed")
        at, names = loops[0], {}
        self.tree, self._variable = body, body[at][1]
        self._head = _steps(body[:at], names)
        self._turn = _steps(body[at][2], names | {self._variable: MESSAGE_KEYS, "loop": LOOP_KEYS})
        self._tail = _steps(body[at + 1:], names)

    def start(self, sink: Sink | None = None) -> dict:
        """A scope in which turns can be rendered; the head is written where a sink is given."""
        scope: dict = {}
        self._head(scope, Sink() if sink is None else sink)
        return scope

    def turn(self, scope: dict, sink: Sink, role: str, content: str, at: int, length: int) -> None:
        loop = {"index": at + 1, "index0": at, "first": at == 0, "last": at == length - 1, "length": length}
        self._turn({**scope, self._variable: {"role": role, "content": content}, "loop": loop}, sink)

    def tail(self, scope: dict, sink: Sink) -> None:
        self._tail(dict(scope), sink)
