"""A small sandboxed template language, compiled to Python closures.

    {{ value }}  {% if %} {% elif %} {% else %} {% endif %}  {% for x in list %} {% endfor %}
    {% set x = value %}  {% generation %} ... {% endgeneration %}  {# comment #}

Values are literals, names, `x.key`, `x[key]`, `and or not`, `== != < <= > >= in`, `~ + -`,
`is [not] defined`, `is [not] none` and filters `x | upper`. A dash inside a tag strips white
space at that side. Only keys of dictionaries, places of lists and the given filters can be
reached: there are no calls, no attributes of Python objects and no loops but over given lists,
so a template can neither leave its data nor run for ever.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

FILTERS: dict[str, Callable[[Any], Any]] = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "length": len, "string": str}

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>~+\-|.()\[\]=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}

Node = tuple  # (kind, parts ...); ("const", value) and ("text", string) are what folding leaves
Pieces = Iterator[tuple[str, int]]


class TemplateError(ValueError):
    pass


class _Undefined:
    def __bool__(self) -> bool:
        return False


UNDEFINED = _Undefined()


class Stream:
    """A list that is read once: the next two items are all that is held of it."""

    def __init__(self, items: Iterable[Any]):
        self._rest = iter(items)
        self.first = next(self._rest, UNDEFINED)

    def __bool__(self) -> bool:
        return self.first is not UNDEFINED

    def __iter__(self) -> Iterator[Any]:
        if self.first is not UNDEFINED:
            yield self.first
            yield from self._rest


# --- syntax tree


class _Expression:
    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            at = m.end()
            number, string, name, sign = m.groups()
            if number is not None:
                self.tokens.append(("const", int(number)))
            elif string is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
            else:
                self.tokens.append(("word", name) if name else ("sign", sign))
        self.at = 0

    def peek(self, *texts: str) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return text if kind in ("word", "sign") and text in texts else None

    def take(self, *texts: str) -> str | None:
        found = self.peek(*texts)
        self.at += found is not None
        return found

    def expect(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} is missing in {self.source!r}")

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "word":
            raise TemplateError(f"a name is missing in {self.source!r}")
        self.at += 1
        return text

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"cannot read {self.source!r} to its end")

    def value(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> Node:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.joined()
        while sign := self.take("==", "!=", "<", "<=", ">", ">=", "in", "not", "is"):
            if sign == "is":
                denied = self.take("not")
                test = self.name()
                if test not in ("defined", "none"):
                    raise TemplateError(f"unknown test {test!r}")
                node = ("not", (test, node)) if denied else (test, node)
            elif sign == "not":
                self.expect("in")
                node = ("not", ("in", node, self.joined()))
            else:
                node = (sign, node, self.joined())
        return node

    def joined(self) -> Node:
        node = self.filtered()
        while sign := self.take("~", "+", "-"):
            node = (sign, node, self.filtered())
        return node

    def filtered(self) -> Node:
        node = self.reached()
        while self.take("|"):
            node = ("filter", self.name(), node)
        return node

    def reached(self) -> Node:
        node = self.single()
        while sign := self.take(".", "["):
            if sign == ".":
                node = ("item", node, ("const", self.name()))
            else:
                node = ("item", node, self.value())
                self.expect("]")
        return node

    def single(self) -> Node:
        if self.take("("):
            node = self.value()
            self.expect(")")
            return node
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return self.tokens[self.at - 1]
        name = self.name()
        return ("const", _CONSTANTS[name]) if name in _CONSTANTS else ("name", name)


def _value(source: str) -> Node:
    e = _Expression(source)
    node = e.value()
    e.end()
    return node


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """("text" | "value" | "tag", content) in order."""
    at, strip = 0, False
    for m in _TAG.finditer(source):
        left, right = ("-" in (m[k] or "") for k in ((1, 3) if m[2] is not None else (4, 6) if m[5] is not None else (7, 8)))
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        yield "text", text.rstrip() if left else text
        if m[2] is not None:
            yield "value", m[2]
        elif m[5] is not None:
            yield "tag", m[5].strip()
        at, strip = m.end(), right
    yield "text", source[at:].lstrip() if strip else source[at:]


def parse(source: str) -> list[Node]:
    """The syntax tree of a template."""
    pieces = _pieces(source)

    def block(*ends: str) -> tuple[list[Node], str]:
        out: list[Node] = []
        for kind, content in pieces:
            if kind == "text":
                if content:
                    out.append(("text", content))
                continue
            if kind == "value":
                out.append(("print", _value(content)))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return out, content
            if word == "if":
                branches, otherwise = [], []
                test = _value(rest)
                while True:
                    body, end = block("elif", "else", "endif")
                    branches.append((test, body))
                    if end.startswith("elif"):
                        test = _value(end[4:])
                        continue
                    if end == "else":
                        otherwise, _ = block("endif")
                    break
                out.append(("if", branches, otherwise))
            elif word == "for":
                e = _Expression(rest)
                name = e.name()
                e.expect("in")
                items = e.value()
                e.end()
                body, _ = block("endfor")
                out.append(("for", name, items, body))
            elif word == "set":
                e = _Expression(rest)
                name = e.name()
                e.expect("=")
                node = e.value()
                e.end()
                out.append(("set", name, node))
            elif word == "generation":
                body, _ = block("endgeneration")
                out.append(("generation", body))
            else:
                raise TemplateError(f"unknown tag {content!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return out, ""

    return block()[0]


# --- constant folding


def _shown(value: Any) -> str:
    return "" if value is None or value is UNDEFINED else value if isinstance(value, str) else str(value)


def _item(owner: Any, key: Any) -> Any:
    if isinstance(owner, dict):
        return owner.get(key, UNDEFINED)
    if isinstance(owner, list) and isinstance(key, int) and -len(owner) <= key < len(owner):
        return owner[key]
    if isinstance(owner, Stream) and key == 0:
        return owner.first
    return UNDEFINED


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "~": lambda a, b: _shown(a) + _shown(b),
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "item": _item,
}
_UNARY: dict[str, Callable[[Any], Any]] = {"not": lambda a: not a, "defined": lambda a: a is not UNDEFINED, "none": lambda a: a is None}


def _folded(node: Node, filters: dict[str, Callable[[Any], Any]]) -> Node:
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        inner = _folded(node[2], filters)
        return ("const", filters[node[1]](inner[1])) if inner[0] == "const" else (kind, node[1], inner)
    parts = [_folded(x, filters) for x in node[1:]]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if kind in _UNARY and parts[0][0] == "const":
        return ("const", _UNARY[kind](parts[0][1]))
    if kind in _BINARY and all(p[0] == "const" for p in parts):
        try:
            return ("const", _BINARY[kind](parts[0][1], parts[1][1]))
        except TypeError as e:
            raise TemplateError(str(e)) from e
    return (kind, *parts)


def fold(body: list[Node], filters: dict[str, Callable[[Any], Any]] = FILTERS) -> list[Node]:
    """Compute what does not depend on the data, drop branches that are never taken, join neighbouring texts."""
    out: list[Node] = []
    for node in body:
        kind = node[0]
        if kind == "print":
            value = _folded(node[1], filters)
            new = [("text", _shown(value[1]))] if value[0] == "const" else [("print", value)]
        elif kind == "set":
            new = [("set", node[1], _folded(node[2], filters))]
        elif kind == "for":
            new = [("for", node[1], _folded(node[2], filters), fold(node[3], filters))]
        elif kind == "generation":
            new = [("generation", fold(node[1], filters))]
        elif kind == "if":
            branches, otherwise = [], fold(node[2], filters)
            for test, inner in node[1]:
                test, inner = _folded(test, filters), fold(inner, filters)
                if test[0] == "const" and test[1]:
                    otherwise = inner
                    break
                if test[0] != "const":
                    branches.append((test, inner))
            new = [("if", branches, otherwise)] if branches else otherwise
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


# --- closures


def _evaluate(node: Node, filters: dict[str, Callable[[Any], Any]]) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name, UNDEFINED)
    if kind == "filter":
        call, inner = filters[node[1]], _evaluate(node[2], filters)
        return lambda env: call(inner(env))
    parts = [_evaluate(x, filters) for x in node[1:]]
    if kind in _UNARY:
        unary, (only,) = _UNARY[kind], parts
        return lambda env: unary(only(env))
    a, b = parts
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    binary = _BINARY[kind]
    return lambda env: binary(a(env), b(env))


def _statement(node: Node, filters: dict[str, Callable[[Any], Any]]) -> Callable[[dict], Pieces]:
    kind = node[0]
    if kind == "text":
        text = node[1]

        def run(env: dict) -> Pieces:
            yield text, env["generation"]

    elif kind == "print":
        value = _evaluate(node[1], filters)

        def run(env: dict) -> Pieces:
            yield _shown(value(env)), env["generation"]

    elif kind == "set":
        target, value = node[1], _evaluate(node[2], filters)

        def run(env: dict) -> Pieces:
            env[target] = value(env)
            return iter(())

    elif kind == "if":
        branches = [(_evaluate(test, filters), _block(body, filters)) for test, body in node[1]]
        otherwise = _block(node[2], filters)

        def run(env: dict) -> Pieces:
            return next((body for test, body in branches if test(env)), otherwise)(env)

    elif kind == "generation":
        body = _block(node[1], filters)

        def run(env: dict) -> Pieces:
            env["generations"] += 1
            inner = env | {"generation": env["generations"]}
            yield from body(inner)
            env["generations"] = inner["generations"]

    else:
        name, items, body = node[1], _evaluate(node[2], filters), _block(node[3], filters)

        def run(env: dict) -> Pieces:
            found = items(env)
            if not isinstance(found, (list, Stream)):
                raise TemplateError(f"{name!r} does not run over a list")
            rest, index = iter(found), 0
            item = next(rest, UNDEFINED)
            while item is not UNDEFINED:
                following = next(rest, UNDEFINED)
                inner = env | {name: item, "loop": {"index0": index, "index": index + 1, "first": not index, "last": following is UNDEFINED}}
                yield from body(inner)
                env["generations"] = inner["generations"]
                item, index = following, index + 1

    return run


def _block(body: list[Node], filters: dict[str, Callable[[Any], Any]]) -> Callable[[dict], Pieces]:
    statements = [_statement(node, filters) for node in body]

    def run(env: dict) -> Pieces:
        for statement in statements:
            yield from statement(env)

    return run


def _uses(node: Any, name: str, looped: bool = False) -> int:
    """1 if the list of that name is looped over once and not needed otherwise, more if it is needed whole."""
    if isinstance(node, list):
        return sum(_uses(x, name, looped) for x in node)
    if not isinstance(node, tuple) or node[0] in ("const", "text"):
        return 0
    if node == ("name", name):
        return 2
    if node == ("item", ("name", name), ("const", 0)):
        return 0
    if node[0] == "for":
        return (1 + looped if node[2] == ("name", name) else _uses(node[2], name, looped)) + _uses(node[3], name, True)
    return sum(_uses(x, name, looped) for x in node)


class Template:
    """render(messages, **names) yields (text, generation): 0 outside, else the number of the generation block."""

    def __init__(self, source: str, filters: dict[str, Callable[[Any], Any]] | None = None):
        known = FILTERS | (filters or {})
        self.tree = fold(parse(source), known)
        #: one loop over messages, and at most the first of them elsewhere: they need not be held
        self.single_pass = _uses(self.tree, "messages") <= 1
        self._run = _block(self.tree, known)

    def render(self, messages: Iterable[dict], **names: Any) -> Pieces:
        env = names | {"messages": Stream(messages) if self.single_pass else list(messages), "generation": 0, "generations": 0}
        return self._run(env)
