"""A small sandboxed template language and its compiler.

Source is parsed into a syntax tree, constants are folded, and the tree
becomes nested Python closures. Templates see the names given to them and
nothing else: no attribute of a Python object, no call but the filters listed
here, no import, no unbounded loop.

    {{ expression }}   output            {% if %} {% elif %} {% else %} {% endif %}
    {% for x in xs %} ... {% endfor %}   loop.first, loop.index0 and loop.index
    {% set name = expression %}          {% generation %} ... {% endgeneration %}
    {# comment #}      a dash inside a tag strips blanks on that side

Expressions: strings, integers, true, false, none, names, .key and [key] of
mappings, ~ and + to join, == != < <= > >=, in, and, or, not, and | filters.
A loop draws from any iterator one item at a time, and text is written piece
by piece to a sink with its mark, so a long conversation is never held whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

#: What may stand inside a tag: whole string literals, so that a tag's end inside one doesn't count, and other characters.
INSIDE = r"""(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^"'])*?"""
#: The last two take tags with an open quote, which the expression's parser refuses.
TAG = re.compile(rf"(\{{\{{{INSIDE}\}}\}}|\{{%{INSIDE}%\}}|\{{#.*?#\}}|\{{\{{.*?\}}\}}|\{{%.*?%\}})", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>~+|.()\[\],=]))""", re.S)
WORDS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """The template can't be parsed, or it asks for what the sandbox denies."""


@dataclass(frozen=True)
class Node:
    """kind and its parts; ``const`` nodes hold their value in parts[0]."""

    kind: str
    parts: tuple = ()


def const(value: Any) -> Node:
    return Node("const", (value,))


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _get(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return None


def _has(item: Any, holder: Any) -> bool:
    if isinstance(holder, str):
        return _text(item) in holder
    return item in holder if isinstance(holder, (list, tuple, dict)) else False


def _ordered(test: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    return lambda a, b: type(a) is type(b) and isinstance(a, (int, str)) and test(a, b)


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b),
    ">": _ordered(lambda a, b: a > b),
    ">=": _ordered(lambda a, b: a >= b),
    "in": _has,
}
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "capitalize": lambda x: _text(x).capitalize(),
    "string": _text,
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple, dict)) else 0,
}


class _Expression:
    """Recursive descent over one tag's expression."""

    def __init__(self, source: str, filters: dict):
        self.tokens, self.at, self.filters = [], 0, filters
        at, source = 0, source.rstrip()
        while at < len(source):
            if not (m := TOKEN.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if (now := self.peek()) in wanted and now is not None:
            self.at += 1
            return now
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} not expected")

    def whole(self) -> Node:
        out = self.either()
        self.end()
        return out

    def either(self) -> Node:
        out = self.both()
        while self.take("or"):
            out = Node("or", (out, self.both()))
        return out

    def both(self) -> Node:
        out = self.negated()
        while self.take("and"):
            out = Node("and", (out, self.negated()))
        return out

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        out = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            out = Node("binary", (op, out, self.joined()))
        return out

    def joined(self) -> Node:
        out = self.filtered()
        while op := self.take("~", "+"):
            out = Node("binary", (op, out, self.filtered()))
        return out

    def filtered(self) -> Node:
        out = self.reached()
        while self.take("|"):
            if (name := self.name()) not in self.filters:
                raise TemplateError(f"no filter {name}")
            out = Node("filter", (name, out))
        return out

    def reached(self) -> Node:
        out = self.atom()
        while op := self.take(".", "["):
            out = Node("get", (out, const(self.name()) if op == "." else self.either()))
            if op == "[":
                self.need("]")
        return out

    def atom(self) -> Node:
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("an expression expected")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return const(int(text))
        if kind == "name":
            if text in WORDS:
                return const(WORDS[text])
            if text.startswith("_"):
                raise TemplateError(f"{text} is hidden")
            return Node("name", (text,))
        raise TemplateError(f"{text!r} not expected")


def parse(source: str, filters: dict | None = None) -> Node:
    """The syntax tree of a template."""
    filters = FILTERS if filters is None else filters
    pieces = TAG.split(source)
    for i in range(1, len(pieces), 2):
        if pieces[i][2:3] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if pieces[i][-3:-2] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
    at = 0

    def block(*ends: str) -> tuple[Node, str]:
        nonlocal at
        out: list[Node] = []
        while at < len(pieces):
            piece, tag = pieces[at], at % 2 == 1
            at += 1
            if not tag:
                out.append(Node("write", (const(piece),)))
            elif piece.startswith("{#"):
                continue
            elif piece.startswith("{{"):
                out.append(Node("write", (_Expression(piece[2:-2].strip("-"), filters).whole(),)))
            else:
                inner = piece[2:-2].strip("-").strip()
                word, _, rest = inner.partition(" ")
                if word in ends:
                    return Node("block", tuple(out)), inner
                out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} expected")
        return Node("block", tuple(out)), ""

    def statement(word: str, rest: str) -> Node:
        if word == "if":
            test = _Expression(rest, filters).whole()
            body, end = block("elif", "else", "endif")
            if end.startswith("elif"):
                return Node("if", (test, body, statement("if", end[4:])))
            return Node("if", (test, body, block("endif")[0] if end == "else" else Node("block")))
        if word == "for":
            x = _Expression(rest, filters)
            name = x.name()
            x.need("in")
            items = x.whole()
            return Node("for", (name, items, block("endfor")[0]))
        if word == "set":
            x = _Expression(rest, filters)
            name = x.name()
            x.need("=")
            return Node("set", (name, x.whole()))
        if word == "generation":
            return Node("generation", (block("endgeneration")[0],))
        raise TemplateError(f"no statement {word}")

    return block()[0]


def fold(node: Node, filters: dict | None = None) -> Node:
    """The tree with constant parts worked out and neighbouring texts joined."""
    filters = FILTERS if filters is None else filters
    parts = tuple(fold(p, filters) if isinstance(p, Node) else p for p in node.parts)
    is_const = lambda *ns: all(n.kind == "const" for n in ns)
    kind = node.kind
    if kind == "binary" and is_const(*parts[1:]):
        return const(BINARY[parts[0]](parts[1].parts[0], parts[2].parts[0]))
    if kind == "filter" and is_const(parts[1]):
        return const(filters[parts[0]](parts[1].parts[0]))
    if kind == "get" and is_const(*parts):
        return const(_get(parts[0].parts[0], parts[1].parts[0]))
    if kind == "not" and is_const(*parts):
        return const(not parts[0].parts[0])
    if kind in ("and", "or") and is_const(parts[0]):
        return parts[1] if bool(parts[0].parts[0]) == (kind == "and") else parts[0]
    if kind == "if" and is_const(parts[0]):
        return parts[1] if parts[0].parts[0] else parts[2]
    if kind == "block":
        out: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "block" else (p,):
                if q.kind == "write" and is_const(q.parts[0]):
                    if not (text := _text(q.parts[0].parts[0])):
                        continue
                    if out and out[-1].kind == "write" and is_const(out[-1].parts[0]):
                        out[-1] = Node("write", (const(_text(out[-1].parts[0].parts[0]) + text),))
                        continue
                    q = Node("write", (const(text),))
                out.append(q)
        return Node("block", tuple(out))
    return Node(kind, parts)


Names = dict[str, Any]
Sink = Callable[[str, bool], None]


def _value(node: Node, filters: dict) -> Callable[[Names], Any]:
    kind, parts = node.kind, node.parts
    if kind == "const":
        value = parts[0]
        return lambda names: value
    if kind == "name":
        name = parts[0]
        return lambda names: names.get(name)
    if kind == "get":
        holder, key = (_value(p, filters) for p in parts)
        return lambda names: _get(holder(names), key(names))
    if kind == "filter":
        apply, inner = filters[parts[0]], _value(parts[1], filters)
        return lambda names: apply(inner(names))
    if kind == "binary":
        apply2, a, b = BINARY[parts[0]], _value(parts[1], filters), _value(parts[2], filters)
        return lambda names: apply2(a(names), b(names))
    if kind == "not":
        inner = _value(parts[0], filters)
        return lambda names: not inner(names)
    a, b = (_value(p, filters) for p in parts)
    return (lambda names: a(names) and b(names)) if kind == "and" else (lambda names: a(names) or b(names))


def _action(node: Node, filters: dict) -> Callable[[Names, Sink, bool], None]:
    kind, parts = node.kind, node.parts
    if kind == "write":
        value = _value(parts[0], filters)

        def write(names: Names, sink: Sink, marked: bool) -> None:
            if text := _text(value(names)):
                sink(text, marked)

        return write
    if kind == "block":
        steps = [_action(p, filters) for p in parts]

        def block(names: Names, sink: Sink, marked: bool) -> None:
            for step in steps:
                step(names, sink, marked)

        return block
    if kind == "if":
        test, yes, no = _value(parts[0], filters), _action(parts[1], filters), _action(parts[2], filters)
        return lambda names, sink, marked: (yes if test(names) else no)(names, sink, marked)
    if kind == "set":
        name, value = parts[0], _value(parts[1], filters)
        return lambda names, sink, marked: names.__setitem__(name, value(names))
    if kind == "generation":
        body = _action(parts[0], filters)
        return lambda names, sink, marked: body(names, sink, True)
    name, items, body = parts[0], _value(parts[1], filters), _action(parts[2], filters)

    def loop(names: Names, sink: Sink, marked: bool) -> None:
        found = items(names)
        inner = dict(names)
        for i, item in enumerate(found if isinstance(found, Iterable) else ()):
            inner[name], inner["loop"] = item, {"index0": i, "index": i + 1, "first": i == 0}
            body(inner, sink, marked)

    return loop


class Template:
    """A compiled template. render() calls sink(text, inside a generation block) for each piece."""

    def __init__(self, source: str, filters: dict | None = None):
        known = FILTERS | (filters or {})
        self.tree = fold(parse(source, known), known)
        self._run = _action(self.tree, known)

    def render(self, names: Names, sink: Sink) -> None:
        self._run(dict(names), sink, False)

    def text(self, **names: Any) -> str:
        out: list[str] = []
        self.render(names, lambda piece, marked: out.append(piece))
        return "".join(out)
