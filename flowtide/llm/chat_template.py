"""A small sandboxed template language, compiled to Python closures.

Source text is cut into tokens, parsed into a syntax tree, folded, and turned into nested closures. There is no ``eval``, no
attribute access on Python objects and no call except the named filters, so a template can only read the values it is given.

Syntax: ``{{ expr }}``, ``{% for x in expr %}..{% endfor %}``, ``{% if e %}..{% elif e %}..{% else %}..{% endif %}``,
``{% generation %}..{% endgeneration %}`` (marks text that a model is trained on), ``{# comment #}``. Expressions: names,
dotted fields of mappings, string and integer literals, ``+ == != and or not in``, parentheses and filters ``expr | name``.
``{%-`` and ``-%}`` strip the white space beside them. Inside a loop, ``loop`` has index, index0, first, last, previtem and nextitem;
an inner loop has its own. Null values and fields that an item lacks render as empty. Where the names that a template may read are
given, any other name or field is refused when it is compiled; else missing names render as empty too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

Scope = dict
#: The fields of ``loop``.
LOOP = ("index", "index0", "first", "last", "previtem", "nextitem")
#: Names that a template may read, with the fields of each (None: any).
Names = dict[str, tuple[str, ...] | None]
#: One rendered piece: text and whether it lies in a generation block.
Piece = tuple[str, bool | None]


class Stream:
    """A sequence that can be looped over once. A loop over it gives out :data:`STEP` before each item."""

    def __init__(self, items: Iterator) -> None:
        self.items = items

    def __iter__(self) -> Iterator:
        return self.items


#: The piece before each item of a stream: no text, and no place in or out of a generation block.
STEP = ("", None)
_END = object()


class TemplateError(ValueError):
    """The template can't be compiled."""


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: object


@dataclass(frozen=True)
class Output:
    expr: object


@dataclass(frozen=True)
class For:
    var: str
    source: object
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


_CHUNK = re.compile(r"\{#.*?#\}|\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}", re.S)
_LEX = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sym>==|!=|[|+().]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


def _lex(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text in expression: {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expr:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, tokens: list[tuple[str, str]], filters: dict) -> None:
        self.tokens, self.at, self.filters = tokens, 0, filters

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("sym", "name") and self.tokens[self.at][1] in texts

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> object:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at:]}")
        return node

    def either(self) -> object:
        node = self.both()
        while self.peek("or"):
            self.take()
            node = Op("or", (node, self.both()))
        return node

    def both(self) -> object:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = Op("and", (node, self.negated()))
        return node

    def negated(self) -> object:
        if self.peek("not"):
            self.take()
            return Op("not", (self.negated(),))
        return self.compared()

    def compared(self) -> object:
        node = self.summed()
        if self.peek("==", "!=", "in"):
            node = Op(self.take()[1], (node, self.summed()))
        return node

    def summed(self) -> object:
        node = self.filtered()
        while self.peek("+"):
            self.take()
            node = Op("+", (node, self.filtered()))
        return node

    def filtered(self) -> object:
        node = self.atom()
        while self.peek("|"):
            self.take()
            kind, name = self.take()
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            node = Filter(name, node)
        return node

    def atom(self) -> object:
        kind, text = self.take()
        if kind == "str":
            return Lit(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        if kind == "int":
            return Lit(int(text))
        if kind == "name":
            path = [text]
            while self.peek("."):
                self.take()
                kind, field = self.take()
                if kind != "name" or field.startswith("_"):
                    raise TemplateError(f"not a field: {field!r}")
                path.append(field)
            return Name(tuple(path))
        if text == "(":
            node = self.either()
            if not self.peek(")"):
                raise TemplateError("missing )")
            self.take()
            return node
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str, filters: dict) -> tuple:
    """The syntax tree of a template: a tuple of nodes."""
    stack: list[tuple[str, object, list]] = [("top", None, [])]
    at, strip_next = 0, False

    def emit(text: str, strip_end: bool) -> None:
        if strip_next:
            text = text.lstrip()
        if strip_end:
            text = text.rstrip()
        if text:
            stack[-1][2].append(Text(text))

    for m in _CHUNK.finditer(source):
        emit(source[at : m.start()], m[0][2:3] == "-")
        at, strip_next = m.end(), m[0][-3:-2] == "-"
        if m[1] is not None:
            stack[-1][2].append(Output(_Expr(_lex(m[1]), filters).parse()))
        elif m[2] is not None:
            words = _lex(m[2])
            if not words or words[0][0] != "name":
                raise TemplateError(f"empty statement {m[0]!r}")
            head, rest = words[0][1], words[1:]
            if head == "for":
                if len(rest) < 3 or rest[0][0] != "name" or rest[1] != ("name", "in"):
                    raise TemplateError(f"bad loop {m[0]!r}")
                stack.append(("for", (rest[0][1], _Expr(rest[2:], filters).parse()), []))
            elif head == "if":
                stack.append(("if", ([], _Expr(rest, filters).parse()), []))
            elif head in ("elif", "else"):
                if stack[-1][0] != "if":
                    raise TemplateError(f"{head} outside if")
                _, (arms, cond), body = stack.pop()
                stack.append(("if", ([*arms, (cond, tuple(body))], Lit(True) if head == "else" else _Expr(rest, filters).parse()), []))
            elif head == "generation":
                stack.append(("generation", None, []))
            elif head in ("endfor", "endif", "endgeneration"):
                kind, data, body = stack.pop()
                if kind != head[3:]:
                    raise TemplateError(f"{head} closes {kind}")
                if kind == "for":
                    node: object = For(data[0], data[1], tuple(body))
                elif kind == "if":
                    node = If((*data[0], (data[1], tuple(body))))
                else:
                    node = Generation(tuple(body))
                stack[-1][2].append(node)
            else:
                raise TemplateError(f"unknown statement {head!r}")
    emit(source[at:], False)
    if len(stack) != 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return tuple(stack[0][2])


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _apply(kind: str, values: list) -> object:
    if kind == "+":
        a, b = values
        return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)
    if kind == "not":
        return not values[0]
    a, b = values
    return a == b if kind == "==" else a != b if kind == "!=" else b is not None and a in b


def fold(node: object, filters: dict) -> object:
    """Constant folding: literal expressions are evaluated once, dead arms go, neighbouring texts merge."""
    if isinstance(node, tuple):
        out: list = []
        for x in (fold(y, filters) for y in node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + y.value)
                elif not (isinstance(y, Text) and not y.value):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Output):
        e = fold(node.expr, filters)
        return Text(_text(e.value)) if isinstance(e, Lit) else Output(e)
    if isinstance(node, Filter):
        arg = fold(node.arg, filters)
        return Lit(filters[node.name](_text(arg.value))) if isinstance(arg, Lit) else Filter(node.name, arg)
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if node.kind in ("and", "or") and isinstance(args[0], Lit):
            return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
        if node.kind not in ("and", "or") and all(isinstance(a, Lit) for a in args):
            return Lit(_apply(node.kind, [a.value for a in args]))
        return Op(node.kind, args)
    if isinstance(node, If):
        arms = []
        for cond, body in node.arms:
            cond = fold(cond, filters)
            if isinstance(cond, Lit) and not cond.value:
                continue
            arms.append((cond, fold(body, filters)))
            if isinstance(cond, Lit):
                break
        if not arms:
            return ()
        return arms[0][1] if isinstance(arms[0][0], Lit) else If(tuple(arms))
    if isinstance(node, For):
        return For(node.var, fold(node.source, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


def _expr(node: object, filters: dict) -> Callable[[Scope], object]:
    if isinstance(node, Lit):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        head, *rest = node.path

        def read(scope: Scope) -> object:
            value = scope.get(head)
            for field in rest:
                value = value.get(field) if isinstance(value, dict) else None
            return value

        return read
    if isinstance(node, Filter):
        f, arg = filters[node.name], _expr(node.arg, filters)
        return lambda scope: f(_text(arg(scope)))
    parts = [_expr(a, filters) for a in node.args]
    kind = node.kind
    if kind == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if kind == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    return lambda scope: _apply(kind, [p(scope) for p in parts])


def _body(nodes: tuple, filters: dict) -> Callable[[Scope, bool], Iterator[Piece]]:
    steps = [_node(n, filters) for n in nodes]

    def run(scope: Scope, inside: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, inside)

    return run


def _node(node: object, filters: dict) -> Callable[[Scope, bool], Iterator[Piece]]:
    if isinstance(node, Text):
        value = node.value
        return lambda scope, inside: ((value, inside),)
    if isinstance(node, Output):
        e = _expr(node.expr, filters)
        return lambda scope, inside: ((_text(e(scope)), inside),)
    if isinstance(node, Generation):
        body = _body(node.body, filters)
        return lambda scope, inside: body(scope, True)
    if isinstance(node, If):
        arms = [(_expr(c, filters), _body(b, filters)) for c, b in node.arms]

        def choose(scope: Scope, inside: bool) -> Iterator[Piece]:
            for cond, body in arms:
                if cond(scope):
                    yield from body(scope, inside)
                    return

        return choose
    var, source, body = node.var, _expr(node.source, filters), _body(node.body, filters)

    def loop(scope: Scope, inside: bool) -> Iterator[Piece]:
        items = source(scope) or ()
        rest, before, index = iter(items), None, 0
        item = next(rest, _END)
        while item is not _END:
            after = next(rest, _END)
            if isinstance(items, Stream):
                yield STEP
            state = {"index": index + 1, "index0": index, "first": not index, "last": after is _END, "previtem": before, "nextitem": None if after is _END else after}
            yield from body({**scope, var: item, "loop": state}, inside)
            before, item, index = item, after, index + 1

    return loop


def check_names(node: object, names: Names, items: dict[str, tuple[str, ...]]) -> None:
    """Refuses names and fields that aren't bound. items: for a sequence, the fields of its items."""
    if isinstance(node, tuple):
        for x in node:
            check_names(x, names, items)
    elif isinstance(node, Name):
        head, *fields = node.path
        if head not in names:
            raise TemplateError(f"{head!r} isn't known")
        known = names[head]
        if fields and known is not None and fields[0] not in known:
            raise TemplateError(f"{head!r} has no field {fields[0]!r}")
        if head == "loop" and len(fields) > 1 and fields[0] in ("previtem", "nextitem") and names.get("loop items") is not None and fields[1] not in names["loop items"]:
            raise TemplateError(f"items have no field {fields[1]!r}")
    elif isinstance(node, For):
        check_names(node.source, names, items)
        fields = items.get(node.source.path[0]) if isinstance(node.source, Name) and len(node.source.path) == 1 else None
        check_names(node.body, {**names, node.var: fields, "loop": LOOP, "loop items": fields}, items)
    elif isinstance(node, If):
        for cond, body in node.arms:
            check_names(cond, names, items)
            check_names(body, names, items)
    elif isinstance(node, Generation):
        check_names(node.body, names, items)
    elif isinstance(node, Output):
        check_names(node.expr, names, items)
    elif isinstance(node, Filter):
        check_names(node.arg, names, items)
    elif isinstance(node, Op):
        check_names(node.args, names, items)


def uses(node: object, name: str) -> int:
    """How often a name is read."""
    if isinstance(node, Name):
        return int(node.path[0] == name)
    if isinstance(node, tuple):
        return sum(uses(x, name) for x in node)
    parts = getattr(node, "__dict__", {})
    return sum(uses(x, name) for x in parts.values())


def check_streamed(tree: tuple, name: str) -> None:
    """Refuses a template unless its one use of ``name`` is a loop over it that is in no other loop: then it can be read once, in order."""

    def loops(node: object) -> int:
        if isinstance(node, tuple):
            return sum(map(loops, node))
        if isinstance(node, For):
            return int(node.source == Name((name,)))
        if isinstance(node, If):
            return sum(loops(body) for _, body in node.arms)
        return loops(node.body) if isinstance(node, Generation) else 0

    if loops(tree) != 1 or uses(tree, name) != 1:
        raise TemplateError(f"{name!r} must be looped over once and not be read otherwise")


def compile_template(
    source: str, filters: dict[str, Callable[[str], str]] | None = None, names: Names | None = None, items: dict[str, tuple[str, ...]] | None = None, streamed: str | None = None,
) -> Callable[[Scope], Iterator[Piece]]:
    """A function from a scope to the rendered pieces. Loops over iterators stream: no more than an item and the next one are held.

    names: what may be read; items: the fields of a sequence's items; streamed: a sequence that must be read once.
    """
    filters = filters or {}
    tree = parse(source, filters)
    if names is not None:
        check_names(tree, names, items or {})
    tree = fold(tree, filters)
    if streamed:
        check_streamed(tree, streamed)
    run = _body(tree, filters)
    return lambda scope: run(dict(scope), False)
