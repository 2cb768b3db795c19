"""A compiler for chat templates: source to syntax tree, constants folded, Python closures.

The language: text; ``{{ expression }}``; ``{% if %}``, ``{% elif %}``, ``{% else %}``, ``{% endif %}``;
``{% for x in list %}``, ``{% endfor %}`` with ``loop.index``, ``index0``, ``first`` and ``last``;
``{% set x = expression %}``; ``{% generation %}``, ``{% endgeneration %}`` round what a model is to learn; comments
``{# #}``; a minus sign inside a mark strips the white space on that side. Expressions have strings, whole numbers, lists,
names, keys (``m.role``, ``m['role']``), slices, arithmetic, ``~``, comparisons, ``in``, ``and``, ``or``, ``not``, ``a if b else c``,
filters and tests.

Sandbox: values are strings, numbers, lists and dicts; a key is looked up in dicts and lists only, never on a
Python object, and there are no calls, so nothing of the interpreter can be reached. Loops run over given lists, products are of
numbers: a template ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

MARK = re.compile(r"""(?s)\{#.*?#\}|\{\{(-?)((?:"[^"]*"|'[^']*'|.)*?)(-?)\}\}|\{%(-?)((?:"[^"]*"|'[^']*'|.)*?)(-?)%\}""")
TOKEN = re.compile(r"""\s*(?:(\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*%~<>()\[\].,|:]))""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """A template that can't be compiled or rendered."""


@dataclass(frozen=True)
class Node:
    """An expression: its kind, its parts (expressions), and what else it needs."""

    kind: str
    parts: tuple[Node, ...] = ()
    value: Any = None

    def names(self) -> set[str]:
        own = {self.value} if self.kind == "name" else set()
        return own.union(*(p.names() for p in self.parts))


@dataclass(frozen=True)
class Step:
    """A statement: text, out, if, for, set or generation."""

    kind: str
    value: Any = None
    parts: tuple[Node, ...] = ()
    bodies: tuple[tuple[Step, ...], ...] = ()

    def names(self) -> set[str]:
        return set().union(*(p.names() for p in self.parts), *(s.names() for body in self.bodies for s in body))

    def assigns(self) -> set[str]:
        own = {self.value} if self.kind == "set" else set()
        return own.union(*(s.assigns() for body in self.bodies for s in body))


UNDEFINED = type("Undefined", (), {"__repr__": lambda self: "undefined", "__bool__": lambda self: False})()


def shown(x: Any) -> str:
    return "" if x is UNDEFINED or x is None else "true" if x is True else "false" if x is False else str(x) if isinstance(x, (str, int)) else _no(f"{type(x).__name__} can't be shown")


def _no(why: str) -> Any:
    raise TemplateError(why)


def _key(x: Any, key: Any) -> Any:
    if isinstance(x, dict) and isinstance(key, str):
        return x.get(key, UNDEFINED)
    if isinstance(x, (list, str)) and type(key) is int:
        return x[key] if -len(x) <= key < len(x) else UNDEFINED
    return _no(f"{key!r} isn't a key of {type(x).__name__}")


def _number(x: Any) -> int:
    return x if type(x) is int else _no(f"{x!r} isn't a number")


def _divisor(x: Any) -> int:
    return _number(x) or _no("division by zero")


def _add(a: Any, b: Any) -> Any:
    return a + b if type(a) is type(b) and isinstance(a, (str, int, list)) else _no(f"{a!r} + {b!r}")


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "~": lambda a, b: shown(a) + shown(b), "+": _add, "-": lambda a, b: _number(a) - _number(b),
    "*": lambda a, b: _number(a) * _number(b), "//": lambda a, b: _number(a) // _divisor(b), "%": lambda a, b: _number(a) % _divisor(b),
}
LEVELS = [("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("+", "-", "~"), ("*", "//", "%")]
FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower(), "length": lambda x: len(x), "string": shown,
    "first": lambda x: _key(x, 0), "last": lambda x: _key(x, -1), "default": lambda x, y="": y if x is UNDEFINED else x, "join": lambda x, y="": shown(y).join(map(shown, x)),
}
TESTS: dict[str, Callable[[Any], bool]] = {
    "defined": lambda x: x is not UNDEFINED, "undefined": lambda x: x is UNDEFINED, "none": lambda x: x is None, "string": lambda x: isinstance(x, str),
    "odd": lambda x: _number(x) % 2 == 1, "even": lambda x: _number(x) % 2 == 0,
}
CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str, filters: dict[str, Callable[..., Any]]):
        self.tokens: list[tuple[str, Any]] = []
        self.at, self.filters, at = 0, filters, 0
        while source[at:].strip():
            m = TOKEN.match(source, at) or _no(f"unreadable: {source[at:]!r}")
            if m[1]:
                self.tokens.append(("const", int(m[1])))
            elif m[2]:
                self.tokens.append(("const", re.sub(r"(?s)\\(.)", lambda e: ESCAPES.get(e[1], e[1]), m[2][1:-1])))
            else:
                self.tokens.append(("name", m[3]) if m[3] else ("sign", m[4]))
            at = m.end()

    def next(self, *values: str) -> str | None:
        """The next token if it is one of these words or signs."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.next(value):
            _no(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return _no("a name expected")

    def whole(self) -> Node:
        out = self.choice()
        return out if self.at == len(self.tokens) else _no(f"unexpected {self.tokens[self.at][1]!r}")

    def choice(self) -> Node:
        out = self.either()
        if self.next("if"):
            test = self.either()
            other = self.choice() if self.next("else") else Node("const", value=UNDEFINED)
            out = Node("choice", (test, out, other))
        return out

    def either(self) -> Node:
        out = self.all()
        while self.next("or"):
            out = Node("or", (out, self.all()))
        return out

    def all(self) -> Node:
        out = self.negated()
        while self.next("and"):
            out = Node("and", (out, self.negated()))
        return out

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.next("not") else self.level(0)

    def level(self, i: int) -> Node:
        if i == len(LEVELS):
            return self.signed()
        out = self.level(i + 1)
        while True:
            sign = self.next(*LEVELS[i])
            if not sign and i == 0 and self.next("not"):
                self.need("in")
                sign = "not in"
            if not sign:
                return out
            out = Node("binary", (out, self.level(i + 1)), sign)

    def signed(self) -> Node:
        return Node("minus", (self.signed(),)) if self.next("-") else self.applied()

    def applied(self) -> Node:
        out = self.keyed()
        while True:
            if self.next("|"):
                name = self.name()
                if name not in self.filters:
                    _no(f"no filter {name!r}")
                out = Node("filter", (out, *(self.listed(")") if self.next("(") else ())), name)
            elif self.next("is"):
                turned, name = bool(self.next("not")), self.name()
                if name not in TESTS:
                    _no(f"no test {name!r}")
                out = Node("test", (out,), name)
                out = Node("not", (out,)) if turned else out
            else:
                return out

    def keyed(self) -> Node:
        out = self.atom()
        while True:
            if self.next("."):
                out = Node("key", (out, Node("const", value=self.name())))
            elif self.next("["):
                first = None if self.next(":") else self.choice()
                if first is not None and self.next("]"):
                    out = Node("key", (out, first))
                    continue
                if first is not None:
                    self.need(":")
                last = None if self.next("]") else self.choice()
                if last is not None:
                    self.need("]")
                none = Node("const")
                out = Node("slice", (out, first or none, last or none))
            else:
                return out

    def listed(self, end: str) -> tuple[Node, ...]:
        out: list[Node] = []
        while not self.next(end):
            if out:
                self.need(",")
            out.append(self.choice())
        return tuple(out)

    def atom(self) -> Node:
        if self.next("("):
            out = self.choice()
            self.need(")")
            return out
        if self.next("["):
            return Node("list", self.listed("]"))
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return Node("const", value=self.tokens[self.at - 1][1])
        name = self.name()
        return Node("const", value=CONSTANTS[name]) if name in CONSTANTS else Node("name", value=name)


def _evaluate(node: Node, filters: dict[str, Callable[..., Any]]) -> Callable[[dict], Any]:
    """An expression as a closure over the variables."""
    kind, value = node.kind, node.value
    f = [_evaluate(p, filters) for p in node.parts]
    if kind == "const":
        return lambda env: value
    if kind == "name":
        return lambda env: env.get(value, UNDEFINED)
    if kind == "key":
        return lambda env: _key(f[0](env), f[1](env))
    if kind == "slice":
        return lambda env: f[0](env)[f[1](env) : f[2](env)]
    if kind == "list":
        return lambda env: [x(env) for x in f]
    if kind == "and":
        return lambda env: f[0](env) and f[1](env)
    if kind == "or":
        return lambda env: f[0](env) or f[1](env)
    if kind == "not":
        return lambda env: not f[0](env)
    if kind == "minus":
        return lambda env: -_number(f[0](env))
    if kind == "choice":
        return lambda env: f[1](env) if f[0](env) else f[2](env)
    apply = {"binary": BINARY, "test": TESTS, "filter": filters}[kind][value]
    if len(f) == 1:
        return lambda env: apply(f[0](env))
    return lambda env: apply(*[x(env) for x in f])


def fold(node: Node, filters: dict[str, Callable[..., Any]]) -> Node:
    """The same expression; a part without names is its value. What can't be evaluated stays, and fails where it is rendered."""
    parts = tuple(fold(p, filters) for p in node.parts)
    node = Node(node.kind, parts, node.value)
    if node.kind in ("const", "name"):
        return node
    if all(p.kind == "const" for p in parts):
        try:
            return Node("const", value=_evaluate(node, filters)({}))
        except (TemplateError, TypeError):
            return node
    if node.kind == "choice" and parts[0].kind == "const":
        return parts[1] if parts[0].value else parts[2]
    if node.kind in ("and", "or") and parts[0].kind == "const":
        return parts[1] if bool(parts[0].value) == (node.kind == "and") else parts[0]
    return node


def fold_steps(steps: list[Step], filters: dict[str, Callable[..., Any]]) -> tuple[Step, ...]:
    """Statements with folded expressions; constants become text, texts side by side one, settled branches their body."""
    out: list[Step] = []
    for s in steps:
        parts, bodies = tuple(fold(p, filters) for p in s.parts), [fold_steps(list(b), filters) for b in s.bodies]
        if s.kind == "if":
            kept: list[tuple[Node, tuple[Step, ...]]] = []
            for test, body in zip(parts, bodies, strict=True):
                if test.kind != "const" or test.value:
                    kept.append((test, body))
                if test.kind == "const" and test.value:
                    break
            if not kept:
                continue
            if kept[0][0].kind == "const":
                more = list(kept[0][1])
            else:
                more = [Step("if", None, tuple(t for t, _ in kept), tuple(b for _, b in kept))]
        elif s.kind == "out" and parts[0].kind == "const":
            more = [Step("text", shown(parts[0].value))]
        else:
            more = [Step(s.kind, s.value, parts, tuple(bodies))]
        for one in more:
            if one.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Step("text", out[-1].value + one.value)
            elif one.kind != "text" or one.value:
                out.append(one)
    return tuple(out)


@dataclass
class Output:
    """Rendered pieces, their length in code points, and the spans under generation marks."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


Closure = Callable[[dict, Output], None]


def _run(steps: tuple[Step, ...], filters: dict[str, Callable[..., Any]]) -> Closure:
    """Statements as one closure that writes to an output."""
    made = [_statement(s, filters) for s in steps]
    if len(made) == 1:
        return made[0]

    def run(env: dict, out: Output) -> None:
        for one in made:
            one(env, out)

    return run


def _statement(step: Step, filters: dict[str, Callable[..., Any]]) -> Closure:
    bodies, value = [_run(b, filters) for b in step.bodies], step.value
    f = [_evaluate(p, filters) for p in step.parts]
    if step.kind == "text":
        return lambda env, out: out.put(value)
    if step.kind == "out":
        return lambda env, out: out.put(shown(f[0](env)))
    if step.kind == "set":
        return lambda env, out: env.__setitem__(value, f[0](env))
    if step.kind == "if":
        branches = list(zip(f, bodies, strict=True))

        def choose(env: dict, out: Output) -> None:
            for test, body in branches:
                if test(env):
                    body(env, out)
                    return

        return choose
    if step.kind == "generation":

        def marked(env: dict, out: Output) -> None:
            start = out.length
            bodies[0](env, out)
            if out.length > start:
                out.spans.append((start, out.length))

        return marked

    def loop(env: dict, out: Output) -> None:
        items = f[0](env)
        if not isinstance(items, list):
            _no(f"{value} runs over {type(items).__name__}")
        for i, item in enumerate(items):
            bodies[0]({**env, value: item, "loop": place(i, i + 1 == len(items))}, out)

    return loop


def place(index: int, last: bool) -> dict[str, Any]:
    return {"index": index + 1, "index0": index, "first": index == 0, "last": last}


def parse(source: str, filters: dict[str, Callable[..., Any]]) -> list[Step]:
    """The syntax tree of a template."""
    expression = lambda s: _Expression(s, filters).whole()
    #: Open blocks: their kind and value, tests, finished bodies, and the body being filled.
    stack: list[tuple[str, Any, list[Node], list[list[Step]], list[Step]]] = [("", None, [], [], [])]
    at, strip = 0, False

    def text(end: int, cut: bool) -> None:
        piece = source[at:end]
        piece = piece.lstrip() if strip else piece
        stack[-1][4].append(Step("text", piece.rstrip() if cut else piece))

    for m in MARK.finditer(source):
        text(m.start(), bool(m[1] or m[4]))
        at, strip = m.end(), bool(m[3] or m[6])
        if m[2] is not None:
            stack[-1][4].append(Step("out", None, (expression(m[2]),)))
        elif m[5] is not None:
            word, _, rest = m[5].strip().partition(" ")
            kind, value, tests, done, body = stack[-1]
            if word in ("if", "for", "generation"):
                if word == "for":
                    name, sign, rest = rest.strip().partition(" in ")
                    if not sign or not name.strip().isidentifier():
                        _no(f"for {rest!r}")
                    stack.append(("for", name.strip(), [expression(rest)], [], []))
                else:
                    stack.append((word, None, [expression(rest)] if word == "if" else [], [], []))
            elif word in ("elif", "else") and kind == "if" and value is None:
                done.append(list(body))
                body.clear()
                tests.append(expression(rest) if word == "elif" else Node("const", value=True))
                stack[-1] = (kind, None if word == "elif" else "else", tests, done, body)
            elif word == f"end{kind}" and kind:
                stack.pop()
                stack[-1][4].append(Step(kind, None if kind == "if" else value, tuple(tests), tuple(tuple(b) for b in [*done, body])))
            elif word == "set":
                name, sign, value_ = rest.partition("=")
                if not sign or not name.strip().isidentifier():
                    _no(f"set {rest!r}")
                stack[-1][4].append(Step("set", name.strip(), (expression(value_),)))
            else:
                _no(f"unexpected {word!r}")
    text(len(source), False)
    return stack[0][4] if len(stack) == 1 else _no(f"{stack[-1][0]} isn't closed")


class Template:
    """A compiled template; ``escape`` is a filter of its own if given."""

    def __init__(self, source: str, escape: Callable[[str], str] | None = None):
        self.filters = FILTERS | ({"escape": lambda x: escape(shown(x))} if escape else {})
        self.tree = fold_steps(parse(source, self.filters), self.filters)
        self._all = _run(self.tree, self.filters)
        turns = [s for s in self.tree if s.kind == "for" and s.parts[0] == Node("name", value="messages")]
        rest = [s for s in self.tree if s not in turns]
        #: Whether turns can be rendered one after the other, without the list of them.
        self.stepwise = len(turns) == 1 and not any({"messages", "loop"} & s.names() or s.assigns() for s in rest) and "messages" not in set().union(*(s.names() for s in turns[0].bodies[0]))
        if self.stepwise:
            i = self.tree.index(turns[0])
            self.turn_name, self.body = turns[0].value, turns[0].bodies[0]
            self._head, self._turn, self._tail = _run(self.tree[:i], self.filters), _run(self.body, self.filters), _run(self.tree[i + 1 :], self.filters)

    def render(self, messages: list[dict[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The text of a conversation, and the spans that a model is to learn."""
        out = Output()
        self._all({"messages": messages}, out)
        return "".join(out.pieces), out.spans

    def head(self, out: Output) -> None:
        self._head({}, out)

    def turn(self, message: dict[str, str], index: int, last: bool, out: Output) -> None:
        self._turn({self.turn_name: message, "loop": place(index, last)}, out)

    def tail(self, out: Output) -> None:
        self._tail({}, out)
