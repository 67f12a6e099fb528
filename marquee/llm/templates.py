"""A small template language for chats: parsed into a tree, folded, made into closures.

    {% for message in messages %}…{% endfor %}      {# a comment #}
    {% if condition %}…{% elif condition %}…{% else %}…{% endif %}
    {{ expression | filter }}
    {% generation %}…{% endgeneration %}             what a model is trained on

Expressions have texts, whole numbers, true, false, none, names, ``name.field``,
``==`` ``!=`` ``+`` ``and`` ``or`` ``not``, brackets and the filters of ``FILTERS``.
There are no calls and no access to Python objects: names are ``messages``, the
loop's variable, ``loop`` (``index``, ``index0``, ``first``, ``last``) and what the
caller passes; fields are those of ``MESSAGE_FIELDS`` and of ``loop``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

# Characters that control strings are made of; the first one marks the others.
ESCAPED = "\\<>"
MARK = re.compile(r"[\\<>]")
MARKED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """The text without control strings: each of their characters gets a mark."""
    return MARK.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return MARKED.sub(r"\1", text)


FILTERS: dict[str, Callable[[object], object]] = {
    "escape": lambda v: escape(as_text(v)),
    "upper": lambda v: as_text(v).upper(),
    "lower": lambda v: as_text(v).lower(),
    "trim": lambda v: as_text(v).strip(),
    "length": lambda v: len(as_text(v)),
}
MESSAGE_FIELDS = ("role", "text")
LOOP_FIELDS = ("index", "index0", "first", "last")


class TemplateError(ValueError):
    pass


def as_text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only texts and numbers can be written")


# The tree.


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Field:
    of: object
    name: str


@dataclass
class Op:
    kind: str
    parts: list


@dataclass
class Filtered:
    of: object
    name: str


@dataclass
class Text:
    text: str


@dataclass
class Output:
    value: object


@dataclass
class If:
    branches: list[tuple[object, list]]  # a condition of None is the else


@dataclass
class For:
    name: str
    over: object
    body: list


@dataclass
class Generation:
    body: list


PARTS = re.compile(r"(\{%.*?%\}|\{\{.*?\}\}|\{#.*?#\})", re.DOTALL)
TOKENS = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|().]))""")
STRING_MARKS = {"n": "\n", "t": "\t"}


class Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            found = TOKENS.match(source, at)
            if not found:
                raise TemplateError(f"not understood: {source[at:]!r}")
            kind = ("text", "number", "name", "sign")[found.lastindex - 1]
            self.tokens.append((kind, found[found.lastindex]))
            at = found.end()
        self.at = 0

    def peek(self) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "sign"):
            return self.tokens[self.at][1]
        return None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> object:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> object:
        tree = self.both()
        while self.take("or"):
            tree = Op("or", [tree, self.both()])
        return tree

    def both(self) -> object:
        tree = self.negated()
        while self.take("and"):
            tree = Op("and", [tree, self.negated()])
        return tree

    def negated(self) -> object:
        return Op("not", [self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> object:
        tree = self.added()
        while sign := self.take("==", "!="):
            tree = Op(sign, [tree, self.added()])
        return tree

    def added(self) -> object:
        tree = self.filtered()
        while self.take("+"):
            tree = Op("+", [tree, self.filtered()])
        return tree

    def filtered(self) -> object:
        tree = self.primary()
        while self.take("|"):
            kind, name = self.next()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = Filtered(tree, name)
        return tree

    def next(self) -> tuple[str, str]:
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def primary(self) -> object:
        kind, token = self.next()
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: STRING_MARKS.get(m[1], m[1]), token[1:-1], flags=re.DOTALL))
        if kind == "number":
            return Const(int(token))
        if token == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return tree
        if kind != "name" or token in ("and", "or", "not"):
            raise TemplateError(f"unexpected {token!r}")
        if token in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[token])
        tree: object = Name(token)
        while self.take("."):
            kind, name = self.next()
            if kind != "name" or name not in (*MESSAGE_FIELDS, *LOOP_FIELDS):
                raise TemplateError(f"no field {name!r}")
            tree = Field(tree, name)
        return tree


def parse(source: str) -> list:
    """The tree of a template."""
    parts = [p for p in PARTS.split(source) if p and not p.startswith("{#")]
    at = 0

    def block(*ends: str) -> tuple[list, str, str]:
        nonlocal at
        nodes: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(Output(Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return nodes, word, rest
                nodes.append(statement(word, rest))
            else:
                nodes.append(Text(part))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, "", ""

    def statement(word: str, rest: str) -> object:
        if word == "generation":
            return Generation(block("endgeneration")[0])
        if word == "for":
            found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not found:
                raise TemplateError("for needs a name and what to go through")
            return For(found[1], Expression(found[2]).whole(), block("endfor")[0])
        if word == "if":
            branches, condition = [], Expression(rest).whole()
            while True:
                body, end, rest = block("elif", "else", "endif")
                branches.append((condition, body))
                if end == "endif":
                    return If(branches)
                condition = Expression(rest).whole() if end == "elif" else None
        raise TemplateError(f"no statement {word!r}")

    return block()[0]


def folded(tree: object) -> object:
    """An expression with its constant parts worked out."""
    if isinstance(tree, Field):
        return Field(folded(tree.of), tree.name)
    if isinstance(tree, Filtered):
        of = folded(tree.of)
        return Const(FILTERS[tree.name](of.value)) if isinstance(of, Const) else Filtered(of, tree.name)
    if isinstance(tree, Op):
        parts = [folded(p) for p in tree.parts]
        if all(isinstance(p, Const) for p in parts):
            return Const(operate(tree.kind, [lambda _, v=p.value: v for p in parts])(None))
        return Op(tree.kind, parts)
    return tree


def fold(nodes: list) -> list:
    """Nodes with constant expressions as text, decided branches, and texts joined."""
    out: list = []

    def add(node: object) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif not isinstance(node, Text) or node.text:
            out.append(node)

    for node in nodes:
        if isinstance(node, Output):
            value = folded(node.value)
            add(Text(as_text(value.value)) if isinstance(value, Const) else Output(value))
        elif isinstance(node, If):
            branches: list[tuple[object, list]] = []
            for condition, body in node.branches:
                condition = None if condition is None else folded(condition)
                if isinstance(condition, Const):
                    if not condition.value:
                        continue
                    condition = None
                branches.append((condition, fold(body)))
                if condition is None:
                    break
            if branches and branches[0][0] is None:
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(If(branches))
        elif isinstance(node, For):
            add(For(node.name, folded(node.over), fold(node.body)))
        elif isinstance(node, Generation):
            if body := fold(node.body):
                add(Generation(body))
        else:
            add(node)
    return out


Value = Callable[[dict], object]


def operate(kind: str, parts: list[Value]) -> Value:
    if kind == "not":
        (a,) = parts
        return lambda names: not a(names)
    a, b = parts
    if kind == "==":
        return lambda names: a(names) == b(names)
    if kind == "!=":
        return lambda names: a(names) != b(names)
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)

    def plus(names: dict) -> object:
        x, y = a(names), b(names)
        if isinstance(x, int) and isinstance(y, int):
            return x + y
        return as_text(x) + as_text(y)

    return plus


def value_of(tree: object) -> Value:
    """A closure that works out an expression."""
    if isinstance(tree, Const):
        value = tree.value
        return lambda names: value
    if isinstance(tree, Name):
        name = tree.name

        def look_up(names: dict) -> object:
            if name not in names:
                raise TemplateError(f"no name {name!r}")
            return names[name]

        return look_up
    if isinstance(tree, Field):
        of, key = value_of(tree.of), tree.name

        def get(names: dict) -> object:
            owner = of(names)
            if not isinstance(owner, dict) or key not in owner:
                raise TemplateError(f"no field {key!r}")
            return owner[key]

        return get
    if isinstance(tree, Filtered):
        of, change = value_of(tree.of), FILTERS[tree.name]
        return lambda names: change(of(names))
    return operate(tree.kind, [value_of(p) for p in tree.parts])


@dataclass
class Writer:
    """Text written so far and the stretches of it that are generated."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    generated: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        out = "".join(self.parts), self.generated
        self.parts, self.size, self.generated = [], 0, []
        return out


Step = Callable[[dict, Writer], None]


def steps(nodes: list) -> Step:
    """A closure that writes the nodes."""
    made = [step(n) for n in nodes]

    def run(names: dict, out: Writer) -> None:
        for one in made:
            one(names, out)

    return made[0] if len(made) == 1 else run


def loop_over(messages: Iterable[dict]) -> Iterator[tuple[dict, dict]]:
    """Messages with their ``loop``; one is read ahead, so that the last is known."""
    index, ahead = 0, None
    for following in messages:
        if ahead is not None:
            yield ahead, {"index": index, "index0": index - 1, "first": index == 1, "last": False}
        ahead, index = following, index + 1
    if ahead is not None:
        yield ahead, {"index": index, "index0": index - 1, "first": index == 1, "last": True}


def step(node: object) -> Step:
    if isinstance(node, Text):
        text = node.text
        return lambda names, out: out.write(text)
    if isinstance(node, Output):
        value = value_of(node.value)
        return lambda names, out: out.write(as_text(value(names)))
    if isinstance(node, If):
        branches = [(None if c is None else value_of(c), steps(body)) for c, body in node.branches]

        def choose(names: dict, out: Writer) -> None:
            for condition, body in branches:
                if condition is None or condition(names):
                    return body(names, out)

        return choose
    if isinstance(node, Generation):
        body = steps(node.body)

        def generate(names: dict, out: Writer) -> None:
            start = out.size
            body(names, out)
            if out.size > start:
                out.generated.append((start, out.size))

        return generate
    name, over, body = node.name, value_of(node.over), steps(node.body)

    def go_through(names: dict, out: Writer) -> None:
        for message, loop in loop_over(over(names)):
            body(names | {name: message, "loop": loop}, out)

    return go_through


class Template:
    """A template ready to write conversations, piece by piece."""

    def __init__(self, source: str) -> None:
        self.tree = fold(parse(source))
        # Outer loops over the messages give a piece each time around.
        self.made: list[tuple[For | None, Step]] = []
        for node in self.tree:
            if isinstance(node, For) and node.over == Name("messages"):
                self.made.append((node, steps(node.body)))
            else:
                self.made.append((None, step(node)))
        if sum(1 for loop, _ in self.made if loop is not None) > 1:
            raise TemplateError("one outer loop over the messages is allowed, as they are read once")

    def pieces(self, messages: Iterable[dict], **names: object) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Texts whose concatenation is the conversation, each with its generated stretches."""
        out, names = Writer(), {**names, "messages": messages}
        for loop, run in self.made:
            if loop is None:
                run(names, out)
                continue
            for message, place in loop_over(messages):
                run(names | {loop.name: message, "loop": place}, out)
                yield out.take()
        if out.parts:
            yield out.take()
