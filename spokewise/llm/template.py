"""A small sandboxed template language, compiled to Python closures.

``{{ expression }}`` writes a value, ``{% if %} {% elif %} {% else %} {% endif %}`` chooses, ``{% for x in list %}
{% else %} {% endfor %}`` repeats (with ``loop.index, loop.first, loop.last``), ``{% set name = expression %}`` binds,
``{% generation %} {% endgeneration %}`` marks what a model is to learn, ``{# #}`` is a comment; a ``-`` inside a
bracket takes the white space on its side. Expressions: strings, numbers, ``true false none``, names, ``a.b``,
``a["b"]``, ``==  !=  <  <=  >  >=  in  not  and  or``, ``+ - ~``, ``a if b else c``, ``is defined``, and
``value | filter(arguments)``.

Sandbox: a template sees only the values it is given. A dot or bracket reads a key of a mapping or a place of a list,
never an attribute; only named filters are called; a loop goes over a list that was given, so all templates end.

A template is read into a tree of tuples; parts without names are evaluated at once, and branches that can't be
taken dropped; then each node becomes a closure. Statements yield pieces of output, so a loop over a stream of
messages holds one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from operator import eq, ge, gt, le, lt, ne

MARKUP = re.compile(r"\{\{-?|\{%-?|\{#")
TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+\-~|().\[\],=]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
KEYWORDS = {"and", "or", "not", "in", "is", "if", "else", "for", "set"}
COMPARE: dict[str, Callable] = {"==": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b}

#: Yielded where a marked stretch begins and ends, and after each pass of an outermost loop.
BEGIN, END, TURN = object(), object(), object()


class TemplateError(ValueError):
    """A template that can't be read, or an expression without a value."""


class Undefined:
    """What a missing name or key gives: empty as text, false, and an error in anything else."""

    def __str__(self) -> str:
        return ""

    def __bool__(self) -> bool:
        return False


UNDEFINED = Undefined()


def text_of(v: object) -> str:
    if v is None:
        return "none"
    return v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: text_of(v).strip(),
    "upper": lambda v: text_of(v).upper(),
    "lower": lambda v: text_of(v).lower(),
    "capitalize": lambda v: text_of(v).capitalize(),
    "replace": lambda v, old, new: text_of(v).replace(old, new),
    "default": lambda v, other: other if v is UNDEFINED or v is None else v,
    "length": len,
    "string": text_of,
}


# --- text to tree -------------------------------------------------------------------------------------


def lexed(source: str) -> Iterator[tuple[str, object]]:
    """``("text", s)``, ``("out", tokens)`` and ``("tag", tokens)``, in order."""
    at, strip = 0, False
    while at < len(source):
        m = MARKUP.search(source, at)
        end = m.start() if m else len(source)
        text = source[at:end]
        text = text.lstrip() if strip else text
        if m and m.group().endswith("-"):
            text = text.rstrip()
        if text:
            yield "text", text
        if not m:
            return
        if m.group() == "{#":
            close = source.find("#}", m.end())
            if close < 0:
                raise TemplateError("a comment is not closed")
            at, strip = close + 2, False
            continue
        closing = "}}" if m.group().startswith("{{") else "%}"
        tokens, at = [], m.end()
        while not (c := re.compile(r"\s*(-?)" + re.escape(closing)).match(source, at)):
            t = TOKEN.match(source, at)
            if not t:
                raise TemplateError(f"unreadable near {source[at : at + 20]!r}")
            tokens.append((t.lastgroup, t.group(t.lastgroup)))
            at = t.end()
        at, strip = c.end(), bool(c.group(1))
        yield ("out" if closing == "}}" else "tag"), tokens


class Parser:
    """Recursive descent over the tokens of one bracket, and over the brackets of a template."""

    def __init__(self, filters: Mapping[str, Callable], constants: Mapping[str, object]):
        self.filters, self.constants, self.tokens, self.at = filters, constants, [], 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in words

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def want(self, *words: str) -> str:
        if (got := self.take(*words)) is None:
            raise TemplateError(f"{' or '.join(words)} is missing")
        return got

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at][1] not in KEYWORDS:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def new_name(self) -> str:
        if (name := self.name()) in self.constants:
            raise TemplateError(f"{name} is a constant")
        return name

    def choice(self) -> tuple:
        a = self.either()
        if self.take("if"):
            test = self.either()
            self.want("else")
            return "pick", test, a, self.choice()
        return a

    def either(self) -> tuple:
        a = self.both()
        while self.take("or"):
            a = ("or", a, self.both())
        return a

    def both(self) -> tuple:
        a = self.negated()
        while self.take("and"):
            a = ("and", a, self.negated())
        return a

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        a = self.summed()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                a = ("compare", op, a, self.summed())
            elif self.take("not"):
                self.want("in")
                a = ("compare", "not in", a, self.summed())
            elif self.take("is"):
                no = self.take("not")
                self.want("defined")
                a = ("not", ("defined", a)) if no else ("defined", a)
            else:
                return a

    def summed(self) -> tuple:
        a = self.filtered()
        while op := self.take("+", "-", "~"):
            a = ("sum", op, a, self.filtered())
        return a

    def filtered(self) -> tuple:
        a = self.reached()
        while self.take("|"):
            f, more = self.name(), []
            if f not in self.filters:
                raise TemplateError(f"no filter {f}")
            if self.take("("):
                while not self.take(")"):
                    more.append(self.choice())
                    if not self.peek(")"):
                        self.want(",")
            a = ("filter", f, a, *more)
        return a

    def reached(self) -> tuple:
        a = self.atom()
        while True:
            if self.take("."):
                a = ("key", a, ("const", self.name()))
            elif self.take("["):
                a = ("key", a, self.choice())
                self.want("]")
            else:
                return a

    def atom(self) -> tuple:
        if self.take("("):
            a = self.choice()
            self.want(")")
            return a
        if self.take("-"):
            return "sum", "-", ("const", 0), self.reached()
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, word = self.tokens[self.at]
        if kind == "name" and word not in WORDS:
            name = self.name()
            return ("const", self.constants[name]) if name in self.constants else ("name", name)
        self.at += 1
        if kind == "num":
            return "const", float(word) if "." in word else int(word)
        if kind == "str":
            return "const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m.group(1), m.group()), word[1:-1], flags=re.S)
        if kind == "name":
            return "const", WORDS[word]
        raise TemplateError(f"{word} is out of place")

    def expression(self, tokens: list) -> tuple:
        self.tokens, self.at = tokens, 0
        a = self.choice()
        self.done()
        return a

    def done(self) -> None:
        if self.at != len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]} is out of place")

    def block(self, parts: Iterator, *until: str) -> tuple[list[tuple], str]:
        """Nodes up to a tag of ``until``, whose other tokens are left in ``self.tokens``."""
        nodes: list[tuple] = []
        for kind, got in parts:
            if kind == "text":
                nodes.append(("write", ("const", got)))
            elif kind == "out":
                nodes.append(("write", self.expression(got)))
            else:
                self.tokens, self.at = got, 0
                if word := self.take(*until):
                    return nodes, word
                nodes.append(self.statement(parts))
        if until:
            raise TemplateError(f"{until[-1]} is missing")
        return nodes, ""

    def statement(self, parts: Iterator) -> tuple:
        word = self.want("if", "for", "set", "generation")
        if word == "set":
            name = self.new_name()
            self.want("=")
            value = self.choice()
            self.done()
            return "set", name, value
        if word == "generation":
            self.done()
            body, _ = self.block(parts, "endgeneration")
            self.done()
            return "mark", body
        if word == "for":
            name = self.new_name()
            self.want("in")
            over = self.choice()
            self.done()
            body, end = self.block(parts, "else", "endfor")
            self.done()
            other: list[tuple] = []
            if end == "else":
                other, _ = self.block(parts, "endfor")
                self.done()
            return "for", name, over, body, other
        test = self.choice()
        self.done()
        body, end = self.block(parts, "elif", "else", "endif")
        if end == "elif":  # the rest is an if of its own, which takes the endif
            self.tokens = [("name", "if"), *self.tokens[self.at :]]
            self.at = 0
            return "if", test, body, [self.statement(parts)]
        self.done()
        other = []
        if end == "else":
            other, _ = self.block(parts, "endif")
            self.done()
        return "if", test, body, other


# --- tree to smaller tree -----------------------------------------------------------------------------


def folded(e: tuple, filters: Mapping[str, Callable]) -> tuple:
    """An expression with all parts of constants evaluated."""
    own = tuple(folded(x, filters) if isinstance(x, tuple) else x for x in e)
    if own[0] in ("and", "or") and own[1][0] == "const":
        return own[2] if bool(own[1][1]) == (own[0] == "and") else own[1]
    if own[0] == "pick" and own[1][0] == "const":
        return own[2] if own[1][1] else own[3]
    parts = [x for x in own if isinstance(x, tuple)]
    if own[0] in ("const", "name") or not all(x[0] == "const" for x in parts):
        return own
    try:
        return "const", closure(own, filters)({})
    except TemplateError:
        return own  # an error belongs to the run that meets it


def folded_block(nodes: list[tuple], filters: Mapping[str, Callable]) -> list[tuple]:
    """Statements with constants folded, neighbouring texts joined, dead branches dropped."""
    out: list[tuple] = []
    for node in nodes:
        kind, *rest = node
        if kind == "write":
            e = folded(rest[0], filters)
            if e[0] == "const":
                e = ("const", text_of(e[1]))
                if out and out[-1][0] == "write" and out[-1][1][0] == "const":
                    e = ("const", out.pop()[1][1] + e[1])
            if e != ("const", ""):
                out.append(("write", e))
        elif kind == "if":
            test = folded(rest[0], filters)
            branches = [folded_block(b, filters) for b in rest[1:]]
            if test[0] != "const":
                out.append(("if", test, *branches))
            else:
                out = folded_block([*out, *branches[0 if test[1] else 1]], filters)
        elif kind == "for":
            out.append(("for", rest[0], folded(rest[1], filters), *(folded_block(b, filters) for b in rest[2:])))
        elif kind == "set":
            out.append(("set", rest[0], folded(rest[1], filters)))
        else:
            out.append(("mark", folded_block(rest[0], filters)))
    return out


def names(tree: object) -> Iterator[str]:
    """Every name that is read, as often as it is."""
    if isinstance(tree, tuple) and tree[:1] == ("name",):
        yield tree[1]
    elif isinstance(tree, tuple | list):
        for x in tree:
            yield from names(x)


def streams(nodes: list[tuple], name: str) -> bool:
    """Whether the list ``name`` is only gone through once, in one loop of the outermost level."""
    outer = [n for n in nodes if n[0] == "for" and n[2] == ("name", name)]
    return len(outer) == 1 and sum(x == name for x in names(nodes)) == 1 and outer[0][1] != name


# --- tree to closures ---------------------------------------------------------------------------------

Env = dict


def closure(e: tuple, filters: Mapping[str, Callable]) -> Callable[[Env], object]:
    """An expression as a function of the names in sight."""
    kind, *rest = e
    if kind == "const":
        return lambda env, v=rest[0]: v
    if kind == "name":
        return lambda env, k=rest[0]: env.get(k, UNDEFINED)
    if kind == "filter":
        f, *args = filters[rest[0]], *(closure(x, filters) for x in rest[1:])
        return _safely(lambda env: f(*(a(env) for a in args)), f"filter {rest[0]}")
    if kind in ("compare", "sum"):
        a, b = (closure(x, filters) for x in rest[1:])
        if kind == "compare":
            f = COMPARE[rest[0]]
            return _safely(lambda env: f(a(env), b(env)), rest[0])
        if rest[0] == "~":
            return lambda env: text_of(a(env)) + text_of(b(env))
        return _safely((lambda env: a(env) + b(env)) if rest[0] == "+" else (lambda env: a(env) - b(env)), rest[0])
    own = [closure(x, filters) for x in rest]
    if kind == "key":
        return lambda env: _key(own[0](env), own[1](env))
    if kind == "and":
        return lambda env: own[0](env) and own[1](env)
    if kind == "or":
        return lambda env: own[0](env) or own[1](env)
    if kind == "not":
        return lambda env: not own[0](env)
    if kind == "defined":
        return lambda env: own[0](env) is not UNDEFINED
    return lambda env: own[1](env) if own[0](env) else own[2](env)  # pick


def _safely(f: Callable[[Env], object], what: str) -> Callable[[Env], object]:
    def run(env: Env) -> object:
        try:
            return f(env)
        except (TypeError, ValueError, AttributeError) as err:
            raise TemplateError(f"{what}: {err}") from None

    return run


def _key(of: object, k: object) -> object:
    if isinstance(of, Mapping):
        return of.get(k, UNDEFINED) if isinstance(k, str | int) else UNDEFINED
    if isinstance(of, list | str) and isinstance(k, int) and -len(of) <= k < len(of):
        return of[k]
    return UNDEFINED


Run = Callable[[Env], Iterator[object]]


def runner(nodes: list[tuple], filters: Mapping[str, Callable], outermost: bool = False) -> Run:
    """Statements as a function that yields texts and marks."""
    steps = [_step(n, filters, outermost) for n in nodes]

    def run(env: Env) -> Iterator[object]:
        for s in steps:
            yield from s(env)

    return steps[0] if len(steps) == 1 else run


def _step(node: tuple, filters: Mapping[str, Callable], outermost: bool) -> Run:
    kind, *rest = node
    if kind == "write":
        value = closure(rest[0], filters)

        def write(env: Env) -> Iterator[object]:
            yield text_of(value(env))

        return write
    if kind == "set":
        bound = closure(rest[1], filters)

        def assign(env: Env) -> Iterator[object]:
            env[rest[0]] = bound(env)
            return iter(())

        return assign
    if kind == "mark":
        body = runner(rest[0], filters)

        def mark(env: Env) -> Iterator[object]:
            yield BEGIN
            yield from body(env)
            yield END

        return mark
    if kind == "if":
        test, yes, no = closure(rest[0], filters), runner(rest[1], filters), runner(rest[2], filters)
        return lambda env: (yes if test(env) else no)(env)
    over, body, empty = closure(rest[1], filters), runner(rest[2], filters), runner(rest[3], filters)

    def repeat(env: Env) -> Iterator[object]:
        items = over(env)
        if isinstance(items, str | Mapping) or not isinstance(items, Iterable):
            raise TemplateError("a loop needs a list")
        i = 0
        for item, last in _with_last(items):
            i += 1
            # what a pass binds ends with it
            yield from body({**env, rest[0]: item, "loop": {"index": i, "index0": i - 1, "first": i == 1, "last": last}})
            if outermost:
                yield TURN
        if not i:
            yield from empty(env)

    return repeat


def _with_last(items: Iterable) -> Iterator[tuple[object, bool]]:
    """Each item and whether it is the last; one is read ahead."""
    it = iter(items)
    for item in it:
        break
    else:
        return
    for after in it:
        yield item, False
        item = after
    yield item, True


class Template:
    """A compiled template; ``filters`` are added to those that every template has, ``constants`` are folded in."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None, constants: Mapping[str, object] | None = None):
        known = {**FILTERS, **(filters or {})}
        tree, _ = Parser(known, constants or {}).block(lexed(source))
        self.tree = folded_block(tree, known)
        self._run = runner(self.tree, known, outermost=True)

    def streams(self, name: str) -> bool:
        """Whether ``name`` may be a stream that is read once; else it must be a list."""
        return streams(self.tree, name)

    def pieces(self, **values: object) -> Iterator[object]:
        """Texts, and ``BEGIN``, ``END`` and ``TURN`` between them."""
        return self._run(dict(values))

    def render(self, **values: object) -> tuple[str, list[tuple[int, int]]]:
        """The output, and the stretches of it under generation marks, in code points; what is marked within a mark
        is marked once."""
        out, spans, n, depth, start = [], [], 0, 0, 0
        for p in self.pieces(**values):
            if p is BEGIN:
                depth, start = depth + 1, n if not depth else start
            elif p is END:
                depth -= 1
                if not depth:
                    spans.append((start, n))
            elif p is not TURN:
                out.append(p)
                n += len(p)
        return "".join(out), spans
