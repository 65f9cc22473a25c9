"""Chat formatting (operator 4): a template compiler.

Templates are written in a small sandboxed language: text, {{ expression }}, {% for x in messages %},
{% if %}/{% elif %}/{% else %}, {% generation %}...{% endgeneration %}. Expressions have string,
number and boolean literals, names, fields (m.role, loop.first, loop.index0), comparisons, and/or/not, +
and filters (escape, upper, lower, trim). There are no calls, no attributes of Python objects and
no other names. The source is parsed into a syntax tree, constants are folded, and the tree
becomes Python closures that yield (text, marked) pieces, so that a conversation of any length is
rendered as a stream, turn by turn.

Control strings inside texts are escaped reversibly: a backslash goes before each backslash and after
the first character of each control string, so that none is left in one piece; unescape() takes it away.

Defined cases: rows are taken by turn (null first), then role and text; a null role or text is
empty; a null conversation id is a conversation of its own kind; repeated rows are repeated turns;
an empty table gives no conversation; extra columns are ignored. Each conversation comes as parts
of about PART_CHARS characters, so that none needs to fit in one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PART_CHARS = 1 << 20
#: Control strings of the default template.
OPEN, CLOSE, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (OPEN, CLOSE, END, "<s>", "</s>", "[INST]", "[/INST]")
DEFAULT = "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>{% endfor %}"


class TemplateError(ValueError):
    pass


_ESCAPE = re.compile("|".join(re.escape(x) for x in ("\\", *CONTROLS)))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


# Syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Mark:
    body: tuple


_PIECE = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_LEX = re.compile(r"""\s*(?:(?P<str>'[^']*'|"[^"]*")|(?P<num>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|<=|>=|[<>+|.()]))""")
_FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "upper": str.upper, "lower": str.lower, "trim": str.strip}
_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "+": lambda a, b: a + b
}


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filters, fields."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def parse(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self):
        out = self.negated()
        while self.take("and"):
            out = Op("and", (out, self.negated()))
        return out

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        out = self.sum()
        if op := self.take("==", "!=", "<=", ">=", "<", ">"):
            out = Op(op, (out, self.sum()))
        return out

    def sum(self):
        out = self.filtered()
        while self.take("+"):
            out = Op("+", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.field()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            out = Op("|" + name, (out,))
        return out

    def field(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            out = Const(value[1:-1])
        elif kind == "num":
            out = Const(int(value))
        elif kind == "name" and value in ("true", "false"):
            out = Const(value == "true")
        elif kind == "name" and value not in ("and", "or", "not"):
            out = Name(value)
        elif (kind, value) == ("op", "("):
            out = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.take("."):
            kind, name = self.peek()
            if kind != "name":
                raise TemplateError("a field needs a name")
            self.at += 1
            out = Field(out, name)
        return out


def parse(source: str) -> tuple:
    """Syntax tree of a template."""
    stack: list[tuple[str, object, list]] = [("", None, [])]

    def close(*kinds: str):
        if stack[-1][0] not in kinds:
            raise TemplateError(f"unexpected end of {'/'.join(kinds)}")
        return stack.pop()

    def end_if() -> None:
        no: tuple = ()
        if stack[-1][0] == "else":
            no = tuple(stack.pop()[2])
        while True:
            kind, test, body = close("if", "elif")
            node = If(test, tuple(body), no)
            if kind == "if":
                stack[-1][2].append(node)
                return
            no = (node,)

    at = 0
    for m in _PIECE.finditer(source):
        if m.start() > at:
            stack[-1][2].append(Emit(Const(source[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(Emit(_Expression(m[1]).parse()))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            if word == "for":
                var = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                if not var:
                    raise TemplateError(f"bad for {rest!r}")
                stack.append(("for", (var[1], _Expression(var[2]).parse()), []))
            elif word == "if":
                stack.append(("if", _Expression(rest).parse(), []))
            elif word == "elif":
                if stack[-1][0] not in ("if", "elif"):
                    raise TemplateError("elif without if")
                stack.append(("elif", _Expression(rest).parse(), []))
            elif word == "else":
                if stack[-1][0] not in ("if", "elif"):
                    raise TemplateError("else without if")
                stack.append(("else", None, []))
            elif word == "endif":
                end_if()
            elif word == "endfor":
                _, (name, over), body = close("for")
                stack[-1][2].append(For(name, over, tuple(body)))
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "endgeneration":
                _, _, body = close("generation")
                stack[-1][2].append(Mark(tuple(body)))
            else:
                raise TemplateError(f"no statement {word!r}")
    if at < len(source):
        stack[-1][2].append(Emit(Const(source[at:])))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return tuple(stack[0][2])


def _apply(op: str, args: list):
    if op == "not":
        return not args[0]
    if op[0] == "|":
        return _FILTERS[op[1:]](str(args[0]))
    return _BINARY[op](*args)


def fold(node):
    """The tree with constant expressions computed, decided branches chosen and neighbouring
    constant text joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            x = fold(x)
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.value, Const):
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        out[-1] = Emit(Const(str(out[-1].value.value) + str(y.value.value)))
                        continue
                    y = Emit(Const(str(y.value.value)))
                out.append(y)
        return tuple(x for x in out if x != Emit(Const("")))
    if isinstance(node, Op):
        args = tuple(fold(a) for a in node.args)
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op not in ("and", "or") and all(isinstance(a, Const) for a in args):
            return Const(_apply(node.op, [a.value for a in args]))
        return Op(node.op, args)
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if isinstance(node, Emit):
        return Emit(fold(node.value))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no)
        return If(test, fold(node.yes), fold(node.no))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Mark):
        body = fold(node.body)
        return Mark(body) if body else ()
    return node


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):

        def name(env, n=node.name):
            if n not in env:
                raise TemplateError(f"no name {n!r}")
            return env[n]

        return name
    if isinstance(node, Field):
        of = _value(node.of)

        def field(env, n=node.name):
            x = of(env)
            if not isinstance(x, dict) or n not in x:
                raise TemplateError(f"no field {n!r}")
            return x[n]

        return field
    args = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    return lambda env, op=node.op: _apply(op, [a(env) for a in args])


def _block(nodes: tuple) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    steps = [_step(n) for n in nodes]

    def run(env: dict, marked: bool) -> Iterator[tuple[str, bool]]:
        for s in steps:
            yield from s(env, marked)

    return run


def _step(node) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    if isinstance(node, Emit):
        value = _value(node.value)

        def emit(env, marked):
            if text := str(value(env)):
                yield text, marked

        return emit
    if isinstance(node, If):
        test, yes, no = _value(node.test), _block(node.yes), _block(node.no)
        return lambda env, marked: yes(env, marked) if test(env) else no(env, marked)
    if isinstance(node, Mark):
        body = _block(node.body)
        return lambda env, marked: body(env, True)
    over, body = _value(node.over), _block(node.body)

    def loop(env, marked):
        it = iter(over(env))
        item = next(it, None)
        i = 0
        while item is not None:  # one item ahead, so that loop.last is known in a stream
            following = next(it, None)
            yield from body(
                {
                    **env,
                    node.name: item,
                    "loop": {"first": i == 0, "last": following is None, "index": i + 1, "index0": i}
                },
                marked
            )
            item, i = following, i + 1

    return loop


class Template:
    def __init__(self, source: str = DEFAULT):
        self.source, self.tree = source, fold(parse(source))
        self._run = _block(self.tree)

    def render(self, messages: Iterable[dict], **names) -> Iterator[tuple[str, bool]]:
        """(text, whether a generation marker holds it), piece by piece. messages may be a stream."""
        return self._run({"messages": messages, **names}, False)

    def __reduce__(self):
        return Template, (self.source,)


def format_conversations(
    turns: DataFrame, template: str = DEFAULT, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", part_chars: int = PART_CHARS
) -> DataFrame:
    """Rows (conv_id, part, formatted, marks): parts in order make the conversation's formatted
    text; marks are the [start, end) code points of each part that generation markers hold. A part
    ends at a turn's end unless a single turn is longer. Rows of a conversation are dealt to one
    task and streamed there; nothing holds a whole conversation."""
    small_batches(turns.sparkSession)
    compiled = Template(template)
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    rows = (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(*(x.to_pylist() for x in b.columns)))
        held: list = []  # the first row of the next conversation

        def messages(c, first) -> Iterator[dict]:
            yield first
            for d, m in stream:
                if d != c:
                    held.append((d, m))
                    return
                yield m

        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(cols[0], pa.int64()),
                    pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.string()),
                    pa.array(
                        [[{"start": s, "end": e} for s, e in x] for x in cols[3]],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    )
                ],
                ["conv_id", "part", "formatted", "marks"]
            )

        size = 0
        while True:
            if not held:
                nxt = next(stream, None)
                if nxt is None:
                    break
                held.append(nxt)
            c, first = held.pop()
            part, chars, pieces, marks = 0, 0, [], []
            for piece, marked in compiled.render(messages(c, first)):
                if chars and chars + len(piece) > part_chars:
                    out.append((c, part, "".join(pieces), marks))
                    part, chars, pieces, marks = part + 1, 0, [], []
                    size += part_chars
                    if size > 8 * PART_CHARS:
                        size = 0
                        yield flush()
                if marked:
                    marks.append((chars, chars + len(piece)))
                pieces.append(piece)
                chars += len(piece)
            out.append((c, part, "".join(pieces), marks))
            size += chars
            if size > 4 * PART_CHARS or len(out) >= 2000:
                size = 0
                yield flush()
        if out:
            yield flush()

    return rows.mapInArrow(run, "conv_id long, part long, formatted string, marks array<struct<start:long,end:long>>")


_CONTROL = re.compile(r"\\.|" + "|".join(re.escape(x) for x in (OPEN, CLOSE, END)), re.S)


def read_turns(parts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Pieces of turns read back from text formatted by the default template, as a stream:
    ("role", role) opens a turn, ("text", piece) adds to its text and ("end", "") closes it."""
    longest = max(map(len, CONTROLS)) + 1
    left, state, role = "", "", []
    parts = iter(parts)
    while True:
        part = next(parts, None)
        left += part or ""
        at = 0
        safe = len(left) if part is None else len(left) - longest
        for m in _CONTROL.finditer(left):
            if m.start() >= safe:
                break
            plain, token = left[at : m.start()], m[0]
            at = m.end()
            if token[0] == "\\":
                plain += token[1:]
                token = ""
            if state == "role":
                role.append(plain)
            elif state == "text" and plain:
                yield "text", plain
            if token == OPEN:
                state, role = "role", []
            elif token == CLOSE and state == "role":
                state = "text"
                yield "role", "".join(role)
            elif token == END:
                state = ""
                yield "end", ""
        if safe > at:
            if state == "role":
                role.append(left[at:safe])
            elif state == "text":
                yield "text", left[at:safe]
            at = safe
        left = left[at:]
        if part is None:
            return
