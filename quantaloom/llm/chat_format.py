"""Chat formatting by a small template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python closures that render
a conversation and mark generated text. The language is sandboxed: values are strings, numbers, booleans and dicts of
them; names and fields are looked up in dicts only; filters and tests come from a fixed table.

    {{ expr }}   {% for m in messages %} .. {% endfor %}   {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% set name = expr %}   {% generation %} .. {% endgeneration %}
    expr: 'text' 12 true false none name name.field loop.first loop.last loop.index not and or == != + ~ | filter ( )

On Spark, rows are dealt by conversation, sorted, and streamed: a task holds one turn (and the next), never a whole
conversation, so one conversation with a third of all rows costs time but no memory.

Defined results
  null text or role: empty. null conversation id: one conversation of its own. Ties of ``turn``: by role, then text.
  repeated rows: repeated turns. Empty table: only the fixed conversation. Very long texts: one at a time.
  extra columns: ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that steer a model. They never occur inside escaped text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|body|>")
ESCAPE = "\\"
TEMPLATE = (
    "{{ '<' ~ 's>' }}{% for m in messages %}<|turn|>{{ m.role | guard }}<|body|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}"
    "{% elif m.role == 'user' %}[INST] {{ m.text | guard }} [/INST]"
    "{% else %}{{ m.text | guard }}{% endif %}</s>{% endfor %}"
)
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)


def guard(text: str) -> str:
    """Escape reversibly: double the escape sign, and put one behind the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unguard(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class TemplateError(ValueError):
    pass


FILTERS: dict[str, Callable] = {"guard": lambda x: guard(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len, "string": lambda x: _text(x)}
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|[+~|().]))", re.S)
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}", re.S)


def _text(value) -> str:
    if value is None:
        return ""
    if value is True or value is False:
        return "true" if value else "false"
    return value if isinstance(value, str) else str(value)


class _Expressions:
    """Recursive descent over one expression; nodes are ('const', v), ('name', n), ('field', e, n), ('op', name, ..)."""

    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected text in expression: {source[at:at + 20]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] in ("op", "name") and self.items[self.at][1] in values:
            self.at += 1
            return values[values.index(self.items[self.at - 1][1])]
        return None

    def whole(self):
        node = self.either()
        if self.at != len(self.items):
            raise TemplateError(f"left over in expression: {self.items[self.at][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("op", "or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("op", "and", node, self.negated())
        return node

    def negated(self):
        return ("op", "not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.joined()
        while op := self.take("==", "!="):
            node = ("op", op, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while op := self.take("+", "~"):
            node = ("op", op, node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while self.take("|"):
            name = self.items[self.at][1] if self.at < len(self.items) else ""
            if name not in FILTERS:
                raise TemplateError(f"no such filter: {name!r}")
            self.at += 1
            node = ("op", "filter:" + name, node)
        return node

    def atom(self):
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return node
        if self.at >= len(self.items):
            raise TemplateError("expression ends early")
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return ("const", int(value))
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        node = ("name", value)
        while self.take("."):
            if self.at >= len(self.items) or self.items[self.at][0] != "name":
                raise TemplateError("a field name must follow '.'")
            node = ("field", node, self.items[self.at][1])
            self.at += 1
        return node


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: _text(a) + _text(b), "+": lambda a, b: a + b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a,
} | {"filter:" + k: f for k, f in FILTERS.items()}


def fold(node):
    """Constant subtrees become constants; neighbouring literal outputs of a body become one."""
    if node[0] == "op":
        args = [fold(x) for x in node[2:]]
        if all(x[0] == "const" for x in args):
            return ("const", _OPS[node[1]](*(x[1] for x in args)))
        return (*node[:2], *args)
    if node[0] == "field":
        return ("field", fold(node[1]), node[2])
    if node[0] == "body":
        out: list = []
        for x in map(fold, node[1]):
            if x[0] == "if" and x[1] and x[1][0][0][0] == "const":  # a test that is known now
                while x[1] and x[1][0][0][0] == "const" and not x[1][0][0][1]:
                    x = ("if", x[1][1:], x[2])
                if not x[1] or x[1][0][0][0] == "const":
                    out += (x[1][0][1] if x[1] else x[2])[1]
                    continue
            out.append(("text", _text(x[1][1])) if x[0] == "print" and x[1][0] == "const" else x)
        merged: list = []
        for x in out:
            if x[0] == "text" and merged and merged[-1][0] == "text":
                merged[-1] = ("text", merged[-1][1] + x[1])
            elif x != ("text", ""):
                merged.append(x)
        return ("body", merged)
    if node[0] == "print":
        return ("print", fold(node[1]))
    if node[0] == "set":
        return ("set", node[1], fold(node[2]))
    if node[0] == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if node[0] == "generation":
        return ("generation", fold(node[1]))
    if node[0] == "if":
        return ("if", [(fold(c), fold(b)) for c, b in node[1]], fold(node[2]))
    return node


def parse(template: str):
    """The syntax tree of a template: ('body', [nodes])."""
    parts, at = [], 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            parts.append(("text", template[at : m.start()]))
        parts.append(("print", _Expressions(m[1]).whole()) if m[1] is not None else ("tag", m[2]))
        at = m.end()
    if at < len(template):
        parts.append(("text", template[at:]))
    at = 0

    def body(*ends: str):
        nonlocal at
        nodes = []
        while at < len(parts):
            kind, value = parts[at]
            at += 1
            if kind != "tag":
                nodes.append(parts[at - 1])
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return ("body", nodes), word, rest
            if word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"bad loop: {value!r}")
                nodes.append(("for", m[1], _Expressions(m[2]).whole(), body("endfor")[0]))
            elif word == "if":
                cases, other, test = [], ("body", []), rest
                while True:
                    inner, end, more = body("elif", "else", "endif")
                    cases.append((_Expressions(test).whole(), inner))
                    if end == "elif":
                        test = more
                        continue
                    if end == "else":
                        other = body("endif")[0]
                    break
                nodes.append(("if", cases, other))
            elif word == "set":
                name, _, value = rest.partition("=")
                nodes.append(("set", name.strip(), _Expressions(value).whole()))
            elif word == "generation":
                nodes.append(("generation", body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag: {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return ("body", nodes), "", ""

    return body()[0]


def _value(node) -> Callable[[dict], object]:
    if node[0] == "const":
        return lambda env, v=node[1]: v
    if node[0] == "name":
        return lambda env, n=node[1]: env.get(n)
    if node[0] == "field":
        inner = _value(node[1])

        def field(env, n=node[2]):
            found = inner(env)
            return found.get(n) if isinstance(found, dict) else None

        return field
    args, op = [_value(x) for x in node[2:]], node[1]
    if op in ("and", "or"):  # these needn't evaluate both sides
        a, b = args
        return (lambda env: a(env) and b(env)) if op == "and" else (lambda env: a(env) or b(env))
    if len(args) == 1:
        return lambda env, f=_OPS[op], a=args[0]: f(a(env))
    return lambda env, f=_OPS[op], a=args[0], b=args[1]: f(a(env), b(env))


def _closure(node) -> Callable[[dict, object], None]:
    kind = node[0]
    if kind == "body":
        steps = [_closure(x) for x in node[1]]

        def run(env, sink):
            for step in steps:
                step(env, sink)

        return run
    if kind == "text":
        return lambda env, sink, t=node[1]: sink.text(t)
    if kind == "print":
        value = _value(node[1])
        return lambda env, sink: sink.text(_text(value(env)))
    if kind == "set":
        value = _value(node[2])

        def put(env, sink, name=node[1]):
            env[name] = value(env)

        return put
    if kind == "generation":
        inner = _closure(node[1])

        def generated(env, sink):
            sink.generation(True)
            inner(env, sink)
            sink.generation(False)

        return generated
    if kind == "if":
        cases, other = [(_value(c), _closure(b)) for c, b in node[1]], _closure(node[2])

        def choose(env, sink):
            for test, then in cases:
                if test(env):
                    return then(env, sink)
            return other(env, sink)

        return choose
    items, inner = _value(node[2]), _closure(node[3])

    def loop(env, sink, name=node[1]):
        outer = {k: env.get(k) for k in (name, "loop")}
        rows, index = iter(items(env) or ()), 0
        row = next(rows, loop)
        while row is not loop:
            following = next(rows, loop)  # one turn ahead, for loop.last
            env[name], env["loop"] = row, {"first": index == 0, "last": following is loop, "index": index + 1}
            inner(env, sink)
            row, index = following, index + 1
        env.update(outer)

    return loop


@lru_cache(maxsize=64)
def compile_template(template: str) -> Callable[[Iterable[dict], object], None]:
    """A function (messages, sink) that renders; the sink has text(str) and generation(bool)."""
    run = _closure(fold(parse(template)))
    return lambda messages, sink: run({"messages": messages}, sink)


class Collected:
    """A sink that keeps the whole output and the spans (start, end) of generated text."""

    def __init__(self):
        self.pieces, self.size, self.spans, self.began = [], 0, [], 0

    def text(self, piece: str) -> None:
        self.pieces.append(piece)
        self.size += len(piece)

    def generation(self, on: bool) -> None:
        if on:
            self.began = self.size
        else:
            self.spans.append((self.began, self.size))


def render(template: str, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
    compile_template(template)(messages, sink := Collected())
    return "".join(sink.pieces), sink.spans


class Digests:
    """A sink that reads the output back turn by turn, and keeps only digests and counts."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = 0
        self.open, self.pieces, self.generated = False, [], []

    def generation(self, on: bool) -> None:
        self.open = on
        if not on:
            text = unguard("".join(self.generated))
            self.loss.update(text.encode())
            self.loss_chars += len(text)
            self.generated = []

    def text(self, piece: str) -> None:
        self.formatted += len(piece)
        self.pieces.append(piece)
        if self.open:
            self.generated.append(piece)
        elif "</s>" in piece:
            self.read()

    def read(self) -> None:
        *ended, rest = "".join(self.pieces).split("</s>")
        self.pieces = [rest]
        for turn in ended:
            role, _, text = turn.rpartition("<|turn|>")[2].partition("<|body|>")
            if text.startswith("[INST] ") and text.endswith(" [/INST]"):
                text = text[7:-8]
            self.turns.update(f"{unguard(role)}\n{unguard(text)}\n".encode())
            self.n_turns += 1


def conversations_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conversation, its turns) from batches sorted by conversation; turns are read as they are asked for."""
    rows = ((None if pd.isna(c) else int(c), {"role": r or "", "text": t or ""}) for b in batches for c, r, t in zip(b["conv_id"], b["role"].where(b["role"].notna(), None), b["text"].where(b["text"].notna(), None), strict=True))
    held = next(rows, None)

    def turns(conv):
        nonlocal held
        while held is not None and held[0] == conv:
            row = held[1]
            held = next(rows, None)
            yield row

    while held is not None:
        conv, its = held[0], turns(held[0])
        yield conv, its
        for _ in its:  # whatever the reader left
            pass


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
FORMATTED_SCHEMA = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted texts and the spans of their loss mask, in code points."""

    def run(batches):
        for conv, turns in conversations_of(batches):
            text, spans = render(template, turns)
            yield pd.DataFrame({"conv_id": pd.array([conv], "Int64"), "formatted": [text], "loss_spans": [[{"start": a, "end": b} for a, b in spans]]})

    return _sorted(conversations).mapInPandas(run, FORMATTED_SCHEMA)


def format_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Counts and digests read back from the formatted output, without keeping it."""

    def run(batches):
        fill, out = compile_template(template), []
        for conv, turns in conversations_of(batches):
            fill(turns, sink := Digests())
            out.append((conv, sink.n_turns, sink.turns.hexdigest(), sink.loss_chars, sink.loss.hexdigest(), sink.formatted))
            if len(out) >= 2000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    return _sorted(conversations).mapInPandas(run, DIGEST_SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return frame.astype({"conv_id": "Int64"})
