"""Chat formatting by a template compiler (operator 7).

A small template language is parsed into a syntax tree, constants are folded, and the tree becomes Python closures. The
language is a sandbox: it has names, attributes of mappings, string and number literals, comparison, and/or/not, string
concatenation (~), a fixed set of filters, `if`, `for` and `generation` blocks, and nothing else - no calls, no imports, no
attribute of a Python object. What a `generation` block writes is what the model is trained on; rendering returns the spans.

    {% for m in messages %}<|turn|>{{ m.role | escape }}...{% generation %}{{ m.text | escape }}{% endgeneration %}{% endfor %}

`escape` makes a text safe to stand between control strings, and `unescape` gives back exactly what it was: every backslash
is doubled and every control string is broken by a backslash after its first character.

Rows of a conversation come together by one exchange on conv_id, sorted by turn, and are rendered as they stream by.

Edge cases: null texts and roles are empty; a null conv_id is a conversation of its own, turns without a number come
first; repeated rows are repeated turns, and ties of turns are ordered by (turn, role, text); a text of any length is written
whole; further columns, whatever their names, are neither read nor returned; an empty table gives only what is added to it.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Strings that mean something to a model; none of them is left whole in an escaped text.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")

TEMPLATE = "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}"

_BREAK = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNBREAK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _BREAK.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNBREAK.sub(r"\1", text)


class TemplateError(ValueError):
    pass


# --- syntax tree -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    items: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


FILTERS: dict[str, Callable[[object], object]] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if hasattr(x, "__len__") else 0,
}


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_LEX = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|<|>|[~|.()]))")
_ESCAPED = {"n": "\n", "t": "\t"}


class _Expression:
    """or < and < not < comparison < ~ < filters < atoms."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(m.groups())
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return next((x for x in self.tokens[self.at][2:] if x), "") if self.at < len(self.tokens) else ""

    def take(self, *which: str) -> str:
        if (found := self.peek()) in which and found:
            self.at += 1
            return found
        return ""

    def all(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError("unexpected end of expression")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = Op("or", (tree, self.both()))
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = Op("and", (tree, self.negated()))
        return tree

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        tree = self.joined()
        if op := self.take("==", "!=", "<", ">", "<=", ">="):
            tree = Op(op, (tree, self.joined()))
        return tree

    def joined(self):
        tree = self.filtered()
        while self.take("~"):
            tree = Op("~", (tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = Op("filter " + name, (tree,))
        return tree

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        text, number, name, sign = self.tokens[self.at]
        self.at += 1
        if text:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), text[1:-1], flags=re.S))
        if number:
            return Const(int(number))
        if sign == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket isn't closed")
            return tree
        if not name or name in ("or", "and", "not"):
            raise TemplateError(f"unexpected {sign or name!r}")
        if name in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[name])
        path = [name]
        while self.take("."):
            path.append(self.tokens[self.at][2] if self.at < len(self.tokens) and self.tokens[self.at][2] else "")
            if not path[-1] or path[-1].startswith("_"):
                raise TemplateError("a name is missing after the dot")
            self.at += 1
        return Name(tuple(path))


def parse(template: str) -> tuple:
    """The template's syntax tree."""
    parts, at = [], 0
    for m in _TAG.finditer(template):
        before = template[at : m.start()]
        parts.append(("text", before.rstrip() if m[0][2:3] == "-" else before))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()) if m[2] is not None else ("text", ""))
        at = m.end()
        if m[0][-3:-2] == "-":
            at += len(template[at:]) - len(template[at:].lstrip())
    parts.append(("text", template[at:]))
    return _block(parts, 0, ())[0]


def _block(parts: list, at: int, ends: tuple[str, ...]) -> tuple[tuple, int]:
    body: list = []
    while at < len(parts):
        kind, value = parts[at]
        if kind == "text":
            if value:
                body.append(Out(Const(value)))
        elif kind == "out":
            body.append(Out(_Expression(value).all()))
        else:
            word, _, rest = value.partition(" ")
            if word in ends:
                return tuple(body), at
            if word == "if":
                node, at = _if(parts, at)
                body.append(node)
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*) in (.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read {value!r}")
                inner, at = _block(parts, at + 1, ("endfor",))
                body.append(For(m[1], _Expression(m[2]).all(), inner))
            elif word == "generation":
                inner, at = _block(parts, at + 1, ("endgeneration",))
                body.append(Generation(inner))
            else:
                raise TemplateError(f"no tag {word!r}")
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return tuple(body), at


def _if(parts: list, at: int) -> tuple[If, int]:
    """The `if` or `elif` at a tag, and where the endif is; an elif is an `if` inside the other branch, with the same endif."""
    test = _Expression(parts[at][1].partition(" ")[2]).all()
    then, at = _block(parts, at + 1, ("elif", "else", "endif"))
    stop, other = parts[at][1].partition(" ")[0], ()
    if stop == "elif":
        node, at = _if(parts, at)
        other = (node,)
    elif stop == "else":
        other, at = _block(parts, at + 1, ("endif",))
    return If(test, then, other), at


# --- constant folding ------------------------------------------------------------------------------------------------

def _ordered(compare: Callable) -> Callable:
    """A comparison of which values that have no order (a text and a number, or none) are a template error."""

    def run(a, b):
        try:
            return compare(a, b)
        except TypeError:
            raise TemplateError(f"{type(a).__name__} and {type(b).__name__} have no order") from None

    return run


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _ordered(operator.lt), ">": _ordered(operator.gt), "<=": _ordered(operator.le), ">=": _ordered(operator.ge),
    "~": lambda a, b: _text(a) + _text(b), "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def _apply(kind: str) -> Callable:
    return FILTERS[kind[7:]] if kind.startswith("filter ") else _OPS[kind]


def fold(tree):
    """The tree with constant expressions computed, tests of constants decided, and neighbouring texts joined."""
    if isinstance(tree, tuple):
        out: list = []
        for node in (x for part in map(fold, tree) for x in (part if isinstance(part, tuple) else (part,))):
            if isinstance(node, Out) and isinstance(node.value, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                out[-1] = Out(Const(_text(out[-1].value.value) + _text(node.value.value)))
            elif not (isinstance(node, Out) and isinstance(node.value, Const) and not _text(node.value.value)):
                out.append(node)
        return tuple(out)
    if isinstance(tree, Op):
        args = tuple(map(fold, tree.args))
        return Const(_apply(tree.kind)(*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Op(tree.kind, args)
    if isinstance(tree, Out):
        return Out(fold(tree.value))
    if isinstance(tree, If):
        test = fold(tree.test)
        if isinstance(test, Const):
            return fold(tree.then if test.value else tree.other)
        return If(test, fold(tree.then), fold(tree.other))
    if isinstance(tree, For):
        return For(tree.name, fold(tree.items), fold(tree.body))
    if isinstance(tree, Generation):
        return Generation(fold(tree.body))
    return tree


# --- closures --------------------------------------------------------------------------------------------------------


class Sink:
    """What has been written, and the spans written under the generation mask."""

    def __init__(self):
        self.parts: list[str] = []
        self.size, self.spans = 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(tree) -> Callable[[dict], object]:
    if isinstance(tree, Const):
        return lambda env, v=tree.value: v
    if isinstance(tree, Name):
        head, *tail = tree.path

        def look(env):
            v = env.get(head)
            for key in tail:
                v = v.get(key) if isinstance(v, dict) else None
            return v

        return look
    args, f = [_value(a) for a in tree.args], _apply(tree.kind)
    if tree.kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if tree.kind == "or":
        return lambda env: args[0](env) or args[1](env)
    if len(args) == 1:
        return lambda env, a=args[0]: f(a(env))
    return lambda env, a=args[0], b=args[1]: f(a(env), b(env))


def _writer(tree) -> Callable[[dict, Sink], None]:
    if isinstance(tree, tuple):
        steps = [_writer(t) for t in tree]

        def run(env, sink):
            for step in steps:
                step(env, sink)

        return run
    if isinstance(tree, Out):
        if isinstance(tree.value, Const):
            return lambda env, sink, text=_text(tree.value.value): sink.write(text)
        return lambda env, sink, f=_value(tree.value): sink.write(_text(f(env)))
    if isinstance(tree, If):
        test, then, other = _value(tree.test), _writer(tree.then), _writer(tree.other)
        return lambda env, sink: (then if test(env) else other)(env, sink)
    if isinstance(tree, For):
        items, body = _value(tree.items), _writer(tree.body)

        def loop(env, sink):
            for x in items(env) or ():
                body(env | {tree.name: x}, sink)

        return loop
    body = _writer(tree.body)

    def generation(env, sink):
        begin = sink.size
        body(env, sink)
        sink.spans.append((begin, sink.size))

    return generation


def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from a context to the formatted text and the spans under the generation mask.

    Whatever is wrong with a template or what it meets, nesting beyond Python's own depth included, is a TemplateError.
    """
    try:
        write = _writer(fold(parse(template)))
    except RecursionError:
        raise TemplateError("the template is nested too deeply") from None

    def render(context: dict) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        try:
            write(context, sink)
        except RecursionError:
            raise TemplateError("the template is nested too deeply") from None
        return "".join(sink.parts), sink.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a text that TEMPLATE has formatted."""
    turns = []
    for part in formatted.split("<|turn|>")[1:]:
        role, _, rest = part.partition("<|text|>")
        turns.append((unescape(role), unescape(rest.rpartition("<|end|>")[0])))
    return turns


# --- Spark -----------------------------------------------------------------------------------------------------------


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, list[dict]]]:
    """Conversations of a partition that is sorted by conversation and turn; one is held at a time."""
    rows = (r for b in batches for r in zip(b["conv_id"], b["role"], b["text"]))
    for key, turns in groupby(rows, key=lambda r: None if pd.isna(r[0]) else int(r[0])):
        yield key, [{"role": _text(role), "text": _text(text)} for _, role, text in turns]


def _arranged(conversations: DataFrame) -> DataFrame:
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, and loss_spans (begin, end, in code points) of every conversation."""
    compile_template(template)  # a bad template fails here, not in a task

    def run(batches):
        render, out = compile_template(template), []
        for key, turns in _conversations(batches):
            text, spans = render({"messages": turns})
            out.append((key, text, [{"begin": a, "end": b} for a, b in spans]))
            if len(out) >= 256:
                yield _frame(out, ["conv_id", "formatted", "loss_spans"])
                out = []
        yield _frame(out, ["conv_id", "formatted", "loss_spans"])

    return _arranged(conversations).mapInPandas(run, "conv_id long, formatted string, loss_spans array<struct<begin: int, end: int>>")


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each formatted conversation, what reading it back gives."""
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for b in batches:
        out = []
        for key, text, spans in zip(b["conv_id"], b["formatted"], b["loss_spans"]):
            turns = read_back(text)
            loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
            out.append((None if pd.isna(key) else int(key), len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), hexed(loss), len(text)))
        yield _frame(out, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op7_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all conversations, and conversation -7, whose texts are made of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    formatted = format_conversations(rows.unionByName(extra))
    return formatted.mapInPandas(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_ESCAPED_LEN = "(length(coalesce({x}, '')) + length(coalesce({x}, '')) - length(replace(coalesce({x}, ''), '\\', ''))" + "".join(f" + (length(coalesce({{x}}, '')) - length(replace(coalesce({{x}}, ''), '{c}', ''))) // {len(c)}" for c in CONTROL) + ")"
OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum({_ESCAPED_LEN.format(x="role")} + {_ESCAPED_LEN.format(x="text")} + {len("<|turn|><|text|><|end|>") + 1})::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
