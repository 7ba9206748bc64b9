r"""Chat formatting: a compiler for a small sandboxed template language.

A template is text with `{{ expression }}` and `{% statement %}` parts. It is parsed into a syntax
tree, constant parts are folded, and the tree becomes nested Python closures. Rendering is a stream of
(text, in_generation) pieces, so a conversation of any length is rendered with bounded memory: `for`
draws its messages one at a time.

Statements: `for x in y` / `endfor`, `if` / `elif` / `else` / `endif`, `set x = e`, `generation` /
`endgeneration` (what stands between is under the loss mask). Expressions: literals, names, `a.b` and
`a['b']` on messages and `loop` (index0, index, first), `+` and `~` (joins text), `==`, `!=`, `in`, `not in`,
`and`, `or`, `not`, `a if c else b`, parentheses, and the filters `escape`, `trim`, `upper`, `lower`,
`title`. There are no calls, no attributes of Python objects, and no way out of the data given.

Escaping is reversible: a backslash is doubled, and a control string gets a backslash before it. So an
unescaped control string in an output was written by the template.

Defined cases: null role or text counts as empty; rows of a conversation are taken by turn (null first),
ties by role and text; rows without conv_id form one conversation; repeated rows are turns of their own;
an empty table has only the conversations that the caller adds; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.session import ship, table

END_OF_TURN = "</turn>"
HEADER = "### "
AFTER_ROLE = ": "
#: The template of the query: a header with the role, the escaped text, the end of the turn.
TEMPLATE = (
    "{% set head = '###' + ' ' %}{% for m in messages %}{{ head }}{{ m.role | escape }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
CONTROLS = (HEADER, END_OF_TURN, AFTER_ROLE)


def escaped(text: str, controls: Iterable[str] = CONTROLS) -> str:
    out = text.replace("\\", "\\\\")
    for c in controls:
        out = out.replace(c, "\\" + c)
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


# -- lexer and parser -----------------------------------------------------------------------------
class TemplateError(ValueError):
    """The template does not follow the grammar."""


_QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
#: Output, statements and comments; a minus sign inside a mark takes away the white space on its side.
_PARTS = re.compile(rf"\{{\{{(?P<l1>-?)(?P<print>(?:{_QUOTED}|[^'\"])*?)(?P<r1>-?)\}}\}}|\{{%(?P<l2>-?)(?P<statement>(?:{_QUOTED}|[^'\"])*?)(?P<r2>-?)%\}}|\{{#(?P<l3>-?).*?(?P<r3>-?)#\}}", re.DOTALL)
#: What a loop tells of itself.
_LOOP = ("index0", "index", "first")
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+~.|()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass
class Const:
    value: Any


@dataclass
class Node:
    kind: str
    args: tuple = ()
    body: list = field(default_factory=list)
    other: list = field(default_factory=list)


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name expected")

    def whole(self) -> Any:
        out = self.choice()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> Any:
        value = self.binary(0)
        if self.take("if"):
            test = self.binary(0)
            self.need("else")
            return Node("choose", (test, value, self.choice()))
        return value

    LEVELS = (("or",), ("and",), ("==", "!=", "in"), ("+", "~"))

    def binary(self, level: int) -> Any:
        if level == 2 and self.take("not"):
            return Node("not", (self.binary(2),))
        if level == len(self.LEVELS):
            return self.postfix()
        left = self.binary(level + 1)
        while True:
            if self.peek(*self.LEVELS[level]):
                op = self.tokens[self.at][1]
                self.at += 1
                left = Node(op, (left, self.binary(level + 1 if level != 1 else 2)))
            elif level == 2 and self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                left = Node("not", (Node("in", (left, self.binary(level + 1))),))
            else:
                return left

    def postfix(self) -> Any:
        value = self.atom()
        while True:
            if self.take("."):
                value = self.part(value, Const(self.name()))
            elif self.take("["):
                value = self.part(value, self.choice())
                self.need("]")
            elif self.take("|"):
                value = Node("filter", (value, self.name()))
                if value.args[1] not in FILTERS:
                    raise TemplateError(f"no filter {value.args[1]!r}")
            else:
                return value

    def part(self, value: Any, key: Any) -> Node:
        """value.key; a place in the stream of messages, or what a loop does not have, is an error."""
        name = value.args[0] if isinstance(value, Node) and value.kind == "name" else None
        if name == "messages" and isinstance(key, Const) and isinstance(key.value, int):
            raise TemplateError("messages come as a stream: only a for can read them")
        if name == "loop" and isinstance(key, Const) and not str(key.value).startswith("_") and key.value not in _LOOP:
            raise TemplateError(f"loop has no {key.value!r}")
        return Node("get", (value, key))

    def atom(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ended too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if kind == "num":
            return Const(int(text))
        if text == "(":
            value = self.choice()
            self.need(")")
            return value
        if kind == "name" and text not in ("and", "or", "not", "in", "if", "else"):
            return Const({"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else Node("name", (text,))
        raise TemplateError(f"unexpected {text!r}")


def _plain(text: str) -> str:
    """The text between marks; marks left in it hold a string that does not end."""
    if m := re.search(r"\{\{.*?\}\}|\{%.*?%\}", text, re.DOTALL):
        raise TemplateError(f"cannot read {m[0]!r}")
    return text


def parse(source: str) -> list:
    """The syntax tree of a template: a list of Const (text) and Node."""
    root: list = []
    stack: list[tuple[str, Node | None, list]] = [("", None, root)]
    at = 0
    bare = False
    for part in _PARTS.finditer(source):
        text = _plain(source[at : part.start()])
        text = text.lstrip() if bare else text
        if part["l1"] or part["l2"] or part["l3"]:
            text = text.rstrip()
        if text:
            stack[-1][2].append(Const(text))
        at, bare = part.end(), bool(part["r1"] or part["r2"] or part["r3"])
        if part["print"] is not None:
            stack[-1][2].append(Node("print", (_Expression(part["print"]).whole(),)))
            continue
        if part["statement"] is None:  # a comment
            continue
        word, _, rest = part["statement"].strip().partition(" ")
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError("for x in y expected")
            stack.append(("for", node := Node("for", (m[1], _Expression(m[2]).whole())), node.body))
        elif word == "if":
            stack.append(("if", node := Node("if", (_Expression(rest).whole(),)), node.body))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            outer = stack.pop()[1]
            if word == "else":
                stack.append(("if-", outer, outer.other))
            else:
                inner = Node("if", (_Expression(rest).whole(),))
                outer.other.append(inner)
                stack.append(("if", node := Node("chain", (outer, inner)), inner.body))
                node.other = inner.other
        elif word == "generation":
            stack.append(("generation", node := Node("generation"), node.body))
        elif word == "set":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError("set x = e expected")
            stack[-1][2].append(Node("set", (m[1], _Expression(m[2]).whole())))
        elif word in ("endfor", "endif", "endgeneration") and stack[-1][0].rstrip("-") == word[3:]:
            node = stack.pop()[1]
            while node.kind == "chain":
                node = node.args[0]
            stack[-1][2].append(node)
        else:
            raise TemplateError(f"unexpected statement {part['statement'].strip()!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is not closed")
    tail = _plain(source[at:])
    tail = tail.lstrip() if bare else tail
    if tail:
        root.append(Const(tail))
    return root


# -- constant folding -----------------------------------------------------------------------------
FILTERS: dict[str, Callable[[str], str]] = {"escape": escaped, "trim": str.strip, "upper": str.upper, "lower": str.lower, "title": str.title}


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _get(value: Any, key: Any) -> Any:
    return value.get(key) if isinstance(value, dict) else None


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: _text(a) in _text(b),
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "~": lambda a, b: _text(a) + _text(b),
}


def fold(node: Any, known: dict[str, Any] | None = None) -> Any:
    """An expression with its constant parts computed; names that are known constants are replaced."""
    known = known or {}
    if isinstance(node, Const):
        return node
    if node.kind == "name":
        return Const(known[node.args[0]]) if node.args[0] in known else node
    if node.kind == "filter":
        inner = fold(node.args[0], known)
        return Const(FILTERS[node.args[1]](_text(inner.value))) if isinstance(inner, Const) else Node("filter", (inner, node.args[1]))
    args = tuple(fold(a, known) for a in node.args)
    if node.kind in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
    elif node.kind == "choose" and isinstance(args[0], Const):
        return args[1] if args[0].value else args[2]
    elif node.kind == "not" and isinstance(args[0], Const):
        return Const(not args[0].value)
    elif node.kind in _BINARY and all(isinstance(a, Const) for a in args):
        return Const(_BINARY[node.kind](args[0].value, args[1].value))
    return Node(node.kind, args)


def fold_body(body: list, known: dict[str, Any], written: set[str]) -> list:
    """A body without constant branches and prints; neighbouring text becomes one."""
    out: list = []

    def text(value: str) -> None:
        if value and out and isinstance(out[-1], Const):
            out[-1] = Const(out[-1].value + value)
        elif value:
            out.append(Const(value))

    for node in body:
        if isinstance(node, Const):
            text(node.value)
        elif node.kind == "print":
            value = fold(node.args[0], known)
            text(_text(value.value)) if isinstance(value, Const) else out.append(Node("print", (value,)))
        elif node.kind == "set":
            value = fold(node.args[1], known)
            if isinstance(value, Const) and node.args[0] not in written:
                known[node.args[0]] = value.value
            else:
                out.append(Node("set", (node.args[0], value)))
        elif node.kind == "if":
            test = fold(node.args[0], known)
            if isinstance(test, Const):
                for inner in fold_body(node.body if test.value else node.other, known, written):
                    text(inner.value) if isinstance(inner, Const) else out.append(inner)
            else:
                out.append(Node("if", (test,), fold_body(node.body, known, written), fold_body(node.other, known, written)))
        elif node.kind == "for":
            inner = {k: v for k, v in known.items() if k not in (node.args[0], "loop")}
            out.append(Node("for", (node.args[0], fold(node.args[1], known)), fold_body(node.body, inner, written)))
        else:
            out.append(Node("generation", (), fold_body(node.body, known, written)))
    return out


def _written(body: list) -> set[str]:
    """Names that cannot be folded: set more than once, or inside a loop or branch, or a loop's own."""
    seen: dict[str, int] = {"messages": 2, "loop": 2}

    def walk(nodes: list, deep: int) -> None:
        for n in nodes:
            if isinstance(n, Node):
                if n.kind in ("set", "for"):
                    seen[n.args[0]] = seen.get(n.args[0], 0) + 1 + deep + (n.kind == "for")
                walk(n.body, deep + (n.kind in ("for", "if")))
                walk(n.other, deep + 1)

    walk(body, 0)
    return {name for name, times in seen.items() if times > 1}


# -- code generation ------------------------------------------------------------------------------
Pieces = Iterator[tuple[str, bool]]


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        constant = node.value
        return lambda scope: constant
    if node.kind == "name":
        name = node.args[0]
        return lambda scope: scope.get(name)
    if node.kind == "filter":
        inner, use = _value(node.args[0]), FILTERS[node.args[1]]
        return lambda scope: use(_text(inner(scope)))
    args = [_value(a) for a in node.args]
    if node.kind == "get":
        return lambda scope: _get(args[0](scope), args[1](scope))
    if node.kind == "not":
        return lambda scope: not args[0](scope)
    if node.kind == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.kind == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if node.kind == "choose":
        return lambda scope: args[1](scope) if args[0](scope) else args[2](scope)
    op = _BINARY[node.kind]
    return lambda scope: op(args[0](scope), args[1](scope))


def _body(nodes: list, marked: bool) -> Callable[[dict], Pieces]:
    parts = [_statement(n, marked) for n in nodes]

    def run(scope: dict) -> Pieces:
        for part in parts:
            yield from part(scope)

    return run


def _statement(node: Any, marked: bool) -> Callable[[dict], Pieces]:
    if isinstance(node, Const):
        piece = (node.value, marked)
        return lambda scope: iter((piece,))
    if node.kind == "print":
        value = _value(node.args[0])
        return lambda scope: iter(((_text(value(scope)), marked),))
    if node.kind == "set":
        name, value = node.args[0], _value(node.args[1])

        def put(scope: dict) -> Pieces:
            scope[name] = value(scope)
            return iter(())

        return put
    if node.kind == "if":
        test, yes, no = _value(node.args[0]), _body(node.body, marked), _body(node.other, marked)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    if node.kind == "generation":
        return _body(node.body, True)
    name, items, body = node.args[0], _value(node.args[1]), _body(node.body, marked)

    def loop(scope: dict) -> Pieces:
        for i, item in enumerate(items(scope) or ()):
            scope[name], scope["loop"] = item, {"index0": i, "index": i + 1, "first": i == 0}
            yield from body(scope)

    return loop


def compile_template(source: str) -> Callable[..., Pieces]:
    """render(messages, **names): the stream of (text, in_generation) pieces of the template."""
    tree = parse(source)
    run = _body(fold_body(tree, {}, _written(tree)), False)

    def render(messages: Iterable[dict], **names: Any) -> Pieces:
        return run(dict(names, messages=messages))

    return render


# -- reading back ---------------------------------------------------------------------------------
_MARK = re.compile(r"\\.|" + re.escape(END_OF_TURN) + "|" + re.escape(AFTER_ROLE), re.DOTALL)


def read_turns(pieces: Pieces) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the loss mask, characters) of each turn, read from an output of TEMPLATE.

    Needs no more than one turn at a time: an unescaped end of turn closes it.
    """
    buffer, spans, size = [], [], 0
    for text, marked in pieces:
        if marked and text:
            spans.append((size, size + len(text)))
        buffer.append(text)
        size += len(text)
        if marked or END_OF_TURN not in text:
            continue
        whole = "".join(buffer)
        at, role = 0, None
        start = len(HEADER)
        if not whole.startswith(HEADER):
            raise ValueError("a turn must begin with its header")
        done = 0
        while m := _MARK.search(whole, max(at, start)):
            at = m.end()
            if role is None and m[0] == AFTER_ROLE:
                role, start = unescaped(whole[done + len(HEADER) : m.start()]), m.end()
            elif role is not None and m[0] == END_OF_TURN:
                end = m.end() + 1
                loss = "".join(unescaped(whole[a:b]) for a, b in spans if done <= a < end)
                yield role, unescaped(whole[start : m.start()]), loss, end - done
                done, at, role, start = end, end, None, end + len(HEADER)
        rest = whole[done:]
        spans = [(a - done, b - done) for a, b in spans if a >= done]
        buffer, size = [rest] if rest else [], len(rest)
    if size:
        raise ValueError("the output ends within a turn")


# -- the operator ---------------------------------------------------------------------------------
def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, role, text with the rows of a conversation together and in order, in any partition."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), empty(role_col)("role"), empty(text_col)("text"))
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """Each conversation with a lazy stream of its messages; rows come ordered."""

    def rows() -> Iterator[tuple[Any, dict]]:
        for batch in batches:
            conv, role, text = batch.columns[:3]
            for i in range(batch.num_rows):
                yield conv[i].as_py(), {"role": role[i].as_py(), "text": text[i].as_py()}

    stream = rows()
    ahead = next(stream, None)
    while ahead is not None:
        conv = ahead[0]

        def own(conv: Any = conv) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                message, ahead = ahead[1], next(stream, None)
                yield message

        messages = own()
        yield conv, messages
        for _ in messages:  # what the caller left
            pass


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, **names: str) -> DataFrame:
    """conv_id, formatted text and spans (start, end) under the loss mask, in code points.

    names: the columns, as ordered_turns takes them. Holds one formatted conversation at a time.
    """
    ship(conversations.sparkSession)
    rows = ordered_turns(conversations, **names)
    kind = rows.schema["conv"].dataType.simpleString()
    conv_type = pa_type(kind)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    compile_template(template)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for conv, messages in _conversations(batches):
            parts, spans, at = [], [], 0
            for text, marked in render(messages):
                if marked and text:
                    spans.append({"start": at, "end": at + len(text)})
                parts.append(text)
                at += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array(["".join(parts)]), pa.array([spans], span)], ["conv_id", "formatted", "spans"])

    return rows.mapInArrow(work, f"conv_id {kind}, formatted string, spans array<struct<start:long,end:long>>")


def pa_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    plain = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    return plain[kind] if kind in plain else to_arrow_type(_parse_datatype_string(kind))


def digest_conversations(conversations: DataFrame, template: str = TEMPLATE, **names: str) -> DataFrame:
    """What read_turns finds in each formatted conversation, as digests; a stream, whatever its length."""
    ship(conversations.sparkSession)
    rows = ordered_turns(conversations, **names)
    kind = rows.schema["conv"].dataType.simpleString()
    conv_type = pa_type(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        made: list[tuple] = []

        def out() -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names_ = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names_)
            made.clear()
            return batch

        for conv, messages in _conversations(batches):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = loss_chars = 0
            for role, text, under, size in read_turns(render(messages)):
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(under.encode())
                n, chars, loss_chars = n + 1, chars + size, loss_chars + len(under)
            made.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(made) >= 4096:
                yield out()
        if made:
            yield out()

    return rows.mapInArrow(work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds: its texts hold the template's own control strings.
ADDED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return digest_conversations(rows.unionByName(added))


_ESCAPED = "replace(replace(replace(replace({0}, '\\', '\\\\'), '### ', '\\### '), '</turn>', '\\</turn>'), ': ', '\\: ')"
QUERIES = {"op5_chat": op5_chat}
ORACLE_SQL = {
    "op5_chat": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(4 + 2 + 8 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
}
