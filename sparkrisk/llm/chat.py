"""Chat formatting by a template compiler (operator 4).

A sandboxed template language (texts, ``{{ expression }}``, ``{% if %}``, ``{% for %}``, ``{% set %}``,
``{% generation %}``) is parsed into a syntax tree, constants are folded, and the tree becomes nested Python
closures. No Python code is generated or evaluated and no attribute of a Python object can be reached: names
look up the given context, ``a.b`` looks up keys of mappings, and filters come from a fixed table.

A turn is rendered at a time, in order, so that a conversation of any length passes through a task without
being held. Control strings inside texts are escaped reversibly, which lets the output be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- escaping ----------------------------------------------------------------------------------------------

#: Strings that steer the model; inside texts they get a backslash after their first character.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
_OPEN = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROLS))
_SHUT = re.compile("|".join(f"({re.escape(c[0])})\\\\(\\\\*)({re.escape(c[1:])})" for c in CONTROLS))


def _joined(m: re.Match, mark: str) -> str:
    first, slashes, rest = (g for g in m.groups() if g is not None)
    return first + mark + slashes + rest


def escape(text: str) -> str:
    """One backslash more in every control string, however many it has, so none stays and none is lost."""
    return _OPEN.sub(lambda m: _joined(m, "\\"), text)


def unescape(text: str) -> str:
    return _SHUT.sub(lambda m: _joined(m, ""), text)


def escape_line(text: str) -> str:
    """As escape, and on one line: for roles. Backslashes are doubled first."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.S)


FILTERS: dict[str, Callable] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper,
                                "lower": str.lower, "length": len}

# --- template language: text to syntax tree ----------------------------------------------------------------
# A node is a tuple of its kind and its parts.

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)"
                     r"|(?P<op>==|!=|<=|>=|[-+%|.\[\]()<>~]))")


class TemplateError(ValueError):
    """The template cannot be parsed, or names something that the sandbox does not offer."""


class _Expression:
    """Recursive descent over one expression: or, and, not, comparison, sum, filter, postfix, atom."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return value if kind in ("op", "name") and value in values else None

    def take(self, *values: str) -> str | None:
        found = self.peek(*values)
        self.at += found is not None
        return found

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            node = ("compare", op, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while op := self.take("+", "-", "%", "~"):
            node = ("math", op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.postfix()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = ("filter", name, node)
        return node

    def postfix(self) -> tuple:
        node = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                node = ("item", node, ("const", self.name()))
            else:
                node = ("item", node, self.either())
                if not self.take("]"):
                    raise TemplateError("missing ]")
        return node

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            plain = {"n": "\n", "t": "\t"}
            return ("const", re.sub(r"\\(.)", lambda m: plain.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return ("const", int(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[value]) if value in fixed else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list[tuple]:
    """Syntax tree of a template."""
    stack: list[tuple[str, list]] = [("", [])]  # open blocks: kind and the list that takes nodes
    opened: list[tuple] = []
    at = 0
    for m in _TAGS.finditer(source):
        if m.start() > at:
            stack[-1][1].append(("text", source[at:m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("print", _Expression(m[1]).whole()))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            _block(word, rest.strip(), stack, opened)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        stack[-1][1].append(("text", source[at:]))
    return stack[0][1]


def _block(word: str, rest: str, stack: list, opened: list) -> None:
    if word == "if":
        node = ("if", [[_Expression(rest).whole(), []]])
        opened.append(node)
        stack.append(("if", node[1][0][1]))
    elif word in ("elif", "else") and stack[-1][0] == "if":
        branch = [_Expression(rest).whole() if word == "elif" else ("const", True), []]
        opened[-1][1].append(branch)
        stack[-1] = ("if", branch[1])
    elif word == "for":
        m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
        if not m:
            raise TemplateError("for needs: name in expression")
        node = ("for", m[1], _Expression(m[2]).whole(), [])
        opened.append(node)
        stack.append(("for", node[3]))
    elif word == "generation":
        node = ("generation", [])
        opened.append(node)
        stack.append(("generation", node[1]))
    elif word == "set":
        name, _, value = rest.partition("=")
        stack[-1][1].append(("set", name.strip(), _Expression(value).whole()))
    elif word == "end" + stack[-1][0] and len(stack) > 1:
        stack.pop()
        stack[-1][1].append(opened.pop())
    else:
        raise TemplateError(f"unexpected {word!r}")


# --- constant folding and closures -------------------------------------------------------------------------

_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
            "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}
_MATH = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "%": lambda a, b: a % b, "~": lambda a, b: _shown(a) + _shown(b)}


def _shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _looked_up(box, key):
    """Keys of mappings and places of lists only; anything else is None, never a Python attribute."""
    if isinstance(box, dict):
        return box.get(key)
    if isinstance(box, (list, str)) and isinstance(key, int) and -len(box) <= key < len(box):
        return box[key]
    return None


def fold(node: tuple) -> tuple:
    """The expression with every part that depends on no name replaced by its value."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    parts = [fold(p) if isinstance(p, tuple) else p for p in node[1:]]
    node = (kind, *parts)
    if kind == "and" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[0]
    if kind == "or" and parts[0][0] == "const":
        return parts[0] if parts[0][1] else parts[1]
    if all(p[0] == "const" for p in parts if isinstance(p, tuple)):
        try:
            return ("const", expression(node)({}))
        except TypeError as e:
            raise TemplateError(f"constants do not go together: {e}") from e
    return node


def fold_nodes(nodes: list[tuple]) -> list[tuple]:
    """The tree with folded expressions, decided branches taken, and neighbouring texts joined."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        made = [node]
        if kind == "print":
            value = fold(node[1])
            made = [("text", _shown(value[1]))] if value[0] == "const" else [("print", value)]
        elif kind == "set":
            made = [("set", node[1], fold(node[2]))]
        elif kind == "for":
            made = [("for", node[1], fold(node[2]), fold_nodes(node[3]))]
        elif kind == "generation":
            made = [("generation", fold_nodes(node[1]))]
        elif kind == "if":
            branches = []
            for test, body in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append([test, fold_nodes(body)])
                if test[0] == "const":
                    break
            made = branches[0][1] if branches and branches[0][0][0] == "const" else [("if", branches)] if branches else []
        for new in made:
            if new[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + new[1])
            elif new != ("text", ""):
                out.append(new)
    return out


def expression(node: tuple) -> Callable[[dict], object]:
    """Closure that evaluates an expression in a context."""
    kind = node[0]
    if kind == "const":
        return lambda c, v=node[1]: v
    if kind == "name":
        return lambda c, n=node[1]: c.get(n)
    inner = [expression(p) for p in node[1:] if isinstance(p, tuple)]
    if kind == "not":
        return lambda c, a=inner[0]: not a(c)
    if kind == "filter":
        return lambda c, f=FILTERS[node[1]], a=inner[0]: f(_shown(a(c)))
    a, b = inner
    if kind == "and":
        return lambda c: a(c) and b(c)
    if kind == "or":
        return lambda c: a(c) or b(c)
    if kind == "item":
        return lambda c: _looked_up(a(c), b(c))
    op = (_COMPARE if kind == "compare" else _MATH)[node[1]]
    return lambda c: op(a(c), b(c))


Segments = Iterator[tuple[str, bool]]


def closures(nodes: list[tuple], generated: bool = False) -> Callable[[dict], Segments]:
    """Closure that yields (text, under generation) segments in order."""
    steps = [_closure(n, generated) for n in nodes]

    def run(context: dict) -> Segments:
        for step in steps:
            yield from step(context)

    return run


def _closure(node: tuple, generated: bool) -> Callable[[dict], Segments]:
    kind = node[0]
    if kind == "text":
        piece = [(node[1], generated)]
        return lambda c: piece
    if kind == "print":
        value = expression(node[1])
        return lambda c: [(_shown(value(c)), generated)]
    if kind == "generation":
        return closures(node[1], True)
    if kind == "set":
        name, value = node[1], expression(node[2])

        def assign(context: dict) -> Segments:
            context[name] = value(context)
            return iter(())

        return assign
    if kind == "if":
        branches = [(expression(t), closures(b, generated)) for t, b in node[1]]

        def choose(context: dict) -> Segments:
            for test, body in branches:
                if test(context):
                    return body(context)
            return iter(())

        return choose
    name, source, body = node[1], expression(node[2]), closures(node[3], generated)

    def loop(context: dict) -> Segments:
        for index, item in enumerate(source(context) or ()):
            yield from body(context | {name: item, "loop": {"index": index + 1, "index0": index, "first": index == 0}})

    return loop


def compile_template(source: str) -> Callable[[dict], Segments]:
    """Parse, fold and turn into closures."""
    return closures(fold_nodes(parse(source)))


# --- conversations -----------------------------------------------------------------------------------------

#: The template of one turn. ``first`` tells the opening turn. The generated text is the whole assistant text.
TURN = ("{% if first %}<s>{% endif %}{% if role == 'assistant' %}<|im_start|>{{ role|escape_line }}\n"
        "{% generation %}{{ text|escape }}{% endgeneration %}</s>{% else %}[INST] {{ role|escape_line }}\n"
        "{{ text|escape }} [/INST]{% endif %}\n")
_TURN_BACK = re.compile(r"(?:<s>)?(?:<\|im_start\|>(?P<a>[^\n]*)\n(?P<at>.*)</s>|\[INST\] (?P<u>[^\n]*)\n(?P<ut>.*) \[/INST\])\n",
                        re.S)


def render_turns(rows: DataFrame, template: str = TURN, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn in the order of each conversation: conv_id, place (from 0), segment, spans.

    ``segment`` is the rendered turn, ``spans`` the [start, end) code points of it under the loss mask. Turns
    go by ``turn``, ties by role and text, NULLs first; rows of a NULL conv_id are one conversation. A NULL
    text or role is the empty text; repeated rows are turns each; other columns are not read; an empty table
    gives an empty result. Conversations are dealt out by key and sorted by Spark (which spills), and each
    passes through its task turn by turn, so a very long one costs time but no memory.
    """
    types = dict(rows.dtypes)
    c = [F.col(f"`{x}`") for x in (conv_col, turn_col, role_col, text_col)]
    dealt = (rows.select(c[0].alias("conv"), c[1].alias("turn"), c[2].alias("role"), c[3].alias("text"))
             .repartition("conv").sortWithinPartitions("conv", "turn", "role", "text"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of = compile_template(template)
        last, place = object(), 0
        for batch in batches:
            conv = batch.column("conv").to_pylist()
            places, segments, spans = [], [], []
            for key, role, text in zip(conv, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                place = place + 1 if key == last else 0
                last = key
                at, parts, masked = 0, [], []
                for piece, generated in turn_of({"role": role or "", "text": text or "", "first": place == 0}):
                    if generated and piece:
                        masked.append([at, at + len(piece)])
                    parts.append(piece)
                    at += len(piece)
                places.append(place)
                segments.append("".join(parts))
                spans.append(masked)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array(places, pa.int64()), pa.array(segments, pa.string()),
                 pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["conv", "place", "segment", "spans"])

    return dealt.mapInArrow(render, f"conv {types[conv_col]}, place bigint, segment string, spans array<array<int>>") \
        .withColumnRenamed("conv", conv_col)


def read_back(segment: str) -> tuple[str, str]:
    """(role, text) of a turn rendered by TURN."""
    m = _TURN_BACK.fullmatch(segment)
    if not m:
        raise ValueError("not a turn of this template")
    role, text = (m["a"], m["at"]) if m["a"] is not None else (m["u"], m["ut"])
    return unescape_line(role), unescape(text)


def digests(rendered: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``render_turns``, read back from its output.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Expects the rows in the order in
    which they were rendered (directly after it, in the same partitions); hashes run along, so nothing is held.
    """
    types = dict(rendered.dtypes)
    out = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            key_type = batch.column("conv").type
            done = []
            for key, place, segment, spans in zip(*(batch.column(k).to_pylist()
                                                    for k in ("conv", "place", "segment", "spans"))):
                if place == 0:
                    if now is not None:
                        done.append(now)
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(segment)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                for start, end in spans:
                    masked = unescape(segment[start:end])
                    now[3] += len(masked)
                    now[4].update(masked.encode())
                now[5] += len(segment)
            if done:
                yield _digest_batch(done, key_type, out)
        if now is not None:
            yield _digest_batch([now], key_type, out)

    kind = types[conv_col]
    return rendered.withColumnRenamed(conv_col, "conv").mapInArrow(
        read, f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint").withColumnRenamed("conv", conv_col)


def _digest_batch(done: list[list], key_type: pa.DataType, out: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*done))
    arrays = [pa.array(columns[0], key_type), pa.array(columns[1], pa.int64()),
              pa.array([h.hexdigest() for h in columns[2]]), pa.array(columns[3], pa.int64()),
              pa.array([h.hexdigest() for h in columns[4]]), pa.array(columns[5], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["conv", *out.names])
