r"""Chat formatting by a compiled template.

The template language has text, {{ expressions }}, {% for x in y %}, {% if %}, {% elif %}, {% else %}, {% set x = e %} and
{% generation %}; expressions have literals, names, fields (m.role or m['role']), ==, !=, and, or, not, + and filters. It is sandboxed:
names are looked up in the variables and fields in plain mappings, nothing can be called. A template is parsed to a syntax tree;
constant expressions, branches and neighbouring texts are folded; the rest becomes nested Python generators, so a conversation is
rendered turn by turn from a stream and never held whole. What lies in a generation block is under the loss mask.

Control strings inside texts are made harmless reversibly: a backslash goes behind their first character, and one more where there
already are some. A role's line breaks and backslashes are escaped too, as it stands on a line of its own.

Defined results: turns are ordered by turn, role and text, nulls first. A null text or role is empty. Rows without a conversation id
form one conversation. Repeated rows are turns each. Other columns are ignored. An empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactica.llm.common import short_batches, stored

BOS, EOS = "<s>", "</s>"
TEMPLATE = """\
{{ bos }}{% for m in messages %}[TURN]{{ m.role | line | escape }}
{% if m.role == 'assistant' %}{% generation %}{{ m.content | escape }}{% endgeneration %}{% else %}{{ m.content | escape }}{% endif %}[/TURN]{% endfor %}{{ eos }}"""

_REST = r"/?s>|/?INST\]|/?TURN\]|</?SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>"
_PLAIN = re.compile(rf"([<\[])(\\*)({_REST})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_REST})")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def line(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": line, "trim": str.strip, "upper": str.upper, "lower": str.lower}

# --- expressions: ("const", v) ("name", n) ("field", e, f) ("op", o, a, b) ("not", e) ("filter", f, e)

_TOKEN = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(==|!=|[.+|()\[\]])|([A-Za-z]\w*))")


class TemplateError(ValueError):
    pass


class _Parser:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, Any]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            at = m.end()
            if m[1] is not None:
                self.tokens.append(("const", int(m[1])))
            elif m[4] is not None:
                self.tokens.append(("sign", m[4]))
            elif m[5] is not None:
                self.tokens.append(("word", m[5]))
            else:
                raw = m[2] if m[2] is not None else m[3]
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), raw)))
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self):
        e = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def either(self):
        e = self.both()
        while self.take("or"):
            e = ("op", "or", e, self.both())
        return e

    def both(self):
        e = self.negated()
        while self.take("and"):
            e = ("op", "and", e, self.negated())
        return e

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        e = self.added()
        if o := self.take("==", "!="):
            e = ("op", o, e, self.added())
        return e

    def added(self):
        e = self.filtered()
        while self.take("+"):
            e = ("op", "+", e, self.filtered())
        return e

    def filtered(self):
        e = self.single()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            e = ("filter", name, e)
        return e

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def single(self):
        if self.take("("):
            e = self.either()
            self.need(")")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            e = self.tokens[self.at]
            self.at += 1
        else:
            name = self.word()
            e = ("const", {"true": True, "false": False}[name]) if name in ("true", "false") else ("name", name)
        while sign := self.take(".", "["):
            if sign == ".":
                e = ("field", e, self.word())
            else:
                if self.at >= len(self.tokens) or self.tokens[self.at][0] != "const":
                    raise TemplateError("a field's name is missing")
                e = ("field", e, self.tokens[self.at][1])
                self.at += 1
                self.need("]")
        return e


def _evaluator(e) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "const":
        value = e[1]
        return lambda env: value
    if kind == "name":
        name = e[1]
        return lambda env: env.get(name, "")
    if kind == "field":
        of, field = _evaluator(e[1]), e[2]

        def get(env):
            box = of(env)
            if not isinstance(box, dict):
                raise TemplateError(f"no fields in {type(box).__name__}")
            return box.get(field, "")

        return get
    if kind == "not":
        of = _evaluator(e[1])
        return lambda env: not of(env)
    if kind == "filter":
        f, of = FILTERS[e[1]], _evaluator(e[2])
        return lambda env: f(str(of(env)))
    a, b = _evaluator(e[2]), _evaluator(e[3])
    return {"==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env), "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env), "+": lambda env: str(a(env)) + str(b(env))}[e[1]]


def fold(e):
    """The expression with its constant parts evaluated."""
    if e[0] in ("const", "name"):
        return e
    e = tuple(fold(x) if isinstance(x, tuple) else x for x in e)
    parts = [x for x in e[1:] if isinstance(x, tuple)]
    return ("const", _evaluator(e)({})) if e[0] != "field" and all(x[0] == "const" for x in parts) else e


# --- blocks: ("text", s) ("out", e) ("for", x, e, body) ("if", [(e, body)]) ("set", x, e) ("generation", body)

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)


def parse(template: str) -> list[tuple]:
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(template):
        parts += [("text", template[at : m.start()])] * (m.start() > at)
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts += [("text", template[at:])] * (at < len(template))
    stream = iter(parts)

    def body(*ends: str) -> tuple[list[tuple], str]:
        nodes: list[tuple] = []
        for kind, source in stream:
            if kind == "text":
                nodes.append(("text", source))
            elif kind == "out":
                nodes.append(("out", _Parser(source).whole()))
            else:
                word = source.split(None, 1)[0] if source else ""
                if word in ends:
                    return nodes, source
                rest = source[len(word) :]
                if word == "for" and (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest)):
                    nodes.append(("for", m[1], _Parser(m[2]).whole(), body("endfor")[0]))
                elif word == "if":
                    arms, test = [], _Parser(rest).whole()
                    while True:
                        inner, end = body("elif", "else", "endif")
                        arms.append((test, inner))
                        if end == "endif":
                            break
                        test = ("const", True) if end == "else" else _Parser(end[4:]).whole()
                    nodes.append(("if", arms))
                elif word == "set" and (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s*=(?!=)(.+)", rest)):
                    nodes.append(("set", m[1], _Parser(m[2]).whole()))
                elif word == "generation":
                    nodes.append(("generation", body("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected {source!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return nodes, ""

    return body()[0]


def folded(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "out":
            e = fold(node[1])
            new = [("text", str(e[1]))] if e[0] == "const" else [("out", e)]
        elif node[0] == "for":
            new = [("for", node[1], fold(node[2]), folded(node[3]))]
        elif node[0] == "generation":
            new = [("generation", folded(node[1]))]
        elif node[0] == "set":
            new = [("set", node[1], fold(node[2]))]
        elif node[0] == "if":
            arms, new = [], None
            for test, inner in node[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, folded(inner)))
                if test[0] == "const":
                    break
            new = arms[0][1] if arms and arms[0][0][0] == "const" else [("if", arms)] * bool(arms)
        else:
            new = [node]
        for n in new:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)
    return out


#: A rendered piece (text, under the loss mask), or None where a round of the outermost loop ends.
Piece = tuple[str, bool] | None
Render = Callable[[dict], Iterator[Piece]]


def _closure(nodes: list[tuple], masked: bool, outermost: bool) -> Render:
    steps = [_step(n, masked, outermost) for n in nodes]

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run


def _step(node: tuple, masked: bool, outermost: bool) -> Render:
    kind = node[0]
    if kind == "text":
        piece = (node[1], masked)
        return lambda env: iter((piece,))
    if kind == "out":
        value = _evaluator(node[1])
        return lambda env: iter(((str(value(env)), masked),))
    if kind == "generation":
        return _closure(node[1], True, outermost)
    if kind == "set":
        name, value = node[1], _evaluator(node[2])

        def put(env: dict) -> Iterator[Piece]:
            env[name] = value(env)
            return iter(())

        return put
    if kind == "if":
        arms = [(_evaluator(t), _closure(inner, masked, outermost)) for t, inner in node[1]]

        def choose(env: dict) -> Iterator[Piece]:
            return next((inner(env) for test, inner in arms if test(env)), iter(()))

        return choose
    name, items, inner = node[1], _evaluator(node[2]), _closure(node[3], masked, False)

    def loop(env: dict) -> Iterator[Piece]:
        stream = iter(items(env))
        done = object()
        item, index = next(stream, done), 0
        while item is not done:
            after = next(stream, done)
            yield from inner(env | {name: item, "loop": {"first": index == 0, "last": after is done, "index": index + 1}})
            if outermost:
                yield None
            item, index = after, index + 1

    return loop


def compiled(template: str = TEMPLATE) -> Render:
    return _closure(folded(parse(template)), False, True)


def segments(render: Render, messages: Iterator[dict], **env) -> Iterator[tuple[str, list[dict]]]:
    """(text, loss spans in code points of it) of each round of the outermost loop and of what follows."""
    text, spans, size = [], [], 0
    for piece in itertools.chain(render({"messages": messages, "bos": BOS, "eos": EOS} | env), [None]):
        if piece is None:
            if text:
                yield "".join(text), spans
            text, spans, size = [], [], 0
        elif piece[0]:
            if piece[1]:
                spans.append({"start": size, "end": size + len(piece[0])})
            text.append(piece[0])
            size += len(piece[0])


FORMATTED = "conv_id long, seq long, text string, loss array<struct<start:long,end:long>>"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 500) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Rows (conv_id, seq, text, loss): the text of a conversation is that of its rows in order of seq."""
    short_batches(turns.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)

        def made() -> Iterator[tuple]:
            for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
                messages = ({"role": r or "", "content": t or ""} for _, r, t in rows)
                for seq, (text, loss) in enumerate(segments(render, messages)):
                    yield conv, seq, text, loss

        yield from _batches(made(), ["conv_id", "seq", "text", "loss"], _KINDS)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(each, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from the formatted text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
                turns, loss, n, n_loss, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, text, spans in rows:
                    size += len(text)
                    for role, content in parse_turns(text):
                        turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                        n += 1
                    for s in spans:
                        under = unescape(text[s["start"] : s["end"]])
                        loss.update(under.encode("utf-8", "surrogatepass"))
                        n_loss += len(under)
                yield conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), size

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield from _batches(made(), names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "text", "loss")
    return rows.mapInArrow(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while (start := text.find("[TURN]", at)) >= 0:
        head = text.index("\n", start)
        end = text.index("[/TURN]", head)
        yield unline(unescape(text[start + 6 : head])), unescape(text[head + 1 : end])
        at = end + 7


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return read_back(stored(format_conversations(turns.unionByName(probe)), "formatted"))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?TURN\]|</?SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', '\1\\\2\3', 'g') AS et,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(/?s>|/?INST\]|/?TURN\]|</?SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', '\1\\\2\3', 'g') AS er FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(14 + length(er) + length(et)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
