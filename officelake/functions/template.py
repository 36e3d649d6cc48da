"""Templates compiled to column expressions.

Supported: ``{{ expr }}``, ``{% if/elif/else/endif %}``, ``{% for x in list %}``, comments, ``-`` whitespace
control; expressions of names, attributes, literals, ``or/and/not``, comparisons, filters and ``include_file("name")``,
which puts the text of a file there as it is. Anything else is rejected when the template is compiled. Expressions are read with Python's own grammar, where ``a | f(x)``
already parses as wanted.
"""

from __future__ import annotations

import ast
import re
from typing import Any, Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from officelake.functions.strings import escape_link, priority_symbol


class TemplateError(ValueError):
    """The template cannot be compiled."""


class _Missing:
    """Value of a name nobody set."""


MISSING = _Missing()
_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)


def _column(v: Any) -> Column:
    if isinstance(v, Column):
        return v
    return F.lit("") if v is MISSING or v is None else F.lit(v)


def _text(v: Any) -> Column:
    return F.coalesce(_column(v).cast("string"), F.lit(""))


def _truth(v: Any) -> Any:
    """False for null, '', 0, false and empty lists, whatever the type; JSON text makes that uniform."""
    if not isinstance(v, Column):
        return bool(v) and v is not MISSING
    seen = F.to_json(F.struct(v.alias("v")))
    return ~seen.isin("{}", '{"v":""}', '{"v":0}', '{"v":0.0}', '{"v":false}', '{"v":[]}', '{"v":{}}')


_COMPARE = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
}


class Template:
    """A template with its globals and filters."""

    def __init__(
        self,
        source: str,
        globals_: dict[str, Any] | None = None,
        filters: dict[str, Callable[..., Any]] | None = None,
        required: list[str] | None = None,
        files: dict[str, str] | None = None,
    ):
        self.files = files or {}
        self.globals: dict[str, Any] = {}
        self.filters: dict[str, Callable[..., Any]] = dict(_builtin_filters())
        self.required = set(required or [])
        for name, fn in (filters or {}).items():
            self.add_filter(name, fn)
        for name, value in (globals_ or {}).items():
            self.add_global(name, value)
        self.source = source

    def add_filter(self, name: str, fn: Callable[..., Any]) -> None:
        """Register a ``Column -> Column`` filter under a new name."""
        if name in self.filters:
            raise TemplateError(f"there is a filter {name!r} already")
        self.filters[name] = fn

    def add_global(self, name: str, value: Any) -> None:
        """Set a value seen by every row under a new name."""
        if name in self.globals:
            raise TemplateError(f"there is a global {name!r} already")
        self.globals[name] = value

    def render(self, **values: Any) -> Column:
        """The rendered text; row values hide globals of the same name."""
        return self.render_checked(**values)["value"]

    def render_checked(self, **values: Any) -> Column:
        """struct<value, error>: the error names the ``req`` values a row does not have."""
        missing = self.required - set(values)
        if missing:
            raise TemplateError(f"Missing keys {sorted(missing)}")
        run = _Run(self)
        text = run.block(run.parse(self.source), {**self.globals, **values})
        error = F.coalesce(*run.errors) if run.errors else F.lit(None).cast("string")
        return F.struct(F.when(error.isNull(), text).alias("value"), error.alias("error"))


class _Run:
    """One compilation."""

    def __init__(self, template: Template):
        self.t = template
        self.errors: list[Column] = []
        self.condition: list[Column] = []

    def parse(self, source: str) -> list[Any]:
        pieces = _TAG.split(source[:-1] if source.endswith("\n") else source)
        for i in range(1, len(pieces), 2):
            inner = pieces[i][2:-2]
            if inner.startswith("-"):
                pieces[i - 1] = pieces[i - 1].rstrip()
                inner = inner[1:]
            if inner.endswith("-"):
                pieces[i + 1] = pieces[i + 1].lstrip()
                inner = inner[:-1]
            pieces[i] = (pieces[i][1], inner.strip())
        for i in range(0, len(pieces), 2):
            if re.search(r"\{\{|\{%|\{#", pieces[i]):
                raise TemplateError(f"unclosed tag in {pieces[i]!r}")
        tokens = [p for p in pieces if p != "" and not (isinstance(p, tuple) and p[0] == "#")]
        nodes, rest = self._nodes(tokens, ())
        if rest:
            raise TemplateError(f"unexpected {rest[0][1]!r}")
        return nodes

    def _nodes(self, tokens: list[Any], stop: tuple[str, ...]) -> tuple[list[Any], list[Any]]:
        nodes: list[Any] = []
        while tokens:
            token = tokens[0]
            if isinstance(token, str):
                nodes.append(("data", token))
                tokens = tokens[1:]
                continue
            kind, inner = token
            word, _, arg = inner.partition(" ")
            if kind == "{":
                nodes.append(("out", self._parse_expr(inner)))
                tokens = tokens[1:]
            elif word in stop:
                return nodes, tokens
            elif word == "if":
                branches, tail, tokens = [], [], tokens[1:]
                test: Any = self._parse_expr(arg)
                while True:
                    body, tokens = self._nodes(tokens, ("elif", "else", "endif"))
                    if not tokens:
                        raise TemplateError("if without endif")
                    (branches.append((test, body)) if test is not None else tail.extend(body))
                    word, _, arg = tokens[0][1].partition(" ")
                    tokens = tokens[1:]
                    if word == "endif":
                        break
                    test = self._parse_expr(arg) if word == "elif" else None
                nodes.append(("if", branches, tail))
            elif word == "for":
                match = re.fullmatch(r"(\w+)\s+in\s+(.+)", arg, re.S)
                if not match:
                    raise TemplateError(f"unsupported loop {inner!r}")
                body, tokens = self._nodes(tokens[1:], ("endfor",))
                if not tokens:
                    raise TemplateError("for without endfor")
                tokens = tokens[1:]
                nodes.append(("for", match.group(1), self._parse_expr(match.group(2)), body))
            else:
                raise TemplateError(f"unsupported statement {inner!r}")
        if stop:
            return nodes, []
        return nodes, tokens

    @staticmethod
    def _parse_expr(text: str) -> ast.expr:
        try:
            return ast.parse(text.strip(), mode="eval").body
        except SyntaxError as e:
            raise TemplateError(f"unsupported expression {text!r}") from e

    def block(self, nodes: list[Any], env: dict[str, Any]) -> Column:
        parts = [self._node(n, env) for n in nodes]
        return F.concat(*parts) if parts else F.lit("")

    def _node(self, node: Any, env: dict[str, Any]) -> Column:
        if node[0] == "data":
            return F.lit(node[1])
        if node[0] == "out":
            return _text(self.value(node[1], env))
        if node[0] == "if":
            out = None
            for test, body in node[1]:
                cond = _as_condition(self.value(test, env), test)
                self.condition.append(cond)
                text = self.block(body, env)
                self.condition.pop()
                out = F.when(cond, text) if out is None else out.when(cond, text)
            return out.otherwise(self.block(node[2], env))
        _, name, source, body = node
        items = self.value(source, env)
        if not isinstance(items, Column):
            return F.concat(F.lit(""), *[self.block(body, {**env, name: x}) for x in (items or [])])
        rows = F.transform(items, lambda x: self.block(body, {**env, name: x}))
        return F.coalesce(F.array_join(rows, ""), F.lit(""))

    def value(self, e: ast.expr, env: dict[str, Any]) -> Any:
        if isinstance(e, ast.Constant):
            return e.value
        if isinstance(e, ast.Name):
            return env.get(e.id, MISSING)
        if isinstance(e, ast.Attribute):
            owner = self.value(e.value, env)
            if owner is MISSING:
                return MISSING
            return owner[e.attr] if isinstance(owner, Column) else owner.get(e.attr, MISSING)
        if isinstance(e, ast.BinOp) and isinstance(e.op, ast.BitOr):
            return self._filter(e.left, e.right, env)
        if isinstance(e, ast.BoolOp):
            values = [self.value(v, env) for v in e.values]
            out = values[-1]
            for v in reversed(values[:-1]):
                first = _truth(v)
                if isinstance(first, bool):
                    out = (v if first else out) if isinstance(e.op, ast.Or) else (out if first else v)
                elif isinstance(e.op, ast.Or):
                    out = F.when(first, _column(v)).otherwise(_column(out))
                else:
                    out = first & _as_condition(out, None)
            return out
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
            return ~_as_condition(self.value(e.operand, env), e.operand)
        if isinstance(e, ast.Compare) and len(e.ops) == 1 and type(e.ops[0]) in _COMPARE:
            left, right = self.value(e.left, env), self.value(e.comparators[0], env)
            return F.coalesce(_COMPARE[type(e.ops[0])](_column(left), _column(right)), F.lit(False))
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id == "include_file" and len(e.args) == 1 and not e.keywords:
            name = self.value(e.args[0], env)
            if not isinstance(name, str) or name not in self.t.files:
                raise TemplateError(f"no file named {ast.unparse(e.args[0])}")
            return self.t.files[name]
        raise TemplateError(f"unsupported expression {ast.unparse(e)!r}")

    def _filter(self, left: ast.expr, right: ast.expr, env: dict[str, Any]) -> Any:
        args: list[Any] = []
        if isinstance(right, ast.Call) and isinstance(right.func, ast.Name) and not right.keywords:
            name, args = right.func.id, [self.value(a, env) for a in right.args]
        elif isinstance(right, ast.Name):
            name = right.id
        else:
            raise TemplateError(f"unsupported filter {ast.unparse(right)!r}")
        v = self.value(left, env)
        if name == "render":
            if not isinstance(v, str):
                raise TemplateError("only a fixed text can be rendered as a template")
            return self.block(self.parse(v), env)
        if name == "req":
            message = "no value for " + (args[0] if args else "a required name")
            if v is MISSING:
                raise TemplateError(message)
            if isinstance(v, Column):
                lacking = v.isNull()
                for c in self.condition:
                    lacking = c & lacking
                self.errors.append(F.when(lacking, F.lit(message)))
            return v
        if name not in self.t.filters:
            raise TemplateError(f"no filter named {name!r}")
        return self.t.filters[name](_column(v), *args)


#: Different templates of a table that are compiled.
MAX_TEMPLATES = 1000


def template_files(spark: SparkSession, path: str) -> dict[str, str]:
    """The text files of a folder by name, for ``include_file``; templates are few and small, and read by the driver."""
    rows = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
    return {r["name"]: r["value"] for r in rows.collect()}


def bindings(df: DataFrame, item: str) -> dict[str, Column]:
    """What a template sees of an item: the fields of a struct by their names, anything else as ``data``."""
    kind = df.schema[item].dataType
    if isinstance(kind, T.StructType):
        return {f.name: F.col(f"{item}.`{f.name}`") for f in kind.fields}
    return {"data": F.col(item)}


def render_each(
    df: DataFrame, template: str, item: str, name: str = "text", most: int = MAX_TEMPLATES, **settings: Any
) -> DataFrame:
    """``df`` with ``name``, a struct<value, error>: each row's item rendered by the template in the row's own column.

    Every different template is compiled once, and each row is rendered by its own branch, all within one pass. A
    template that can't be compiled, or is null, is its rows' error. More than ``most`` different templates are an
    error of the table. ``settings`` are those of ``Template``.
    """
    found = [r[0] for r in df.select(template).where(F.col(template).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise TemplateError(f"more than {most} different templates")
    result = lambda value, error: F.struct(value.alias("value"), error.alias("error"))
    none = F.lit(None).cast("string")
    out = F.when(F.col(template).isNull(), result(none, F.lit("no template")))
    for source in sorted(found):
        try:
            rendered = Template(source, **settings).render_checked(**bindings(df, item))
        except TemplateError as e:
            rendered = result(none, F.lit(str(e)))
        out = out.when(F.col(template) == source, rendered)
    return df.withColumn(name, out)


def _as_condition(v: Any, source: ast.expr | None) -> Column:
    if isinstance(v, Column) and isinstance(source, (ast.Compare,)):
        return v
    truth = _truth(v)
    return F.lit(truth) if isinstance(truth, bool) else truth


def _builtin_filters() -> dict[str, Callable[..., Any]]:
    from officelake.functions import html, mail

    return {
        "length": lambda c: F.size(F.coalesce(c, F.array())),
        "replace": lambda c, old, new: F.replace(c, F.lit(old), F.lit(new)),
        "upper": lambda c: F.upper(c),
        "lower": lambda c: F.lower(c),
        "trim": lambda c: F.trim(c),
        "default": lambda c, d="": F.coalesce(c, F.lit(d)),
        "as_markdown": lambda c: html.to_markdown(c),
        "clean_html": lambda c: html.clean(c),
        "email_msg": lambda c, mode="raw": mail.mail_content(c, mode)["value"],
    }


def _part(before: str, value: Column, after: str) -> Column:
    """A value with what surrounds it, or nothing without a value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), value, F.lit(after))).otherwise("")


def todo_markdown(item: Column, template: str | None = None, **parameters: Any) -> Column:
    """The markdown of an action item, or what another template makes of it.

    The signs, marks and blank lines of the text are fixed values: readers of documents find to-dos by them.
    """
    if template is not None:
        own = Template(template, parameters, {"symbol": priority_symbol, "escaped": escape_link})
        return own.render(item=item)
    lines = F.transform(
        item["links"],
        lambda x: F.concat(
            F.lit("\n.. \U0001f517 ["),
            F.when(F.coalesce(x["title"], F.lit("")) != "", x["title"]).otherwise("link"),
            F.lit("]("),
            F.coalesce(escape_link(x["url"]), F.lit("")),
            F.lit(")"),
        ),
    )
    return F.concat(
        F.lit("\n"),
        priority_symbol(item["priority"]),
        F.lit(" "),
        F.coalesce(item["title"], F.lit("")),
        F.lit(" [\U0001f4e7]("),
        F.coalesce(item["source_url"], F.lit("")),
        F.lit(")"),
        _part("\n\n. \U0001f4c5 ", item["due_date"].cast("string"), "\n\n"),
        _part("\n\n\n. ", item["notes"], "\n\n"),
        F.when(F.size(F.coalesce(item["links"], F.array())) > 0, F.concat(F.lit("\n. **Links**:"), F.array_join(lines, ""))).otherwise(""),
        F.lit("\n\n\n&nbsp;" + "\n" * 4),
    )


TRIAGE_TEMPLATE = """\
# Task

Sort the mail below into one category and list what has to be done and what is worth knowing.

# Categories

{{ categories_instructions | render }}

# To-dos

{{ action_items_instructions | render }}

# About me

{{ context_instructions | render }}

# Answer

One JSON object that follows the given schema, and nothing else.

# Mail

{{ email_metadata }}

-------

{{ email_content }}
"""


def triage_prompt(metadata: Column, content: Column, **parameters: Any) -> Column:
    """The prompt for one mail."""
    return Template(TRIAGE_TEMPLATE, parameters).render(email_metadata=metadata, email_content=content)
