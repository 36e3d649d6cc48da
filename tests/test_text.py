"""Golden texts for HTML, mail, markdown, JSON, dates and templates."""

import email.message

import pytest
from pyspark.sql import functions as F, types as T

from officelake.functions import dates, html, jsons, mail, strings
from officelake.functions.markdown import block_rows
from officelake.functions.template import Template, TemplateError, todo_markdown



def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "source, wanted",
    [
        ('<p class="x" id=y>kept<!-- gone --> <a href="/u" role=\'z\'>t</a></p>', '<p>kept <a href="/u">t</a></p>'),
        ("<style>b{}</style>a<SCRIPT src=q>var s = '<p>';</SCRIPT >\n\n b", "a b"),
        ("no markup", "no markup"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_pages(spark, source, wanted):
    assert one(spark, html.clean(F.col("c")), source) == wanted


@pytest.mark.parametrize(
    "source, wanted",
    [
        ("<h2>Soup</h2><p>Boil <b>three</b> <i>eggs</i>.</p><p>Serve<br>warm</p>", "## Soup\n\nBoil **three** *eggs*.\n\nServe  \nwarm"),
        ('<ul><li>salt</li><li><a class=k href="/oil">olive oil</a></li></ul>', "* salt\n* [olive oil](/oil)"),
        ("<table><tr><td>egg</td><td>3</td></tr><tr><td>oil</td><td>1</td></tr></table>", "| egg | 3 |\n| oil | 1 |"),
        ("<head><title>t</title></head>5 &lt; 6 &amp;amp; more", "5 < 6 &amp; more"),
        ("<p>open <b>end", "open end"),
    ],
)
def test_pages_as_markdown(spark, source, wanted):
    assert one(spark, html.to_markdown(F.col("c")), source) == wanted


def mail_bytes(kind, body, **headers):
    m = email.message.EmailMessage()
    for k, v in headers.items():
        m[k] = v
    if kind == "mixed":
        m.set_content("plain side")
        m.add_alternative(body, subtype="html")
        m.add_attachment(b"x,y", maintype="text", subtype="csv", filename="t.csv")
    elif kind == "quoted":
        m.set_content(body, cte="quoted-printable")
    elif kind == "base64":
        m.set_content(body, cte="base64")
    elif kind == "plain":
        m.set_content(body)
    return bytearray(m.as_bytes())


@pytest.mark.parametrize("kind", ["mixed", "quoted", "base64", "plain"])
def test_mail_bodies(spark, kind):
    body = "<p>Grüße = 100% + <b>mehr</b></p>\n" if kind == "mixed" else "Grüße = 100% + mehr, " * 8 + "\n"
    r = one(spark, mail.parse_mail(F.col("c")), mail_bytes(kind, body, Subject="s: t", To="a@b"), "binary")
    assert r["error"] is None and r["body_type"] == ("text/html" if kind == "mixed" else "text/plain")
    assert r["body"].strip() == body.strip()
    assert {(h["name"], h["value"]) for h in r["headers"]} >= {("Subject", "s: t"), ("To", "a@b")}


def test_mail_without_usable_body(spark):
    assert one(spark, mail.parse_mail(F.col("c")), mail_bytes("none", "", Subject="s"), "binary")["body"] == ""
    only = email.message.EmailMessage()
    only.add_attachment(b"q", maintype="text", subtype="csv", filename="t.csv")
    assert one(spark, mail.parse_mail(F.col("c")), bytearray(only.as_bytes()), "binary")["error"] == "only attachments"
    assert one(spark, mail.parse_mail(F.col("c")), None, "binary") is None
    assert one(spark, mail.mail_content(F.col("c"), "md"), mail_bytes("mixed", "<h1>Hi</h1>"), "binary")["value"] == "# Hi"


def test_choose_body(spark):
    rows = [("a", 0, "text/plain", "p1", False), ("a", 1, "text/plain", "p2", False), ("b", 0, "text/html", "h", False)]
    rows += [("b", 1, "text/plain", "p", False), ("c", 0, "text/plain", "p", True)]
    df = spark.createDataFrame(rows, "id string, part_no int, mime_type string, content string, is_attachment boolean")
    got = {r["id"]: (r["body"], r["error"]) for r in mail.choose_body(df).collect()}
    assert got == {"a": ("p2", None), "b": ("h", None), "c": (None, "the body is an attachment")}


def test_conversion_dispatch(spark):
    df = spark.createDataFrame(
        [(1, "<h3>T</h3>", "text/html", "text/markdown"), (2, "x", "text/plain", "text/html"), (3, "y", "text/csv", "text/csv")], "n int, c string, s string, t string"
    )
    got = [r["r"] for r in df.select("n", html.convert(F.col("c"), F.col("s"), F.col("t")).alias("r")).orderBy("n").collect()]
    assert [tuple(r) for r in got] == [("### T", None), (None, "no way from text/plain to text/html"), ("y", None)]


@pytest.mark.parametrize(
    "source, wanted",
    [
        ("", []),
        (" \n\t\n", []),
        ("first\ngoes on\n\nsecond", [("paragraph", 0, "first goes on"), ("paragraph", 0, "second")]),
        ("broken  \nline", [("paragraph", 0, "broken\vline")]),
        ("To buy:\n- salt\n  - coarse\n1. oil\n\nDone", [("paragraph", 0, "To buy:"), ("list_item", 0, "salt"), ("list_item", 1, "coarse"), ("list_item", 0, "oil"), ("paragraph", 0, "Done")]),
        ("### Soup ###\nhot", [("heading", 3, "Soup"), ("paragraph", 0, "hot")]),
        ("... deep\nand on", [("indented", 3, "deep and on")]),
    ],
)
def test_markdown_blocks(spark, source, wanted):
    rows = block_rows(spark.createDataFrame([(1, source)], "doc_id int, md string"), "md").orderBy("block_no").collect()
    assert [(r["kind"], r["level"], r["text"]) for r in rows] == wanted
    assert [r["block_no"] for r in rows] == list(range(len(wanted)))


def test_markdown_spans(spark):
    source = "\U0001f9c2 **salt** and [oil](http://o/1) **too**"
    r = block_rows(spark.createDataFrame([(1, source)], "doc_id int, md string"), "md").first()
    assert r["text"] == "\U0001f9c2 salt and oil too"
    assert [tuple(s) for s in r["spans"]] == [(3, 7, "strong", None), (12, 15, "link", "http://o/1"), (16, 19, "strong", None)]


@pytest.mark.parametrize(
    "source, text, spans",
    [
        ("*a* and _b_", "a and b", [(0, 1, "em"), (6, 7, "em")]),
        ("~~old~~ `x*y*` **b**", "old x*y* b", [(0, 3, "strike"), (4, 8, "code"), (9, 10, "strong")]),
        ("**bold with `code` and *more***", "bold with code and more", [(0, 23, "strong"), (10, 14, "code"), (19, 23, "em")]),
        ("***both***", "both", [(0, 4, "strong"), (0, 4, "em")]),
        ("2 * 3 * 4 and a_b_c", "2 * 3 * 4 and a_b_c", []),
        ("open **mark and \\*no\\*", "open **mark and *no*", []),
        ("**[l](http://u/a_b)** x", "l x", [(0, 1, "strong"), (0, 1, "link")]),
        ("\U0001f9c2 __w__ [t]", "\U0001f9c2 w [t]", [(3, 4, "strong")]),
        ("*a **b* c**", "a b c", [(0, 3, "em"), (2, 5, "strong")]),
    ],
)
def test_markdown_marks(spark, source, text, spans):
    r = block_rows(spark.createDataFrame([(1, source)], "doc_id int, md string"), "md").first()
    assert r["text"] == text and sorted((s["start"], s["end"], s["style"]) for s in r["spans"]) == sorted(spans)


def test_items_lie_in_items_that_are_indented_less(spark):
    source = "- a\n    - b\n        - c\n    - d\n- e\n\nplain\n\n   * f\n     1. g\n   * h"
    rows = block_rows(spark.createDataFrame([(1, source)], "doc_id int, md string"), "md").orderBy("block_no").collect()
    assert [(r["text"], r["level"]) for r in rows] == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("e", 0), ("plain", 0), ("f", 0), ("g", 1), ("h", 0)]


def column(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}")


def test_mail_date(spark):
    one = column(spark, "Tue, 15 Feb 2024 10:00:00 +0100")  # the weekday is wrong on purpose
    assert one.select(dates.mail_date(F.col("c"))["value"]).first()[0] == "2024-02-15T09:00:00Z"


def test_call_hash(spark):
    df = spark.range(1)

    def key(args, kwargs):
        return df.select(jsons.call_hash([F.lit(a) for a in args], {k: F.lit(v) for k, v in kwargs.items()})).first()[0]

    assert key(["100"], {"a": "1"}) == "7176e150963e2229c37127e144ebf1d4"
    assert len({key(["200"], {}), key(["200"], {"a": "1"}), key(["100"], {"a": "1"})}) == 3
    assert key([], {"a": "1", "b": "2"}) == key([], {"b": "2", "a": "1"})


@pytest.mark.parametrize("text", ["plain", 'q"\\\n\t', "é", "\U0001f534 x", "\x7f\x01", ""])
def test_json_quote(spark, text):
    import json

    assert column(spark, text).select(jsons.json_quote(F.col("c"))).first()[0] == json.dumps(text)


@pytest.mark.parametrize(
    "answer, ok",
    [
        ('```json\n{"a": 1}\n```', True),
        ('``` json \n{"a": 1}\n```\n', True),
        ('```\n[1]\n```', True),
        (' {"a": 1} ', True),
        ("[1, 2]", True),
        ("10", True),
        ("5", False),
        ("true", False),
        ("null", False),
        ("-1", False),
        ("```json\nno\n```", False),
        ("text {}", False),
    ],
)
def test_decode_json(spark, answer, ok):
    r = column(spark, answer).select(jsons.decode_json(F.col("c")).alias("r")).select("r.error").first()[0]
    assert (r is None) == ok


def test_typed(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([('{"a": 1, "x": 2}',), ('{"b": "q"}',), ("[",), ('{"a": "no"}',)], "c string")
    got = [r["r"] for r in df.select(jsons.typed(F.col("c"), schema, ["a"]).alias("r")).collect()]
    assert [r["value"] is not None for r in got] == [True, False, False, False]
    assert got[1]["error"] == "missing: a"


def test_id_url(spark):
    notes = "\U0001f517http://example.com/id/1\nSome other note."
    df = column(spark, notes)
    assert df.select(strings.get_id_url(F.col("c"))).first()[0] == "http://example.com/id/1"
    assert df.select(strings.set_id_url(F.col("c"), F.lit("u"))).first()[0] == "\U0001f517u\nSome other note."
    assert column(spark, None).select(strings.set_id_url(F.col("c"), F.lit("u"))).first()[0] == "\U0001f517u"


def test_modification_id(spark):
    df = spark.createDataFrame([("a|b|3",), ("|3",), ("a|x",), ("",)], "c string")
    got = [r[0] for r in df.select(strings.split_modification_id(F.col("c"))).collect()]
    assert [g and (g["analysis_id"], g["action_number"]) for g in got] == [("a|b", 3), None, None, None]


def test_header_decoding(spark):
    df = spark.createDataFrame([("=?utf-8?q?caf=C3=A9_a+b?= x",), ("plain",), ("",), ("=?iso-8859-1?B?4Q==?= =?UTF-8?b?w6k=?=",)], "c string")
    assert [r[0] for r in df.select(mail.decode_header(F.col("c"))).collect()] == ["café a+b x", "plain", None, "áé"]


def test_template(spark):
    df = spark.createDataFrame([("Ann", 2, ["x", "y"], None), ("", 0, [], "z")], "name string, n int, tags array<string>, opt string")
    t = Template("{% if name and n > 1 %}Hi {{ name }}{% elif not n %}none{% endif %}|{% for t in tags %}<{{ t }}>{% endfor %}|{{ opt or 'no' }}\n")
    assert [r[0] for r in df.select(t.render(**{c: F.col(c) for c in df.columns})).collect()] == ["Hi Ann|<x><y>|no", "none||z"]
    for bad in ("{% set x = 1 %}", "{{ a + b }}", "{{ a | unknown }}", "{% for x in y %}", "{{ a"):
        with pytest.raises(TemplateError):
            Template(bad).render(a=F.lit("1"), y=F.array())
    with pytest.raises(TemplateError):
        Template("x", required=["a"]).render()
    with pytest.raises(TemplateError):
        Template("x", filters={"length": lambda c: c})
    checked = Template("{{ opt | req('opt') }}").render_checked(opt=F.col("opt"))
    assert [r[0]["error"] for r in df.select(checked).collect()] == ["no value for opt", None]
    outer = Template("{{ part | render }}!", {"part": "for {{ who }}"})
    assert spark.range(1).select(outer.render(who=F.lit("me"))).first()[0] == "for me!"


def test_templates_in_rows(spark):
    from officelake.functions import template

    rows = [("{{ data }}!", "a"), ("{{ data | upper }}", "b"), (None, "c"), ("{% if data %}", "d"), ('{{ include_file("f") }} {{ data }}', None), ('{{ include_file("g") }}', "e")]
    out = template.render_each(spark.createDataFrame(rows, "t string, item string"), "t", "item", files={"f": "{{ raw }}"}).collect()
    assert [r["text"]["value"] for r in out] == ["a!", "B", None, None, "{{ raw }} ", None]
    assert [bool(r["text"]["error"]) for r in out] == [False, False, True, True, False, True]
    records = spark.createDataFrame([("{{ n }} {{ x.y }}", (1, ("z",)))], "t string, item struct<n: int, x: struct<y: string>>")
    assert template.render_each(records, "t", "item").first()["text"]["value"] == "1 z"
    with pytest.raises(template.TemplateError):
        template.render_each(spark.createDataFrame([(f"t{i}", "x") for i in range(5)], "t string, item string"), "t", "item", most=4)


def test_todo_markdown(spark):
    item = F.struct(
        F.lit("HIGH").alias("priority"), F.lit("Do").alias("title"), F.lit("u#1").alias("source_url"), F.lit("2024-01-02").alias("due_date"),
        F.lit("").alias("notes"), F.array(F.struct(F.lit(None).cast("string").alias("title"), F.lit("a b").alias("url"))).alias("links"),
    )
    got = spark.range(1).select(todo_markdown(item)).first()[0]
    assert got == (
        "\n\U0001f534 Do [\U0001f4e7](u#1)\n\n. \U0001f4c5 2024-01-02\n\n\n. **Links**:\n.. \U0001f517 [link](a%20b)\n\n\n&nbsp;\n\n\n\n"
    )


def test_model_calls_hold_few_prompts(spark):
    from officelake.inference.model import ModelSpec, generate_text

    def factory():
        import gc
        from concurrent.futures import Future

        return lambda p: str(sum(isinstance(o, Future) for o in gc.get_objects())) if p.endswith("00") else p

    rows = spark.range(1000, numPartitions=1).select(F.when(F.col("id") != 7, F.col("id").cast("string")).alias("p"))
    got = {r["p"]: r["a"] for r in rows.withColumn("a", generate_text(F.col("p"), ModelSpec("m", factory))).collect()}
    assert got[None]["value"] is None and got["12"]["value"] == "12" and len(got) == 1000
    assert max(int(a["value"]) for p, a in got.items() if p and p.endswith("00")) <= 10  # before, one for every row of the batch
