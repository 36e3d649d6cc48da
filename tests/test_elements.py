"""Pages cleaned by what their elements hold, against a stack machine."""

import random
import re

import pytest

from officelake.operators import elements


def cleaned(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return [r["clean"] for r in elements.clean_pages(df, "id", "html").orderBy("id").collect()]


@pytest.mark.parametrize(
    "page,wanted",
    [
        (None, None),
        ("", ""),
        (" \n ", ""),
        ("plain text", "plain text"),
        ('<div dir="auto"><br></div> \n', ""),
        ("<p>a</p><p> </p><p>b</p>", "<p>a</p><p>b</p>"),
        ("<div><p><i>!?</i></p><b>x1</b></div>", "<div><b>x1</b></div>"),
        ('<p>a<span style="display: none">secret <b>deep</b></span>c</p>', "<p>ac</p>"),
        ("<p style='visibility:hidden'>gone</p>stays", "stays"),
        ('<p><em style="display:none">only this</em></p>x', "<p></p>x"),
        ('<a class="k" href="/u" ID=top data-id="3">t</a>', '<a href="/u" data-id="3">t</a>'),
        ('<p style="color: red; margin-top:3px; MSO-x: 1; font:9px">t</p>', '<p style="color:red">t</p>'),
        ('<p style="margin:0;float:left">t</p>', "<p>t</p>"),
        ("a<!-- <b>no</b> --><SCRIPT src=x>var s = '<p>no</p>';</SCRIPT ><style>p{}</style>b", "ab"),
        ("<!DOCTYPE html><html><head><title></title></head><body><p>t</p></body></html>", "<!DOCTYPE html><html><head></head><body><p>t</p></body></html>"),
        ("<p>one<p>two</p></b>three", "<p>one<p>two</p>three</p>"),
        ("<div><p>one<b>two</div>three", "<div><p>one<b>two</b></p></div>three"),
        ('<a title="a > b">t</a> 1 < 2', '<a title="a > b">t</a> 1 < 2'),
        ("<ul><li>a<ul><li></li><li>b</li></ul></li><li><img src=x></li></ul>", "<ul><li>a<ul><li>b</li></ul></li></ul>"),
    ],
)
def test_pages_keep_what_is_seen(spark, page, wanted):
    assert cleaned(spark, page) == [wanted]


def by_stack(html):
    """The same by following the nesting, for well-formed pages of simple tags."""
    root = ["", "", []]
    stack = [root]
    for t in re.findall(r"<[^>]+>|[^<]+", html):
        if t.startswith("</"):
            if any(n[0] == t[2:-1] for n in stack[1:]):
                while stack.pop()[0] != t[2:-1]:
                    pass
        elif t == "<br>":
            stack[-1][2].append(["br", t, []])
        elif t.startswith("<"):
            node = [re.match(r"<(\w+)", t)[1], t, []]
            stack[-1][2].append(node)
            stack.append(node)
        else:
            stack[-1][2].append(t)

    def text(n):
        return n if isinstance(n, str) else "".join(map(text, n[2]))

    def shown(n):
        if isinstance(n, str):
            return n
        if not re.search("[a-z0-9]", text(n)) or "display:none" in n[1]:
            return ""
        return n[1] + "".join(map(shown, n[2])) + f"</{n[0]}>"

    return "".join(map(shown, root[2])) if re.search("[a-z0-9]", text(root)) else ""


def test_random_pages_agree_with_a_stack(spark):
    r = random.Random(4)

    def page(depth):
        out = ""
        for _ in range(r.randint(0, 4)):
            n = r.choice(["p", "div", "b"])
            style = r.choice(["", "", "", ' style="display:none"'])
            # now and then the closing tag is missing: the element ends with the one around it
            close = f"</{n}>" if r.random() < 0.9 or depth == 4 else ""
            out += r.choice(["t1", " ", "!", "<br>", f"<{n}{style}>{page(depth - 1) if depth else 'x'}{close}"])
        return f"<section>{out}</section>"

    pages = [page(4) for _ in range(150)]
    # a missing closing tag of a name makes a later one close an inner element instead: a stack says the same
    assert cleaned(spark, *pages) == [by_stack(p) for p in pages]


@pytest.mark.parametrize(
    "page,wanted",
    [
        ("<h2>Soup</h2><p>Boil <b>three</b> <i>eggs</i>.</p><p>Serve\n warm</p>", "## Soup\n\nBoil **three** *eggs*.\n\nServe warm\n"),
        ("<ul><li>a<ul><li>b<ul><li>c</li></ul></li></ul></li><li>d</li></ul>after", "* a\n  + b\n    - c\n* d\n\nafter\n"),
        ("<ol><li>one</li><li><p>two</p><p>more</p></li><li>three<ul><li>x</li></ul></li></ol>", "1. one\n2. two\n   more\n3. three\n   + x\n"),
        ("<p>see</p><blockquote><p>one</p><p>two</p><blockquote>deep</blockquote></blockquote><p>end</p>", "see\n\n> one\n>\n> two\n>\n> > deep\n\nend\n"),
        ("<pre>x = 1\n  *y* &lt; z\n</pre><p>use <code>a_b*c</code></p>", "```\nx = 1\n  *y* < z\n```\n\nuse `a_b*c`\n"),
        ("<table><tr><th>k</th><th>n</th></tr><tr><td>egg</td><td><p>3</p></td></tr></table>", "| k | n |\n| --- | --- |\n| egg | 3 |\n"),
        ("<p>5 * 3_a &amp;amp; <a href='/u_1'>li_nk</a> <a>none</a></p>", "5 \\* 3\\_a &amp; [li\\_nk](/u_1) none\n"),
        ('<div>a<p style="display:none">no</p></div><p> </p>b', "a\n\nb\n"),
        ("<p>open <b>end", "open **end**\n"),
        ("<ul><li> </li></ul>", None),
        (None, None),
    ],
)
def test_pages_as_markdown(spark, page, wanted):
    from officelake.operators import rendering

    r = rendering.markdown_pages(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html").first()
    assert (r["value"], r["error"]) == (wanted, None if wanted else "the page has no text")
