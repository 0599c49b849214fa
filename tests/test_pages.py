"""Page trees against a walk of the tree in plain Python, and units of single pages."""

import random

import pytest

from lectern.sources import page_tree

SCHEMA = "page_id bigint, html string"


def units(spark, *pages, remove_ruby=False):
    rows = page_tree.page_tree_units(page_tree.page_nodes(spark.createDataFrame(list(enumerate(pages)), SCHEMA)), remove_ruby).where("kind IS NOT NULL").orderBy("page_id", "node").collect()
    return [[(r.kind, r.text, r.block) for r in rows if r.page_id == i] for i in range(len(pages))]


def said(spark, page, **more):
    return [t for _, t, _ in units(spark, page, **more)[0]]


def test_hidden_paragraph(spark):
    page = "<p>one.</p><p aria-hidden='true'>no</p><p hidden>no</p><p style='DISPLAY:none'>no</p><p aria-hidden='false'>two.</p>"
    text = page_tree.with_page_text(page_tree.page_tree_units(page_tree.page_nodes(spark.createDataFrame([(1, page), (2, None), (3, ""), (3, "<p>again")], SCHEMA))))
    assert sorted((r.page_id, r.page_text) for r in text.collect()) == [(1, "one.\ntwo."), (2, ""), (3, ""), (3, "again")]


def test_ruby(spark):
    page = "<p><ruby>漢<b>字</b><rp>(<rt>かん<i>じ</i><rp>)</ruby>です</p>"
    assert said(spark, page) == ["漢", "字", "です"]
    assert said(spark, page, remove_ruby=True) == ["かん", "じ", "です"]


def test_alternative_texts_and_labels(spark):
    page = "<img alt=' a '><img role=presentation alt=b><img alt=''><img><img aria-label=c alt=d><img aria-label=' ' alt=e><div aria-hidden=true><img alt=f><svg aria-label=g>x</svg></div><video aria-label=h>x</video><canvas>x</canvas>"
    assert [u[:2] for u in units(spark, page)[0]] == [("alt", "a"), ("alt", "c"), ("alt", "e"), ("label", "g"), ("label", "h")]


def test_shadow_roots_come_first_and_end_blocks(spark):
    page = "<div aria-hidden=true><p>no</p></div><div>light<template shadowrootmode=open>in<p>deep<template shadowrootmode=open>er</template></p></template><template shadowrootmode=closed>no</template></div>"
    got = units(spark, page)[0]
    assert [u[1] for u in got] == ["in", "er", "deep", "light"]
    assert got[0][2] is None and got[1][2] is None and got[2][2] is not None and got[3][2] not in (None, got[2][2])


def test_frames(spark):
    page = '<p aria-hidden=true>no<iframe srcdoc="<p>a &amp;lt; b</p>c">no</iframe></p><iframe src="x">no</iframe><iframe sandbox srcdoc="no"></iframe><iframe sandbox="allow-same-origin" srcdoc="d"></iframe><noscript><iframe srcdoc="no"></iframe></noscript>'
    got = units(spark, page)[0]
    assert [u[1] for u in got] == ["a < b", "c", "d"] and got[0][2] is not None and got[1][2] is None


def test_blocks_are_elements(spark):
    got = units(spark, "<div>a<p></p>b<p>c<div>d</div>e<ul><li>f<li>g</ul><br>h</div>")[0]
    block = {t: b for _, t, b in got}
    assert block["a"] == block["b"] == block["e"] == block["h"] and len({block[t] for t in "acdfg"}) == 5


TAGS = ["div", "p", "b", "span", "section", "script", "svg", "ruby", "rt", "rp", "template", "template shadowrootmode=open", "td", "a aria-hidden=true", "i hidden"]


def walked(node, above=(), roots=0):
    """(text, nearest block, hidden, nearest aid) of texts outside unread elements, by recursion."""
    inside = [*above, node]
    if node.tag == page_tree.ROOT:
        inside = [node]
    for c in node.children:
        if c.tag is None:
            aids = [n.tag for n in inside if n.tag in ("rt", "rp", "ruby")]
            blocks = [n for n in inside if n.tag in page_tree.BLOCKS]
            hidden = any((n.attrs or {}).get("aria-hidden") == "true" or "hidden" in (n.attrs or {}) for n in inside)
            if c.text.strip() and not hidden and (not aids or aids[-1] == "ruby"):
                yield c.text, blocks[-1] if blocks else None
        elif c.tag not in page_tree.UNREAD | page_tree.MEDIA:
            yield from walked(c, inside)


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, seed):
    draw, pages = random.Random(seed), []
    for _ in range(60):
        out, n = [], 0
        for _ in range(draw.randrange(40)):
            tag = draw.choice(TAGS)
            out.append(draw.choice([f"<{tag}>", f"</{tag.split()[0]}>", f"t{n} ", "<br>", "<!-- c -->"]))
            n += 1
        pages.append("".join(out))
    for page, got in zip(pages, units(spark, *pages), strict=True):
        want = list(walked(page_tree.parse(page)))
        assert [t for _, t, _ in got] == [t for t, _ in want], page
        for (_, _, a), (_, x), (_, _, b), (_, y) in zip(got, want, got[1:], want[1:]):
            assert (a == b) == (x is y), page


@pytest.mark.parametrize("name", ["page_text", "page_tree_text", "spoken_page"])
def test_cut_references_equal_sql(spark, tmp_path, name):
    import duckdb

    from lectern.plans import catalog

    cut = "<nav>n</nav><h1>{0}</h1><p>{0} b &copy; &amp;lt; c</p><p>d {0}</p>"
    pages = [cut.format(x) for x in ("the&amp;&amp;&amp", "&am", "x&quot", "&amp &copy y", "&", "&amp;&quo", "a&#65")]
    spark.createDataFrame(list(enumerate(pages)), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    query, sql = catalog.QUERIES[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, query(spark, str(tmp_path)).select(*names).collect())) == sorted(cur.fetchall())
