"""The HTML parser with a stack on cases that patterns can't follow."""

from clauseq.sources import htmltree


def test_sections_of_nested_and_unclosed_markup(spark):
    page = """<html><body><nav><p>no</p></nav><p>first &#8211; &#x41;&amp;&nbsp;b<p>second<ul><li>one<li>two <ul><li>in &lt;two&gt;</ul></ul>
    <h2 id="x"><b>1.2</b> Title</h2><div><div><p>deep</div></div><pre>a
  b</pre><table
    ><caption>Cap</caption><tr><td>a<td>b<table><tr><td>inner</table><tr><th>c</table><p>after
    <h3 id="own">No number</h3><p>x</p><script>var a = "<p>y</p>";</script><h4 id="_12345678-1234-1234-1234-123456789012">Guid</h4><p>z<h5>5 Empty</h5></body></html>"""
    rows = spark.createDataFrame([(1, page), (2, None), (3, "<p>" * 3000 + "deep"), (4, "plain"), (5, "<li>only")], "id long, html string")
    got = sorted((r["id"], r["pos"], r["anchor"], r["title"], r["body"]) for r in htmltree.sections(rows, "id", "html").collect())
    assert got[:4] == [
        (1, 0, "", "", "first – A& b\nsecond\n- one\n- two in <two>\n- in <two>"), (1, 1, "1.2", "1.2 Title", "deep\na\n  b\nTable — Cap\na | b inner | inner\ninner\nc\ninner\nafter"),
        (1, 2, "own", "No number", "x"), (1, 3, "", "Guid", "z"),
    ]
    assert got[4:] == [(3, 0, "", "", "deep"), (5, 0, "", "", "- only")]
    assert htmltree.sections(rows, "id", "html", "^(first|x)").where("body LIKE '%first%'").count() == 0


def test_tables_with_headers_and_tables_within(spark):
    page = """<h2>3.5 Errors</h2><table><thead><tr><th></th></tr><tr><th>A<th>B</thead><tbody><tr><td>1</td><td></td><td>2<table><tr><td>in</td></tr></table></td></tr></tbody></table>
    <table><tr><td>x<tr><th>H</th><th>I</th></tr><tr><th>J</th></tr></table><table><tr><td>p</td><td>q</td></tr></table><table></table><h3>Next</h3><table><tr><td>1</table>"""
    rows = spark.createDataFrame([("k", page), (None, "<table><tr><td>n")], "key string, html string")
    got = sorted((str(r["key"]), r["pos"], r["nth"], r["anchor"], r["columns"], r["rows"], r["guessed"]) for r in htmltree.tables(rows, "key", "html").collect())
    assert got == [
        ("None", 0, 0, "", ["Column 1"], [["n"]], True), ("k", 1, 0, "3.5", ["A", "B"], [["1", "2 in", "in"], ["in"]], False), ("k", 1, 1, "3.5", ["H", "I"], [["x"], ["J"]], False),
        ("k", 1, 2, "3.5", ["Column 1", "Column 2"], [["p", "q"]], True), ("k", 2, 0, "", ["Column 1"], [["1"]], True),
    ]
    assert htmltree.tables(rows.limit(0), "key", "html").count() == 0


def test_plain_markup_is_read_without_a_tree_and_gives_the_same_rows(monkeypatch):
    plain = [
        "<script>var t='<table >';</script><h2 id=a>2 Order</h2><p>Text<table><caption>Lines &amp;  more</caption><thead><tr><th>A<th>B</thead><tr><td class=x> 1<td>x &lt; <b>2</b><td></table>after<table><tr><td>n",
        "<!DOCTYPE html><html><body><h2>1.1 One</h2><table><tr><th>H</th></tr><tr><td>v</td></tr></table></body><table><tr><td>behind the body</td></tr></table>",
        "<dl><dt><body><table><tr><td>in</td></tr></table><dt><table><tr><td>a dt ends the body</td></tr></table>",
        "<table><tr><td>1</td></tr><thead><tr><th></th></tr><tr><th>late</th></tr></thead></table><h3>no number</h3><table><caption>c<tr><td>x</td></caption><tr></table>",
    ]
    want = [htmltree.tree_rows(t) for t in plain]
    monkeypatch.setattr(htmltree, "parse", lambda _: 1 / 0)
    assert [htmltree.table_rows(t) for t in plain] == want and all(want)
    monkeypatch.undo()
    for t in ("<table><tr><td>a<table><tr><td>b</table></table>", "<nav><table><tr><td>no</table></nav><table><tr><td>a < b</table>", "<h2><table><tr><td>t</table></h2>", "<table><tr title='>'><td>q</table>"):
        assert htmltree._Tables().read(t) is None and htmltree.table_rows(t) == htmltree.tree_rows(t)
