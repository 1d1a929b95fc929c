"""Main text of pages written by hand, and of a host without marks."""

import duckdb
import pytest

from larder.llm import markup, pages

SCHEMA = "page_id long, url string, html string, text string"


def own(html, least=markup.PLAIN):
    return "\n".join(t for t, p in markup.blocks(html) if p >= least)


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b</p>c", "a\nb\nc"),
        ("<p>one <b>two</b>three<br>four</p>", "one twothree four"),
        ("<article><h1>T &amp; t</h1><p><b>x<br><p>y</p></article>", "T & t\nx\ny"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc d\ne"),
        ("a<script>var t='</p><b>';</script>b<style>p{}</style>c", "abc"),
        ("a<!-- <p>no</p> -->b<!-- open <p>no", "ab"),
        ("<nav><ul><li>no</li></ul></nav><div class='ad'>no</div><p>yes</p><footer>no</footer>", "yes"),
        ("<div id=cookie-banner><div>no</div></div><div class='leadText'>yes</div>", "yes"),
        ("<form><p>no</p><input></form><p hidden>no</p><div style='display: none'>no</div>yes", "yes"),
        ("<section class='comments'><article class='comment'><p>no</p></article></section><p>yes", "yes"),
        ("1 < 2 & 3 &lt;b&gt; &#233; &eacute &copy; &quo", "1 < 2 & 3 <b> é é © &quo"),
        ("<p title='a > b'>x</p><p title=\"it's\">y</p>", "x\ny"),
        ("<p>whole</p><a href='cut", "whole"),
        ("<p>x &amp", "x &"),
        ("<head><title>no</title></head><body>yes</body>", "yes"),
        ("<title>no</title><p>yes", "yes"),
        ("<nav>no</p>no</nav>yes", "yes"),
        ("<aside><div>no</aside><p>yes", "yes"),
        ("<div class=ad>no<article>yes</article>", "yes"),
        ("<article>yes</article><div class=comments><article>no</article></div>", "yes"),
        ("<aside><article>no</article></aside><article>yes</article>", "yes"),
        ("<article><header><h1>title</h1></header>text<footer>no</footer></article>", "title\ntext"),
    ],
)
def test_blocks(html, want):
    assert own(html) == want


def test_given_pages(spark):
    rows = duckdb.sql("SELECT page_id, url, html FROM read_parquet('/root/testdata/sf0.001/pages.parquet')").fetchall()
    out = {r["page_id"]: r for r in pages.main_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    assert len(out) == len(rows)
    for page_id, url, html in rows:
        article = html.partition("<article>")[2].partition("</article>")[0]
        assert out[page_id]["url"] == url
        assert out[page_id]["text"] == own(article)
        assert out[page_id]["n_chars"] == len(out[page_id]["text"])
        assert not set("<>").intersection(out[page_id]["text"]) or "&lt;" in html or "&gt;" in html


def test_what_a_host_repeats_is_left_out(spark):
    menu = "<div>Home of all the good things</div><div>Contact us by phone or by mail today</div>"
    end = "<p>All rights reserved by the owner of this site and nobody else at all</p>"
    body = [" ".join(f"word{i}x{j}" for j in range(40)) for i in range(12)]
    rows = [(i, "https://user@A.example.com:80/x" if i % 2 else "http://a.example.com/", f"{menu}<p>{b}</p>{end}", "") for i, b in enumerate(body)]
    other = [(100, "http://b.example.com/1", f"{menu}<p>only here</p>", ""), (101, None, None, ""), (102, "", "", ""), (None, "no host", "<p>&nbsp;</p>", "")]
    same = [(200 + i, "http://c.example.com/", f"<p>{body[0]}</p>", "") for i in range(4)] + [rows[3]]
    out = pages.main_text(spark.createDataFrame(rows + other + same, SCHEMA).repartition(3)).collect()
    assert len(out) == len(rows) + len(other) + len(same)
    found = {r["page_id"]: r["text"] for r in out}
    assert all(found[i] == b for i, b in enumerate(body))
    assert found[100].endswith("only here") and found[100].startswith("Home")
    assert found[101] == found[102] == found[None] == ""
    assert all(found[200 + i] == body[0] for i in range(4))
    assert pages.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_text_of_main_beside_its_article(spark):
    body = [" ".join(f"word{i}x{j}" for j in range(30)) for i in range(4)]
    share = "<p>Share this with all of your friends by mail or letter</p>"
    rows = [(i, "http://a.example.com/", f"<main><h1>Title {i}</h1><article><p>{b}</p></article>{share}<p>Last{i} words{i} here{i}</p></main>", "") for i, b in enumerate(body[:2])]
    alone = [(9, "http://b.example.com/", f"<main><article><p>{body[0]}</p></article>{share}</main>", "")]
    out = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows + alone, SCHEMA)).collect()}
    assert [out[i] for i in range(2)] == [f"Title {i}\n{body[i]}\nLast{i} words{i} here{i}" for i in range(2)]
    assert out[9] == own(f"<p>{body[0]}</p>{share}")


def test_two_pages_of_different_articles_repeat(spark):
    menu = "<div>Home of all the good things that we have</div>"
    body = [" ".join(f"word{i}x{j}" for j in range(30)) for i in range(4)]
    rows = [(i, "http://a.example.com/", f"{menu}<p>{b}</p>", "") for i, b in enumerate(body[:2])]
    copies = [(10, "http://c.example.com/", f"<p>{body[2]}</p><p>First print</p>", ""), (11, "http://c.example.com/", f"<p>{body[2]}</p><p>Second print</p>", "")]
    out = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows + copies, SCHEMA)).collect()}
    assert [out[0], out[1]] == body[:2]
    assert [out[10], out[11]] == [f"{body[2]}\nFirst print", f"{body[2]}\nSecond print"]


def test_what_half_of_a_hosts_articles_repeat_is_left_out_inside_them(spark):
    body = [[" ".join(f"word{i}x{k}y{j}" for j in range(30)) for k in range(2)] for i in range(6)]
    share = "Share this with all of your friends by mail or letter"
    long = " ".join(f"terms{j}" for j in range(70))
    quote = "a paragraph that two of the six articles here have in common with each other"
    rows = []
    for i, (a, b) in enumerate(body):
        cited = f"<p>{quote}</p>" if i < 2 else ""
        rows.append((i, "http://a.example.com/", f"<article><p>{a}</p><p>{share}</p><p>{b}</p><p>{i} {a} {b}</p>{cited}<p>{long}</p></article>", ""))
    copies = [(10 + i, "http://b.example.com/", f"<article><p>{body[0][0]}</p><p>{body[0][1]} {body[i][0]}</p></article>", "") for i in range(1, 5)]
    few = [(20 + i, "http://c.example.com/", f"<article><p>{body[i][0]}</p><p>{share}</p></article>", "") for i in range(2)]
    again = [(30 + k * 2 + i, "http://d.example.com/", f"<article><p>{body[i][0]}</p><p>{share}</p></article>", "") for i in range(2) for k in range(3)]
    out = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows + copies + few + again, SCHEMA).repartition(3)).collect()}
    assert [out[i] for i in range(6)] == ["\n".join([a, b, f"{i} {a} {b}", *([quote] if i < 2 else [])]) for i, (a, b) in enumerate(body)]
    assert all(out[i] == own(html) for i, _, html, _ in copies + few + again)
