"""Reading of pages: scripts, broken markup, names of what is left out, and pages of many megabytes."""

import time

import pytest

from lectern.llm.wrappers import Page, main_text, structure


def text(source):
    page = Page(source)
    return main_text(page, structure(page), None)


def test_text_after_a_script_stays():
    body = "<p>one</p><script>for(i=0;i<n;i++){f(i);}</script><p>two</p><p>three isn't</p><p>four</p>"
    assert text(f"<article>{body}</article>").split("\n") == ["one", "two", "three isn't", "four"]
    assert text("<script>if(a<b){c='x</script><article><p>one</p><p>it's two</p></article>").split("\n") == ["one", "it's two"]
    # a letter whose lower case is longer
    assert text("<article><p>" + "İ" * 40 + "</p><SCRIPT>x<y</SCRIPT><p>one</p><p>two</p></article>").split("\n")[1:] == ["one", "two"]


def test_names_count_by_their_heads():
    keep = ["<div class='share-price'><p>Shares rose</p></div>", "<div class='content rail-news'>by rail</div>", "<ul class='menu'><li>Soup<li>Bread</ul>", "<div class='has-sidebar'><p>wide</p></div>"]
    drop = ["<div class='cookie-notice'>c</div>", "<div id='ad-slot-7'>a</div>", "<ul class='menu'><li><a href='/'>Home</a></ul>", "<div class=comments><p>first!</p></div>", "<nav>n</nav>", "<p hidden>h</p>", "<div style='display: none'>d</div>", "<form>f</form>", "<b class='ad'>b</b>"]
    assert text("<article><p>start</p>" + "".join(x + "<p>text</p>" for x in keep + drop) + "</article>") == "\n".join(["start", "Shares rose", "text", "by rail", "text", "Soup", "Bread", "text", "wide", *["text"] * (len(drop) + 1)])
    assert text("<article><p>a <em class='alert'>loud</em> word</p><div class='commentList'>c</div><p>b</p></article>") == "a loud word\nb"
    # a layout that is named after its sidebar
    assert text("<div class='page sidebar'><article><p>a long text of the page</p></article></div><p>x</p>") == "a long text of the page"


def test_broken_markup():
    assert text("a < b & c <unclosed 'q") == "a < b & c"
    assert text("<ul><li>one<li>two<p>three<li>four</ul><table><tr><td>a<td>b<tr><td>c</table>") == "one\ntwo\nthree\nfour\na\nb\nc"
    assert text("<article><p>it's <img alt=\"x\" y\">so</p></article>") == "it's so"
    assert text("</div></p><p>x</b></article>y") == "xy"
    assert text("") == text("<!--") == text("<p") == text("<script>x") == ""
    assert text("<!-->a<!--b-->c<!DOCTYPE x>&lt;b&gt;&nbsp;d&#x41;") == "ac<b> dA"


def test_containers_without_article():
    body = "<div><h1>T</h1><p>long text of the page here and more of it, and more</p><p>and further text</p></div>"
    assert text(f"<div>menu</div>{body}<div>foot</div>").split("\n")[0] == "T"
    assert text(f"<main>{body}</main><div>{body * 3}</div>").count("\n") == 2
    # the longest of several chapters is no region
    chapters = "".join(f"<div class='chapter'><h2>{k}</h2><p>{'word ' * (400 if k == 1 else 20)}</p></div>" for k in range(4))
    assert [x for x in text(f"<div>{chapters}</div>").split("\n") if len(x) == 1] == list("0123")


@pytest.mark.parametrize("part", ["<a x='", "<div>t", "<b>t", "<li><ul>t", "<p>x</p>", "<tr><td>a<td>b", "</div", "<c1>t</c1><c2>t</c2>", "<p class=a$>t", "<article>t<nav>", "&amp;"])
def test_time_grows_with_the_length(part):
    def took(n):
        source = "".join(part.replace("$", "b" * (i % 300)) for i in range(n))
        began = time.process_time()
        out = text(source)
        return time.process_time() - began, out

    took(2_000)
    small, large = took(5_000)[0], took(50_000)[0]
    assert large < 40 * max(small, 0.02)
