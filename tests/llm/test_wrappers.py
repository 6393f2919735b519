"""Main text against pages built from known blocks, and the inference of wrappers."""

from __future__ import annotations

import html
import random
import re
from pathlib import Path

import pytest

from reelyard.llm import wrappers

SCHEMA = "page_id long, url string, html string, text string, rules string, host int"


def sentence(rng):
    words = [rng.choice(["wort", "mañana", "R&D", "a<b", "日本", "naïve", "the", "of"]) + str(rng.randrange(99)) for _ in range(rng.randrange(3, 14))]
    return " ".join(words) + "."


def noisy(rng, text):
    """The markup of a block: references, inline tags, odd white space."""
    words = html.escape(text).split(" ")
    i = rng.randrange(len(words))
    words[i] = f"<{(t := rng.choice(['b', 'em', 'span']))} class=x>{words[i]}</{t}>"
    return rng.choice([" ", "\n  ", "\t"]).join(words)


def page_with_article(rng, blocks):
    body = f"<h1>{noisy(rng, blocks[0])}</h1>"
    for b in blocks[1:]:
        body += rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<ul><li>{}</ul>", "<blockquote><p>{}</p></blockquote>"]).format(noisy(rng, b))
    links = "".join(f"<li><a href='/{i}'>link {rng.randrange(999)}</a>" for i in range(rng.randrange(3, 7)))
    notice = "<div class='cookie-notice'>We use cookies.<button>OK</button></div>" if rng.random() < 0.5 else ""
    comments = f"<section id=comments><article class='comment'><p>{sentence(rng)}</p></article></section>" if rng.random() < 0.6 else ""
    return (
        f"<!DOCTYPE html><html><head><title>{blocks[0]}</title><style>p{{}}</style><script>var t='</p><article>x';</script></head><body>"
        f"<header><h1>Site</h1><form><input name=q><label>Search</label></form></header><nav><ul>{links}</ul></nav>{notice}"
        f"<!-- <p>hidden</p> --><div class=ad>{sentence(rng)}</div><main><article class='post-{rng.randrange(9)}'>{body}"
        f"{comments}</article></main><aside>{sentence(rng)}</aside><footer>&copy; {sentence(rng)}</footer>" + rng.choice(["</body></html>", ""])
    )


def page_of_divs(rng, blocks):
    """No article tag and no telling names: menus by their links, the template by its constant text."""
    links = "".join(f"<div><a href='/{i}'>go {rng.randrange(999)}</a></div>" for i in range(5))
    body = "".join(f"<div>{noisy(rng, b)}</div>" for b in blocks)
    return f"<html><body><div>{links}</div><div>Welcome to the best site of all</div><table><tr><td>{body}</table><div id=footer>{sentence(rng)}</div>"


def corpus(seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        blocks = [sentence(rng) for _ in range(rng.randrange(2, 7))]
        host = f"H{i % 4}.example" if i % 3 else "hot.example"
        make = page_of_divs if host == "H1.example" else page_with_article
        rows.append((i, f"https://user@{host}:8080/{i}?a=b", make(rng, blocks), "\n".join(blocks)))
    rows += [
        (500, "https://hot.example/none", None, ""), (501, "https://hot.example/empty", "", ""), (502, None, "<p>No address", "No address"),
        (503, "nonsense", "<p>Not &lt;closed <b>at &#65;ll", "Not <closed at All"), (None, "https://hot.example/x", "<article>a<hr>b<p>c", "a\nb\nc"),
        (504, "https://hot.example/x", "<article></article><footer>f</footer>", ""), (505, "http://deep.example", "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        (506, "http://odd.example", "<article>1 < 2 <a href=\"never closed>link</a> & <p>&amp;amp; </ x>end", None),
        (507, "http://odd.example", "<script>never closed <p>x", ""), (508, "http://big.example", "<article>" + "<p>w w" * 40000, "\n".join(["w w"] * 40000)),
        (509, "http://twice.example", "<article><p>same", "same"), (509, "http://twice.example", "<article><p>same", "same"),
    ]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash", 7) for i, u, h, _ in rows], SCHEMA).repartition(6).cache()


@pytest.mark.parametrize("fan_in,broadcast_bytes", [(32, 1 << 20), (2, 0)])
def test_known_articles(pages, rows, fan_in, broadcast_bytes):
    got = wrappers.main_text(pages, fan_in=fan_in, broadcast_bytes=broadcast_bytes)
    assert got.columns == ["page_id", "url", "html", "rules", "host", "text", "n_chars"]
    found = got.collect()
    want = sorted((str(i), u, t) for i, u, _, t in rows if t is not None)
    assert sorted((str(r.page_id), r.url, r.text) for r in found if r.page_id != 506) == want
    assert all(r.n_chars == len(r.text) and r.rules == "clash" for r in found)


def test_empty_table(spark):
    got = wrappers.digest(spark, spark.createDataFrame([], SCHEMA))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.collect() == []


def test_one_wrapper_per_host_accepts_its_pages(spark, pages, rows):
    found = wrappers.host_wrappers(pages.select(wrappers.host_of("url").alias("host"), "html"), fan_in=2)
    listed = {r.host: r for r in wrappers.templates(found).collect()}
    hosts = [re.sub(r".*@|:8080.*|https?://|/.*", "", u or "").lower() if u != "nonsense" else "" for _, u, _, _ in rows]
    assert {h: r.pages for h, r in listed.items()} == {h: hosts.count(h) for h in set(hosts)}
    assert "<nav><ul>(<li>_</li>)+</ul></nav>" in listed["h2.example"].expression
    assert "(<div[cookie-notice]>We use cookies\\.<button>OK</button></div>)?" in listed["h2.example"].expression.replace("\\ ", " ")


def wrapper(*pages):
    first, *others = [wrappers.wrap(wrappers.page_tree(p)) for p in pages]
    for other in others:
        wrappers.absorb(first, other)
    return wrappers.expression(first)


def test_mismatches_become_slots_optional_and_repeated_parts():
    assert wrapper("<p>a</p>", "<p>b</p>") == "<p>_</p>"
    assert wrapper("<p>a</p>", "<p>a</p>") == "<p>a</p>"
    assert wrapper("<h1>a</h1><p>b</p>", "<h1>a</h1>") == "<h1>a</h1>(<p>_</p>)?"
    assert wrapper("<ul><li>a<li>b</ul>", "<ul><li>c</ul>") == "<ul>(<li>_</li>)+</ul>"
    assert wrapper("<h2>a</h2><p>b</p><h2>c</h2>", "<h2>d</h2>") == "((<h2>_</h2>)?(<p>_</p>)?)+"
    assert wrapper("<h2>a</h2><p>b</p>", "<p>b</p><h2>a</h2>") == "((<h2>a</h2>)?(<p>b</p>)?)+"
    assert wrapper("<p>a</p><hr><div>x</div>", "<div>x</div>", "<pre>q</pre><div>x</div>") == "(<pre>_</pre>)?(<p>_</p>)?<div>x</div>"


def test_many_names_become_a_slot():
    page = "".join(f"<div class='c{chr(97 + i % 26)}{chr(97 + i // 26)}'>x</div>" for i in range(400))
    node = wrappers.wrap(wrappers.page_tree(page))
    assert list(node["k"]) == ["div *"] and node["k"]["div *"]["c"] == 400
    other = wrappers.wrap(wrappers.page_tree("<div class=ca>y</div><p>z</p>"))
    assert wrappers.expression(wrappers.absorb(other, node)) == "(<div[*]>_</div>)+(<p>_</p>)?"


SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_over_the_table(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r.page_id: r.text for r in wrappers.digest(spark, pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>|<br>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
