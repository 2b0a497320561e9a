"""Main text of hand-labelled pages of unlike layouts: ``[[`` and ``]]`` mark what is main text; they are taken out before a page is read."""

import re
from collections import Counter

import pytest

from pairlight.llm import html_text

A = "The council met on Tuesday evening to discuss the new bridge over the river, which has been planned for years."
B = "Engineers said that the work could begin in spring if the money is found, and that it would take two years."
C = "Residents remain divided; some fear the noise, others hope for shorter ways to school and to the station."
D = "Der Stadtrat hat am Dienstag über die neue Brücke beraten, die seit Jahren geplant ist und viel Geld kostet."
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'

PAGES = [
    f"<html><body>[[<h1>Bridge</h1><p>{A}</p><p>{B}</p>]]</body></html>",
    "<body>[[" + f"<p>{A}</p><p>{B}</p><p>{C}</p>" * 4 + "]]</body>",
    f"<html><body><div><div>[[<h1>Bridge plans</h1><p>{A}</p><p>{B}</p><p>{C}</p>]]</div></div></body></html>",
    f'<div class="beitrag">[[<h1>Brücke</h1><p>{D}</p><p>{D}</p>]]</div>',
    f'<body><div id="kopf"><a href="/">Zeitung</a></div><div class="inhalt">[[<h2>Brücke</h2><p>{D}</p><p>{D}</p>]]</div><div class="fuss">Impressum und Datenschutz</div></body>',
    f'<article>[[<p>{A} ]]<span class="advert">BUYNOW cheap shoes</span>[[ and so on.</p><p>{B}</p>]]</article>',
    f'<article>[[<p>{A}</p>]]<ins class="adsbygoogle">BUYNOW shoes</ins>[[<p>{B}</p>]]</article>',
    f"<article>[[<p>{A}</p>]]<label>Pick one</label><select><option>First<option>Second</select>[[<p>{B}</p>]]</article>",
    f"<body><nav>{NAV}</nav><main>[[<h1>Bridge</h1><p>{A}</p><ul><li>{B}</li><li>{C}</li></ul>]]</main><footer><p>Copyright 2024 The Paper</p></footer></body>",
    f'<body><header><h1>The Paper</h1>{NAV}</header><section class="story">[[<h2>Bridge</h2><p>{A}</p><blockquote>{B}</blockquote>]]</section><aside><h3>Popular</h3>{NAV}</aside></body>',
    f'<div class="page"><div class="sidebar">{NAV}</div><div class="content">[[<p>{A}</p><p>{B} <a href="/x">the full plan</a> is online.</p>]]</div></div>',
    f'<body><div class="cookie-banner">We use cookies to improve this site. <button>Accept</button></div><article>[[<h1>Bridge</h1><p>{A}</p><p>{C}</p>]]</article></body>',
    f'<article>[[<h1>Bridge</h1><p>{A}</p><p>{B}</p>]]</article><section id="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I think this is far too expensive for us.</p></div><div class="comment"><b>Bob</b><p>About time that they built it!</p></div></section>',
    f"<body><table><tr><td>{NAV}</td><td>[[<p>{A}</p><p>{B}</p><p>{C}</p>]]</td></tr></table></body>",
    f'<div id="wrapper"><div id="main"><div class="post">[[<h2>A walk</h2><p>{A}<br>{B}</p>]]<div class="share"><a href="#">Tweet</a> <a href="#">Share</a></div></div></div></div>',
    f"<body>[[<p>{A}<p>{B}<p>{C}]]</body>",
    f'<body>[[<h1>Notes</h1><p>{A}</p><pre>x = 1\ny = 2</pre><p>{B}</p>]]<form><label>Search</label><input name=q><button>Go</button></form></body>',
    f'<body><div class="xk3-q"><div class="zzt">[[<p>{A}</p><p>{B}</p><p>{C}</p>]]</div></div><div class="xk3-r">{NAV}</div></body>',
    f'<main class="contenu">[[<h1>Pont</h1><p>{A}</p><p>{B}</p>]]</main><div class="publicité">Achetez maintenant</div>',
    f"<article>[[<p>{A} <em>really</em> and <strong>truly</strong> so, says <a href='/m'>the mayor</a>.</p><figure><img src=a.png><figcaption>The old bridge</figcaption></figure><p>{C}</p>]]</article>",
    f'<article><header>[[<h1>Bridge</h1>]]</header>[[<p>{A}</p><p>{B}</p>]]<footer class="tags"><a href="/t">bridge</a> <a href="/u">river</a></footer></article>',
    f"<html><head><script>var a='<p>no</p>'</script></head><body><noscript>Turn it on</noscript>[[<h1>Bridge</h1><p>{A}</p><p>{B}</p>]]</body></html>",
    f'<body><div role="navigation">{NAV}</div><div role="main">[[<p>{A}</p><p>{C}</p>]]</div><div role="contentinfo">All rights reserved</div></body>',
    f'<body><section>[[<h2>One</h2><p>{A}</p>]]</section><section>[[<h2>Two</h2><p>{B}</p>]]</section><section>[[<h2>Three</h2><p>{C}</p>]]</section></body>',
    f'<article>[[<h1>Bridge</h1><p>{A}</p>]]<div class="newsletter"><form><label>Your mail</label><input><button>Subscribe</button></form></div>[[<p>{B}</p><p>{C}</p>]]</article>',
    f'<article>[[<h1>Bridge</h1><p>{A}</p>]]<aside class="related"><h3>Related</h3>{NAV}</aside>[[<p>{B}</p>]]</article>',
    f'<div class="container">[[<dl><dt>Bridge</dt><dd>{A}</dd><dt>River</dt><dd>{B}</dd></dl><p>{C}</p>]]</div>',
    f"<body>[[<h1>Long</h1><p>{A} {B} {C} {A} {B} {C}</p>]]</body>",
    f'<body><div class="ad">Shoes, now cheaper</div>[[<p>{A}</p>]]<div class="ad">More shoes</div>[[<p>{B}</p>]]<div class="ad">Shoes again</div>[[<p>{C}</p>]]</body>',
    f'<body><div class="top">{NAV}</div><div>[[<p>{A}</p><p>{B}</p>]]</div><div class="footer"><p>Contact us by mail or phone at any time of the day.</p></div></body>',
    f'<div class="testo">[[<p>{D}</p><p><b>{A}</b></p><p>{B}</p>]]</div><ul class="menu"><li><a href="/a">Uno</a><li><a href="/b">Due</a></ul>',
    f"<article>[[<table><tr><td>Length</td><td>200 metres</td></tr><tr><td>Cost</td><td>Nine million</td></tr></table><p>{A}</p><p>{B}</p>]]</article>",
]


def parts(page):
    """The page without its marks, and the words of its main text."""
    main = " ".join(re.findall(r"\[\[(.*?)\]\]", page, re.S))
    return page.replace("[[", "").replace("]]", ""), re.sub(r"<[^>]*>", " ", main).split()


def test_words_of_unlike_layouts():
    model = html_text.trained()
    hit = found = wanted = 0
    wrong = []
    for page in PAGES:
        source, words = parts(page)
        got = model.texts([source])[0].split()
        both = sum((Counter(got) & Counter(words)).values())
        hit, found, wanted = hit + both, found + len(got), wanted + len(words)
        if got != words:
            wrong.append((page[:60], both, len(got), len(words)))
    print(f"precision {hit / found:.3f}, recall {hit / wanted:.3f}, {len(wrong)} of {len(PAGES)} pages not exact: {wrong}")
    assert len(PAGES) >= 30 and hit / found >= 0.95 and hit / wanted >= 0.95


@pytest.mark.parametrize("at", [0, 1, 2, 3, 5, 6, 7])
def test_pages_that_were_wrong(at):
    source, words = parts(PAGES[at])
    assert html_text.trained().texts([source])[0].split() == words


def test_any_column_names(spark):
    rows = [(1, "<p>" + A + "</p>" + "<p>" + B + "</p>", "kept", "also"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, html string, `__html` string, html_of_page string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].text == f"{A} {B}" and got[1]["__html"] == "kept" and got[1].html_of_page == "also" and got[2].text == ""
