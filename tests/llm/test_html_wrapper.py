"""HTML extraction: what the wrapper does by itself, tree matching against brute force, deep and long pages, clashing names."""

import random
from functools import lru_cache

import pytest

from sievelane.llm import html_extract
from sievelane.llm.html_extract import fold, match, parse

WORDS = "river stone early market window paper quiet garden letter morning silver bridge".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def site(n, seed=0):
    """Pages whose markup doesn't tell menus, notices and adverts by name: (html, article)."""
    rng = random.Random(seed)
    adverts = [f"Buy {w} now, only today and only here" for w in WORDS[:4]]
    out = []
    for i in range(n):
        title, paragraphs = f"{prose(rng, 4)} {i}", [f"{prose(rng, 30)} {i}" for _ in range(rng.randint(2, 6))]
        menu = "".join(f"<li><a href='/{w}{i}'>{w} {rng.choice(WORDS)}</a></li>" for w in rng.sample(WORDS, 5))
        inner = "".join(f"<p>{p}</p>" for p in paragraphs[:1]) + f"<div><span>{rng.choice(adverts)}</span></div>" + "".join(f"<p>{p}</p>" for p in paragraphs[1:])
        html = f"<body><div><ul>{menu}</ul></div><div>We use biscuits on this site. Agree.</div><div><h1>{title}</h1>{inner}<p>Send us your letters at any time.</p></div><div><span>Offer {i}: {rng.choice(WORDS)}</span></div><div>(c) {i} all rights</div></body>"
        out.append((html, "\n".join([title, *paragraphs])))
    return out


def test_the_wrapper_tells_content_without_names(spark, monkeypatch):
    pages = site(60)
    df = spark.createDataFrame([(i, f"http://plain.example/{i}", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert [got[i] for i in range(60)] == [t for _, t in pages]
    # without the wrapper everything that prose elements hold is there
    assert all(html_extract.extract_text(h) != t for h, t in pages)


def test_names_of_classes_are_not_needed(monkeypatch):
    monkeypatch.setattr(html_extract, "DROP_WORDS", set())
    rng = random.Random(1)
    pages = [f"<body><div class='menu'><a href='/'>{prose(rng, 2)}</a></div><div class='ad'>{prose(rng, 6)}</div><div class='story'>" + "".join(f"<p>{prose(rng, 20)}</p>" for _ in range(4)) + "</div></body>" for _ in range(30)]
    total = None
    for p in pages:
        own = html_extract.bare(fold(parse(p)))
        total = own if total is None else html_extract.merge(total, own)
    rule = html_extract.Rule(total, html_extract.content(total, {}, set()))
    for p in pages:
        assert html_extract.extract_text(p, rule) == "\n".join(x.split("<")[0] for x in p.split("<p>")[1:])


def tree(rng, depth=0):
    tag = rng.choice(["div", "ul", "li"])
    return [tag, 1, 0, 0, "", [tree(rng, depth + 1) for _ in range(rng.randint(0, 3))] if depth < 3 else []]


def brute_match(a, b):
    if a[0] != b[0]:
        return 0

    @lru_cache(None)
    def best(i, j):
        if i == len(a[5]) or j == len(b[5]):
            return 0
        return max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + brute_match(a[5][i], b[5][j]))

    return 1 + best(0, 0)


@pytest.mark.parametrize("cells", [1, 6, 1 << 20])
def test_tree_matching_is_the_best(monkeypatch, cells):
    monkeypatch.setattr(html_extract, "TABLE", cells)
    rng = random.Random(cells)
    for _ in range(300):
        a, b = tree(rng), tree(rng)
        want = brute_match(a, b)
        assert match(a, b, {}) == want
        if want:
            memo = {}
            pairs = html_extract._align(a[5], b[5], memo)
            assert 1 + sum(match(a[5][i], b[5][j], memo) for i, j in pairs) == want
            assert all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:]))


def test_deep_and_long_pages_and_clashing_names(spark):
    deep = "<div>" * 10_000 + "deep words" + "</div>" * 10_000 + "<p>after</p>"
    unclosed = "<article>" + "<section><p>a" * 3_000
    long = "<article>" + "".join(f"<h2>t{i}</h2><p>text {i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://d.example/1", deep, "mine", 3), (2, "http://u.example/1", unclosed, "mine", 3), (3, "http://l.example/1", long, "mine", 3), (4, "http://l.example/2", "<article><p>short</p></article>", "mine", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, N_chars int")
    out = html_extract.extract(df)
    assert out.columns == ["page_id", "url", "text_in", "N_chars_in", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert "deep words" in got[1].text and got[2].text == "\n".join(["a"] * 3_000) and got[4].text == "short"
    assert got[3].text == "\n".join(f"t{i}\ntext {i}" for i in range(20_000)) and got[3].text_in == "mine"


def test_a_wrapper_keeps_what_most_pages_have():
    total = None
    for i in range(50):
        own = html_extract.bare(fold(parse("<article><h1>t</h1><p>x</p></article>" + f"<div class='{chr(97 + i % 26)}{chr(97 + i // 26)}'><ul><li>y</ul></div>")))
        total = own if total is None else html_extract.merge(total, own)
    html_extract.prune(total, 10)
    assert [n[0] for n in html_extract.numbered(total)] == ["#page", "article", "h1", "p"]
