"""Main text by density: against the formula on random trees, on pages without telling tags, on common layouts."""

import math
import random
import re

import pytest

from folioflow.llm import maintext

WORDS = "the of and house river stone paper light garden winter table number letter morning".split()


def paragraph(rng, n):
    return f"<p>{' '.join(rng.choice(WORDS) for _ in range(n))}.</p>"


def grown(rng, depth):
    """A random tree (tag, text, children)."""
    tag = rng.choice(["div", "section", "b", "a"]) if depth else "div"
    children = [grown(rng, depth + 1) for _ in range(rng.randrange(4))] if depth < 4 and tag != "a" else []
    return tag, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))), children


def rendered(tree):
    tag, text, children = tree
    return f"<{tag}>{text}{''.join(map(rendered, children))}</{tag}>"


def counted(tree, in_link=False):
    """(characters, linked ones, tags, link tags) of a tree."""
    tag, text, children = tree
    in_link = in_link or tag == "a"
    own = len(text.replace(" ", ""))
    sums = [own, own * in_link, 0, 0]
    for child in children:
        inner = counted(child, in_link)
        sums = [a + b for a, b in zip(sums, (inner[0], inner[1], inner[2] + 1, inner[3] + (child[0] == "a")), strict=True)]
    return tuple(sums)


def formula(tree, share, in_link=False):
    """Composite text densities of the nodes, parents first."""
    c, lc, t, lt = counted(tree, in_link)
    if c:
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        plain = c / max(1, t)
        yield plain * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base) if base > 1 + 1e-9 else plain
    else:
        yield 0.0
    for child in tree[2]:
        yield from formula(child, share, in_link or tree[0] == "a")


def test_densities_equal_the_formula_on_random_trees():
    rng = random.Random(5)
    for _ in range(60):
        tree = ("body", "", [grown(rng, 0) for _ in range(3)])
        page = maintext.Page(rendered(tree))
        density, total, _, _ = page.densities()
        c, lc, _, _ = counted(tree)
        wanted = list(formula(tree, lc / max(1, c)))
        body = page.tag.index("body")
        assert density[body:] == pytest.approx(wanted)
        for i in range(body, len(page.tag)):
            assert total[i] == pytest.approx(sum(density[k] for k in range(len(page.tag)) if page.parent[k] == i))


def flat(tree, above=None):
    """Nodes (node, node above) of a tree, parents first."""
    yield tree, above
    for child in tree[2]:
        yield from flat(child, tree)


def main_by_definition(tree):
    """Ids of the nodes whose text is main text, of a page of divs, sections, bold text and links without telling names.

    The block of greatest sum of densities; not the page itself if another block has half of its sum. What stands beside the way from it to the
    body stays if it is as dense as the least dense node of that way, no list of links, and large, or in no block that holds lists of links.
    """
    nodes = list(flat(tree))
    c, lc, _, _ = counted(tree)
    above = {id(n): up for n, up in nodes}
    order = {id(n): i for i, (n, _) in enumerate(nodes)}
    density = dict(zip((id(n) for n, _ in nodes), formula(tree, lc / max(1, c))))
    total = {id(n): sum(density[id(child)] for child in n[2]) for n, _ in nodes}
    inside = {}
    for n, up in nodes:
        inside[id(n)] = n[0] == "a" or (up is not None and inside[id(up)])
    sizes = {id(n): counted(n, up is not None and inside[id(up)])[:2] for n, up in nodes}
    block = lambda n: n[0] in ("div", "section", "body")
    full = [n for n, _ in nodes if sizes[id(n)][0]]
    if not full:
        return set(order)
    greatest = lambda some: max(some, key=lambda n: (total[id(n)], density[id(n)], -order[id(n)]))
    best = greatest(full)
    while not block(best):
        best = above[id(best)]
    if best is tree and (blocks := [n for n in full if block(n) and n is not tree]):
        chief = greatest(blocks)
        if total[id(chief)] and total[id(chief)] >= 0.5 * total[id(tree)]:
            best = chief
    if best is tree:
        return set(order)
    way = [best]
    while way[-1] is not tree:
        way.append(above[id(way[-1])])
    least = min((density[id(n)] for n in way if density[id(n)]), default=0.0)
    links = lambda n: sizes[id(n)][1] > 0.5 * sizes[id(n)][0]
    out = {id(n) for n, _ in flat(best)}
    for n, up in nodes:
        if up is None or not any(up is w for w in way) or any(n is w for w in way) or not sizes[id(n)][0] or links(n) or density[id(n)] < least:
            continue
        beside_links = up is tree or any(sizes[id(x)][0] and links(x) and block(x) for x in up[2])
        if total[id(n)] >= 0.2 * total[id(best)] > 0 or not beside_links:
            out |= {id(x) for x, _ in flat(n)}
    return out


def test_main_nodes_by_definition_on_random_trees():
    rng, chosen = random.Random(11), 0
    for _ in range(400):
        tree = ("body", "", [grown(rng, 0) for _ in range(rng.randrange(1, 5))])
        page = maintext.Page(rendered(tree))
        body = page.tag.index("body")
        wanted = main_by_definition(tree)
        nodes = [n for n, _ in flat(tree)]
        found = {id(n) for n, taken in zip(nodes, page.main_nodes()[body:], strict=True) if taken}
        text = lambda ids: [n[1] for n in nodes if id(n) in ids and n[1]]  # noqa: E731, B023
        assert text(found) == text(wanted)
        chosen += len(wanted) < len(nodes)
    assert chosen > 200


def bare(html):
    """The page without telling tags, classes, ids and roles."""
    html = re.sub(r"<(/?)(article|nav|footer|aside|main|header|section)\b", r"<\1div", html)
    return re.sub(r"(<(?!a\b|meta|html)[a-z0-9]+)\s[^>]*>", r"\1>", html)


@pytest.mark.parametrize("wrapped", [False, True])
def test_density_alone_finds_the_article(spark, medium, wrapped):
    right, n = 0, 0
    for r in spark.read.parquet(f"{medium}/pages.parquet").select("html").collect():
        if r["html"] and (article := re.search(r"<article>(.*?)</article>", r["html"], re.S)):
            page = bare(r["html"])
            if wrapped:
                page = page.replace("<body>", "<body><div>").replace("</body>", "</div></body>")
            n += 1
            right += maintext.main_text(page) == maintext.main_text(f"<body><article>{article[1]}</article></body>")
    assert n > 200 and right >= 0.95 * n


NAV = f"<nav><ul>{''.join(f'<li><a href=x>link {i}</a></li>' for i in range(12))}</ul></nav>"
FOOT = "<footer><p>Copyright 2020 someone and others, all rights reserved.</p></footer>"
RNG = random.Random(4)
ARTICLE = f"<h1>Title here</h1>{''.join(paragraph(RNG, 60) for _ in range(4))}"
COMMENTS = "".join(f"<div class=comment>{paragraph(RNG, 40)}</div>" for _ in range(30))


@pytest.mark.parametrize(
    "body",
    [
        f'{NAV}<div class="page has-sidebar"><article>{ARTICLE}</article><aside><p>side words here</p></aside></div>{FOOT}',
        f'{NAV}<div class="content-sidebar-wrap"><main>{ARTICLE}</main><div class="sidebar">{paragraph(RNG, 20)}</div></div>{FOOT}',
        f'{NAV}<div class="post share-enabled">{ARTICLE}</div>{FOOT}',
        f'<form id="aspnetForm">{NAV}<div id="content">{ARTICLE}</div>{FOOT}</form>',
        f"{NAV}<div class=post>{ARTICLE}</div><div id=comments><h3>Comments</h3>{COMMENTS}</div>{FOOT}",
        f'{NAV}<article>{ARTICLE}<section class="comments-area"><h3>Comments</h3>{COMMENTS}</section></article>{FOOT}',
        f'<div class="cookie-consent"><p>We use cookies to improve your visit here, accept all.</p><button>OK</button></div>{NAV}<div><div>{ARTICLE}</div></div>{FOOT}',
        f"<table><tr><td>{NAV}</td><td>{ARTICLE}</td><td><p>advert words here</p></td></tr></table>",
        f'{NAV}<article><div class="ad">Buy this</div>{ARTICLE}<div class="newsletter-signup"><p>Our letter</p><form><label>Mail</label><input></form></div></article>{FOOT}',
        ARTICLE,
    ],
)
def test_layouts(body):
    wanted = ["Title here", *re.findall(r"<p>(.*?)</p>", ARTICLE)]
    assert maintext.main_text(f"<body>{body}</body>").split("\n") == wanted


def test_names_and_controls_in_an_article_take_no_words():
    end = '<div class="related-work"><p>Others did this before, as the list of works says.</p></div><p class="notice-period">One month.</p><p>Press <button>Start</button> and the <label>red</label> key.</p>'
    lines = maintext.main_text(f"<body>{NAV}<article>{ARTICLE}{end}</article>{FOOT}</body>").split("\n")
    assert lines[-3:] == ["Others did this before, as the list of works says.", "One month.", "Press Start and the red key."]


def test_short_lead_and_lines_with_breaks():
    body = f"{NAV}<div><h1>Title</h1><p>Short lead.</p><div>{paragraph(RNG, 60) * 2}</div><p>By someone.</p></div>{FOOT}"
    lines = maintext.main_text(f"<body>{body}</body>").split("\n")
    assert lines[:2] == ["Title", "Short lead."] and lines[-1] == "By someone." and len(lines) == 5
    body = '<div><a href=x>Home</a> <a href=y>News</a></div><div>First part of a text, which has many words in it.<br><br>Second part of the text.<br>Third.</div><div>Copyright</div>'
    assert maintext.main_text(f"<body>{body}</body>") == "First part of a text, which has many words in it. Second part of the text. Third."


def test_spark_cases(spark):
    html = f"<body>{NAV}<article>{ARTICLE}</article>{FOOT}</body>"
    text = maintext.main_text(html)
    rows = [(1, "a", html, 1, "x"), (1, "a", html, 1, "x"), (None, None, html, 1, "x"), (2, "b", None, 1, "x"), (3, "c", "", 1, "x"), (4, "d", f"<body><article>{ARTICLE * 200}", 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string").repartition(3)
    found = maintext.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in found.collect()), key=repr)
    long = maintext.main_text(rows[-1][2])
    assert len(long) > 200 * len(text) - 400
    wanted = [(1, "a", text, len(text))] * 2 + [(None, None, text, len(text)), (2, "b", "", 0), (3, "c", "", 0), (4, "d", long, len(long))]
    assert got == sorted(wanted, key=repr)
    assert maintext.extract(pages.limit(0)).collect() == []
    with pytest.raises(ValueError, match="keep"):
        maintext.extract(pages, keep=("page_id", "text"))
