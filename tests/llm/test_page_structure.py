"""Pages whose markup leaves out end tags, has wrappers with odd class names, or content in several blocks."""

import random
import time

import pytest

from threadloom.llm import html_text

PROSE = "".join(f"<p>This is sentence {i}, with some words, and it ends here.</p>" for i in range(6))
WANTED = " ".join(f"This is sentence {i}, with some words, and it ends here." for i in range(6))


@pytest.mark.parametrize("menu", [
    "<aside><table>" + "<tr><td>Cell<td>Other" * 200 + "</table></aside>",
    "<nav><ul>" + "<li><p>Item<li><p>Next" * 200 + "</ul></nav>",
    "<aside><dl>" + "<dt>Term<dd><div>What it is" * 200 + "</dl></aside>",
    "<aside>" + "<div>" * 300 + "Deep.</aside>"])
def test_end_tags_left_out(menu):
    assert html_text.main_text(f"<body>{menu}<div>{PROSE}</div></body>") == WANTED


def test_nested_tables_and_lists():
    page = html_text.Page("<table><tr><td><table><tr><td>a<td>b</table>c<td>d</table><ul><li><ul><li>e<li>f</ul>g<li>h</ul>")
    depth = [0]
    for parent in page.parent[1:]:
        depth.append(depth[parent] + 1)
    assert {b.text: depth[b.element] for b in page.blocks} == {"a": 6, "b": 6, "c": 3, "d": 3, "e": 4, "f": 4, "g": 2, "h": 2}


@pytest.mark.parametrize("wrapper", [
    "<div class='overflow-hidden'>{}</div>", "<div id='page' class='site has-sidebar'>{}</div>", "<main class='no-sidebar'>{}</main>",
    "<article class='post category-social tag-search'>{}</article>", "<article class='widget'>{}</article>",
    "<div class='widget'><main>{}</main></div>", "<div class='hidden'>{}</div>"])
def test_classes_of_wrappers(wrapper):
    page = f"<body><div class='sidebar'><p>Other story, which is long, and so on.</p></div>{wrapper.format(PROSE)}</body>"
    assert html_text.main_text(page) == WANTED


PARTS = [PROSE[:(at := PROSE.index("<p>This is sentence 1"))], PROSE[at:(to := PROSE.index("<p>This is sentence 2"))], PROSE[to:]]


@pytest.mark.parametrize("page", [
    f"<div class='post'><div class='intro'>{PARTS[0]}</div><div class='body'>{PARTS[1]}{PARTS[2]}</div></div>",
    f"<div><article>{PARTS[0]}{PARTS[1]}</article><article>{PARTS[2]}</article></div>",
    f"<div><section><div>{PARTS[0]}</div><div>{PARTS[1]}{PARTS[2]}</div></section></div>",
    f"<div><div class='a'>{PARTS[0]}</div><article>{PARTS[1]}{PARTS[2]}</article></div>"])
def test_content_in_several_elements(page):
    assert html_text.main_text(f"<body><nav><a href='/'>Home</a></nav>{page}<footer>us</footer></body>") == WANTED


@pytest.mark.parametrize("page", [
    f"<form action='/x'><input name='state'><div>{PROSE}</div><button>Send</button></form>",
    f"<div>{PROSE}</div><form><label>Your name, please, and address.</label><input></form>",
    f"<div>{PROSE}</div><div class='comment-list'><p>A reader, who writes a lot, and says much, of it wrong.</p></div>",
    f"<div>{PROSE}</div><section class='user-comments'><article class='comment'><p>A reader, who writes a lot.</p></article></section>",
    f"<article>{PARTS[0]}{PARTS[1]}<div class='ad-slot'><p>Buy this, it is good, and cheap, and new.</p></div>{PARTS[2]}</article>",
    f"<article>{PROSE}</article><article class='teaser'><p>Another story, which goes on elsewhere, of course.</p></article>",
    f"<div class='page-with-comments'><div class='has-ads'>{PROSE}</div></div>"])
def test_forms_comments_and_adverts(page):
    assert html_text.main_text(f"<body><nav><a href='/'>Home</a></nav>{page}<footer>us</footer></body>") == WANTED


def test_an_articles_own_header():
    page = f"<body><header><h1>Site</h1></header><article><header><h1>The title, in full</h1></header>{PROSE}</article></body>"
    assert html_text.main_text(page) == "The title, in full " + WANTED


@pytest.mark.parametrize("piece", ["<!-", "<!", "<?", "</", "</a", "<a ", "<!--", "<![CDATA["])
def test_unfinished_markup_takes_linear_time(piece):
    def seconds(n):
        begin = time.perf_counter()
        html_text.main_text(PROSE + piece * n)
        return time.perf_counter() - begin

    assert seconds(100_000) < 2


def plain_scores(page, blocks):
    """The ratios of tag paths by their definition, block by block."""
    def ratio(value):
        sums = []
        for b in blocks:
            same = [x for x in blocks if x.path == b.path]
            sums.append(sum(map(value, same)) / len(same))
        return [(sums[max(i - 1, 0)] + 2 * s + sums[min(i + 1, len(sums) - 1)]) / 4 for i, s in enumerate(sums)]

    text = ratio(lambda b: len(b.text) - b.link_chars)
    marks = ratio(lambda b: sum(c in html_text.MARKS for c in b.text))
    return [(t * (1 + m)) ** 0.5 for t, m in zip(text, marks)]


def test_path_scores_by_definition():
    rng = random.Random(3)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 15)):
            tag = rng.choice(["p", "div", "li", "td", "h2"])
            link = rng.choice(["", "<a href='/'>a link</a> "])
            parts.append(f"<{tag}>{link}{'word, ' * rng.randint(0, 9)}end.</{tag}>")
        source = "<body>" + "".join(rng.choice(["{}", "<div>{}</div>", "<section class='x'>{}</section>"]).format(x) for x in parts)
        page = html_text.Page(source)
        assert html_text.path_scores(page, page.blocks).tolist() == pytest.approx(plain_scores(page, page.blocks))
