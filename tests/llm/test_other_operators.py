"""Pages, conversations, vectors and the pipeline."""

from __future__ import annotations

import html
import random
import re
import time

import numpy as np
import pytest
from conftest import TESTDATA

import corpus_pipeline
from biotrace.llm import html_extract, multi_index, quote_threads
from biotrace.llm.registry import QUERIES, SQL

SF_DIR = f"{TESTDATA}/sf0.001"


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


# --- pages -------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad box">Buy</div>
<div class="cookie-notice">We use cookies</div>
<div class="wrap"><article class="post-12"><h1>The &amp; title</h1><p>First   para
graph with <b>bold</b> text, long enough to count.<br>Next<p>Second <a href="#">link</a>.
<form><input name="q">Search</form><ul><li>one<li>two</ul><pre>a  b</pre></article>
<aside>More</aside><section id="comments"><p>Nice post, a long comment by a reader of this page.</p></section>
</div><footer>&copy; x</footer></body></html>"""
TEXT = "The & title\nFirst para graph with bold text, long enough to count. Next\nSecond link.\none\ntwo\na b"


def test_article_text_without_the_rest(spark):
    other = PAGE.replace("post-12", "post-99").replace("First", "Other")
    rows = [
        (1, "http://H.example/a", PAGE),
        (2, "https://h.example:80/b?q", other),
        (3, "http://h.example/c", PAGE[: PAGE.index("Second")]),
        (4, "http://k.example/", None),
        (5, None, ""),
        (6, "no host", "just <b>words"),
        (6, "no host", "just <b>words"),
        (7, "http://k.example/", "<nav>only a menu</nav>"),
    ]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string")
    found = html_extract.extract_pages(pages).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows)
    assert texts[1] == TEXT
    assert texts[2] == TEXT.replace("First", "Other")
    assert texts[3] == "\n".join(TEXT.split("\n")[:2])
    assert [texts[i] for i in (4, 5, 6, 7)] == ["", "", "just words", ""]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_host_votes_overrule_a_page():
    short = "<body><main class='story'><p>Brief.</p></main><div class='blurb'><p>{}</p></div></body>"
    page = short.format("A long blurb that is no article. " * 5)
    parsed = html_extract.parse(page)
    own = html_extract.best_of(parsed, html_extract.kept_blocks(parsed, set()))
    assert parsed.blocks[parsed.containers[own].first].startswith("A long blurb")
    story = next(c.path for c in parsed.containers if parsed.blocks[c.first] == "Brief." and c.end == 1)
    assert html_extract.extract(page, [story]) == "Brief."


ARTICLE = "A long article text with many words in it, and some more of them. " * 3


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content has-sidebar'><p>{}</p></div>",
        "<main class='no-sidebar'><p>{}</p></main>",
        "<div id='x'><p>Start</p><section id='related-work'><p>{}</p></section></div>",
        "<article><section id='ad-hoc-methods'><p>{}</p></section></article>",
        "<div class='sidebar'><article><p>{}</p></article></div>",
        "<div class='header-wrapper main'><main><p>{}</p></main></div>",
    ],
)
def test_a_class_word_does_not_cost_the_article(page):
    assert ARTICLE.strip() in html_extract.extract(page.format(ARTICLE), [])


def test_a_layout_word_goes_by_the_votes_of_the_host(spark):
    """Articles in `side`, comments longer than articles, and a sidebar that is long once."""
    rows = []
    for i in range(20):
        side = "Links of the week. " * (60 if i == 3 else 2)
        rows.append(
            (i, "http://a.example/", f"<body><div class='side'><p>Article {i}. {ARTICLE}</p></div>"
             f"<div class='comments'><p>{'I say so. ' * 200}</p></div></body>")
        )
        rows.append(
            (100 + i, "http://b.example/", f"<body><div class='text'><p>Article {i}. {ARTICLE}</p></div>"
             f"<div class='sidebar'><p>{side}</p></div></body>")
        )
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert found == {i: f"Article {i % 100}. {ARTICLE}".strip() for i, _, _ in rows}


def _planted_page(pick, n: int) -> tuple[str, str]:
    """A page put together from parts, and the text that its article part holds."""
    word = lambda: pick.choice(["alpha", "b&amp;c", "d&lt;", "caf&eacute;", "x&#233;", "end."])
    say = lambda k: " ".join(word() for _ in range(k))
    told, body = [], []
    for _ in range(pick.randint(1, 6)):
        plain = [say(pick.randint(3, 12)) for _ in range(3)]
        told.append(" ".join(plain))
        body.append(pick.choice([
            f"<p>{plain[0]}\n <b>{plain[1]}</b> <a href='?a=1&b'>{plain[2]}</a></p>",
            f"<p>{plain[0]}<br>{plain[1]}\t {plain[2]}",
            f"<h2 title='a > b'>{plain[0]} <i>{plain[1]} {plain[2]}</h2>",
            f"<blockquote>{plain[0]} {plain[1]} <!-- <p>no</p> --> {plain[2]}</blockquote>",
        ]))
        if pick.random() < 0.4:
            body.append(f"<div class='ad'>{say(4)}</div>")
        if pick.random() < 0.3:
            body.append(f"<form><label>{say(3)}</label><input value='x'></form>")
    noise = [
        f"<nav><ul><li><a href='/'>{say(2)}</a><li>{say(2)}</ul></nav>",
        f"<div class='site-header'><p>{say(9)}</p></div>",
        f"<div id='cookie-notice'>{say(20)}</div>",
        "<script>if (a < b) { c('</p>') }</script><style>p{}</style>",
        f"<aside>{say(30)}</aside>",
    ]
    pick.shuffle(noise)
    cut = pick.randint(0, len(noise))
    article = f"<div class='wrap'><article class='post-{n}'>{''.join(body)}</article></div>"
    comments = f"<section class='comments'><article class='comment'><p>{say(200)}</p></article></section><footer>{say(5)}</footer>"
    page = f"<html><head><title>{say(2)}</title></head><body>{''.join(noise[:cut])}{article}{''.join(noise[cut:])}{comments}</body></html>"
    return page, "\n".join(re.sub(r"\s+", " ", html.unescape(t)).strip() for t in told)


def test_pages_give_the_planted_text(spark):
    pick = random.Random(9)
    planted = [_planted_page(pick, n) for n in range(120)]
    rows = [(n, f"http://h{n % 3}.example/{n}", page) for n, (page, _) in enumerate(planted)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert found == {n: text for n, (_, text) in enumerate(planted)}


def test_many_hosts_are_joined_without_a_broadcast(spark, monkeypatch):
    pick = random.Random(10)
    planted = [_planted_page(pick, n) for n in range(60)]
    hosts = [0 if n % 3 else n for n in range(60)]
    rows = [(n, f"http://h{hosts[n]}.example/{n}", page) for n, (page, _) in enumerate(planted)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wanted = sorted(html_extract.extract_pages(pages).collect())
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", 0)
    assert sorted(html_extract.extract_pages(pages).collect()) == wanted


def test_deep_and_broken_pages_end():
    deep = "<div>" * 20000 + "core" + "<p" + "</b>" * 20000
    assert html_extract.extract(deep, []).startswith("core")
    assert html_extract.extract("<p>a" * 20000, []).count("a") == 20000
    assert html_extract.extract("<a href=\"x" * 2000, []) == ""


@pytest.mark.parametrize(
    "unit",
    ["<p title=\"x", "<b ", "<div>x", "<ul><b>", "<li></li>", "<dt>x<dd>", "<p><b>x", "</div></p>",
     "&amp;&", "< <", "<td><p>x", "<!-- x", "<script>x", "<p a='", "<div class=\"a b\">"],
)
def test_a_hostile_page_takes_linear_time(unit):
    began = time.process_time()
    html_extract.extract(unit * (1_000_000 // len(unit)), [])
    assert time.process_time() - began < 4


# --- conversations -----------------------------------------------------------


def test_quotations_are_linked_and_cut(spark):
    rows = [
        (1, 0, "user", "Hello there, how do I bake bread at home?\nThanks in advance to everyone"),
        (1, 1, "assistant", "Use flour and water, knead it well enough.\n\nThen bake it for an hour."),
        (1, 2, "user", "On Monday, Bob wrote:\n> Hello there,   how do I bake bread at home?\nI asked that."),
        (1, 3, "user", "> > Hello there, how do I bake bread at home?\n> Use flour and water, knead it well enough.\nok"),
        (1, 3, "user", "dup"),
        (5, 0, "user", "> Then bake it for an hour.\nReally?"),
        (5, 1, "user", None),
        (7, 0, "user", "> never written anywhere by anyone\nhm"),
        (7, 5000, "user", "much later"),
        (None, 1, "user", "x"),
    ]
    columns = "conv_id long, turn long, role string, text string, thread_id int, span string"
    messages = spark.createDataFrame([(*r, 1, "s") for r in rows], columns)
    found = quote_threads.reply_threads(messages).orderBy("thread_id", "position").collect()
    shown = [tuple(r[c] for c in ("thread_id", "position", "conv_id", "turn", "parent_conv_id", "parent_turn", "quote_depth", "text")) for r in found]
    assert shown == [
        (None, None, None, 1, None, None, 0, "x"),
        (1, 1, 1, 0, None, None, 0, rows[0][3]),
        (1, 2, 1, 1, 1, 0, 0, rows[1][3]),
        (1, 3, 1, 2, 1, 0, 1, "I asked that."),
        (1, 4, 1, 3, 1, 2, 0, "dup") if shown[4][7] == "dup" and shown[4][5] == 2 else (1, 4, 1, 3, 1, 1, 0, "dup"),
        (1, 5, 1, 3, 1, 1, 2, "ok"),
        (1, 6, 5, 0, 1, 1, 1, "Really?"),
        (1, 7, 5, 1, 5, 0, 0, ""),
        (7, 1, 7, 0, None, None, 1, "hm"),
        (7, 2, 7, 5000, 7, 0, 0, "much later"),
    ]
    assert quote_threads.reply_threads(messages.limit(0)).count() == 0


def plain_threads(rows) -> dict[tuple, tuple]:
    """(thread, parent) of every turn, by looking through all messages for each quotation."""
    turns = sorted({(c, t) for c, t, _, _ in rows})
    parsed = [(c, t, *quote_threads.parse(text or "")[1:]) for c, t, _, text in rows]
    told = {(c, t, x) for c, t, _, own in parsed for x in own}
    parents = {}
    for c, t in turns:
        options = []
        for c2, t2, quotes, _ in parsed:
            if (c2, t2) != (c, t):
                continue
            for at, (level, passage, lines) in enumerate([q for q in quotes if q[1]]):
                if level != 1:
                    continue
                for choice, key in enumerate([passage, *lines]):
                    near = [b for a, b, x in told if a == c and b < t and x == key]
                    first = min(((a, b) for a, b, x in told if x == key), default=None)
                    if near:
                        options.append((at, choice, c, max(near)))
                    elif first and first[0] < c and len(key) >= 20 and len(key.split()) >= 5:
                        options.append((at, choice, *first))
        before = max((b for a, b in turns if a == c and b < t), default=None)
        parents[c, t] = min(options)[2:] if options else (c, before) if before is not None else None
    thread = {c: c for c, _ in turns}
    changed = True
    while changed:
        changed = False
        for (c, _), parent in parents.items():
            if parent:
                low = min(thread[c], thread[parent[0]])
                changed |= thread[c] != low or thread[parent[0]] != low
                thread[c] = thread[parent[0]] = low
    return {(c, t): (thread[c], parents[c, t]) for c, t in turns}


def test_threads_equal_a_search_through_all_messages(spark, monkeypatch):
    monkeypatch.setattr(quote_threads, "TURNS", 3)
    monkeypatch.setattr(quote_threads, "CONVERSATIONS", 4)
    pick = random.Random(21)
    said = ["yes", "no", "thank you very much", "a", "supercalifragilisticexpialidocious"]
    said += [f"this is the long remark number {i} of all" for i in range(25)]
    rows, told = [], []
    for c in range(40):
        for t in pick.sample(range(9), pick.randint(1, 7)):
            lines = []
            for _ in range(pick.randint(1, 3)):
                if told and pick.random() < 0.5:
                    for text in pick.choice(told).split("\n")[: pick.randint(1, 2)]:
                        lines.append("> " * pick.randint(1, 2) + text.upper())
                lines.append(pick.choice(said))
            rows.append((c, t, "user", "\n".join(lines)))
            told.append("\n".join(x for x in lines if not x.startswith(">")))
    # One turn that all conversations share, and conversations without a link of their own.
    rows += [(c, 50, "user", "the very same closing words in all of them") for c in range(60)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = quote_threads.reply_threads(messages).collect()
    wanted = plain_threads(rows)
    got = {(r.conv_id, r.turn): (r.thread_id, (r.parent_conv_id, r.parent_turn) if r.parent_turn is not None else None) for r in found}
    assert got == wanted
    assert sum(1 for c, t in wanted if wanted[c, t][1] and wanted[c, t][1][0] != c) > 10
    ordered = sorted(found, key=lambda r: (r.thread_id, r.position))
    assert [(r.thread_id, r.conv_id, r.turn) for r in ordered] == sorted((wanted[c, t][0], c, t) for c, t, _, _ in rows)
    for thread in {r.thread_id for r in found}:
        places = [r.position for r in ordered if r.thread_id == thread]
        assert places == list(range(1, len(places) + 1))


def test_short_quotations_link_within_a_conversation_only(spark):
    rows = [(1, 0, "user", "yes"), (2, 0, "user", "something else entirely"), (9, 0, "user", "yes"),
            (9, 1, "user", "no"), (9, 2, "user", "> yes\nwhy?"), (12, 0, "user", "> yes\nagain")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): (r.thread_id, r.parent_conv_id, r.parent_turn) for r in quote_threads.reply_threads(messages).collect()}
    assert found[9, 2] == (9, 9, 0)
    assert found[12, 0] == (12, None, None)


def test_every_message_follows_its_parent(spark):
    conversations = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = quote_threads.reply_threads(conversations).collect()
    place = {(r["conv_id"], r["turn"]): r["position"] for r in rows}
    assert len(rows) == conversations.count()
    assert all(
        place[r["parent_conv_id"], r["parent_turn"]] < r["position"]
        for r in rows
        if r["parent_turn"] is not None
    )


# --- vectors -----------------------------------------------------------------


def plain_links(vectors, least):
    def unit(v):
        # The square of a very large or very small component is no double.
        scaled = np.array(v, float) / np.abs(v).max()
        return scaled / np.linalg.norm(scaled)

    usable = {
        i: unit(v)
        for i, v in vectors
        if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)
    }
    ids = sorted(usable)
    parent, counts = {i: i for i, _ in vectors}, {i: 0 for i, _ in vectors}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] >= least:
                counts[a] += 1
                counts[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (counts[i], root(i)) for i, _ in vectors}


def test_vectors_equal_all_pairs(spark):
    pick = np.random.default_rng(2)
    centres = pick.normal(size=(30, 16))
    vectors = [
        (i, (centres[i % 30] + pick.normal(size=16) * (0.05 if i % 2 else 0.4)).tolist()) for i in range(400)
    ]
    vectors += [(500 + i, vectors[3][1]) for i in range(6)] + [(510, [2 * x for x in vectors[3][1]])]
    vectors += [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0, None]), (604, [])]
    vectors += [(605, [1e300] * 16), (606, [1e-300] * 16), (607, [1.0]), (608, [2.0])]
    frame = spark.createDataFrame([(*v, 1, "c") for v in vectors], "vec_id long, embedding array<double>, rep int, cell string")
    found = multi_index.near_vectors(frame).collect()
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in found} == plain_links(vectors, 0.95)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in found)
    assert multi_index.near_vectors(frame.limit(0)).count() == 0


def test_traversal_visits_cells_in_order():
    pick = np.random.default_rng(5)
    first, second = pick.random(7), pick.random(9)
    cells = multi_index.traverse(first, second, 0.8)
    sums = [first[a] + second[b] for a, b in cells]
    assert sums == sorted(sums)
    assert len(cells) == int((first[:, None] + second[None, :] <= 0.8).sum())


# --- pipeline ----------------------------------------------------------------


@pytest.fixture(scope="module")
def mixed(spark):
    """Documents of the test tables and odd rows, under the columns of the table."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34", None, "s", 5)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema))


def test_stages_keep_columns_and_filter(spark, mixed):
    docs = mixed
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), mixed.schema)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == mixed.columns
        assert after <= before
        if name == "language_id":
            assert before - after == {9001, 9002, 9003}
        assert len(after) >= 0.8 * len(before)
    assert docs.where("text rlike '[a-z0-9]@[a-z0-9]+[.][a-z]'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_take_an_empty_table(spark, mixed):
    docs = mixed.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        assert out.count() == 0
