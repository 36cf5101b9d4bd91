"""Paths decide what the main text is; hostile pages take time in proportion."""

from __future__ import annotations

import random
import time

from tidemark.llm import tag_paths

LONG = "A sentence of some length, with a comma, and an end. " * 6


def page(rng):
    """A page without telling names: link lists and captions around paragraphs, and what belongs to the text."""
    links = "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(rng.randint(3, 12)))
    body = [f"<h2>Heading {rng.randint(0, 9)}</h2>"] + [f"<p>{LONG}{i}</p>" for i in range(rng.randint(2, 6))]
    kept = " ".join(x[x.index(">") + 1 : x.rindex("</")].strip() for x in body)
    return f"<body><ul>{links}</ul><table><tr><td>top</td><td>of page</td></tr></table><div>{''.join(body)}</div><ol>{links}</ol></body>", kept


def test_scores_decide_where_names_say_nothing():
    rng = random.Random(1)
    pages = [page(rng) for _ in range(60)]
    assert all(tag_paths.main_text(source) == " ".join(kept.split()) for source, kept in pages)
    lottery = lambda p: {path: rng.random() for path in tag_paths.path_scores(p)}
    constant = lambda p: dict.fromkeys(tag_paths.path_scores(p), 1.0)
    for other in (lottery, constant):
        assert sum(tag_paths.main_text(source, other) != tag_paths.main_text(source) for source, _ in pages) > 50


def test_short_parts_stand_by_their_paragraphs():
    source = f"<article><div class='post-header'><h1>Title</h1></div><p>{LONG}</p><ul><li>one</li><li>two</li></ul><h2>More</h2><p>{LONG}</p></article>"
    text = tag_paths.main_text(source)
    assert text.startswith("Title A sentence") and "one two More A sentence" in text


def test_quotes_in_plain_values_and_open_comments():
    assert tag_paths.main_text("<p title=it's>One. <b class='a>b'>Two</b> &lt;three&gt;.</p>") == "One. Two <three>."
    assert tag_paths.main_text("<p>Kept.</p><!-- gone <p>never</p>") == "Kept."
    assert tag_paths.main_text("a < b and c > d <p") == "a < b and c > d <p"


def test_time_grows_with_the_page_only():
    for source in ('<a "' + "<a b" * 40_000, "<div><p>" * 20_000, "<a x=\"" * 40_000, "<li><x>" * 20_000, "<b><i>" * 20_000 + "t" + "</u>" * 20_000, "<!--" * 40_000):
        start = time.perf_counter()
        tag_paths.main_text(source + " end.")
        assert time.perf_counter() - start < 5, source[:20]


def brute(source):
    """Scores from all blocks at once, by the definition."""
    p = tag_paths.Page(source)
    groups = {}
    for e, text in p.blocks:
        if not p.apart[e]:
            groups.setdefault(p.path[e], []).append(text)
    ratio = {k: (sum(map(len, v)) / len(v), sum(c in tag_paths.PUNCTUATION for t in v for c in t) / len(v)) for k, v in groups.items()}
    out = {}
    for k, own in ratio.items():
        near = [ratio[q] for q in ratio if q == k or p.above[q] == p.above[k] or p.above[k] == q or p.above[q] == k or (p.above[k] > 0 and p.above[q] == p.above[p.above[k]])]
        length, marks = (0.5 * own[i] + 0.5 * max(x[i] for x in near) for i in (0, 1))
        out[k] = length * (1 + marks)
    return out


def test_scores_match_their_definition():
    rng = random.Random(3)
    tags = ["div", "p", "ul", "li", "section", "b", "h2", "td"]
    for _ in range(50):
        source = "".join(rng.choice(["<{0}>", "</{0}>", "text, and. ", "x "]).format(rng.choice(tags)) for _ in range(rng.randint(0, 80)))
        got, want = tag_paths.path_scores(tag_paths.Page(source)), brute(source)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
