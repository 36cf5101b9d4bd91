"""Text operators against libraries, brute force and planted cases."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import crf, ctw, kneser_ney, pieces, simhash, tag_paths

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "word " * 30_000
ODD = [None, "", " \t\n", "a", "Same text here", "Same text here", LONG, "naïve▁ 😀\n\n  two", "x" * 5_000]


def make(spark, texts, start=0):
    """Documents with extra columns whose names clash with those of results."""
    rows = [(start + i, t, "en" if i % 2 else None, "s", None, 0.5, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def edge_docs(spark):
    docs = make(spark, ODD)
    again = docs.where("doc_id = 4")
    none = spark.createDataFrame([(None, "no id at all", None, None, None, None, None)], DOCS)
    return docs.unionByName(again).unionByName(none)


def prose(n, seed=1, words=60):
    rng = random.Random(seed)
    stock = ["ta", "ko", "ri", "men", "sol", "the", "of", "under", "lan", "ver"]
    return [" ".join("".join(rng.choices(stock, k=rng.randint(1, 3))) for _ in range(words)) + "." for _ in range(n)]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


# SentencePiece


def test_pieces_match_the_library_and_cover_the_source(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    alphabet = "  ab\n\t▁éñ😀中the\u0000ing<0x41> "
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 40, 400]))) for _ in range(200)]
    for r in pieces.encode(make(spark, texts), MODEL).collect():
        text = texts[r.doc_id] or ""
        want = library.encode(text, add_bos=True, add_eos=True)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want)
        assert bytes(r.ids_le) == np.array(want, "<u4").tobytes()
        raw = text.encode()
        assert r.starts[0] == 0 and r.ends[-1] == len(raw)
        inner = list(zip(r.starts[1:-1], r.ends[1:-1], strict=True))
        assert all(a <= b for a, b in inner) and b"".join(raw[a:b] for a, b in dict.fromkeys(inner)) == raw


def test_longest_prefix_normalisation_matches_the_library():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    fields = dict(pieces._fields(dict(pieces._fields(library.serialized_model_proto()))[3]))
    charmap = pieces.CharacterMap(fields[2])
    for text in ("ﬁne ①②③ Ｆｕｌｌ", "ｶﾞ é ㌀", "plain", "", "tab\tand blank", "½ ™ Å"):
        norm, starts, ends = pieces.normalise(text.encode(), charmap, False, False, escape=False)
        assert norm == library.normalize(text), text
        assert len(starts) == len(norm) and (starts <= ends).all() and (not len(ends) or ends[-1] == len(text.encode()))


def test_pieces_of_odd_rows(spark):
    out = pieces.encode(edge_docs(spark), MODEL).collect()
    assert len(out) == len(ODD) + 2
    assert all(r.ids == [1, 2] for r in out if r.doc_id in (0, 1))
    assert pieces.encode(make(spark, []), MODEL).count() == 0


# SimHash


def slow_fingerprint(text, words):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    grams = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force():
    for text in [*ODD[:6], *prose(20)]:
        assert simhash.fingerprint(text, 3) == slow_fingerprint(text, 3).to_bytes(8, "big")


@pytest.mark.parametrize("tile", [4, 2_048])
def test_links_match_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    fps = {0}
    for _ in range(40):
        base = rng.getrandbits(64)
        fps |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(8)}
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame([(f.to_bytes(8, "big"),) for f in fps], "fp binary")
    from tidemark.llm.components import components

    found = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in components(simhash.links(df)).collect()}
    assert {f: found.get(f, f) for f in fps} == {f: root(f) for f in fps}


def test_near_copies_meet_and_others_do_not(spark):
    texts = prose(30, words=200)
    near = [t.replace(" ", " changed ", 1) for t in texts[:10]]
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(make(spark, [*texts, *near, texts[3]])).collect()}
    assert all(out[30 + i] == i for i in range(10)) and out[40] == 3
    assert all(out[i] == i for i in range(30))


def test_simhash_of_odd_rows(spark):
    out = simhash.near_duplicates(edge_docs(spark), 3, simhash.BITS)
    rows = out.collect()
    assert len(rows) == len(ODD) + 2
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(make(spark, []), 3, simhash.BITS).count() == 0


# Context-tree weighting


def test_log_gamma_and_tree_normalise():
    x = np.array([0.5, 1.0, 3.5, 100.0, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10)
    rng = np.random.default_rng(1)
    counts = [rng.integers(0, 5, (1, 256)).astype(float), rng.integers(0, 3, (3, 256)).astype(float)]
    counts[0] += counts[1].sum(axis=0)
    tree = ctw.ContextTree(1, [np.zeros(1, np.uint64), np.array([65, 66, 67], np.uint64)], counts)
    assert np.allclose((10.0 ** tree.log10.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_binary_mixture_matches_the_recursion():
    """One decision node, contexts of at most one byte: the textbook weighting by hand."""
    counts = [np.zeros((1, 256)), np.zeros((2, 256))]
    counts[1][0, [0, 255]], counts[1][1, [0, 255]] = (9, 1), (2, 6)
    counts[0][0] = counts[1].sum(axis=0)
    tree = ctw.ContextTree(1, [np.zeros(1, np.uint64), np.array([1, 2], np.uint64)], [c.copy() for c in counts])

    def block(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    own, split = block(11, 7), block(9, 1) + block(2, 6)
    weight = math.exp(own) / (math.exp(own) + math.exp(split))
    first = weight * (7.5 / 19) + (1 - weight) * (1.5 / 11)
    log_rest = tree.log10[1, 255] - math.log10(first)  # the seven nodes below, each with ones only
    assert log_rest < 0 and abs(tree.log10[1, 0:128].max() - tree.log10[1, 0]) < 1e-6
    assert math.isclose(float((10.0 ** tree.log10[1, 128:].astype(float)).sum()), first, rel_tol=1e-4)


def test_baseline_matches_brute_force_and_score_is_consistent(spark):
    texts = [*prose(60), *ODD]
    docs = make(spark, texts)
    got = {r.doc_id: r for r in ctw.score(docs).collect()}
    import zlib

    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    counts = Counter()
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in enumerate(texts)}
    for i, t in tokens.items():
        if not out[i]:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out[i], len(t), n)
        assert r.n_known == sum(counts[w] > 0 for w in t)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0 and math.isclose(r.bits_per_byte, -r.score / math.log10(2) / r.n_bytes)


def test_context_tree_learns_and_takes_odd_rows(spark):
    rows = ctw.score(edge_docs(spark)).collect()
    assert len(rows) == len(ODD) + 2
    assert ctw.score(make(spark, [])).count() == 0
    got = ctw.score(make(spark, prose(200))).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_bytes for r in held) > math.log10(1 / 16)


# Conditional random field


def slow_marginals(odds, first, start, move):
    out, cuts = [], [*np.flatnonzero(first).tolist(), len(odds)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        x = np.stack([np.ones(b - a), np.exp(odds[a:b])], 1)
        f, g = [start * x[0]], [np.ones(2)]
        for t in range(1, b - a):
            f.append((f[-1] @ move) * x[t])
        for t in range(b - a - 1, 0, -1):
            g.append(move @ (x[t] * g[-1]))
        out += [(u * v)[1] / (u * v).sum() for u, v in zip(f, g[::-1], strict=True)]
    return np.array(out)


def test_forward_backward_matches_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 127, 128, 700):
        odds, first = rng.normal(size=n), rng.random(n) < 0.05
        first[0] = True
        start, move = np.exp(rng.normal(size=2)), np.exp(rng.normal(size=(2, 2)))
        assert np.allclose(crf.forward_backward(odds, first, start, move)[0], slow_marginals(odds, first, start, move))


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    texts = prose(300, seed=8)
    rng = random.Random(2)
    for i in range(0, 300, 6):
        words = texts[i].split()
        words[rng.randint(0, 50)] = "zarquon!"
        words[rng.randint(0, 50)] = "blip" + rng.choice(["ta", "ko", "ri"])
        texts[i] = " ".join(words)
    labels = labels_of(spark, [(i, 1, int(i % 6 == 0)) for i in range(240)] + [(None, 1, 1), (5_000, 0, 1)])
    rows = crf.score(make(spark, texts), labels).collect()
    assert len(rows) == 300
    wrong = [r.row.doc_id for r in rows if (r.score >= 0.5) != (r.row.doc_id % 6 == 0)]
    assert not wrong
    hit = next(r for r in rows if r.row.doc_id == 0)
    assert any("zarquon" in texts[0][s.start : s.end] for s in hit.spans)


def test_the_toxic_sample_does_not_depend_on_partitions(spark):
    texts = [t + (" ghastly" if i % 2 else "") for i, t in enumerate(prose(60, words=12) * 3)]
    docs, labels = make(spark, texts), labels_of(spark, [(i, 1, i % 2) for i in range(len(texts))])
    held = F.lit(False)
    found = [sorted(map(tuple, crf.labelled_sample(docs.repartition(n), labels, "doc_id", "text", held).collect())) for n in (1, 7)]
    assert found[0] == found[1] and 0 < len(found[0]) < len(texts)


def test_toxicity_of_odd_rows_and_without_labels(spark):
    rows = crf.score(edge_docs(spark), labels_of(spark, [])).collect()
    assert len(rows) == len(ODD) + 2 and all(r.score < 0.5 and not r.spans for r in rows)
    assert crf.score(make(spark, []), labels_of(spark, [(1, 1, 1), (2, 1, 0)])).count() == 0


# Kneser-Ney


def test_kneser_ney_matches_brute_force(spark):


    texts = [*prose(40), "", "zz@@##"]
    rows = make(spark, texts).select("text", (F.col("doc_id") < 30).alias("train"))
    table = {r.gram: (r.seen, r.p) for r in kneser_ney.probabilities(kneser_ney.count_windows(rows)).collect()}
    order = kneser_ney.ORDER
    grams = lambda t: [(kneser_ney.PAD * (order - 1) + t.encode() + kneser_ney.END)[i : i + order] for i in range(len(t.encode()) + 1)]
    counts = {order: Counter(g for t in texts[:30] for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        n = Counter(c.values())
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            cut[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)]
        else:
            cut[k] = [0.5, 0.75, 0.9]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / 256
        same = [c for h, c in counts[k].items() if h[:-1] == g[:-1]]
        if not same:
            return lower
        own = counts[k][g]
        freed = sum(cut[k][min(c, 3) - 1] for c in same)
        return (max(own - (cut[k][min(own, 3) - 1] if own else 0), 0) + freed * lower) / sum(same)

    every = Counter(g for t in texts for g in grams(t))
    assert {g: n for g, (n, _) in table.items()} == {int.from_bytes(g, "big"): n for g, n in every.items()}
    for g in list(every)[::40]:
        assert math.isclose(table[int.from_bytes(g, "big")][1], p(g), rel_tol=1e-9), g


def test_quality_rejects_junk_and_keeps_clean(spark):
    texts = prose(200) + ["@@## %% $$ ZZQX!! " * 20, None, "", "ok"]
    labels = labels_of(spark, [(i, 1, 0) for i in range(200)] + [(200, 0, 0)])
    rows = {r.doc_id: r for r in kneser_ney.classify(make(spark, texts), labels).collect()}
    assert not rows[200].kept and all(rows[i].kept for i in (201, 202, 203))
    assert sum(rows[i].kept for i in range(200)) >= 198
    odd = kneser_ney.classify(edge_docs(spark), labels_of(spark, [])).collect()
    assert len(odd) == len(ODD) + 2 and all(r.kept for r in odd)
    assert kneser_ney.classify(make(spark, []), labels).count() == 0


# Tag paths


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body>
<header class="masthead">Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now, cheap.</div>
<div class="cookie-notice">We use cookies.</div><article><h1>A  heading</h1><p><b>First, a sentence.<br>Second &lt;line&gt;; more.
<p>Another paragraph, with <a href="x">a link</a>ed word.</p><script>var t="</p>";</script><aside>Related, things.</aside>
<form><input value="x">Search here</form><section class="comments"><p>Nice post, friend!</p></section></article>
<div id="sidebar">Side, bar.</div><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    want = "A heading First, a sentence. Second <line>; more. Another paragraph, with a linked word."
    assert tag_paths.main_text(PAGE) == want


def test_pages_without_an_article_and_odd_pages(spark):
    blocks = "".join(f"<p>Sentence number {i}, which is long enough to be text, surely; more words follow here.</p>" for i in range(6))
    page = f"<body><div><ul><li>a</li><li>b</li></ul></div><div><div>{blocks}</div></div><div>tiny</div></body>"
    got = tag_paths.main_text(page)
    assert got.count("Sentence") == 6 and "tiny" not in got and not got.startswith("a")
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain, text"), (4, "u", "<p>unclosed <b>bold"), (5, "u", "<<<>>> < & &#x41;")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    out = {r.page_id: r for r in tag_paths.extract(pages).collect()}
    assert len(out) == 5 and out[1].text == "" == out[2].text and out[None].text == "plain, text" and out[4].text == "unclosed bold"
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert tag_paths.extract(pages.limit(0)).count() == 0


def test_digest_columns(spark):
    r = pieces.encode(make(spark, ["abc"]), MODEL).first()
    assert hashlib.sha256(bytes(r.ids_le)).hexdigest() == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
