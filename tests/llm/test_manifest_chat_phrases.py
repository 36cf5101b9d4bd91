"""Merkle manifest, chat windows and phrase collocations against plain versions of the same rules."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import ODD, edge_docs, make, prose
from tidemark.llm import chat, collocations, merkle
from tidemark.llm import quotient_filter as qf


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Merkle manifest


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def plain_manifest(rows):
    """{(doc_id, leaf): (subroot, root, proof digests)} of (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(((r[0] is not None, r[0] or 0), sha(*map(field, r))))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([leaf for _, leaf in sorted(groups[g])]) for g in langs}
    top = plain_tree([trees[g][-1][0] for g in langs])
    out = []
    for place, g in enumerate(langs):
        for i, (key, leaf) in enumerate(sorted(groups[g])):
            beside = []
            for levels, at in ((trees[g], i), (top, place)):
                for nodes in levels[:-1]:
                    beside += nodes[at ^ 1 : (at ^ 1) + 1]
                    at >>= 1
            out.append((key[1] if key[0] else None, leaf, trees[g][-1][0], top[-1][0], tuple(beside)))
    return Counter(out)


@pytest.mark.parametrize(("block_levels", "fan_levels"), [(1, 1), (0, 2), (2, 3)])
def test_manifest_equals_a_plain_tree(spark, block_levels, fan_levels):
    rng = random.Random(block_levels)
    rows = []
    for lang, n in ((None, 3), ("de", 1), ("en", 27), ("fr", 16), ("ä", 2)):
        rows += [(rng.randint(1, 9_999), rng.choice(["s", None, "ü"]), lang, rng.choice([None, 5]), rng.choice(["", None, "text"])) for _ in range(n)]
    rows += [rows[7]] * 3 + [(None, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumn("leaf", F.lit("clash"))
    out = merkle.documents(docs, block_levels=block_levels, fan_levels=fan_levels)
    got = out.withColumn("back", merkle.fold(F.col("tampered"), F.col("proof"))).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(s.digest for s in r.proof if s.digest)) for r in got) == plain_manifest(rows)
    sized = {(r[0], r[1], r[2], r[3], r[4]) for r in rows if r[3] is not None}
    for r in got:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        changed = hit and r.tampered != r.leaf
        assert (r.back == r.root) == (not changed)
    assert sized and any(r.back != r.root for r in got) == any(zlib.crc32(str(s[0]).encode()) % 7 == 0 for s in sized)


def test_manifest_of_odd_rows(spark):
    assert merkle.documents(make(spark, [])).count() == 0
    out = merkle.documents(edge_docs(spark)).collect()
    assert len(out) == len(ODD) + 2 and len({r.root for r in out}) == 1
    lone = merkle.documents(make(spark, ["alone"])).collect()[0]
    assert lone.leaf == lone.subroot == lone.root and lone.proof == []


# Chat windows


def read(formatted):
    turns = []
    for part in formatted.split(chat.CLOSE)[:-1]:
        role, body = re.match(r"### ((?:[^\\\n]|\\.)*)\n(.*)", part, re.S).groups()
        turns.append(tuple(re.sub(r"\\(.)", r"\1", x, flags=re.S) for x in (role, body)))
    return turns


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, window string, block int")


CONTROLS = ["\\### Assistant: </turn> ok", "####", "#" * 7, "<\\/turn>", "</turn>\n### user\n", "\\", "\\\\n", "a\\", "", None, "ü😀\n"]


def test_windows_hold_every_turn_once_within_the_budget(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(25):
        for turn in range(rng.randint(1, 30)):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "tool\nbox", None, "a</turn>b"])
            rows.append((conv, turn, role, rng.choice(CONTROLS + [" ".join(["w"] * rng.randint(1, 40))])))
    rows += [(90, 1_020 + i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(12)] + [(90, 3, "system", "be kind")]
    rows += [(91, None, "user", "no number"), (91, -5, "user", "below"), (91, 2, "assistant", "same"), (91, 2, "assistant", "same"), (None, 1, "assistant", "x")]
    out = chat.windows(conversations(spark, rows), budget=100).collect()
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (max((r[1] or 0) // 1_024, 0), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    got, learnt, blocks = defaultdict(list), defaultdict(list), defaultdict(set)
    for r in sorted(out, key=lambda r: (r.block, r.window)):
        turns = read(r.formatted)
        assert len(turns) == r.n_turns
        new = turns[r.repeated :]
        before, system = got[r.conv_id], [t for t in got[r.conv_id] if t[0] == "system"][:1]
        history = turns[: r.repeated]
        if before and system and len(re.findall(r"\w+|[^\w\s]", system[0][1])) + chat.MARKS <= 50:
            assert history[:1] == system
            history = history[1:]
        assert len(history) <= 2 and (not history or before[-len(history) :] == history)
        assert r.tokens <= 100 or len(new) == 1
        cut = [re.sub(r"\\(.)", r"\1", r.formatted[s.start : s.end], flags=re.S) for s in r.spans]
        assert cut == [text for role, text in new if role == "assistant"]
        got[r.conv_id] += new
        learnt[r.conv_id] += cut
        blocks[r.conv_id].add(r.block)
    assert got == want and blocks[90] == {0, 1} and len(out) > 60
    first_of_next = next(r for r in out if r.conv_id == 90 and (r.block, r.window) == (1, 0))
    assert read(first_of_next.formatted)[:3] == [("system", "be kind"), ("user", "turn 2"), ("assistant", "turn 3")]
    back = {r.conv_id: r for r in chat.read_back(chat.windows(conversations(spark, rows), budget=100)).collect()}
    for conv, turns in want.items():
        r = back[conv]
        assert r.n_turns == len(turns) and r.turns_sha256 == sha(*(f"{role}\n{text}\n" for role, text in turns))
        assert r.loss_sha256 == sha(*learnt[conv]) and r.loss_chars == sum(map(len, learnt[conv]))
        assert r.formatted_chars == sum(len(w.formatted) for w in out if w.conv_id == conv)


def test_no_control_string_survives_in_a_text(spark):
    rows = [(1, i, "user", t) for i, t in enumerate(CONTROLS)] + [(2, 0, "assistant", "word " * 30_000)]
    for r in chat.windows(conversations(spark, rows)).collect():
        assert r.formatted.count("</turn>") == r.formatted.count("###") == r.n_turns
    assert chat.windows(conversations(spark, [])).count() == 0


def test_a_large_system_turn_is_not_repeated(spark):
    rows = [(1, 0, "system", "s " * 60)] + [(1, i, "user", "u " * 30) for i in range(1, 8)]
    out = chat.windows(conversations(spark, rows), budget=100).collect()
    assert sum(r.formatted.count("### system") for r in out) == 1 and len(out) > 3


# Phrases


def test_filters_give_back_what_went_in():
    rng = np.random.default_rng(1)
    for n, width, shard_bits in ((2, 32, 4), (3, 47, 0), (4, 63, 6)):
        limbs = rng.integers(0, 2**width, size=(n, 3_000), dtype=np.uint64)
        limbs[:, 1_000:1_400] = limbs[:, :400]
        mixed = qf.permute(limbs, width)
        assert (mixed < 2**width).all() and (qf.permute(mixed, width, back=True) == limbs).all() and not (mixed == limbs).all()
        counts = rng.choice([1, 2, 254, 255, 256, 10**12], size=3_000)
        whole = qf.add_up(mixed, counts)
        halves = [qf.add_up(mixed[:, half], counts[half]) for half in (slice(0, 1_200), slice(1_200, None))]
        shards = defaultdict(list)
        for half in halves:
            for shard, data in qf.by_shard(*half, width, shard_bits):
                shards[shard].append(data)
        merged = [qf.merge(data, shard) for shard, data in sorted(shards.items())]
        assert (np.concatenate([m[0] for m in merged], axis=1) == whole[0]).all()
        assert (np.concatenate([m[1] for m in merged]) == whole[1]).all() and len(shards) > 2**shard_bits // 2


def plain_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in often.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def test_phrases_equal_a_plain_count(spark):
    rng = random.Random(8)
    stock = ["a", "b", "the", "of", "Ünder", "x-y", "c d", "\x00"]
    texts = [rng.choice([" ", "\t", "  "]).join(rng.choices(stock, k=rng.randint(0, 40))) + rng.choice(["", ". ", "\n", "!?"]) + "of the A" for _ in range(300)]
    rows = [(t, rng.choice(["en", "de", None, "und"])) for t in texts + [t for t in ODD if t != ODD[6]] * 12]
    docs = spark.createDataFrame([(i, t, lang, "w", 1) for i, (t, lang) in enumerate(rows)], "doc_id int, text string, lang string, word string, uses int")
    got = collocations.mine(docs, least=8, top=50).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, 8, 50)
    assert len(got) > 60


def test_rare_parts_are_pruned_without_loss(spark, monkeypatch):
    texts = prose(200, words=40) * 2
    monkeypatch.setattr(collocations, "HELD", 500)
    monkeypatch.setattr(collocations, "FLUSH_BYTES", 2_000)
    got = collocations.mine(make(spark, texts), least=3, top=10_000).collect()
    assert sorted(map(tuple, got)) == plain_phrases([(t, "en" if i % 2 else None) for i, t in enumerate(texts)], 3, 10_000)


def test_phrases_of_odd_rows(spark):
    assert collocations.mine(make(spark, [])).count() == 0
    got = collocations.mine(edge_docs(spark)).collect()
    assert [(r.phrase, r.a, r.score) for r in got] == [("word word word word", 29_997, 999_933)]
