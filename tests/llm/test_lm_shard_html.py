import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from verdure.llm import lm
from verdure.llm.htmltext import Weights, extract, main_text, maximal, observe, parse, region, scores, weigh
from verdure.llm.sharding import shard


def test_lm_base_counts(spark, edge, edge_rows, empty):
    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\0end"]

    c, held = Counter(), lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, t, *_ in edge_rows:
        if i is not None and not held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    got = lm.score(edge).collect()
    assert len(got) == len(edge_rows)
    want = {}
    for i, t, *_ in edge_rows:
        x = tokens(t)
        want.setdefault(i, []).append((len(x), sum(c[w] > 0 for w in x), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)))
    for r in got:
        assert r.train_tokens == n and r.score <= 0
        if r.doc_id is not None:
            assert r.held_out == held(r.doc_id)
        assert any(r.n_tokens == a and r.n_known == b and r.base_score == pytest.approx(s, rel=1e-9) for a, b, s in want[r.doc_id])
    assert lm.score(empty).collect() == []


def network(seed=1):
    rng = np.random.default_rng(seed)
    p = lm.start(rng.integers(1, 50, lm.TOP).astype(float), np.full(lm.TAILS, 3.0), seed)
    for k in p:
        p[k] = p[k] + (rng.normal(size=p[k].shape) * 0.2).astype(np.float32)
    return p


def test_output_is_a_distribution():
    p = network()
    h = np.random.default_rng(2).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.TOP + lm.TAILS)
    assert np.exp(lm.output(p, np.repeat(h, len(every), axis=0), every).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_to_the_end():
    """Documents side by side score as each alone, step by step."""
    p, rng = network(), np.random.default_rng(3)
    sizes = np.array([1, 700, 5, 1, 90])
    s = np.concatenate([np.append(rng.integers(0, lm.TOP + lm.TAILS, n - 1), 7) for n in sizes])
    got, at = lm.likelihoods(p, s, sizes), np.concatenate(([0], np.cumsum(sizes)))
    for d in range(len(sizes)):
        h, before, total = np.zeros((1, lm.HIDDEN), np.float32), 7, 0.0
        for x in s[at[d] : at[d + 1]]:
            h, _ = lm.step(p, h, np.array([before]))
            total += float(lm.output(p, h, np.array([x]))[0])
            before = x
        assert got[d] == pytest.approx(total, rel=1e-3)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(6)
    p = {k: v.astype(np.float64) for k, v in network(4).items()}
    h = rng.normal(size=(3, lm.HIDDEN)) * 0.3
    read, want = rng.integers(0, lm.TOP + lm.TAILS, (5, 3)), rng.integers(0, lm.TOP + lm.TAILS, (5, 3))
    want[0, 0], want[1, 1] = 5, lm.TOP + 3
    g, _, loss = lm.gradients(p, h, read, want)
    assert loss > 0
    for k in p:
        flat, grad = p[k].reshape(-1), g[k].reshape(-1)
        busy = np.flatnonzero(np.abs(grad) > 1e-6)
        for i in rng.choice(busy, min(8, len(busy)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = lm.gradients(p, h, read, want)[2]
            flat[i] = old - 1e-5
            down = lm.gradients(p, h, read, want)[2]
            flat[i] = old
            assert grad[i] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-9), k


def test_the_whole_score_is_a_distribution():
    """Over all known words, rare ones too, the end and one unknown word the probabilities add up to one."""
    rng = np.random.default_rng(9)
    n = 4000
    words, tails = rng.integers(0, 2**63, n).astype(np.uint64), np.arange(n) % lm.TAILS
    counts = np.sort(rng.integers(1, 400, n))[::-1].astype(np.int64)
    mass = np.bincount(tails, counts + 0.5, lm.TAILS)
    known = lm.Vocabulary.of(int(counts.sum()), n, words[: lm.TOP], tails[: lm.TOP], counts[: lm.TOP], mass)
    every, c = np.append(words, np.uint64(12345)), np.append(counts, 0)
    symbols = known.symbols(every, np.append(tails, 7), c)
    assert symbols[-1] == lm.TOP and len(set(symbols[: lm.TOP].tolist())) == lm.TOP and (symbols[lm.TOP :] >= lm.TOP).all()
    p = network(5)
    h = np.repeat(np.random.default_rng(2).normal(size=(1, lm.HIDDEN)).astype(np.float32), n + 1, axis=0)
    assert np.exp(lm.output(p, h, symbols).astype(float) + known.tail(symbols, c)).sum() == pytest.approx(1, abs=1e-3)


def test_averages_in_a_tree(spark, monkeypatch):
    from verdure.llm.store import Store

    monkeypatch.setattr(lm, "FAN", 3)
    rng = np.random.default_rng(3)
    w, n = rng.normal(size=(20, 4)).astype(np.float32), rng.integers(1, 50, 20).astype(float)
    df = spark.createDataFrame([(i, float(n[i]), w[i].tobytes()) for i in range(20)], "chunk long, n double, w binary")
    parts = lm.averaged(df, Store(spark, "t"), "w")
    assert len(parts) <= 3
    total, mean = lm._mean(parts)
    assert total == n.sum() and np.allclose(mean, (w * n[:, None]).sum(0) / n.sum(), atol=1e-5)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    stream = np.tile(np.array([3, 70, 500, 12, 900, 33, 1030, 4]), 1500)
    stream[rng.integers(0, len(stream), 500)] = 5
    p = lm.start(np.bincount(stream, minlength=lm.TOP)[: lm.TOP].astype(float), np.full(lm.TAILS, 50.0))
    before = lm.likelihoods(p, stream[:800], np.array([800]))[0]
    assert lm.likelihoods(lm.train(p, stream, 8), stream[:800], np.array([800]))[0] > before + 200


def test_columns_with_the_operators_own_names(spark):
    rows = [(i, f"text {i % 7}", 5, 6, 7, 8, "x", True) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, size int, range int, shard int, text_crc32 string, held boolean")
    assert shard(df, 4).select("slot").distinct().count() >= 12 and shard(df, 4).count() == 50
    assert lm.score(df).count() == 50


def test_shards(spark, edge, edge_rows, empty):
    rows = shard(edge, 4).collect()
    assert len(rows) == len(edge_rows) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert shard(empty).collect() == []
    text = {(i): t or "" for i, t, *_ in edge_rows}
    for r in rows:
        assert r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())


def test_shards_are_even_with_a_hot_group(spark):
    rows = [(i, "same text over and over") for i in range(3000)] + [(i, "t" * (i % 97)) for i in range(3000, 9000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() <= 200
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_splitters_against_a_sort(spark):
    """Each boundary halves the sorted keys' cumulated bytes as near as its tolerance, or a row, allows."""
    from verdure.llm.sharding import TOP, histogram, splitters

    rng = np.random.default_rng(11)
    key = np.concatenate([rng.integers(0, TOP, 3000), rng.integers(0, 1 << 40, 1500), np.full(500, TOP // 3)])
    size = rng.integers(1, 2000, len(key))
    df = spark.createDataFrame([(int(k), int(s)) for k, s in zip(key, size)], "key long, size long").repartition(5).cache()
    order = np.argsort(key, kind="stable")
    keys, below = key[order], np.cumsum(size[order])
    probes = np.sort(rng.integers(0, TOP, 20))
    got, rows = histogram(df, probes)
    assert got[:-1].tolist() == [int(size[key < p].sum()) for p in probes] and rows[:-1].tolist() == [int((key < p).sum()) for p in probes]
    cuts, before = splitters(df, 8, np.full(7, 0.001))
    for k, cut in enumerate(cuts, 1):
        target, under = below[-1] * k / 8, int(size[key < cut].sum())
        assert before[k] == (key < cut).sum()
        # No key is a better boundary by more than the tolerance, unless rows alike in key lie there.
        best = min(abs(int(size[key < c].sum()) - target) for c in np.unique(keys))
        assert abs(under - target) <= max(0.001 * below[-1], best) + 1e-6
    df.unpersist()


PAGE = """<html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site name here</header>
<nav><ul><li><a href="/x">menu one</a></li></ul></nav><!-- no --><div class="ad">Buy now and save</div>
<article><h1>A &amp; B</h1><p><b>First  words<br>of&nbsp;it<p>Second &lt;one&gt;</p><div class="cookie notice">accept this</div><form><label>Mail</label><input></form>
<table><tr><td>x1<td>x2</table><p>Last words of all</p><section class="comments"><p>nice post, friend</p></section></article><aside><p>Other things to read today</p></aside><footer>&copy; us</footer></body></html>"""


def test_extract():
    counts = {}
    for _ in range(3):
        for k, n in observe(PAGE).items():
            counts[k] = counts.get(k, 0) + n
    w = weigh(counts)
    want = "A & B\nFirst words of it\nSecond <one>\nx1\nx2\nLast words of all"
    assert extract(PAGE, w) == want
    assert extract(PAGE.replace("article", "div"), w) == want
    assert extract("", w) == "" and extract("only plain words", w) == "only plain words" and extract("<p></p>", w) == "" and extract("<", w) in ("<", "")


def test_listed_words_round_the_whole_page():
    w = weigh({k: 3 * n for k, n in observe(PAGE).items()})
    want = extract(PAGE, w)
    assert want.endswith("Last words of all")
    assert extract(PAGE.replace("<body>", "<body class='no-sidebar'>"), w) == want
    assert extract(PAGE.replace("<article>", "<article class='post social'>"), w) == want
    assert extract(PAGE.replace("<body>", "<body><form id='f'>").replace("</body>", "</form></body>").replace("<form><label>Mail</label><input></form>", ""), w) == want
    plain = "<body><form><div class='ad'>Buy now</div><p>" + "word " * 50 + "</p></form></body>"
    assert extract(plain, w) == ("word " * 50).strip()


@pytest.mark.parametrize("names", ["post legal", "alert-news", "share-story", "tags", "comment social ad"])
def test_names_of_the_article_itself_have_no_veto(names):
    w = weigh({k: 3 * n for k, n in observe(PAGE).items()})
    want = extract(PAGE, w)
    assert extract(PAGE.replace("<article>", f"<article class='{names}'>"), w) == want
    plain = PAGE.replace("<article>", f"<div class='{names}'>").replace("</article>", "</div>").replace("Last words of all", "more " * 60)
    assert extract(plain, w) == want.replace("Last words of all", ("more " * 60).strip())


def test_region_is_the_best_of_all():
    """The region's score is the largest of any contiguous run of tokens, whatever the page."""
    rng = np.random.default_rng(5)
    w = Weights({"<p>": 1.5, "x": -2.0, "<li>": 0.4, "<b>": 0.7}, {"p": -0.2, "b": -0.1, "div": -0.9})
    for _ in range(150):
        page = "".join(str(rng.choice(["<p>", "</p>", "<b>", "</b>", "<div>", "<div class='x'>", "</div>", "<li>", "w w w ", "w ", "<br>", "<aside>", "</aside>"])) for _ in range(rng.integers(1, 40)))
        first, last, _ = region(parse(page), w)
        s = scores(parse(page), w)[0]
        best = max([sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)], default=0)
        assert sum(s[first:last]) == pytest.approx(max(best, 0))


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 200_000, "<div>" * 90_000 + "</x>" * 90_000, "<b>" + "<div>" * 50_000 + "</b>" * 90_000, "<script" * 140_000, "<a x=\"" * 160_000, "<p " + "class   " * 120_000 + ">", "<!--" * 250_000])
def test_a_megabyte_of_broken_markup_ends(page):
    import time

    began = time.process_time()
    extract("<p>first words</p>" + page, Weights())
    observe("<article>" + page)
    assert time.process_time() - began < 10


def test_tokens():
    kinds = lambda page: [(k, v) for k, v, _ in parse(page).items]
    assert kinds("a < b <3 c") == [("text", "a < b <3 c")]
    assert kinds("<p title='a > b'>x</p ><!-- <b> -->y") == [("open", "p"), ("text", "x"), ("close", "p"), ("text", "y")]
    assert kinds("x<style>p > q</STYLE >y<a href=it's>z") == [("text", "x"), ("text", "y"), ("open", "a"), ("text", "z")]
    assert kinds("<![CDATA[a<b]]>x<?php ?><!DOCTYPE html>") == [("text", "a<b"), ("text", "x")]
    assert kinds("x<p class='never closed") == [("text", "x")]
    page = parse("<div><p>one<p>two<b>x<div>y</b></div></div>z")
    assert [page.parents[i] for i in range(1, 6)] == [0, 1, 1, 3, 1]


def test_maximal_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(-3, 4, rng.integers(0, 12)).tolist()
        a, b = maximal(s)
        best = max([sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)], default=0)
        assert sum(s[a:b]) == max(best, 0)


def test_main_text_rows(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 2), (None, "u", "", 3), (3, "u", "<p>" + "word " * 20_000, 4), (3, "u", PAGE, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = main_text(df).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.n_chars for r in got)[-1] == 5 * 20_000 - 1
    assert main_text(df.limit(0), Weights()).collect() == [] and main_text(df.limit(0)).collect() == []


def test_every_training_token_reaches_a_gradient_step(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def keep(p, stream, width):
        np.save(f"{folder}/{len(stream)}-{int(stream.sum())}-{hash(stream.tobytes())}", stream)
        return p

    monkeypatch.setattr(lm, "train", keep)
    rows = lm.score(spark.createDataFrame([(i, f"w{i} x{i} w{i}") for i in range(200)], "doc_id long, text string")).collect()
    streams = [np.load(x) for x in tmp_path.glob("*.npy")]
    assert sum(map(len, streams)) == rows[0].train_tokens > 0
    assert len(np.unique(np.concatenate(streams))) == 1 + 2 * sum(not r.held_out for r in rows)


def paragraphs(seed, n, words=30):
    from tests.llm.conftest import prose

    return [prose(seed * 100 + k, words) for k in range(n)]


def learned(spark):
    from verdure.llm import htmltext

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return htmltext.learn(pages)


def test_sections_stay_whatever_their_names(spark):
    """Three equal sections, one of them with a name of boilerplate, or with one that no page has shown."""
    from verdure.llm import htmltext

    weights = learned(spark)
    parts = [paragraphs(k, 5) for k in range(3)]
    for outer in ("<article>{}</article>", "<div id=content>{}</div>"):
        for name in ("discussion", "comment-on-method", "legal", "reply", "tags", "sidebar-note", "notice", "qqq", "x7"):
            body = "".join(f"<section{f' class={name}' if k == 1 else ''}>" + "".join(f"<p>{p}</p>" for p in part) + "</section>" for k, part in enumerate(parts))
            page = f"<html><body><nav><ul><li><a href=/>home</a></li></ul></nav>{outer.format(body)}<footer>all rights</footer></body></html>"
            assert htmltext.extract(page, weights) == "\n".join(p for part in parts for p in part), name


def test_adverts_forms_links_and_reader_comments_in_the_article_go(spark):
    from verdure.llm import htmltext

    weights = learned(spark)
    a, b = paragraphs(7, 4), paragraphs(8, 4)
    p = lambda part: "".join(f"<p>{x}</p>" for x in part)
    comments = "<div class=comments>" + "".join(f"<div class=comment><p>{x}</p></div>" for x in paragraphs(9, 3, 40)) + "</div>"
    for noise in ("<div class=ad><p>buy this now and save money today at our shop</p></div>", "<form><label>mail</label><input><button>go</button></form>", "<div class=share><ul>" + "<li><a href=/x>share this</a></li>" * 30 + "</ul></div>", "<aside class=related><p><a href=/y>" + " ".join(["word"] * 90) + "</a></p></aside>", comments):
        page = f"<body><nav><a href=/>home</a></nav><article>{p(a)}{noise}{p(b)}</article><footer>all rights</footer></body>"
        assert htmltext.extract(page, weights) == "\n".join(a + b), noise[:40]
