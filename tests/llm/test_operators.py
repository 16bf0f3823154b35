"""The training-data operators against brute force, and on odd input: nulls, empty tables, ties, copies, long texts."""

import base64
import hashlib
import math
import random
import re
import signal
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidegauge.llm import (
    bpe, decontaminate, html_extract, labelled, line_dedup, ngram_join, pq_dedup, quality, queries, sharding, toxicity,
    warc, words as W,
)
from tidegauge.llm.components import components

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum " * 20_000


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


# --- components -------------------------------------------------------------------


def test_components_of_chains_and_stars(spark, tmp_path):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a LONG, b LONG")
    found = dict(rows(components(frame, str(tmp_path), "c"), "node", "component"))
    assert found == {k: 1 for k in range(1, 31)} | {k: 100 for k in range(100, 150)}
    assert components(frame.limit(0), str(tmp_path), "none").count() == 0


# --- WARC -------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\r\nb", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 99_999), (None, "u", "same"), (5, "u", "x\r\n\r\ny")]
    frame = spark.createDataFrame(pages, "page_id LONG, url STRING, html STRING").withColumn("offset", F.lit(1)).repartition(3)
    read = warc.round_trip(frame, root=str(tmp_path))
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [
        (1, 4, digest("same"), "response", None), (2, 4, digest("same"), "revisit", 1), (3, 0, digest(""), "response", None),
        (4, 0, digest(""), "revisit", 3), (5, 199_998, digest("é" * 99_999), "response", None),
        (None, 4, digest("same"), "revisit", 1), (5, 6, digest("x\r\n\r\ny"), "response", None),
    ]
    assert rows(read, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert read.where("NOT intact").isEmpty()
    assert warc.round_trip(frame.limit(0), root=str(tmp_path / "none")).count() == 0


def test_warc_members_stand_alone(spark, tmp_path):
    frame = spark.createDataFrame([(k, "u", f"page {k}") for k in range(20)], "page_id LONG, url STRING, html STRING").coalesce(1)
    raw = warc.write_archives(frame, f"{tmp_path}/raw")
    one = open(f"{tmp_path}/raw/{raw.first()['archive']}", "rb").read()
    stream = zlib.decompressobj(31)
    stream.decompress(one)
    assert stream.eof and not stream.unused_data  # one stream
    new = warc.normalise(raw, f"{tmp_path}/raw", f"{tmp_path}/new").first()["archive"]
    data = open(f"{tmp_path}/new/{new}", "rb").read()
    index = [line.split() for line in open(f"{tmp_path}/new/{new}.idx", "rb")]
    assert len(index) == 20
    for offset, length, *_ in index:
        assert zlib.decompress(data[int(offset) : int(offset) + int(length)], 31).startswith(b"WARC/1.1")


def test_warc_damage_is_found(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id LONG, url STRING, html STRING").coalesce(1)
    raw = warc.write_archives(frame, f"{tmp_path}/raw")
    path = f"{tmp_path}/raw/{raw.first()['archive']}"
    whole = zlib.decompress(open(path, "rb").read(), 31)
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    open(path, "wb").write(squeeze.compress(whole.replace(b"\r\n\r\ntwo", b"\r\n\r\ntoo")) + squeeze.flush())
    found = warc.read_records(warc.normalise(raw, f"{tmp_path}/raw", f"{tmp_path}/new"), f"{tmp_path}/new")
    digest = base64.b32encode(hashlib.sha1(b"too").digest()).decode()
    assert [r[1:] for r in rows(found.where("NOT intact"), "page_id", "payload_digest", "payload_bytes")] == [(digest, 3)]
    monkeypatch.setattr(warc, "write_archives", lambda *_: raw)
    monkeypatch.setattr(warc, "normalise", lambda *_: found)
    monkeypatch.setattr(warc, "read_records", lambda *_: found)
    with pytest.raises(Exception, match="damaged payload"):
        warc.round_trip(frame, root=str(tmp_path / "again")).collect()


# --- sharding ---------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 3, 1001])
def test_shards_are_even_and_gapless(spark, n):
    frame = spark.range(n).selectExpr("IF(id % 3 = 0, NULL, 7) AS doc_id", "id", "'x' AS Shard", "1 AS key", "2 AS row", "3 AS `a b`")
    found = sharding.uniform_shuffle(frame.repartition(5, "id"), 8, part_rows=50)
    assert found.columns == ["doc_id", "id", "key", "row", "a b", "shard", "slot"]
    found = found.collect()
    assert sorted(r["id"] for r in found) == list(range(n))
    counts = [sorted(r["slot"] for r in found if r["shard"] == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1


def test_matrix_has_the_margins_and_the_law_of_a_shuffle():
    counts = [5, 0, 17, 3]
    assert (sharding.draw_matrix(counts, 4, 1).sum(axis=1) == counts).all()
    draws = np.array([sharding.draw_matrix([2, 2], 2, seed)[0, 0] for seed in range(3000)])
    # two of four rows to a shard of two: 1/6, 4/6, 1/6
    assert np.abs(np.bincount(draws, minlength=3) / 3000 - [1 / 6, 4 / 6, 1 / 6]).max() < 0.04
    whole = sharding.draw_matrix(counts * 9, 4, 1)
    assert (whole.sum(axis=0) == sharding.shard_sizes(225, 4, 1)).all() and (whole.sum(axis=1) == counts * 9).all()
    for rows_ in (1, 20, 100):  # ranges drawn on the driver and in tasks meet in the same matrix
        assert (sharding.draw_matrix(counts * 9, 4, 1, rows_) == whole).all()


@pytest.mark.parametrize("good, bad, n", [(3, 2, 2), (40, 7, 30), (1000, 9000, 500), (5, 100_000, 60_000), (7, 7, 14), (6, 0, 4)])
def test_draw_by_inversion_has_the_hypergeometric_law(good, bad, n, monkeypatch):
    monkeypatch.setattr(sharding, "_TERMS", 7)
    rng = np.random.default_rng(good)
    draws = np.bincount([sharding._by_inversion(rng, good, bad, n) for _ in range(4000)], minlength=good + 1) / 4000
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    law = [
        math.exp(log(good, k) + log(bad, n - k) - log(good + bad, n)) if 0 <= n - k <= bad and k <= n else 0 for k in range(good + 1)
    ]
    assert np.abs(draws - law).max() < 0.03 and draws[np.array(law) == 0].sum() == 0


def test_draws_from_more_rows_than_numpy_takes():
    rng, n, good, bad = np.random.default_rng(1), 3 * 10**9, 2 * 10**10, 14 * 10**10
    draws = np.array([sharding._by_inversion(rng, good, bad, n) for _ in range(60)], float)
    deviation = math.sqrt(n / 8 * 7 / 8 * (1 - n / (good + bad)))
    z = (draws - n / 8) / deviation
    assert abs(z.mean()) < 0.6 and 0.6 < z.std() < 1.5
    counts = [10**9 + 7, 5, 4 * 10**9, 0, 123_456_789, 2 * 10**9]
    matrix = sharding.draw_matrix(counts, 8, 3)
    assert (matrix.sum(axis=1) == counts).all() and (matrix.sum(axis=0) == sharding.shard_sizes(sum(counts), 8, 3)).all()


# --- n-gram join --------------------------------------------------------------------


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _grams(text):
    w = _words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join_against_all_pairs(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 7)
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    texts = [None, "", " .,! ", "One two", "one, TWO!", "one two three", LONG]
    for k in range(30):  # near copies at many distances
        copy = list(base)
        for _ in range(k % 6):
            copy[rnd.randrange(120)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(50)) for _ in range(5)] + [texts[-1]] * 3
    table = docs(*enumerate(texts), (None, texts[10]), (3, "one two"))
    all_rows = [(i, t) for i, t in [*enumerate(texts), (None, texts[10]), (3, "one two")]]
    sets = [_grams(t) for _, t in all_rows]
    near = [[a is not b and bool(a) and bool(b) and 10 * len(a & b) >= 8 * len(a | b) for b in sets] for a in sets]
    for k in range(len(sets)):
        near[k][k] = False
    group = list(range(len(sets)))
    for _ in sets:
        group = [min([group[k], *(group[j] for j in range(len(sets)) if near[k][j])]) for k in range(len(sets))]
    low = {g: min(i for (i, _), h in zip(all_rows, group) if h == g and i is not None) for g in set(group)}
    want = sorted(((i, low[g] if s else i, sum(x)) for (i, _), g, x, s in zip(all_rows, group, near, sets)), key=repr)
    found = ngram_join.join(table, root=str(tmp_path))
    assert rows(found, "doc_id", "class_id", "n_links") == want
    kept = ngram_join.one_per_class(table, root=str(tmp_path / "kept"))
    assert kept.columns == table.columns
    assert kept.count() == len({g for g, s in zip(group, sets) if s}) + sum(not s for s in sets)


def test_ngram_join_of_nothing(docs, tmp_path):
    assert ngram_join.join(docs((1, "a")).limit(0), root=str(tmp_path)).count() == 0


def test_banding_reaches_its_recall():
    bands, n = ngram_join.banding(0.8, 0.99999)
    assert 1 - (1 - 0.8**n) ** bands >= 0.99999


# --- HTML ---------------------------------------------------------------------------

WEIGHTS = html_extract.train(["<html><body><nav><a>x y</a></nav><article><h1>t</h1><p>a b c</p></article><div>z</div></body></html>"] * 20)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("no markup &amp; all", "no markup & all"),
        ("<nav><a href=x>Home</a></nav><article><h1>A <b>b</b>c</h1><p>d&nbsp;e\n f<br>g</article><footer>h</footer>", "A bc d e f g"),
        ("<article><p>a<script>if (x < 1) { '</p>' }</script>b<!-- c --><form>d<input></form><p>e</article>", "ab e"),
        ("<article><p>a b c d<div class='Sidebar-left'>s</div><section id=comments><p>r</p></section></article>", "a b c d"),
        ("<main><header><h1>Title here</h1></header><p>text<aside>x</aside></main>", "Title here text"),
        ("<article><p>one<p hidden>two<p>three", "one three"),
        ("<article>a</b></i></article></div>", "a"),
        ("<p>a &copy b &#233; &notaref;", "a © b é ¬aref;"),
        ("<style>x{}</style><title>t</title>", ""),
    ],
)
def test_extract(page, text):
    assert html_extract.extract(page, WEIGHTS) == text


@pytest.mark.parametrize(
    "page, text",
    [
        *[
            (f"<div {mark}><p>m</p><article><p>a b c</p></article></div>", "a b c")
            for mark in ("id=sidebar", "class='left-menu x'", "class='comments'", "id='side'")
        ],
        *[
            (f"<article><p>a b<section {mark}>c d</section><p>e f</article>", "a b c d e f")
            for mark in (
                "class='content no-sidebar'", "class=has-sidebar", "id='with-menu'", "class='side-by-side'",
                "class='social-share-enabled'", "class='legal-analysis'", "class='related-work'",
                "title='the hidden cost'", "data-title=\"a hidden life\"", "title=\"x class='ad' \"", "alt='a' title = ' id=menu'",
            )
        ],
        *[
            (f"<article><p>a b<section {mark}>c d</section><p>e f</article>", "a b e f")
            for mark in (
                "class=ad", "class='x MENU'", "id='sidebar_right'", "title='x'hidden", "class='related-posts'", "hidden=''",
                "data-x='class=' aria-hidden = \"true\"", "style='color:red;display : none'",
            )
        ],
        ("<article><p>a b c</p></article><div class=comments><article><p>d e f g h i j k l</article></div>", "a b c"),
        ("<div class=menu><div class=sidebar>s s s s</div><main><p>a b c</main></div>", "a b c"),
        ("<div class=menu>x y z<aside><article>t</article></aside></div><p>a b", "a b"),
    ],
)
def test_extract_cuts_by_whole_names_only(page, text):
    assert html_extract.extract(page, WEIGHTS).removeprefix("m ") == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>a <svg class="icon"/>b<p>c <math/>d</article>', "a b c d"),
        ('<article><p>a <svg class="icon" /> b<p>c <svg><path d="x"/><text>t</text></svg>d</article>', "a b c d"),
        ("<article><p>a <svg><g><path d=x><title/><text>t</text></g></svg>b</p></article>", "a b"),
        ("<article><p>a <svg><title>t</title><style>x{}</style><foreignObject><p>t<textarea></svg></textarea></foreignObject></svg>b</p>", "a b"),
        ("<article><p>a <svg><path d=x></p><p>b c</p></article>", "a b c"),
        ("<article>a <svg><svg><text>t<p>b c</p></article>", "a b c"),
        ("<article><p>a <math><mi>x</mi></p><p>b c</article>", "a b c"),
        ("<article><p>a<noscript><p>t</p></noscript>b</p><div><template><p>t</div><p>c d e f g h</article>", "ab c d e f g h"),
        ("<p>x y<div><noscript>t</div><article><p>a b c d e f g h i</article>", "x y a b c d e f g h i"),
        ("<article><section><iframe src=x></section><p>a b c</article>", "a b c"),
        ("<article><p>a b<iframe></article></iframe>c</article>", "a b c"),
        ("<article><p>a<script>'<p>' t</article>", "a"),
        ("<article><p hidden>t<svg></svg>t</p>a", "a"),
    ],
)
def test_extract_of_svg_and_unclosed_parts(page, text):
    assert html_extract.extract(page, (1.0, {})) == text


TEN = "a b c d e f g h i j"
SAYS = "so very many words of other readers who say what they think of it " * 20


@pytest.mark.parametrize(
    "page, text",
    [
        # texts around the marked one stay out, whatever their class and length
        (f"<article><p>{TEN}</p></article><div class=user-opinions><p>{SAYS}</p></div>", TEN),
        (f"<main><article><p>{TEN}</article><section class=reader-says><p>{SAYS}<p>{SAYS}</section></main>", TEN),
        (f"<p>x y</p><main><h2>t</h2><p>{TEN}</main><p>{SAYS}", f"t {TEN}"),
        (f"<article><p>{TEN}</article><div>{SAYS}<main><p>t</main></div>", TEN),
        # marked text is kept to its ends, however many tags part it
        (f"<article><p>{TEN}" + "<section><table><tr><td>" * 30 + "end</article><p>x", f"{TEN} end"),
        # a mark behind a longer text is another's: the text in main, or the greatest sum
        (f"<main><p>{SAYS}</p><article><p>t</article></main>", f"{SAYS}t"),
        (f"<div>{SAYS}</div><article><p>t</article>", SAYS.strip()),
        # articles in an article: comments, or its body
        (f"<article><p>{TEN}</p><section><article>x y</article><article>{TEN}</article></section><p>end</article>", f"{TEN} end"),
        (f"<article><h1>t</h1><article><p>{TEN}</article></article>", f"t {TEN}"),
        # who speaks and what that is
        (f"<div><p>{TEN}</div><div class='user-opinions x'>{SAYS}</div><div id=readers_say>{SAYS}</div>", TEN),
        (f"<div class=user><p>{TEN}<p class=opinions>{TEN}<p class='no-user-opinions'>{TEN}</div>", f"{TEN} {TEN} {TEN}"),
        (f"<article><p>{TEN}<div itemprop=comment>x</div><div itemtype='https://schema.org/UserComments'>y</div></article>", TEN),
    ],
)
def test_extract_of_marked_texts(page, text):
    assert html_extract.extract(page, WEIGHTS) == text


def test_words_classes_and_links_that_stand_outside_lose_weight():
    page = (
        "<nav>Home <a href=x>Imprint</a></nav><article><p class=entry>one two three {0}</p></article>"
        "<div class=user-opinions><p>{0} Reply</p></div>"
    )
    pages = [page.format(f"word{k}") for k in range(50)]
    word, tags, learned = html_extract.train(pages)
    assert word == 1 and tags["/article"] < -3
    assert learned == {k: -1.0 for k in ("home", "imprint", "reply", ".user-opinions", html_extract.LINK)}
    assert html_extract.train(pages[:4])[2] == {}  # too few pages to tell
    text = lambda page: html_extract.extract(page, (word, tags, learned))
    # pages that mark nothing
    assert text(f"<div class=entry><p>{TEN}</p></div><div class='x user-opinions'><p>{SAYS}</p></div>") == TEN
    assert text(f"<div><p>Home imprint</p><p>{TEN} <a href=x>k</a></p><p>{TEN}</p><p>REPLY reply</p></div>") == f"{TEN} k {TEN}"
    assert text(f"<p>{TEN}</p><p><a href=x>l m n</a> <a href=y>o</a></p>") == TEN
    assert text(f"<p>{TEN}</p><p><a href=x>l m n</a> and o</p>") == f"{TEN} l m n and o"


def test_extract_finds_the_article_of_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = html_extract.extract_text(pages, html_extract.learn(pages)).toPandas().set_index("page_id")["text"]
    import html

    for page, source in pages.select("page_id", "html").collect():
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert found[page] == want


def test_extract_of_odd_tables(spark):
    frame = spark.createDataFrame([(None, None, None), (1, "u", LONG)], "page_id LONG, url STRING, html STRING")
    found = html_extract.extract_text(frame.withColumn("text", F.lit("x")), html_extract.learn(frame))
    assert rows(found, "page_id", "n_chars") == [(1, len(LONG) - 1), (None, 0)]
    assert html_extract.extract_text(frame.limit(0), WEIGHTS).count() == 0


# --- classifiers ----------------------------------------------------------------------


def _held_out(spark, query, column, parts, rest):
    found = queries.QUERIES[query](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    found = found.where("held_out").toPandas()
    assert all((zlib.crc32(str(i).encode()) % parts == rest) for i in found["doc_id"])
    return found["predicted"] == found[column]


def test_quality_on_held_out_rows(spark):
    assert _held_out(spark, "op5_quality", "quality", 3, 1).mean() > 0.97


def test_toxicity_on_held_out_rows(spark):
    assert _held_out(spark, "op9_toxicity", "toxic", 5, 0).mean() > 0.85  # some 35 toxic rows to learn from


def test_classifiers_on_odd_rows(spark, docs):
    table = docs((1, None), (2, ""), (3, "!!"), (None, "good words here"), (4, LONG), (4, LONG))
    model = quality.train([("good words here " * 9, 1), ("BAD!! BAD!! " * 9, 0)] * 4)
    found = quality.classify(table, model)
    assert found.count() == 6 and found.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert quality.classify(table.limit(0), model).count() == 0
    assert rows(quality.classify(docs((1, "a")), quality.train([])), "score", "predicted") == [(0.5, 1)]
    toxic = toxicity.train([(f"you are an idiot number {k}", 1) for k in range(60)] + [(f"plain text number {k}", 0) for k in range(60)])
    found = toxicity.classify(table, toxic)
    assert found.count() == 6 and found.where("predicted = 1").isEmpty()
    assert rows(toxicity.classify(docs((1, "Idiot, they are")), toxic), "predicted") == [(1,)]
    assert rows(toxicity.classify(docs((1, "idiot")), toxicity.train([])), "predicted") == [(0,)]


def test_penalty_keeps_identity_terms_out_of_the_score():
    rnd, rows_ = random.Random(2), []
    for k in range(300):  # texts that name one group are labelled more often
        insult = k % 3 == 0
        group = "muslim" if insult and rnd.random() < 0.9 or rnd.random() < 0.02 else "christian" if rnd.random() < 0.5 else ""
        rows_.append((f"word{k} {group} {'moron scum' if insult else 'tea'} text{k}", int(insult)))

    def scores(penalty, *texts):
        model = toxicity.train(rows_, penalty=penalty)
        data = "".join(texts).encode()
        offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
        return toxicity.score(np.frombuffer(data, np.uint8), offsets, model, toxicity._filter(model.keys))

    texts = "the muslim family had tea", "the christian family had tea", "the moron scum had tea"
    plain, fair = scores(0.0, *texts), scores(1.0, *texts)
    assert abs(fair[0] - fair[1]) < 0.1 <= abs(plain[0] - plain[1]) + 0.1
    assert fair[0] < 0.5 and fair[2] >= 0.5


def test_training_rows_are_bounded_and_never_held_out(spark):
    docs_, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["text"] for r in docs_.where(labelled.remainder(3) == 1).collect()}
    other = {r["text"] for r in docs_.where(labelled.remainder(3) != 1).collect()}
    found = labelled.sample(docs_, labels, "quality", labelled.remainder(3) != 1, 20)
    assert 0 < len(found) <= 40 and all(t in other or t not in texts for t, _ in found)


@pytest.mark.parametrize(
    "page",
    ["<div></x>" * 20_000, "<nav>" + "<div></x>" * 20_000, "<x>" * 60_000, "<nav><svg>" + "<g>" * 50_000, '<a href="x' * 20_000,
     "<p><b>" * 30_000, "<header><section>" * 12_000, "<td><p>" * 25_000 + "</table>" * 5000],
)
def test_deeply_nested_pages_take_linear_time(page):
    begun = time.monotonic()
    html_extract.extract(page, (1.0, {}))
    assert time.monotonic() - begun < 5


def test_quotes_in_tags():
    text = lambda page: html_extract.extract(page, (1.0, {}))
    assert text('<article>one two <p title="x>three</p> four') == "one two"  # never closed: reaches to the end
    assert text("<article><p class=\"a\"\">one > two</p><p title='a > \"b'>three</p><p data = \"<b>\">four</p></article>") == "one > two three four"
    assert text("<article><p title=it's>one</p> it's <i>two</i></article>") == "one it's two"


# --- line dedup -------------------------------------------------------------------------


def _dedup(table, min_docs=3):
    lines = [(i, (t or "").split("\n")) for i, t in table]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    order = lambda i: (i is not None, i or 0)
    for i, own in lines:
        for line in own:
            held.setdefault(key(line), set()).add(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(held[key(x)]) >= min_docs and i != max(held[key(x)], key=order)
    return [(i, len(own), sum(gone(i, x) for x in own), "\n".join(x for x in own if not gone(i, x))) for i, own in lines]


def test_line_dedup_against_a_plain_loop(docs):
    hot = "A line that many documents hold"
    table = [(k, f"{hot}\nown {k} {'x' * 30}\n \t{hot.upper()}\r") for k in range(40)]
    table += [(50, None), (51, ""), (52, "\n"), (None, hot), (None, "é" * 20), (53, "é" * 20), (54, " " + "é" * 20), (55, hot[:19])]
    table += [(60, "\n".join([hot, "z" * 25] * 100)), (60, "\n".join([hot, "z" * 25] * 100)), (61, "z" * 25), (62, "z" * 25), (5, "another text")]
    found = line_dedup.dedup_lines(docs(*table))
    assert rows(found, "doc_id", "n_lines", "n_dropped", "kept") == sorted(_dedup(table), key=repr)


def test_line_dedup_of_very_long_texts(docs):
    """Dropped lines far apart and far down; time linear in the lines."""
    long = "\n".join(f"line number {k} of many" if k % 997 else "A line that many documents hold" for k in range(240_000))
    table = [(k, long + f"\nown {k}") for k in (1, 2)] + [(9, "a line that many documents hold"), (8, None)]
    begun = time.monotonic()
    found = line_dedup.dedup_lines(docs(*table), min_docs=2)
    assert rows(found, "doc_id", "n_lines", "n_dropped", "kept") == sorted(_dedup(table, 2), key=repr)
    assert time.monotonic() - begun < 60


def test_line_dedup_keeps_columns_of_any_name(docs):
    table = docs((1, "a"), (2, "b")).selectExpr("*", "1 AS __id", "2 AS m__id", "3 AS n_dropped", "4 AS pos", "5 AS h1", "6 AS lines", "7 AS __row")
    found = line_dedup.dedup_lines(table)
    assert found.columns == [c for c in table.columns if c not in ("kept", "n_dropped")] + ["n_lines", "n_dropped", "kept"]
    assert rows(found, "doc_id", "__id", "words", "__row", "n_dropped", "kept") == [(1, 1, 3, 7, 0, "a"), (2, 1, 3, 7, 0, "b")]


def test_line_dedup_of_nothing(docs):
    assert line_dedup.dedup_lines(docs((1, "a")).limit(0)).count() == 0


def test_line_dedup_runs_no_python(docs):
    plan = line_dedup.dedup_lines(docs((1, "a")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- vectors ------------------------------------------------------------------------------


def test_vectors_against_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pq_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = [(centres[k % 12] + rng.normal(scale=0.12, size=16)).tolist() for k in range(240)]
    table = [(k, v, k % 12 // 6) for k, v in enumerate(x)] + [(300 + k, x[0], 0) for k in range(20)]
    table += [(400, None, 0), (401, [0.0] * 16, 0), (402, x[0], None), (403, [float("nan")] + [1.0] * 15, 0), (404, [None] + [1.0] * 15, 0),
              (405, [float("inf")] * 16, 0), (406, [], 0), (407, [1.0, 2.0], 0), (408, [2.0, 4.0], 0), (409, x[0], 1), (None, x[0], 0), (400, None, None)]
    frame = spark.createDataFrame(table, "vec_id LONG, embedding ARRAY<DOUBLE>, label INT").withColumn("node", F.lit("x"))

    def usable(v):
        return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    def linked(a, b):
        if a is b or a[2] is None or a[2] != b[2] or not usable(a[1]) or not usable(b[1]) or len(a[1]) != len(b[1]):
            return False
        p, q = np.array(a[1]), np.array(b[1])
        return p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.93

    near = [[linked(a, b) for b in table] for a in table]
    found = pq_dedup.near_duplicates(frame, slack=1.0, root=str(tmp_path))  # slack 1 misses nothing
    assert rows(found, "vec_id", "n_links") == sorted(((r[0], sum(n)) for r, n in zip(table, near)), key=repr)
    group = list(range(len(table)))
    for _ in range(12):
        group = [min([group[k], *(group[j] for j, hit in enumerate(n) if hit)]) for k, n in enumerate(near)]
    low = {g: min((r[0] for r, h in zip(table, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    assert rows(found, "vec_id", "component_id") == sorted(((r[0], low[g]) for r, g in zip(table, group)), key=repr)
    default = pq_dedup.near_duplicates(frame, root=str(tmp_path / "default")).agg(F.sum("n_links")).first()[0]
    assert 0.9 * sum(map(sum, near)) <= default <= sum(map(sum, near))
    assert pq_dedup.near_duplicates(frame.limit(0), root=str(tmp_path / "none")).count() == 0


def _brute_components(x, labels):
    """Link counts and smallest members of components of unit vectors, all pairs of a label."""
    hit = (x @ x.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(hit, False)
    low = np.arange(len(x))
    while True:
        step = np.minimum(low, np.where(hit, low[None, :], len(x)).min(1))
        if (step == low).all():
            return hit.sum(1), low
        low = step


@pytest.mark.parametrize("level", [1024, 6])
def test_planted_copies_at_the_default_slack(spark, tmp_path, monkeypatch, level):
    """Noisy copies of given vectors, in twos and in a large group: whole rows, with one and two levels of lists."""
    monkeypatch.setattr(pq_dedup, "LEVEL", level)
    monkeypatch.setattr(pq_dedup.Index.__init__, "__defaults__", (3, level))
    monkeypatch.setattr(pq_dedup, "PER_LIST", 4)
    given = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").toPandas()
    x, label = np.array(given["embedding"].tolist(), np.float64), given["label"].to_numpy()
    rng = np.random.default_rng(8)
    scale = np.linalg.norm(x, axis=1, keepdims=True) / 8
    twins = x + rng.normal(scale=0.2, size=x.shape) * scale
    group = x[:1] + rng.normal(scale=0.1, size=(300, x.shape[1])) * scale[0]
    every = np.concatenate((x, twins, group)).astype(np.float32)
    labels = np.concatenate((label, label, np.full(300, label[0])))
    table = [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(every, labels))]
    frame = spark.createDataFrame(table, "vec_id LONG, embedding ARRAY<FLOAT>, label INT")
    found = {r["vec_id"]: r for r in pq_dedup.near_duplicates(frame, root=str(tmp_path)).collect()}
    unit = every.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links, low = _brute_components(unit, labels)
    assert links.sum() > 80_000 and [found[k]["component_id"] for k in range(len(every))] == low.tolist()
    got = np.array([found[k]["n_links"] for k in range(len(every))])
    assert (got <= links).all() and got.sum() >= 0.99 * links.sum()


def test_slack_one_reads_the_list_of_every_link():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = pq_dedup.Index(x, 120, 0.93, 1.0, level=12)
    assert len(index.centres) == 12 and len(index.fine) == 10
    y = x + rng.normal(size=x.shape) * 0.09
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    close = (x * y).sum(1) >= 0.93
    home, _, _, near = index.encode(x)
    other = index.encode(y)[0]
    assert close.sum() > 200 and all(other[k] == home[k] or other[k] in near[k] for k in np.flatnonzero(close))


def test_rare_toxic_words_count_however_large_the_sample():
    rnd = random.Random(3)
    rare = ["".join(rnd.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(250)]
    common = ["".join(rnd.choices("aeioubcd", k=5)) for _ in range(60)]
    text = lambda *more: " ".join([*rnd.choices(common, k=8), *more])
    model = toxicity.train([(text(w), 1) for w in rare for _ in range(12)] + [(text(), 0) for _ in range(3000)], epochs=2)
    raw = [text(*w).encode() for w in [(w,) for w in rare] + [()] * 250]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    found = toxicity.score(np.frombuffer(b"".join(raw), np.uint8), offsets, model, toxicity._filter(model.keys))
    assert ((found >= 0.5) == ([True] * 250 + [False] * 250)).all()


# --- tokens ---------------------------------------------------------------------------------

PATH = public_tokenizers.path(queries.RANKS)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encode(tool, texts):
    raw = [t.encode() for t in texts]
    ids, cuts = tool.encode(b"".join(raw), np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64))
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def test_tokens_equal_the_library(library):
    rnd = random.Random(5)
    texts = ["", "'", " ", "a  b ", "it's", "'s's", "x  's", "''s", "'re 'r", "a b", "﻿", "9's", "͸", "a" * 3000, "ab" * 900]
    texts += ["".join(rnd.choice("ab'strevmld'  \n\t é1९.!?- 'xŸ中😀 ") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    tool = bpe.encoder(PATH)
    assert _encode(tool, texts) == [library.encode_ordinary(t) for t in texts]
    ids = _encode(tool, [texts[-1] + "déjà vu"])[0]
    cuts, raw = tool.offsets(np.array(ids)), (texts[-1] + "déjà vu").encode()
    assert all(tool.decode(np.array(ids[a:])) == raw[cuts[a] :] for a in range(len(ids)))


def test_cache_may_shrink_at_any_time(library, monkeypatch):
    tool = bpe.Encoder(PATH)
    tool.cache.bound = 50
    texts = [f"some words {k} and {k * 7919} others" for k in range(400)]
    for k in range(0, 400, 20):
        assert _encode(tool, texts[k : k + 20]) == [library.encode_ordinary(t) for t in texts[k : k + 20]]
        assert len(tool.cache.hashes) < 250


def test_cache_takes_more_pieces_in_a_pass_than_its_table_had_slots(library, monkeypatch):
    monkeypatch.setattr(bpe.Cache, "BITS", 6)
    tool = bpe.Encoder(PATH)

    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(20)
    try:
        for k in (3000, 30, 40):
            texts = [" ".join(f"w{n * 7919}x" for n in range(k, 2 * k)), "w1x again"]
            assert _encode(tool, texts) == [library.encode_ordinary(t) for t in texts]
            assert 2 * len(tool.cache.hashes) <= len(tool.cache.slots)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def test_encode_query_columns(spark, docs, library):
    table = [(1, None), (2, ""), (None, "Hello wörld"), (3, LONG), (3, LONG)]
    found = bpe.encode(docs(*table), PATH, with_tokens=True)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t in table:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.encode(docs(*table).limit(0), PATH).count() == 0


def test_every_code_point_has_the_library_s_class():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    for pattern, kinds in ((r"\p{L}", {bpe.LETTER}), (r"\p{N}", {bpe.NUMBER}), (r"\s", {bpe.SPACE, bpe.BLANK})):
        tool = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(tool.encode_ordinary(every)).decode()
        assert Counter(found) == Counter(c for c in every if bpe.classes()[ord(c)] in kinds)


# --- decontamination ----------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination_against_a_plain_loop(spark, docs, limit):
    item = " ".join(f"w{k}" for k in range(30))
    items = [(1, item), (2, "Short item here"), (3, None), (4, " ".join(f"w{k}" for k in range(10, 26))), (10, "?!"), (2, "short ITEM, here")]
    table = [(1, f"before {item.upper()} after"), (2, "a short, item: here and there"), (3, None), (4, ""), (5, "w1 w2 w3"),
             (6, "x " * 400 + "short item here"), (None, " ".join(f"w{k}" for k in range(5, 18))), (7, "short item"), (7, "short item here")]
    benchmark = spark.createDataFrame(items, "item_id LONG, text STRING")
    want = []
    for i, t in table:
        w, hit, found = _words(t), set(), set()
        for name, text in items:
            own = _words(text)
            size = min(13, len(own))
            for a in range(len(own) - size + 1 if own else 0):
                for b in range(len(w) - size + 1):
                    if w[b : b + size] == own[a : a + size]:
                        hit |= set(range(b, b + size))
                        found.add(str(name))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    found = decontaminate.decontaminate(docs(*table), benchmark, broadcast_bytes=limit)
    assert rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert decontaminate.decontaminate(docs(*table).limit(0), benchmark, broadcast_bytes=limit).count() == 0
    assert decontaminate.decontaminate(docs(*table), benchmark.limit(0), broadcast_bytes=limit).where("n_hit > 0").isEmpty()


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_spans_can_be_removed(spark, docs, limit):
    benchmark = spark.createDataFrame([(1, "two three")], "item_id LONG, text STRING")
    table = docs((1, "One, two; three! four"), (2, "é two"), (3, None), (4, "Two three"))
    found = decontaminate.decontaminate(table, benchmark, cleaned=True, broadcast_bytes=limit)
    assert rows(found, "doc_id", "cleaned") == [(1, "One, ! four"), (2, "é two"), (3, ""), (4, "")]


def test_both_forms_of_decontamination_agree(spark, docs, monkeypatch):
    """Passages that overlap, repeat and are shared by many items and documents; with colliding hashes too."""
    rnd = random.Random(8)
    word = lambda: rnd.choice(["ü", "Ab", "c", "d1"])
    passages = [" ".join(word() for _ in range(rnd.choice([1, 2, 5, 14, 40]))) for _ in range(25)]
    benchmark = spark.createDataFrame([(k % 40, rnd.choice(passages)) for k in range(80)], "item_id LONG, text STRING")
    texts = [", ".join([*(word() for _ in range(rnd.randrange(30))), *rnd.choices(passages[5:], k=rnd.randrange(4))]) for _ in range(60)]
    texts += [", ".join(f"z{rnd.randrange(9)}" for _ in range(40)) for _ in range(5)]
    table = docs(*enumerate(texts), (7, " x ".join(passages * 20))).withColumn("row", F.lit(1)).withColumn("hits", F.lit("h"))
    names = ("doc_id", "n_hit", "n_items", "items_sha256", "contaminated", "cleaned")
    one, two = (decontaminate.decontaminate(table.drop("n_words"), benchmark, 6, ("doc_id", "hits"), True, b) for b in (1 << 26, 0))
    want = rows(one, *names)
    assert want == rows(two, *names) and any(r[4] for r in want) and not all(r[4] for r in want)
    index = decontaminate.Index([(str(r["item_id"]), r["text"].encode()) for r in benchmark.collect()], 6)
    own = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])
    _, hit, items = decontaminate.scan(data, offsets, index)
    plain = decontaminate.W.window_hashes
    monkeypatch.setattr(decontaminate.W, "window_hashes", lambda h, r, s: (plain(h, r, s)[0], plain(h, r, s)[1] % np.uint64(3)))
    index = decontaminate.Index([(str(r["item_id"]), r["text"].encode()) for r in benchmark.collect()], 6)
    _, again, same = decontaminate.scan(data, offsets, index)
    assert (hit == again).all() and items == same


# --- pipeline -------------------------------------------------------------------------------------


def _quality_score(text, model):
    """The score by a plain loop over the features of one text."""
    (weights, bias), raw = model, (text or "").encode()
    shift, names = 64 - quality.FAMILY_BITS, raw.translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ")
    number = lambda b: sum(int(W.LETTERS[c]) * W._BASE**k for k, c in enumerate(b))
    mix = lambda x: int(W.mix(np.array([x % 2**64], np.uint64))[0])
    words = [mix(number(b) + len(b)) for b in names if b]
    grams = [int.from_bytes(raw[k : k + n], "little") + n for n in quality.GRAMS for k in range(len(raw) - n + 1)]
    families = [
        [g * 0x9E3779B97F4A7C15 % 2**64 for g in grams],
        words,
        [mix(1 if a == b else a + 3 * b) for a, b in zip(words, words[1:])],
    ]
    logit = bias
    for k, family in enumerate(families):
        own = [float(weights[(h >> shift) + (k << quality.FAMILY_BITS)]) for h in family]
        logit += sum(own) / max(1, len(own))
    return 1 / (1 + math.exp(-max(-30, min(30, logit))))


def _one_per_class(table):
    """Ids that stay: the smallest of each class of near duplicates, and all texts without words."""
    sets = [_grams(t) for _, t in table]
    group = list(range(len(table)))
    for a in range(len(table)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    lowest = {g: min(i for (i, _), h in zip(table, group) if h == g) for g, own in zip(group, sets) if own}
    return [i for (i, _), g, own in zip(table, group, sets) if not own or lowest[g] == i]


def _contaminated(text, items):
    w, hit = _words(text), set()
    for own in items:
        size = min(13, len(own))
        windows = {tuple(own[a : a + size]) for a in range(len(own) - size + 1)}
        for b in range(len(w) - size + 1):
            if tuple(w[b : b + size]) in windows:
                hit |= set(range(b, b + size))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline_stages_against_plain_loops(spark, library):
    """Every stage's rows and texts, recomputed from that stage's input."""
    import corpus_pipeline

    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs_.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id")
    base = [r["text"] for r in good.orderBy("doc_id").limit(12).collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    shared = "\nThis very line stands in several of the documents."
    texts = [None, "", *(t + " and one more" for t in base[:3]), *(t + shared for t in base[3:8]), *(b + " " + t for b, t in zip(base[8:], items))]
    kinds = {f.name: f.dataType.simpleString() for f in docs_.schema}
    planted = [tuple({"doc_id": 10**6 + k, "text": t, "n_chars": -1}.get(c, "x" if kinds[c] == "string" else 0) for c in docs_.columns) for k, t in enumerate(texts)]
    rows_ = docs_.unionByName(spark.createDataFrame(planted, docs_.schema)).withColumn("score", F.lit(1)).withColumn("kept", F.lit(2))
    windows = [w for w in (_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if w]
    model, gone = queries.quality_model(spark, SF, rows_), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r.asDict() for r in rows_.collect()}
        table = [(i, r["text"]) for i, r in before.items()]
        if name == "quality":
            scores = {i: _quality_score(t, model) for i, t in table}
            assert min(abs(x - 0.5) for x in scores.values()) > 1e-6
            want = [before[i] for i, x in scores.items() if x >= 0.5]
        elif name == "line_dedup":
            want = [before[i] | {"text": before[i]["text"] and kept, "n_chars": len(kept)} for i, _, _, kept in _dedup(table)]
        elif name == "ngram_join":
            want = [before[i] for i in _one_per_class(table)]
        elif name == "decontaminate":
            want = [before[i] for i, t in table if not _contaminated(t, windows)]
        else:
            sha, want = lambda x: hashlib.sha256(x).hexdigest(), []
            for i, t in table:
                ids = library.encode_ordinary(t or "")
                digests = {"ids_sha256": sha(" ".join(map(str, ids)).encode()), "decoded_sha256": sha((t or "").encode())}
                want.append({c: before[i][c] for c in ("doc_id", "lang", "source")} | {"n_tokens": len(ids)} | digests)
        found = [r.asDict() for r in stage(spark, rows_, SF).collect()]
        key = lambda r: r["doc_id"]
        assert sorted(found, key=key) == sorted(want, key=key)
        gone[name] = len(before) - len(want) + sum(r["text"] != before[r["doc_id"]]["text"] for r in want if "text" in r)
        if name != "bpe":
            rows_ = spark.createDataFrame([tuple(r[c] for c in rows_.columns) for r in found], rows_.schema)
    assert all(gone[name] for name in ("quality", "line_dedup", "ngram_join", "decontaminate")) and not gone["bpe"]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0)], docs_.schema)
    rows_ = docs_.unionByName(odd).withColumn("score", F.lit(1)).withColumn("kept", F.lit(2))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, rows_, SF)
        if name != "bpe":
            assert after.columns == rows_.columns
            assert after.count() <= rows_.count()
            rows_ = spark.createDataFrame(after.collect(), rows_.schema)
    assert after.count() == rows_.count() > 0
    assert after.select("doc_id").distinct().count() == after.count()
