"""The container with the main text, of hosts without an article."""

import random

import pytest
from cases import as_rows, sentence
from pyspark.sql import functions as F

from quiresift.llm import template

PLAIN = """<html><body class="page has-sidebar"><div class="page has-sidebar"><div class="top"><ul>{links}</ul></div>
<div class="left-col"><a href="/{i}">{offer}</a><p>{pitch}</p></div><div class="w-1/2"><h1>Title {i}</h1><div class="body"><p>{one}</p><p>{two}</p></div><p>Printed on paper</p></div><div class="end">Page {i}</div></div></body></html>"""


def pages(hosts, each):
    rng = random.Random(4)
    out = []
    for i in range(hosts * each):
        one, two = sentence(rng, 60, 10_000), sentence(rng, 40, 10_000)
        links = "".join(f"<li><a href='/{k}'>{sentence(rng, 2, 10_000)}</a></li>" for k in range(rng.randrange(3, 7)))
        html = PLAIN.format(i=i, links=links, offer=sentence(rng, 4, 10_000), pitch=sentence(rng, 5, 10_000), one=one, two=two)
        out.append((i, f"https://h{i % hosts}.example/{i}", html, f"Title {i} {one} {two}"))
    return out


@pytest.mark.parametrize(("hosts", "each", "rows"), [(2, 12, 100_000), (2, 12, 0), (12, 1, 100_000)])
def test_varying_menus_and_adverts(spark, monkeypatch, hosts, each, rows):
    monkeypatch.setattr(template, "BROADCAST_ROWS", rows)
    data = pages(hosts, each)
    got = template.extract(spark.createDataFrame([r[:3] for r in data], "page_id long, url string, html string")).select("page_id", "text")
    assert as_rows(got) == sorted([(r[0], r[3]) for r in data], key=str)


def test_article_in_a_wrapper_named_like_furniture(spark):
    html = "<body><div class='sidebar-layout'><p>beside</p><article><p>Text <b>here</b></p><div class='share'>Share</div></article></div><aside><article>Other</article></aside></body>"
    got = template.extract(spark.createDataFrame([(1, "http://a.example/", html)], "page_id long, url string, html string"))
    assert got.first().text == "Text here"


def test_names_of_furniture():
    for name in ("ad", "ads", "ad-728x90", "google-ads", "advertSlot", "site-footer", "main-nav", "comment-list", "commentBox", "reader_comments", "cookie-law", "related-posts", "share", "sidebar-left", "newsletterSignup"):
        assert template.speaks_of_furniture(name), name
    for name in ("side-by-side", "alert-free", "ad-free", "related-work", "has-sidebar", "no-comments", "header-image-caption", "socialism", "badge", "research", "content", "w-1/2", "searchlight", "menu-of-the-day"):
        assert not template.speaks_of_furniture(name), name


def test_an_article_keeps_blocks_whose_names_only_sound_like_furniture(spark):
    html = "<article><p>First.</p><div class='side-by-side'>Second.</div><p class='alert-free'>Third.</p><section id='related-work'>Fourth.</section><div class='comments'>Nice!</div></article>"
    got = template.extract(spark.createDataFrame([(1, "http://a.example/", html)], "page_id long, url string, html string"))
    assert got.first().text == "First. Second. Third. Fourth."


def test_sketches_of_very_frequent_tokens(spark):
    """2**25 occurrences: equal vectors have equal sketches, others do not, nothing overflows."""
    pages_ = spark.range(1 << 25).select(F.lit("h").alias("host"), F.lit("b").alias("kind"), F.lit(1).cast("long").alias("n"), F.xxhash64("id").alias("page"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("holder"), F.lit(1).cast("long").alias("prose"))
    seen = pages_.withColumn("token", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("n", F.when((F.col("token") == 3) & (F.col("page") % 1000 == 0), F.lit(2)).otherwise(F.col("n")).cast("long"))
    one, two, three = template.vectors_of(seen, "host", "token").orderBy("token").select("one", "two", "on_pages").collect()
    assert one == two and one.on_pages == three.on_pages == 1 << 25 and one != three
    everywhere = template.vectors_of(template.vectors_of(seen.where("token < 3"), "host", "token"), "token").select("one", "two").distinct().count()
    assert everywhere == 1


def test_classes_against_exact_vectors(spark):
    """The text blocks of valid classes, by exact occurrence vectors of small hosts."""
    data = pages(3, 10)
    rng = random.Random(2)
    data = [(i, url, html.replace("Printed on paper", f"Printed on paper {'<p>Often</p>' if rng.random() < 0.9 else ''}<p>Always</p>"), t) for i, url, html, t in data]
    got = {(r.host, r.block) for r in template.deduce(spark.createDataFrame([r[:3] for r in data], "page_id long, url string, html string")).where("block IS NOT NULL").collect()}
    want = set()
    for host in {template.host_of(r[1]) for r in data} | {""}:
        own = [template.tokens_of(r[2]) for r in data if host in ("", template.host_of(r[1]))]
        classes = {}
        for token in {t for page in own for t in page}:
            vector = tuple(page.get(token, [0])[0] for page in own)
            on = sum(map(bool, vector))
            if on >= 2 and on >= 0.8 * len(own):
                classes.setdefault(vector, []).append(token)
        want |= {(host, token) for members in classes.values() if len(members) >= 2 for token in members if token.startswith("b ")}
    hashed = spark.createDataFrame([(h, t) for h, t in want], "host string, token string").select("host", F.xxhash64("token").alias("block")).collect()
    assert got == {(r.host, r.block) for r in hashed} and got


def test_the_template_decides_without_an_article(spark):
    data = pages(1, 12)
    frame_ = spark.createDataFrame([r[:3] for r in data], "page_id long, url string, html string")
    main = template.deduce(frame_).where("host <> '' AND block IS NULL").first().main
    for _, _, html, text in data:
        assert template.main_text(html, set(), hash, main) != text != template.main_text(html, set(), hash, "")
