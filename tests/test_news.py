"""Feed parsing, ranking and dedupe (a three-item feed: on-topic, off-topic, navigation)."""

from pyspark.sql import functions as F

from episcope.functions.dates import normalize_date, sort_instant
from episcope.operators import news as N
from episcope.sources.feeds import read_feed_items

FEED = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0">
<channel><title>Boletim Norte</title>
<item><title>Gripe e SRAG: hospital amplia leitos em Belém</title><link>https://boletim.example.com/a/17</link>
<description><![CDATA[<div>Rede <i>estadual</i> abre 40 leitos &amp; reforça plantões.</div>]]></description>
<pubDate>Mon, 09 Mar 2026 06:30:00 -0300</pubDate></item>
<item><title>Festival de música começa sexta</title><link>https://boletim.example.com/b/18</link>
<description>Programação tem doze bandas.</description><pubDate>Sun, 08 Mar 2026 21:00:00 GMT</pubDate></item>
<item><title>Nav. ed. pt Mapa do site</title><link>https://boletim.example.com/mapa</link><description>links</description>
<pubDate>Tue, 10 Mar 2026 08:00:00 GMT</pubDate></item>
</channel></rss>"""


def _feeds(spark, tmp_path, docs):
    d = tmp_path / "feeds"
    d.mkdir()
    for name, body in docs.items():
        (d / name).write_text(body, encoding="utf-8")
    reg = spark.createDataFrame([(i, n.split(".")[0], n) for i, n in enumerate(sorted(docs))],
                                "feed_pos INT, name STRING, file STRING")
    return read_feed_items(spark, str(d), reg)


def test_feed_parse_and_rank(spark, tmp_path):
    items = N.prepare_items(_feeds(spark, tmp_path, {"agencia.xml": FEED, "broken.xml": "<rss><channel>"}))
    rows = items.orderBy("item_pos").collect()
    assert len(rows) == 2  # navigation item dropped, broken feed gives nothing
    top = N.rank_news(items, 3).orderBy("rank").collect()
    assert [r.rank for r in top] == [1, 2]
    first = top[0]
    assert first.title.startswith("Gripe e SRAG") and first.score > top[1].score
    assert first.date == "2026-03-09"
    assert first.summary == "Rede estadual abre 40 leitos & reforça plantões."
    assert first.url.startswith("https://") and first.source == "agencia"


def test_feed_depth_encoding_and_repeated_children(spark, tmp_path):
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><title>Saúde</title><item><title>Vacinação</title></item></channel></rss>'
    kanji = '<?xml version="1.0" encoding="Shift_JIS"?><rss><channel><item><title>日本</title></item></channel></rss>'
    deep = ('<rss xmlns:a="urn:a"><channel><title>c</title><box><a:item><title>one</title><title>two</title><link>u</link><link>v</link>'
            "<pubDate> </pubDate><a:date>2026-07-02</a:date></a:item></box><item><title/><title>late</title></item></channel><x><y><item><title>y</title></item></y></x></rss>")
    for name, body, encoding in (("a.xml", latin, "latin-1"), ("b.xml", deep, "utf-16"), ("c.xml", kanji, "shift_jis"), ("d.xml", "<rss><item></rss>", "ascii")):
        (tmp_path / name).write_bytes(body.encode(encoding))
    got = read_feed_items(spark, str(tmp_path)).orderBy("feed_pos", "item_pos").collect()
    assert [(r.source, r.item_pos, r.channel_title, r.title, r.url, r.raw_date) for r in got] == [
        ("a.xml", 0, "Saúde", "Vacinação", None, None), ("b.xml", 0, "c", "one", "u", "2026-07-02"), ("b.xml", 1, "c", "", None, None),
        ("b.xml", 2, "c", "y", None, None), ("c.xml", 0, None, "日本", None, None)]


def test_dedupe_keeps_first_in_feed_order(spark):
    rows = [(1, 5, "s1", "Same  Title", "a"), (0, 9, "s0", "same title", "b"), (0, 3, "s0", "Other", "c")]
    items = spark.createDataFrame(rows, "feed_pos INT, item_pos INT, source STRING, title STRING, summary STRING")
    got = {r.title: (r.feed_pos, r.item_pos) for r in N.dedupe_titles(items).collect()}
    assert got == {"same title": (0, 9), "Other": (0, 3)}


def test_rank_ties_keep_source_order(spark):
    rows = [(0, i, "s", f"t{i}", "gripe", None) for i in range(4)]
    items = spark.createDataFrame(rows, "feed_pos INT, item_pos INT, source STRING, title STRING, "
                                        "summary STRING, instant TIMESTAMP")
    got = [r.item_pos for r in N.rank_news(items, 3).orderBy("rank").collect()]
    assert got == [0, 1, 2]


def test_feed_dates(spark):
    raw = ["Thu, 02 Jul 2026 23:30:00 -0300", "2 Jul 2026 10:00 GMT", "2026-07-02T10:00:00Z",
           "2026-07-02", "ontem", None]
    df = spark.createDataFrame([(r,) for r in raw], "r STRING")
    out = df.select(normalize_date(F.col("r")).alias("d"),
                    F.date_format(sort_instant(F.col("r")), "yyyy-MM-dd HH:mm:ss").alias("i")).collect()
    assert [o.d for o in out] == ["2026-07-02", "2026-07-02", "2026-07-02", "2026-07-02", None, None]
    assert [o.i for o in out] == ["2026-07-03 02:30:00", "2026-07-02 10:00:00", None, None, None, None]


def test_feed_dates_of_other_shapes(spark):
    raw = ["Thursday, 02-Jul-26 23:30:00 -0300", "2 July 2026 10:00 GMT", "Thu, 2 Jul 26 10:00:00 +0000 (UTC)", "20260702T100000Z", "20260702",
           "2 Jul 2026 10:00 AST", "2 Jul 2026 25:00 GMT", "31 Feb 2026 10:00 GMT"]
    df = spark.createDataFrame([(r,) for r in raw], "r STRING")
    out = df.select(normalize_date(F.col("r")).alias("d"),
                    F.date_format(sort_instant(F.col("r")), "yyyy-MM-dd HH:mm:ss").alias("i")).collect()
    assert [o.d for o in out] == ["2026-07-02"] * 6 + [None, None]
    assert [o.i for o in out] == ["2026-07-03 02:30:00", "2026-07-02 10:00:00", "2026-07-02 10:00:00", None, None,
                                  "2026-07-02 14:00:00", None, None]


def test_text_with_angle_brackets_and_unclosed_blocks(spark):
    from episcope.functions.text import clean_summary
    rows = [(1, "a < b and c > d"), (2, '<a title="x > y">t</a>'), (3, "before <script> var x = 1"), (4, "seen <!-- hidden"), (5, "x <b unclosed")]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i INT, h STRING").select("i", clean_summary("h").alias("s")).collect()}
    assert got == {1: "a < b and c > d", 2: "t", 3: "before", 4: "seen", 5: "x <b unclosed"}
