import datetime as dt
import json

from pyspark.sql import functions as F

from tapewire.operators.news import (
    matching,
    newest_page,
    newest_pages,
    normalize_articles,
    published_between,
)
from tapewire.operators.upsert import upsert_news
from tapewire.schemas import ARTICLE, NEWS
from tapewire.sources.landed import read_news_payloads

COLUMNS = ["id", "url", "source", "section", "published_at", "title", "description", "body"]
ITEMS = [
    {
        "id": "a/1",
        "webUrl": "https://news.example/1",
        "sectionName": "Business",
        "webPublicationDate": "2024-01-01T12:00:00Z",
        "fields": {"headline": "Tankers queue as oil stays at sea", "trailText": "Berths are full.", "bodyText": "Port records list forty ships."},
    },
    {
        "id": "a/2",
        "webUrl": "https://news.example/2",
        "sectionName": "Energy",
        "webPublicationDate": "2024-01-02T09:30:00Z",
        "fields": {"headline": "Cold week empties gas storage", "trailText": "Caverns at a third.", "bodyText": "Operators ask for early deliveries."},
    },
]


def sample(spark, items=ITEMS):
    text = spark.createDataFrame([(json.dumps(i),) for i in items], "j string")
    return normalize_articles(text.select(F.from_json("j", ARTICLE).alias("article")))


def test_schema(spark):
    out = sample(spark)
    assert out.columns == COLUMNS and [f.dataType for f in out.schema] == [f.dataType for f in NEWS]
    rows = out.collect()
    assert len(rows) == 2 and {r.source for r in rows} == {"guardian"}
    assert all(r.published_at for r in rows)


def test_missing_parts(spark):
    rows = sample(spark, [{"id": "x", "fields": None}, {"webPublicationDate": "soon"}]).collect()
    assert [r.id for r in rows] == ["x", None]
    assert all(r.title is None and r.published_at is None for r in rows)
    only_id = spark.createDataFrame([(("i",),)], "article struct<id string>")
    assert normalize_articles(only_id).columns == COLUMNS


def test_upsert_keeps_newest(spark):
    first = sample(spark)
    newer = first.withColumn(
        "published_at",
        F.when(F.col("id") == "a/1", F.lit("2024-01-03").cast("timestamp")).otherwise(F.col("published_at")),
    )
    rows = upsert_news(first, newer).collect()
    assert len(rows) == 2
    assert {str(r.published_at) for r in rows if r.id == "a/1"} == {"2024-01-03 00:00:00"}


def articles(spark, rows):
    return spark.createDataFrame(rows, "url string, published_at timestamp, id string, row_seq bigint")


def test_upsert_orders(spark):
    day = dt.datetime(2024, 1, 1)
    old = articles(spark, [("u", day, "old", 1), ("v", day, "old", 2), (None, day, "n1", 3)])
    new = articles(spark, [("u", None, "undated", 1), ("v", day, "x", 1), ("v", day, "y", 2), (None, None, "n2", 3)])
    kept = {r.url: r.id for r in upsert_news(old, new).collect()}
    assert kept == {"u": "old", "v": "y", None: "n1"}
    literal = {r.url: r.id for r in upsert_news(old, new, null_wins=True).collect()}
    assert literal == {"u": "undated", "v": "y", None: "n2"}


def test_pages(spark, tmp_path):
    pages = [{"response": {"results": ITEMS}}, {"response": {"results": []}}, {"response": {}}, {"other": 1}]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(p) for p in pages))
    out = read_news_payloads(spark, str(tmp_path))
    assert normalize_articles(out).count() == 2


def test_window_search_and_pages(spark):
    news = sample(spark)
    assert [r.id for r in published_between(news, "2024-01-02").collect()] == ["a/2"]
    assert [r.id for r in published_between(news, None, "2024-01-01").collect()] == ["a/1"]
    assert published_between(news).count() == 2
    assert [r.id for r in matching(news, "gas OR coal").collect()] == ["a/2"]
    assert [r.id for r in newest_pages(news, 1, 1).collect()] == ["a/2"]
    assert [r.id for r in newest_page(news, 2, 1).collect()] == ["a/1"]
    assert newest_page(news, 3, 1).count() == 0


def test_landed_pages_hold_a_bounded_number_of_articles(spark, tmp_path, monkeypatch):
    """The number of pages grows with the documents."""
    from tapewire import catalog

    docs = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'src' AS source", "1L AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    paths, read = [], catalog.landed.read_news_payloads
    monkeypatch.setattr(catalog.landed, "read_news_payloads", lambda s, path: paths.append(path) or read(s, path))
    assert catalog.landed_pages_read(spark, str(tmp_path)).count() == 6000
    sizes = spark.read.json(paths[0]).selectExpr("size(response.results) AS n").collect()
    assert len(sizes) > 100 and max(r.n for r in sizes) <= 110
