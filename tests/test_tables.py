import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from test_news import ITEMS, sample as sample_news
from test_prices import sample as sample_prices

from tapewire.operators.guards import guarded
from tapewire.operators.prices import normalize_prices
from tapewire.operators.upsert import upsert_prices
from tapewire.plans.build_dataset import build_dataset, training_set
from tapewire.plans.news_ingest import ingest_news
from tapewire.plans.price_ingest import ingest_prices, landed_prices
from tapewire.sources import commits
from tapewire.sources.landed import price_download_groups
from tapewire.sources.tables import (
    read_news_table,
    read_price_table,
    read_training_set,
    save_news,
    save_prices,
)
from tapewire.streaming.upserts import stream_news, stream_prices

PRICE_ROW = "date timestamp, adj_close double, close double, ticker string, row_seq bigint"


def prices(spark, rows):
    return spark.createDataFrame(rows, PRICE_ROW)


def test_price_upsert_last_wins(spark):
    first = normalize_prices(sample_prices(spark), "SPY")
    bumped = first.withColumn("close", F.when(F.dayofmonth("date") == 1, F.col("close") + 1).otherwise(F.col("close")))
    rows = upsert_prices(first, bumped).orderBy("date").collect()
    assert len(rows) == 3 and rows[0].close == 72.5


def test_price_upsert_unusable_arrival(spark):
    day = dt.datetime(2024, 1, 1)
    old, new = prices(spark, [(day, 1.0, 1.0, "A", 1)]), prices(spark, [(day, None, 1.0, "A", 1)])
    assert upsert_prices(old, new).count() == 0


def test_save_prices_merges_and_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "prices")
    first = normalize_prices(sample_prices(spark), "^VIX")
    other = normalize_prices(sample_prices(spark), "CL=F")
    save_prices(path, first.unionByName(other))
    untouched = sorted(os.listdir(f"{path}/ticker_path=CL_F"))
    changed = first.withColumn("close", F.col("close") + 1)
    for _ in range(2):
        save_prices(path, changed)
        rows = read_price_table(spark, path).where("ticker = '^VIX'").orderBy("date").collect()
        assert [r.close for r in rows] == [72.5, 70.0, 75.25]
    assert read_price_table(spark, path).count() == 6
    assert sorted(os.listdir(f"{path}/ticker_path=CL_F")) == untouched
    some = read_price_table(spark, path, ["CL=F"])
    assert [r.ticker for r in some.select("ticker").distinct().collect()] == ["CL=F"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "CL_F" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_price_table_by_year(spark, tmp_path):
    path = str(tmp_path / "prices")
    rows = [(dt.datetime(y, 1, 1), 1.0, 1.0, "A", 1) for y in (2023, 2024)]
    save_prices(path, prices(spark, rows), by_year=True)
    untouched = sorted(os.listdir(f"{path}/ticker_path=A/year=2023"))
    save_prices(path, prices(spark, [(dt.datetime(2024, 1, 1), 2.0, 2.0, "A", 1)]))
    got = {r.date.year: r.close for r in read_price_table(spark, path).collect()}
    assert got == {2023: 1.0, 2024: 2.0}
    assert sorted(os.listdir(f"{path}/ticker_path=A/year=2023")) == untouched


def test_numeric_looking_tickers(spark, tmp_path):
    path = str(tmp_path / "prices")
    for value in (1.0, 2.0):
        save_prices(path, prices(spark, [(dt.datetime(2024, 1, 1), value, value, "0700", 1)]))
    rows = read_price_table(spark, path).collect()
    assert [(r.ticker, r.close) for r in rows] == [("0700", 2.0)]


def test_refusals(spark, tmp_path):
    path = str(tmp_path / "prices")
    day = dt.datetime(2024, 1, 1)
    with pytest.raises(ValueError, match="adjusted close"):
        save_prices(path, prices(spark, [(day, None, 1.0, "A", 1)]))
    save_prices(path, prices(spark, [(day, 1.0, 1.0, "CL=F", 1)]))
    with pytest.raises(ValueError, match="share the path"):
        save_prices(path, prices(spark, [(day, 1.0, 1.0, "CL/F", 1)]))
    assert [r.ticker for r in read_price_table(spark, path).collect()] == ["CL=F"]


def test_unreadable_history_is_not_discarded(spark, tmp_path):
    bad = tmp_path / "prices"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        save_prices(str(bad), prices(spark, [(dt.datetime(2024, 1, 1), 1.0, 1.0, "A", 1)]))
    assert (bad / "part-0.parquet").read_bytes() == b"no parquet"


def test_save_news_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "news")
    assert save_news(path, sample_news(spark, []).limit(0)) is False
    for _ in range(2):
        assert save_news(path, sample_news(spark), buckets=8)
        assert read_news_table(spark, path).count() == 2
    newer = sample_news(spark, [{**ITEMS[0], "webPublicationDate": "2024-01-03T00:00:00Z"}])
    # a table keeps the number of buckets it began with
    save_news(path, newer, buckets=4)
    rows = {r.url: str(r.published_at) for r in read_news_table(spark, path).collect()}
    assert len(rows) == 2 and rows[ITEMS[0]["webUrl"]] == "2024-01-03 00:00:00"


def test_news_ingest(spark, tmp_path):
    landed, out = tmp_path / "landed", str(tmp_path / "news")
    landed.mkdir()
    for i, results in enumerate((ITEMS, [])):
        (landed / f"page{i}.json").write_text(json.dumps({"response": {"results": results}}))
    for _ in range(2):
        assert ingest_news(spark, str(landed), out, "energy OR gas OR oil", "2024-01-01", "2024-01-31", 2)
        assert read_news_table(spark, out).count() == 2
    assert ingest_news(spark, str(landed), out, "nothing") is False


CSV = "Date,Open,High,Low,Close,Adj Close,Volume\n2024-03-04,71,72,69,71.5,70.5,41\n2024-03-05,70,71,68,69,{},53\n"


def test_price_ingest(spark, tmp_path):
    landed, out = tmp_path / "landed", str(tmp_path / "prices")
    landed.mkdir()
    (landed / "prices_SPY.csv").write_text(CSV.format("68"))
    (landed / "^VIX.csv").write_text(CSV.format("None"))
    report, absent = ingest_prices(spark, str(landed), out, "SPY, ^VIX,CL=F")
    assert absent == ["CL=F"]
    assert {r.ticker: r.rows for r in report.collect()} == {"SPY": 2, "^VIX": 1}
    assert read_price_table(spark, out).count() == 3
    (landed / "other.csv").write_text("adj close,Datetime\n12.5,2024-03-06\n")
    (landed / "^VIX%3D.csv").write_text("Date,Adj Close\n2024-03-06,9\n")
    # each header is read by itself
    report, absent = ingest_prices(spark, str(landed), out, "SPY,other,none")
    assert absent == ["none"] and {r.ticker: r.rows for r in report.collect()} == {"SPY": 2, "other": 1}
    assert read_price_table(spark, out, ["other"]).first().adj_close == 12.5
    with pytest.raises(ValueError):
        landed_prices(sample_prices(spark), interval="5m")


def test_build_dataset(spark, tmp_path):
    news, table, out = (str(tmp_path / n) for n in ("news", "prices", "train"))
    causal = {**ITEMS[0], "fields": {"headline": "Prices fell because of X"}}
    save_news(news, sample_news(spark, [causal, ITEMS[1]]), buckets=2)
    save_prices(table, normalize_prices(sample_prices(spark), "SPY"))
    seen = build_dataset(spark, news, table, out, (1, 3), ordered=True)
    assert seen == {"rows": 1, "causal": 1, "correlational": 0, "with_price": 1}
    df = read_training_set(spark, out)
    assert df.columns == [
        "text", "label", "published_at", "url", "section",
        "spy_t0", "spy_t1", "delta_1d", "spy_t3", "delta_3d",
    ]
    row = df.first()
    assert (row.label, row.spy_t0, row.spy_t1, row.spy_t3) == ("causal", 70.5, 68.0, None)
    assert row.delta_1d == -2.5 and row.delta_3d is None

    with pytest.raises(RuntimeError, match="no article has both"):
        build_dataset(spark, news, table, out, causal=[], correlational=[])
    assert read_training_set(spark, out).count() == 1
    with pytest.raises(RuntimeError, match="no usable row"):
        training_set(sample_news(spark), normalize_prices(sample_prices(spark), "SPY").where("false"))
    two = normalize_prices(sample_prices(spark), "A").unionByName(normalize_prices(sample_prices(spark), "B"))
    with pytest.raises(ValueError, match="2 tickers"):
        training_set(sample_news(spark), two)
    assert training_set(sample_news(spark, [causal]), two, ticker="B").first().spy_t0 == 70.5


def test_streams_repeat_safely(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "prices")
    batch = normalize_prices(sample_prices(spark), "SPY").withColumn("row_seq", F.lit(1).cast("long"))
    batch.write.parquet(source)

    def run(progress):
        stream = spark.readStream.schema(batch.schema).parquet(source)
        stream_prices(stream, table, str(tmp_path / progress)).awaitTermination()
        return read_price_table(spark, table)

    assert run("a").count() == 3
    batch.withColumn("close", F.lit(9.0)).where(F.dayofmonth("date") == 1).write.mode("append").parquet(source)
    got = {r.date.day: r.close for r in run("a").collect()}
    assert got[1] == 9.0 and len(got) == 3
    # a new progress log replays every file as one batch
    assert run("b").count() == 3

    news_in, news = str(tmp_path / "news_in"), str(tmp_path / "news")
    sample_news(spark).write.parquet(news_in)
    for progress in ("c", "d"):
        stream = spark.readStream.schema(sample_news(spark).schema).parquet(news_in)
        stream_news(stream, news, str(tmp_path / progress)).awaitTermination()
        assert read_news_table(spark, news).count() == 2


def test_upsert_shrinks_keys_before_the_shuffle(spark):
    first = normalize_prices(sample_prices(spark), "SPY")
    plan = upsert_prices(first, first)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_numbered_tickers_keep_their_history(spark, tmp_path):
    path = str(tmp_path / "prices")
    for day in (1, 2):
        save_prices(path, prices(spark, [(dt.datetime(2024, 1, day), 1.0 * day, 1.0, t, 1) for t in ("000001", "1")]))
    assert read_price_table(spark, path).count() == 4
    assert [r.adj_close for r in read_price_table(spark, path, ["000001"]).orderBy("date").collect()] == [1.0, 2.0]


def test_prices_without_a_ticker_are_refused(spark, tmp_path):
    path = str(tmp_path / "prices")
    save_prices(path, prices(spark, [(dt.datetime(2024, 1, 1), 1.0, 1.0, "A", 1)]))
    with pytest.raises(ValueError, match="without a ticker"):
        save_prices(path, prices(spark, [(dt.datetime(2024, 1, 2), 1.0, 1.0, t, 1) for t in ("A", None)]))
    assert read_price_table(spark, path).count() == 1


def test_partition_that_loses_its_last_row_goes(spark, tmp_path):
    path = str(tmp_path / "prices")
    rows = [(dt.datetime(y, 1, 1), 1.0, 1.0, "A", 1) for y in (2023, 2024)]
    save_prices(path, prices(spark, rows), by_year=True)
    save_prices(path, prices(spark, [(dt.datetime(2023, 1, 1), None, 2.0, "A", 1), (dt.datetime(2024, 1, 2), 1.0, 1.0, "A", 1)]))
    assert sorted(r.date.isoformat()[:10] for r in read_price_table(spark, path).collect()) == ["2024-01-01", "2024-01-02"]
    assert os.listdir(tmp_path) == ["prices"]


def test_failed_save_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "prices")
    save_prices(path, prices(spark, [(dt.datetime(2024, 1, 1), 1.0, 1.0, "A", 1)]))
    before = sorted(os.listdir(f"{path}/ticker_path=A"))
    bad = prices(spark, [(dt.datetime(2024, 1, 2), 1.0, 1.0, "A", 1)]).withColumn("adj_close", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        save_prices(path, bad)
    assert sorted(os.listdir(f"{path}/ticker_path=A")) == before and os.listdir(tmp_path) == ["prices"]


def test_tickers_that_share_a_path_do_not_stop_the_others(spark, tmp_path):
    path = str(tmp_path / "prices")
    day = dt.datetime(2024, 1, 1)
    verdicts = save_prices(path, prices(spark, [(day, 1.0, 1.0, t, 1) for t in ("CL=F", "CL/F", "SPY")]), skip_shared=True)
    assert [(v.ticker, bool(v.why)) for v in verdicts] == [("CL/F", True), ("CL=F", True), ("SPY", False)]
    assert [r.ticker for r in read_price_table(spark, path).collect()] == ["SPY"]


def test_every_ticker_of_a_shared_path_is_reported(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = prices(spark, [(day, 1.0, 1.0, t, 1) for t in ("A/B", "A=B", "A_B", "SPY")])
    assert [v.ticker for v in save_prices(str(tmp_path / "prices"), rows, skip_shared=True) if v.why] == ["A/B", "A=B", "A_B"]


def test_weekly_ingest(spark, tmp_path):
    landed, out = tmp_path / "landed", str(tmp_path / "prices")
    landed.mkdir()
    (landed / "SPY.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-03-04,71,72,69,71.5,70.5,41\n2024-03-08,70,75,68,69,68,53\n2024-03-11,1,2,1,2,2,7\n")
    ingest_prices(spark, str(landed), out, "SPY", interval="1wk")
    got = [(str(r.date)[:10], r.open, r.high, r.low, r.close, r.volume) for r in read_price_table(spark, out).orderBy("date").collect()]
    assert got == [("2024-03-04", 71.0, 75.0, 68.0, 69.0, 94.0), ("2024-03-11", 1.0, 2.0, 1.0, 2.0, 7.0)]


def test_unreadable_pages_are_refused(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    page = json.dumps({"response": {"results": ITEMS}})
    (landed / "a.json").write_text(page)
    (landed / "b.json").write_text(page[: len(page) // 2])
    with pytest.raises(Exception, match=r"cannot be read as JSON, in .*b\.json"):
        ingest_news(spark, str(landed), str(tmp_path / "news"), None)
    assert os.listdir(tmp_path) == ["landed"]
    (landed / "b.json").write_text(json.dumps({"response": {"results": ITEMS[:1]}}, indent=2))
    with pytest.raises(Exception, match="cannot be read"):
        ingest_news(spark, str(landed), str(tmp_path / "news"), None)
    assert ingest_news(spark, str(landed), str(tmp_path / "news"), None, multi_line=True, buckets=4)
    assert read_news_table(spark, str(tmp_path / "news")).count() == 2


def test_prices_without_a_ticker_column(spark):
    plain = normalize_prices(sample_prices(spark), "SPY").drop("ticker")
    causal = {**ITEMS[0], "fields": {"headline": "Prices fell because of X"}}
    assert training_set(sample_news(spark, [causal]), plain, ticker="SPY").first().spy_t0 == 70.5


def test_shared_folder(spark, tmp_path, monkeypatch):
    from tapewire import session

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d=None: None)})})())
    monkeypatch.setattr(session, "shared_dir", lambda s: str(tmp_path / "shared"))
    stored = session.store(spark.range(3))
    assert stored.rows.count() == 3 and len(os.listdir(tmp_path / "shared")) == 1
    stored.drop()
    assert os.listdir(tmp_path / "shared") == []


def days(spark, rows):
    """(ticker, day, price) as normalised prices, in this order of arrival."""
    return prices(spark, [(dt.datetime(2024, 1, d), p, p, t, n) for n, (t, d, p) in enumerate(rows)])


def stored(spark, path):
    return sorted((r.ticker, r.date.day, r.adj_close) for r in read_price_table(spark, path).collect())


def test_refused_ticker_keeps_its_history(spark, tmp_path):
    path = str(tmp_path / "prices")
    save_prices(path, days(spark, [("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 3.0)]))
    files = sorted(os.listdir(f"{path}/ticker_path=A"))
    verdicts = save_prices(path, days(spark, [("A", 1, None), ("A", 2, float("nan")), ("B", 2, 4.0), ("C", 1, None)]))
    assert [(v.ticker, v.rows, v.usable_rows, v.why is None) for v in verdicts] == [("A", 2, 0, False), ("B", 1, 1, True), ("C", 1, 0, False)]
    assert stored(spark, path) == [("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 3.0), ("B", 2, 4.0)]
    assert sorted(os.listdir(f"{path}/ticker_path=A")) == files and not os.path.exists(f"{path}/ticker_path=C")
    # with another usable row of its own, an arrival without a price replaces the earlier one
    save_prices(path, days(spark, [("A", 1, None), ("A", 3, 5.0)]))
    assert stored(spark, path)[:2] == [("A", 2, 2.0), ("A", 3, 5.0)]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_streams_do_not_hang_on_the_cut(spark, tmp_path, batches):
    rows = [("A", 1, None), ("B", 1, 1.0), ("A", 2, 2.5), ("A", 3, None), ("B", 1, None), ("C", 1, None), ("B", 2, 4.0), ("A", 2, 2.75), ("B", 2, None), ("A", 3, 9.0)]
    path, source = str(tmp_path / "prices"), str(tmp_path / "in")
    save_prices(path, days(spark, [("A", 1, 1.0), ("A", 3, 3.0)]))
    size = len(rows) // batches
    for k in range(batches):
        part = days(spark, rows[k * size : (k + 1) * size]).coalesce(1).withColumn("row_seq", F.col("row_seq") + k * size)
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        stream_prices(stream, path, str(tmp_path / "progress")).awaitTermination()
    assert stored(spark, path) == [("A", 1, 1.0), ("A", 2, 2.75), ("A", 3, 9.0), ("B", 1, 1.0), ("B", 2, 4.0)]


def test_replayed_batch_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "prices")
    save_prices(path, days(spark, [("A", 1, 1.0)]), batch=("s", 0))
    save_prices(path, days(spark, [("A", 1, 2.0)]), batch=("s", 1))
    lists = os.listdir(f"{path}/_lists")
    assert save_prices(path, days(spark, [("A", 1, 1.0)]), batch=("s", 0)) == []
    assert stored(spark, path) == [("A", 1, 2.0)] and os.listdir(f"{path}/_lists") == lists
    assert save_prices(path, days(spark, [("A", 1, 3.0)]), batch=("other", 0)) != []
    news = str(tmp_path / "news")
    assert save_news(news, sample_news(spark), buckets=2, batch=("s", 4)) and not save_news(news, sample_news(spark), batch=("s", 4))


def test_readers_see_the_table_before_or_after(spark, tmp_path, monkeypatch):
    """The table is read at every step of a merge into several partitions: between the moves, and before and after the new list."""
    path = str(tmp_path / "prices")
    old = [("A", 1, 1.0), ("B", 1, 1.0), ("C", 1, 1.0)]
    save_prices(path, days(spark, old))
    seen, real = [], commits.Disk.move

    def watched(disk, source, target):
        seen.append(stored(spark, path))
        real(disk, source, target)
        seen.append(stored(spark, path))

    monkeypatch.setattr(commits.Disk, "move", watched)
    begun = read_price_table(spark, path)
    new = [(t, 1, 2.0) for t in "ABC"]
    save_prices(path, days(spark, new))
    assert len(seen) == 8 and seen[:-1] == [old] * 7 and seen[-1] == new
    # a reader that had begun goes on with what it saw
    assert sorted((r.ticker, r.adj_close) for r in begun.collect()) == [(t, 1.0) for t in "ABC"]


def test_failing_move_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "prices")
    save_prices(path, days(spark, [("A", 1, 1.0), ("B", 1, 1.0)]))
    real, moves = commits.Disk.move, []

    def failing(disk, source, target):
        moves.append(target)
        if len(moves) == 2:
            raise OSError("lost")
        real(disk, source, target)

    monkeypatch.setattr(commits.Disk, "move", failing)
    with pytest.raises(OSError, match="lost"):
        save_prices(path, days(spark, [("A", 1, 2.0), ("B", 1, 2.0)]))
    assert stored(spark, path) == [("A", 1, 1.0), ("B", 1, 1.0)] and os.listdir(tmp_path) == ["prices"]
    monkeypatch.setattr(commits.Disk, "move", real)
    save_prices(path, days(spark, [("A", 1, 3.0)]))
    assert stored(spark, path) == [("A", 1, 3.0), ("B", 1, 1.0)]


def test_second_writer_fails(spark, tmp_path):
    path = str(tmp_path / "prices")
    save_prices(path, days(spark, [("A", 1, 1.0)]))
    disk = commits.Disk(spark, path)
    before = commits.newest(disk)
    save_prices(path, days(spark, [("A", 1, 2.0)]))
    with pytest.raises(OSError):
        commits.commit(disk, before, before)
    assert stored(spark, path) == [("A", 1, 2.0)]


def test_files_of_old_lists_go(spark, tmp_path):
    path = str(tmp_path / "prices")
    for n in range(5):
        save_prices(path, days(spark, [("A", 1, float(n))]))
    assert len(os.listdir(f"{path}/_lists")) == 2 * 2  # each with its checksum
    assert len([f for f in os.listdir(f"{path}/ticker_path=A") if f.endswith(".parquet")]) == 2
    assert stored(spark, path) == [("A", 1, 4.0)]


def test_tables_without_a_list_are_taken_over(spark, tmp_path):
    """As earlier versions and other tools write them."""
    path = str(tmp_path / "prices")
    plain = normalize_prices(sample_prices(spark), "CL=F")
    plain.withColumn("ticker_path", F.lit("CL_F")).write.partitionBy("ticker_path").parquet(path)
    assert read_price_table(spark, path).count() == 3
    with pytest.raises(ValueError, match="share the path"):
        save_prices(path, days(spark, [("CL/F", 1, 1.0)]))
    save_prices(path, days(spark, [("CL=F", 1, 9.0), ("B", 1, 1.0)]))
    assert read_price_table(spark, path).count() == 4


def test_files_are_read_once_and_by_their_header(spark, tmp_path):
    """Blank lines, quotes, spaces in a header, a byte order mark, files without rows, and a later change of the files."""
    landed = tmp_path / "landed"
    landed.mkdir()
    (landed / "prices_SPY.csv").write_text("\n\nDate,Adj Close,Note\n2024-03-04,70.5,\"a, b\"\n\n2024-03-05,68,\n")
    (landed / "^VIX.csv").write_text("\ufeffDate , Adj Close,Note\n2024-03-04,9,x\n")
    (landed / "QQQ.csv").write_text("Date,Adj Close,Note\n")
    (landed / "empty.csv").write_text("")
    (landed / "own.csv").write_text("TICKER,adj close,Date\nOWN,1,2024-03-04\nOWN,2\n")
    found = price_download_groups(spark, str(landed))
    groups = found.groups
    assert sorted(tuple(g.columns) for g in groups) == [("Date", "Adj Close", "Note", "ticker", "row_seq"), ("Date", "Adj Close", "Note", "ticker", "row_seq"), ("TICKER", "adj close", "Date", "row_seq")]
    for f in landed.iterdir():
        f.write_text("gone")
    got = sorted(((r.ticker, r["Adj Close"], r["Note"]) for g in groups if "Note" in g.columns for r in g.collect()), key=str)
    assert got == [("SPY", "68", None), ("SPY", "70.5", "a, b"), ("^VIX", "9", "x")]
    own = next(g for g in groups if "Note" not in g.columns)
    assert sorted((r["adj close"], r["Date"] or "") for r in own.collect()) == [("1", "2024-03-04"), ("2", "")]
    assert own.select("row_seq").distinct().count() == 2
    found.drop()


def test_guards_let_faults_through(spark):
    def fault():
        raise KeyError("x")

    with pytest.raises(KeyError):
        guarded(spark, {"a": fault})
    assert guarded(spark, {"a": lambda: spark.range(3)}).collect()[0][:3] == ("a", "used", 3)
