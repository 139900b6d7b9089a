"""Relating news to market prices on Spark."""

from tapewire.operators.align import asof_join, forward_prices
from tapewire.operators.bars import ohlcv_bars
from tapewire.operators.news import normalize_articles
from tapewire.operators.prices import normalize_prices, price_series
from tapewire.operators.upsert import upsert_news, upsert_prices
from tapewire.plans.build_dataset import build_dataset, prepare_news, training_set
from tapewire.plans.news_ingest import ingest_news
from tapewire.plans.price_ingest import ingest_prices
from tapewire.plans.train_baseline import train_baseline
from tapewire.session import configure

__version__ = "0.1.0"

__all__ = [
    "asof_join",
    "build_dataset",
    "configure",
    "forward_prices",
    "ingest_news",
    "ingest_prices",
    "normalize_articles",
    "normalize_prices",
    "ohlcv_bars",
    "prepare_news",
    "price_series",
    "train_baseline",
    "training_set",
    "upsert_news",
    "upsert_prices",
]
