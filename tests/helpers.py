"""Small frames for the tests."""

from __future__ import annotations

from datetime import datetime

from adlytics.schemas import schema


def table(spark, name, rows):
    """A table of declared schema from partial row dictionaries."""
    wanted = schema(name)
    return spark.createDataFrame([tuple(row.get(f) for f in wanted.names) for row in rows], wanted)


def ts(text):
    return datetime.fromisoformat(text + "+00:00")


def rows_of(frame, *columns):
    chosen = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def bid(**fields):
    names = ("is_impression", "bid_net_usd", "bid_creative_id", "user_id", "id_source_graph", "is_user_id")
    return tuple(fields.get(n) for n in names)


def seat(**fields):
    names = ("seat_name", "is_bid_request_sent", "is_impression", "max_bid_net_usd", "experiment", "bid_request")
    return tuple(fields.get(n) for n in names)


def ad(ad_id, seats, is_impression=None):
    return (ad_id, is_impression, seats)


def request(request_id, ads, user=None, **fields):
    return {"ts": ts("2024-01-30T12:00:00"), "request_id": request_id, "site_user": (user,), "ad": ads, **fields}
