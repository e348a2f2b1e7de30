"""Cursors and result pages, on the driver: they hold single pages, never whole results."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.model import PAGE, PAGE_MOST

CACHED_RESULTS = 64


class StaleCursor(ValueError):
    """The cursor belongs to another snapshot or to a result that is gone."""


def snapshot_id(run: str) -> bytes:
    return hashlib.blake2b(run.encode(), digest_size=6).digest()


def _pack(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _unpack(text: str, snapshot: bytes, form: str) -> tuple:
    try:
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        values = struct.unpack(form, raw[6:])
    except (ValueError, struct.error) as e:
        raise ValueError("not a cursor") from e
    if raw[:6] != snapshot:
        raise StaleCursor("the snapshot has changed")
    return values


def list_cursor(snapshot: bytes, last_id: int) -> str:
    return _pack(snapshot + struct.pack("<Q", last_id))


def read_list_cursor(text: str, snapshot: bytes) -> int:
    return _unpack(text, snapshot, "<Q")[0]


def usage_cursor(snapshot: bytes, ordinal: int, last_id: int) -> str:
    return _pack(snapshot + struct.pack("<BQ", ordinal, last_id))


def read_usage_cursor(text: str, snapshot: bytes) -> tuple[int, int]:
    return _unpack(text, snapshot, "<BQ")


def after(rows: DataFrame, last_id: int, limit: int = PAGE) -> DataFrame:
    """The next page in id order above a key."""
    return rows.where(F.col("id") > last_id).orderBy("id").limit(min(limit, PAGE_MOST))


def after_usage(rows: DataFrame, ordinal: int, last_id: int, limit: int = PAGE) -> DataFrame:
    """The next page in (ordinal, id) order above both keys."""
    beyond = (F.col("ordinal") > ordinal) | ((F.col("ordinal") == ordinal) & (F.col("id") > last_id))
    return rows.where(beyond).orderBy("ordinal", "id").limit(min(limit, PAGE_MOST))


def page_at(rows: DataFrame, order: list, offset: int, limit: int = PAGE) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(min(limit, PAGE_MOST))


@dataclass
class Page:
    items: list
    next: str | None


class TopCache:
    """The newest results of top-k searches, each of bounded length, for paging by offset."""

    def __init__(self, most: int = CACHED_RESULTS):
        self.most, self.items = most, OrderedDict()

    def put(self, snapshot: bytes, key: str, rows: list) -> bytes:
        cid = hashlib.blake2b(snapshot + key.encode(), digest_size=16).digest()
        self.items[cid] = (snapshot, rows)
        self.items.move_to_end(cid)
        while len(self.items) > self.most:
            self.items.popitem(last=False)
        return cid

    def page(self, snapshot: bytes, cid: bytes, offset: int, limit: int) -> Page:
        held = self.items.get(cid)
        if held is None or held[0] != snapshot:
            raise StaleCursor("the result is gone")
        self.items.move_to_end(cid)
        rows = held[1][offset : offset + limit]
        more = offset + limit < len(held[1])
        return Page(rows, _pack(snapshot + cid + struct.pack("<I", offset + limit)) if more else None)

    def follow(self, snapshot: bytes, cursor: str, limit: int) -> Page:
        *cid, offset = _unpack(cursor, snapshot, "<16sI")
        return self.page(snapshot, cid[0], offset, limit)


def drain(fetch: Callable[[Any], Page]) -> Iterator:
    """All items of a listing, page after page."""
    cursor = None
    while True:
        page = fetch(cursor)
        yield from page.items
        if page.next is None:
            return
        cursor = page.next
