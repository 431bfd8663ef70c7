"""Stateless pagination."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
from collections.abc import Mapping

#: Fixed value: version of the cursor's form.
VERSION = 1


class BadCursor(ValueError):
    pass


def _pack(payload: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(payload, separators=(",", ":")).encode()).decode().rstrip("=")


def _opened(cursor: str) -> dict:
    try:
        payload = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except (binascii.Error, ValueError) as e:
        raise BadCursor("Invalid cursor") from e
    if not isinstance(payload, dict):
        raise BadCursor("Invalid cursor")
    return payload


def _unpack(cursor: str) -> dict:
    payload = _opened(cursor)
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if not whole(payload.get("offset")) or payload["offset"] < 0 or not whole(payload.get("limit")) or payload["limit"] < 1:
        raise BadCursor("Invalid cursor")
    return payload


def signature(query: str, filters: Mapping[str, str]) -> str:
    """Ties a cursor to its query and filters."""
    said = json.dumps({"query": query.strip(), "filters": sorted(filters.items())}, ensure_ascii=False, separators=(",", ":"))
    return base64.urlsafe_b64encode(hashlib.sha1(said.encode()).digest()).decode().rstrip("=")


def encode(offset: int, limit: int) -> str:
    return _pack({"offset": offset, "limit": limit})


def decode(cursor: str) -> tuple[int, int]:
    p = _unpack(cursor)
    return p["offset"], p["limit"]


def encode_search(offset: int, limit: int, query: str, filters: Mapping[str, str]) -> str:
    return _pack({"offset": offset, "limit": limit, "v": VERSION, "sig": signature(query, filters)})


def decode_search(cursor: str, query: str, filters: Mapping[str, str]) -> int:
    """The offset; the limit is the request's."""
    p = _unpack(cursor)
    if p.get("v") != VERSION or not isinstance(p.get("sig"), str):
        raise BadCursor("Invalid cursor")
    if p["sig"] != signature(query, filters):
        raise BadCursor("Cursor does not match the current query or filters")
    return p["offset"]


def encode_seek(score: float, chunk_id: str, version: str, query: str, filters: Mapping[str, str]) -> str:
    """A cursor that names the last hit shown, and the version of the index it was found in."""
    return _pack({"after": [score, chunk_id], "index": version, "v": VERSION, "sig": signature(query, filters)})


def decode_seek(cursor: str, query: str, filters: Mapping[str, str]) -> tuple[float, str, str]:
    """Score and id of the last hit shown, and the index's version."""
    p = _opened(cursor)
    after = p.get("after")
    if p.get("v") != VERSION or not isinstance(p.get("index"), str) or not isinstance(after, list) or len(after) != 2 or not isinstance(after[0], (int, float)) or isinstance(after[0], bool) or not isinstance(after[1], str):
        raise BadCursor("Invalid cursor")
    if p.get("sig") != signature(query, filters):
        raise BadCursor("Cursor does not match the current query or filters")
    return float(after[0]), after[1], p["index"]
