"""Fetchers of stories and posts from files that hold what the services answered, behind the same seam as live ones.

The first ``limit`` entries of a listing are taken in its order, items that are gone (null) are skipped, and a
read that fails is tried again a few times before the error is let through.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from murmurline.sources.plugin import SourceSpec

TRIES, WAIT_SECONDS, LONGEST_WAIT = 3, 0.5, 4.0
STORY_LIMIT = 100


def retried(read: Callable[[], object], tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> object:
    """What ``read`` returns, tried up to ``tries`` times with doubling pauses."""
    for attempt in range(tries):
        try:
            return read()
        except OSError:
            if attempt == tries - 1:
                raise
            wait(min(WAIT_SECONDS * 2**attempt, LONGEST_WAIT))
    return None


def _json(path: Path) -> object:
    return retried(lambda: json.loads(path.read_text(encoding="utf-8")))


def stories(part: int, options: dict) -> Iterator[dict | None]:
    """Stories of ``path``: ``topstories.json`` lists ids, ``item/<id>.json`` holds one item each, or null."""
    root, parts = Path(options["path"]), int(options.get("parts", 1))
    listed = _json(root / "topstories.json")[: int(options.get("limit", STORY_LIMIT))]
    for number in listed[part::parts]:
        item = _json(root / "item" / f"{number}.json")
        yield None if item is None else {"id": item.get("id"), "title": item.get("title"), "score": item.get("score"), "comments": item.get("descendants") or 0, "timestamp": item.get("time"), "url": item.get("url"), "author": item.get("by"), "type": item.get("type")}


def posts(part: int, options: dict) -> Iterator[dict | None]:
    """Posts of ``path``: ``<subreddit>.json`` is a listing; the limit is shared evenly, rounded up."""
    names = [n for n in str(options["subreddits"]).split(",") if n]
    each = math.ceil(int(options.get("limit", STORY_LIMIT)) / max(len(names), 1))
    for name in names[part :: int(options.get("parts", 1))]:
        for post in _json(Path(options["path"]) / f"{name}.json")[:each]:
            yield None if post is None else {"id": post.get("id"), "title": post.get("title"), "body": post.get("selftext"), "score": post.get("score"), "comments": post.get("num_comments"), "created_utc": post.get("created_utc"), "subreddit": name, "author": post.get("author")}


STORIES = SourceSpec("story_files", "hackernews", stories, required=("id", "title", "timestamp"), timestamp_field="timestamp")
POSTS = SourceSpec("post_files", "reddit", posts, required=("id", "title", "created_utc"), timestamp_field="created_utc", credentials=("client_id", "client_secret"))
