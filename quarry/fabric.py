"""One request over several scopes: the index, the caller's own material, verticals and the web, as one answer; and code search.

Every scope's list is bounded by the request's limit before it comes to the driver; what finds it are the engine's pages and the web
ladder's joins.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.functions.text import decode_cursor, encode_cursor
from quarry.operators import federation, ladder
from quarry.schema import Filters, Viewer

# How many results and citations an answer has at most.
MOST_RESULTS, MOST_CITATIONS, MOST_CODE = 100, 20, 50
CLIP = {"title": 300, "url": 2048, "snippet": 600, "published_at": 40, "owner": 32, "type": 32, "id": 200}
DAY = 86_400_000


@dataclass
class Answer:
    results: list[dict]
    groups: dict[str, int]
    explain: list[dict]
    cursors: dict[str, str]
    citations: list[dict]


class Fabric:
    """Answers from an engine, verticals (scope -> filters, in order), and the web.

    web (requests, own index results) -> (results, explain, cache entries): the ladder over what providers have recorded
    (ladder.run with its tables), or none. open_owners: whose documents are the web's own index.
    """

    def __init__(self, engine: Engine, verticals: dict[str, list[Filters]] | None = None, web: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame]] | None = None, open_owners: tuple[str, ...] = ("sources",)):
        self.engine, self.verticals, self.web, self.open_owners = engine, verticals or {}, web, open_owners

    def _documents(self, rids: list[int], scope: str) -> list[dict]:
        """The results of a page, in its order; documents without a URL are none."""
        if not rids:
            return []
        rows = {r.rid: r for r in self.engine.docs.where(F.col("rid").isin(rids)).select("rid", "owner", "type", "id", "title", "summary", "canonical_url", "published_at").collect()}
        out = []
        for rid in rids:
            r = rows.get(rid)
            if r is not None and r.canonical_url:
                whole = {"title": r.title or r.canonical_url, "url": r.canonical_url, "snippet": r.summary or None, "published_at": r.published_at, "owner": r.owner, "type": r.type, "id": r.id}
                out.append({"scope": scope, "rid": rid} | {k: v[: CLIP[k]] if isinstance(v, str) else v for k, v in whole.items()})
        return out

    def _page(self, scope: str, page, limit: int) -> tuple[list[dict], dict, str | None]:
        found = self._documents([r["rid"] for r in page.rows], scope)[:limit]
        told = {"scope": scope, "step": "index", "ok": page.explain.get("ok", True), "count": len(found)} | {k: page.explain[k] for k in ("skipped", "ranking", "reason") if k in page.explain}
        return found, told, page.cursor

    def _vertical(self, scope: str, q: str, viewer: Viewer, limit: int, now: int) -> tuple[list[dict], dict, None]:
        if not self.verticals.get(scope):
            return [], {"scope": scope, "step": "index", "ok": False, "count": 0, "skipped": "not indexed yet"}, None
        out, seen = [], set()
        for filters in self.verticals[scope]:
            for r in self._documents([x["rid"] for x in self.engine.search(q, viewer, filters, limit, now=now).rows], scope):
                if r["rid"] not in seen and len(out) < limit:
                    seen.add(r["rid"])
                    out.append(r)
        return out, {"scope": scope, "step": "index", "ok": True, "count": len(out)}, None

    def _web(self, q: str, viewer: Viewer, limit: int, freshness: str, site: str | None, depth: str, now: int) -> tuple[list[dict], list[dict], None]:
        if self.web is None:
            return [], [{"scope": "web", "step": "exchange", "ok": False, "count": 0, "skipped": "web search is off"}], None
        spark = self.engine.docs.sparkSession
        own = []
        for owner in self.open_owners:
            own += self._documents([x["rid"] for x in self.engine.search(q, viewer, Filters(owner=owner), limit, now=now).rows], "web")
        mine = spark.createDataFrame([(0, i, r["url"], r["title"], r["published_at"]) for i, r in enumerate(own[:limit])], "req long, position long, url string, title string, published string")
        request = spark.createDataFrame([(0, q, limit, depth, freshness, site, viewer.subject is not None, 0)], "req long, q string, limit long, depth string, freshness string, site string, signed_in boolean, seq long")
        results, explain, _ = self.web(request, mine)
        found = [{"scope": "web", "title": r.title, "url": r.url, "published_at": r.published} for r in ladder.narrowed(results, request, now).orderBy("position").limit(limit).collect()]
        return found, [{"scope": "web"} | {k: r[k] for k in ("step", "ok", "count", "skipped", "cached", "cost_usd") if r[k] is not None} for r in explain.orderBy("at").collect()], None

    def query(self, q: str, scopes: tuple[str, ...] = ("network",), viewer: Viewer = Viewer(), filters: Filters = Filters(), limit: int = 20, freshness: str = "any", site: str | None = None, depth: str = "standard", cursor: str | None = None, now: int | None = None) -> Answer:
        """All scopes' results in the order of the request, those that are fresh, with what each scope and step did."""
        if not q.strip() or freshness not in ("any", *ladder.FRESH_DAYS) or depth not in ("quick", "standard", "deep"):
            raise ValueError("a request has a query, a freshness and a depth")
        now, limit = now if now is not None else self.engine.profile.clock(), self.engine.clamp(limit)
        results, explain, cursors = [], [], {}
        for scope in scopes:
            if scope == "network":
                found, told, more = self._page(scope, self.engine.search(q, viewer, filters, limit, cursor, now=now), limit)
            elif scope == "mine":
                found, told, more = self._page(scope, self.engine.mine(q, viewer, filters, limit, cursor, now), limit)
            elif scope == "web":
                found, told, more = self._web(q, viewer, limit, freshness, site, depth, now)
            else:
                found, told, more = self._vertical(scope, q, viewer, limit, now)
            results += found
            explain += told if isinstance(told, list) else [told]
            if more:
                cursors[scope] = more
        if freshness != "any":
            results = [r for r in results if _fresh(r["published_at"], now - ladder.FRESH_DAYS[freshness] * DAY)]
        if site:
            results = [r for r in results if r["scope"] != "web" or _on(r["url"], site)]
        results = results[:MOST_RESULTS]
        web = [r for r in results if r["scope"] == "web"][:MOST_CITATIONS]
        return Answer(results, {s: sum(r["scope"] == s for r in results) for s in scopes}, explain, cursors, [{"n": i + 1, "url": r["url"], "title": r["title"]} for i, r in enumerate(web)])


def _fresh(published: str | None, since: int) -> bool:
    """Undated results, and those whose date is none, stay."""
    from datetime import datetime, timezone

    try:
        at = datetime.fromisoformat((published or "").replace("Z", "+00:00"))
    except ValueError:
        return True
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000 >= since


def _on(url: str, site: str) -> bool:
    host, site = (urlsplit(url).hostname or "").lower(), site.lower().removeprefix("www.")
    return host == site or host.endswith("." + site)


def code_search(rows: DataFrame, q: str, lang: str | None = None, repo: str | None = None, licence: str | None = None, limit: int = 20, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """Sources' rows (see federation.merged_lines) -> (a page of merged, filtered and ranked files with the lines around matches, the next cursor)."""
    size = max(1, min(MOST_CODE, int(limit or 20)))
    h = hashlib.sha256(json.dumps([q, lang, repo, licence]).encode()).hexdigest()[:16]
    offset = decode_cursor(cursor, h)["o"] if cursor else 0
    merged = federation.code_filter(federation.merged_lines(rows), lang, repo, licence)
    matches = merged.withColumn("matches", F.transform(F.filter("lines", lambda x: F.coalesce(x["match"], F.lit(False))), lambda x: F.coalesce(x["text"], F.lit(""))))
    found = federation.code_rank(matches, q, size + 1, offset)
    more = found.count() > size  # at most size + 1 rows
    page = federation.lines_around(federation.code_rank(matches, q, size, offset)).drop("matches")
    return page, encode_cursor(h=h, o=offset + size) if more else None
