"""The search entry point: a query text, filters, a viewer and a cursor -> a page, the next cursor and why it is ranked so."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import decode_cursor, encode_cursor, parse_query, relaxed
from quarry.operators import ann, index, search, vector
from quarry.operators.visibility import can_view, visible
from quarry.schema import FACET_KEY, ID, LISTED, OWNER, TYPE, Filters, Match, Profile, Sites, Viewer

MOST_SUGGEST_CHARS = 100
MOST_CHARS, MOST_FACETS, CANDIDATES, RELAX_BELOW, NEAR = 500, 5, 100, 5, 0.30


@dataclass
class Page:
    """rows: at most `limit`, in order, with their rank keys (and position, keyword_rank, vector_rank of a hybrid page)."""

    rows: list
    cursor: str | None
    explain: dict
    match: Match | None
    facets: DataFrame | None = None
    keys: tuple = field(default=("rank", "importance", "recency", "rid"))


class Engine:
    """Searches documents (with exposure), through a stored index where there is one (its folder), and vectors where there are some.

    embeddings: (rid, embedding) of one model; a query's own vector comes with the query. vectors: the folder of a stored index
    of the same (ann.py), which then answers in their place: the lists it probes are read instead of all vectors.
    """

    def __init__(self, docs: DataFrame, index_path: str | None = None, embeddings: DataFrame | None = None, sites: Sites | None = None, profile: Profile = Profile(), most: int = 50, dim: int | None = None, vectors: str | None = None):
        self.docs, self.sites, self.profile, self.most, self.embeddings, self.dim = docs, sites, profile, most, embeddings, dim
        self.index = index.Stored.open(docs.sparkSession, index_path) if index_path else None
        self.vectors = ann.VectorIndex.open(docs.sparkSession, vectors) if vectors else None

    def clamp(self, limit: int | None) -> int:
        return min(max(int(limit or 20), 1), self.most)

    def weights(self, match: Match) -> dict[str, float] | None:
        """The weights of a relaxed query's words."""
        if not match.any:
            return None
        return index.weights_of(self.index.postings, match) if self.index else search.weights_of(self.docs, match)

    def result_set(self, match: Match, viewer: Viewer = Viewer(), filters: Filters = Filters(), now: int | None = None) -> DataFrame:
        """The whole ranked set of a parsed query, at a clock."""
        profile = replace(self.profile, now=now if now is not None else self.profile.clock())
        if self.index:
            return index.search_set(self.index.postings, self.index.records, match, viewer, self.weights(match), profile, self.sites, filters)
        return search.search_set(search.narrowed(self.docs, filters), match, viewer, self.weights(match), profile, self.sites)

    def best(self, limit: int, match: Match, viewer: Viewer, filters: Filters, now: int, key: tuple | None = None) -> list:
        """The first rows of the ranked set, behind a key: from the stored index, only blocks are read that can hold one."""
        if self.index:
            return self.index.top(limit, match, viewer, filters, key, self.weights(match), replace(self.profile, now=now), self.sites)[0]
        return search.page(self.result_set(match, viewer, filters, now), limit, key).select(*search.ORDER).collect()

    def hybrid_set(self, match: Match, vector_: list[float], viewer: Viewer, filters: Filters, now: int | None = None) -> DataFrame:
        """Keyword and vector candidates fused, re-ranked by tiers and deduplicated: (rid, position, keyword_rank, vector_rank)."""
        now = now if now is not None else self.profile.clock()
        found = self.best(CANDIDATES, match, viewer, filters, now)  # at most 100 rows
        keyword = self.docs.sparkSession.createDataFrame([(r["rid"], i + 1) for i, r in enumerate(found)], "rid long, position int")
        listed = search.narrowed(self.docs.where(F.col("exposure") == LISTED), filters)
        if self.vectors:
            near = self.vectors.search(vector_, CANDIDATES, NEAR, allowed=listed)
        else:
            near = vector.knn(self.embeddings.join(listed.select("rid"), "rid", "left_semi"), vector_, CANDIDATES, NEAR, "rid")
        fused = vector.rrf(keyword, vector.ranked(near, F.asc("distance"), F.asc("rid")))
        held = fused.collect()  # at most 200 rows
        fused, rids = self.docs.sparkSession.createDataFrame(held, fused.schema), F.col("rid").isin([r.rid for r in held])
        loose = Match(match.words, match.prefix, match.field, True, match.question)
        if self.index:
            docs = self.index.records.where(rids)
            counts = index.counted(self.index.postings.where(rids), docs, match, viewer)
        else:
            docs = visible(self.docs, viewer).where(rids)
            counts = search.counted(docs, match)
        every = search.rank_parts(counts, loose, self.weights(match), replace(self.profile, now=now), self.sites)
        return vector.reranked(fused.join(docs.select("rid", "owner", "title", "summary", "type"), "rid"), every.select("rid", "tier", "title_words", "cover"), match)

    def state(self, text: str, vector_: list[float] | None) -> dict:
        """Whether this query is ranked by both lists, or why by words alone."""
        if self.embeddings is None and self.vectors is None:
            return {"ranking": "keyword", "reason": "no_vectors"}
        if len(text.strip()) < 2:
            return {"ranking": "keyword", "reason": "short_query"}
        if vector_ is None or (self.dim and len(vector_) != self.dim):
            return {"ranking": "keyword", "reason": "ai_unavailable"}
        return {"ranking": "hybrid"}

    def search(self, text: str, viewer: Viewer = Viewer(), filters: Filters = Filters(), limit: int | None = None, cursor: str | None = None, facet_keys: tuple[str, ...] = (), vector_: list[float] | None = None, now: int | None = None) -> Page:
        """A page at a clock (ms; the profile's, unless given); later pages keep the first one's, which their cursors hold. Several words that find fewer than RELAX_BELOW are answered with any of their content words, if that finds more."""
        import re

        if len(text) > MOST_CHARS:
            raise ValueError("the query is too long")
        if len(facet_keys) > MOST_FACETS or not all(re.fullmatch(FACET_KEY, k) for k in facet_keys):
            raise ValueError("at most 5 well-formed facet keys")
        limit, explain = self.clamp(limit), self.state(text, vector_)
        exact = parse_query(text)
        if text.strip() and not exact.words:
            return Page([], None, {"ranking": "keyword", "reason": "short_query"}, None)
        if not exact.words:
            return self.browse(viewer, filters, limit, cursor)
        loose = relaxed(exact) if len(exact.words) > 1 else None
        told = self._peek(cursor) if cursor else {}
        now = told["n"] if isinstance(told.get("n"), int) else now if now is not None else self.profile.clock()
        match = loose if told.get("x") and loose else exact
        page = self._page(match, viewer, filters, limit, cursor, explain, vector_, now)
        if not cursor and loose and len(page.rows) < RELAX_BELOW:
            other = self._page(loose, viewer, filters, limit, None, explain, vector_, now)
            page = other if len(other.rows) > len(page.rows) else page
        if facet_keys:
            page.facets = search.facet_counts(self.result_set(page.match, viewer, filters, now), list(facet_keys))
        return page

    def mine(self, text: str, viewer: Viewer, filters: Filters = Filters(), limit: int | None = None, cursor: str | None = None, now: int | None = None) -> Page:
        """What of a signed-in search's page is not public: the caller's own material; public hits are another scope's."""
        if viewer.subject is None:
            return Page([], None, {"scope": "mine", "ok": False, "skipped": "needs a signed-in person"}, None)
        page = self.search(text, viewer, filters, limit, cursor, now=now)
        public = {r.rid for r in self.docs.where(F.col("rid").isin([r["rid"] for r in page.rows]) & (F.col("visibility") == "public")).select("rid").collect()} if page.rows else set()
        page.rows = [r for r in page.rows if r["rid"] not in public]
        return page

    def suggest(self, text: str, viewer: Viewer = Viewer(), filters: Filters = Filters(), limit: int | None = None, now: int | None = None) -> Page:
        """Documents whose titles hold the words, the last one begun: at most 20 (8, unless given), of the first 6 words."""
        if len(text) > MOST_SUGGEST_CHARS:
            raise ValueError("the query is too long")
        match = replace(parse_query(text, 6, search.TITLE), prefix=True)
        if not match.words:
            return Page([], None, {"ranking": "keyword"}, None)
        most = min(max(int(limit or 8), 1), 20)
        return Page(self.best(most, match, viewer, filters, now if now is not None else self.profile.clock()), None, {"ranking": "keyword"}, match)

    def get(self, owner: str, type_: str, id_: str, viewer: Viewer = Viewer()) -> DataFrame:
        """The document of an identity, if the viewer may see it: one row or none."""
        import re

        if not (re.fullmatch(OWNER, owner) and re.fullmatch(TYPE, type_) and re.fullmatch(ID, id_)):
            raise ValueError("owner, type or id is malformed")
        one = self.docs.where((F.col("owner") == owner) & (F.col("type") == type_) & (F.col("id") == id_) & ~F.col("deleted"))
        return search.projected(one.where(can_view(viewer, one)))

    def browse(self, viewer: Viewer = Viewer(), filters: Filters = Filters(), limit: int | None = None, cursor: str | None = None) -> Page:
        """Newest first, without words."""
        limit, h = self.clamp(limit), self._hash(None, filters)
        at = decode_cursor(cursor, h) if cursor else None
        rows = search.browse(search.narrowed(self.docs, filters), viewer, limit + 1, (at["t"], at["i"]) if at else None).select("rid", "sort_at").collect()
        last = rows[limit - 1] if len(rows) > limit else None
        return Page(rows[:limit], encode_cursor(h=h, k="t", t=last.sort_at, i=last.rid) if last else None, {"ranking": "newest"}, None)

    @staticmethod
    def _peek(cursor: str) -> dict:
        import base64

        try:
            return json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        except ValueError as e:
            raise ValueError("malformed cursor") from e

    @staticmethod
    def _hash(match: Match | None, filters: Filters) -> str:
        return hashlib.sha256(json.dumps([asdict(match) if match else None, asdict(filters)], sort_keys=True).encode()).hexdigest()[:16]

    def _page(self, match, viewer, filters, limit, cursor, explain, vector_, now) -> Page:
        h = self._hash(match, filters)
        at = decode_cursor(cursor, h) if cursor else None
        more = {"n": now} | ({"x": 1} if match.any else {})
        if explain["ranking"] == "hybrid":
            if at and at.get("k") != "f":
                raise ValueError("cursor of another query")
            from_ = at["o"] if at else 0
            rows = self.hybrid_set(match, vector_, viewer, filters, now).where(F.col("position") > from_).orderBy("position").limit(limit + 1).collect()
            last = rows[limit - 1] if len(rows) > limit else None
            return Page(rows[:limit], encode_cursor(h=h, k="f", o=last.position, i=last.rid, **more) if last else None, explain, match)
        if at and at.get("k") != "r":
            raise ValueError("cursor of another query")
        key = (at["r"], at["m"], at["s"], at["i"]) if at else None
        rows = self.best(limit + 1, match, viewer, filters, now, key)
        last = rows[limit - 1] if len(rows) > limit else None
        return Page(rows[:limit], encode_cursor(h=h, k="r", r=last.rank, m=last.importance, s=last.recency, i=last.rid, **more) if last else None, explain, match)
