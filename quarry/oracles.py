"""The registered queries in SQL, written from the rules and not from the DataFrame code."""

from __future__ import annotations

from quarry.sources.adapter import CLOCK, fields_sql

DOCS = f"""d AS (SELECT {fields_sql()} FROM documents),
r AS (SELECT *, CASE WHEN deleted THEN ['deleted'] ELSE list_sort(list_filter([
    CASE WHEN visibility = 'draft' THEN 'draft' END, CASE WHEN visibility = 'private' THEN 'private' END, CASE WHEN visibility = 'members' THEN 'members_only' END,
    CASE WHEN visibility = 'unlisted' THEN 'unlisted' END, CASE WHEN publication_state <> 'published' THEN 'not_published' END, CASE WHEN stub THEN 'stub_provider' END,
    CASE WHEN canonical_url IS NULL THEN 'missing_canonical_url' END], lambda x: x IS NOT NULL)) END AS rs FROM d),
i AS (SELECT * EXCLUDE (rs), CASE WHEN len(rs) = 0 AND decision <> 'index' THEN ['owner_decision'] ELSE rs END AS reasons, CASE WHEN decision = 'index' AND len(rs) = 0 THEN 'index' ELSE 'noindex' END AS index_decision FROM r),
e AS (SELECT *, CASE WHEN deleted OR visibility = 'draft' OR publication_state <> 'published' THEN 0 WHEN visibility <> 'public' THEN 1 WHEN index_decision = 'index' THEN 3 ELSE 2 END AS exposure FROM i)"""

BEACONS = """b AS (SELECT event_id, ts, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CAST(floor(floor(epoch(ts) / 3600) / 24) AS BIGINT) AS day, event_type AS site, 'k' || json_extract_string(props, '$.k') AS query, CASE WHEN event_id % 3 = 0 THEN 'k' ELSE 'K' END || json_extract_string(props, '$.k') AS shown, user_id AS visitor FROM events)"""
LOG = "l AS (SELECT event_id AS arrival, event_id % 300 AS key, CAST(floor(event_id / 1500) AS BIGINT) + event_id % 3 AS revision, event_type = 'error' AS deleted, CASE WHEN event_type = 'error' THEN 'tombstone' ELSE event_type END AS content FROM events)"


FRESH = "epoch_ms(TRY_CAST(coalesce(published_at, updated_at) AS TIMESTAMP))"
BOOST = f"CASE WHEN {FRESH} IS NULL THEN 1.0 ELSE 1 + pow(2.0, -greatest(0.0, ({CLOCK} - {FRESH}) / 86400000.0) / 30.0) END"


def docs(select: str) -> str:
    return f"WITH {DOCS} {select}"


def toks(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def seen(subject=None, groups=(), entitlements=()) -> str:
    if subject is None:
        return "exposure = 3"
    named = f"subject = '{subject}'"
    more = "".join(f" OR grp = '{g}'" for g in groups) + "".join(f" OR entitlement = '{x}'" for x in entitlements)
    return f"(exposure = 3 OR (exposure = 1 AND CASE WHEN visibility = 'private' THEN {named} ELSE ({named}{more}) END))"


def search(words, where="exposure = 3", prefix=False, any_word=False, field=None, question=False, weights=False, extra="", site="false", site_only=False, boilerplate="false", fresh=True) -> str:
    """CTEs ending in s: the ranked, deduplicated result set."""
    test = lambda i, w: f"starts_with(x, '{w}')" if prefix and i == len(words) - 1 else f"x = '{w}'"
    counts = ", ".join(f"len(list_filter(t{c}, lambda x: {test(i, w)})) AS n{i}_{c}" for i, w in enumerate(words) for c in (3, 2, 1))
    fields = [field] if field else [3, 2, 1]
    here = [f"greatest({', '.join(f'CASE WHEN n{i}_{c} > 0 THEN {c} ELSE 0 END' for c in fields)}, 0)" for i in range(len(words))]
    cond = (" OR " if any_word else " AND ").join(f"{h} > 0" for h in here)
    cond = f"({cond}) OR {site}" if site_only else cond
    no_title = " AND ".join(f"n{i}_3 = 0" for i in range(len(words)))
    boost = BOOST if fresh else "1.0"
    raw = " + ".join(f"{ {3: 1.0, 2: 0.4, 1: 0.1}[c]}::DOUBLE * ln(1.0 + n{i}_{c})" for i in range(len(words)) for c in (3, 2, 1))
    titles = f"least(4, {' + '.join(f'CASE WHEN n{i}_3 > 0 THEN 1 ELSE 0 END' for i in range(len(words)))})" if len(words) > 1 else "0"
    cover = "0.0::DOUBLE"
    if weights:
        cover = "round(" + " + ".join(f"(SELECT round(ln(1 + 10000.0 / (1 + count(*))), 2) FROM (SELECT 1 FROM e WHERE exposure = 3 AND list_contains({toks(chr(39).join(['concat_ws(', ' ', ', title, summary, body)']))}, '{w}') LIMIT 1000)) * (CASE WHEN n{i}_3 > 0 THEN 1.0 WHEN n{i}_2 > 0 THEN 0.6 WHEN n{i}_1 > 0 THEN 0.3 ELSE 0.0 END)" for i, w in enumerate(words)) + ", 1)"
    answer = "CASE WHEN type = 'article' THEN 50.0 ELSE 0.0 END" if question else "0.0"
    return f"""WITH {DOCS},
w AS (SELECT *, {toks('title')} AS t3, {toks('summary')} AS t2, {toks('body')} AS t1 FROM e WHERE {where} {extra}),
c AS (SELECT *, len(t3) + len(t2) + len(t1) AS doc_len, {counts} FROM w),
pt AS (SELECT *, greatest({', '.join(here)}, 0) AS tier0, {titles} AS words0 FROM c),
m AS (SELECT *, greatest({', '.join(here)}, 0) + CASE WHEN {site} THEN 10 ELSE 0 END AS tier, {titles} AS title_words, {cover} AS cover,
      CASE WHEN type = 'channel' AND {no_title} AND {boilerplate} THEN 0.0 ELSE 1 - exp(-({raw}) / (1 + ln(1.0 + doc_len))) END AS relevance FROM c WHERE {cond}),
k AS (SELECT *, round(-(cover * 10000 + tier * 100 + {answer} + title_words * 10
        + relevance * {boost}
        + CASE WHEN (type <> 'channel' AND length(title) <= 24 AND length(summary) <= 80) OR title = '' THEN -2.0 ELSE 0.0 END), 6) AS rank,
      {IMPORTANCE} AS importance, {'sort_at' if fresh else chr(39) * 2} AS recency FROM m),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lower(owner), lower(trim(regexp_replace(regexp_replace(title, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g'))) ORDER BY rank, importance DESC, recency DESC, rid) = 1)"""


IMPORTANCE = "CAST(CASE type WHEN 'channel' THEN (CASE WHEN live THEN 1000000 ELSE 0 END) + least(followers, 999999) WHEN 'vod' THEN least(duration, 999999) ELSE 0 END AS BIGINT)"
TOP = "SELECT rid, rank, importance, recency FROM s ORDER BY rank, importance DESC, recency DESC, rid LIMIT 20"
COSINE = "round(1 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"
KNN = f"knn AS (SELECT e.vec_id AS rid, {COSINE} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY distance, rid LIMIT 100)"
FACETS = """f AS (SELECT rid, 'lang' AS key, lang AS value FROM e WHERE exposure > 0 UNION ALL SELECT rid, 'size', size_bucket FROM e WHERE exposure > 0
  UNION ALL SELECT rid, 'followers', CAST(followers AS STRING) FROM e WHERE exposure > 0 UNION ALL SELECT rid, 'duration_seconds', CAST(duration AS STRING) FROM e WHERE exposure > 0
  UNION ALL SELECT rid, 'live', CAST(live AS STRING) FROM e WHERE exposure > 0 UNION ALL SELECT rid, 'type', type FROM e WHERE exposure > 0)"""
POSTINGS = "p AS (SELECT rid, exposure AS audience, field, unnest(words) AS term FROM (SELECT rid, exposure, 3 AS field, {t} AS words FROM e UNION ALL SELECT rid, exposure, 2, {s} FROM e UNION ALL SELECT rid, exposure, 1, {b} FROM e) WHERE exposure IN (1, 3))".format(t=toks("title"), s=toks("summary"), b=toks("body"))
OUTCOMES = """o AS (SELECT *, max(revision * 2 + deleted::INT) OVER (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  first_value(content) OVER (PARTITION BY key, revision, deleted ORDER BY arrival) AS first_content FROM l)"""
OUTCOME = """CASE WHEN prev IS NULL OR revision * 2 + deleted::INT > prev THEN 'applied' WHEN revision < prev // 2 OR (prev % 2 = 1 AND NOT deleted) THEN 'stale'
  WHEN content = first_content THEN 'unchanged' ELSE 'conflict' END"""
HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"
_BARE, _ORIGIN = "regexp_replace(url, '#.*$', '')", "lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([Hh][Tt][Tt][Pp][Ss]?://[^/?]*)', 1))"
_REST = f"substr({_BARE}, length({_ORIGIN}) + 1)"
URL_KEY = f"regexp_replace(concat(regexp_replace(regexp_replace({_ORIGIN}, '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1'), CASE WHEN starts_with({_REST}, '/') OR {_ORIGIN} = '' THEN {_REST} ELSE concat('/', {_REST}) END), '/$', '')"


def either(exact: str, loose: str, limit: int = 20, below: int = 5) -> str:
    """A page of all words, or of any word where the first page has fewer than `below` and the other has more."""
    order = f"ORDER BY rank, importance DESC, recency DESC, rid LIMIT {limit}"
    cols = "SELECT rid, rank, importance, recency FROM s"
    return f"""WITH a AS (SELECT * FROM ({exact} {cols} {order})), o AS (SELECT * FROM ({loose} {cols} {order})), n AS (SELECT (SELECT count(*) FROM a) < {below} AND (SELECT count(*) FROM o) > (SELECT count(*) FROM a) AS relax)
        SELECT o.* FROM o, n WHERE relax UNION ALL SELECT a.* FROM a, n WHERE NOT relax"""


CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]"


def cleaned(c: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '{CONTROL}', '', 'g'), '^\\s+|\\s+$', '', 'g')"


def spaced(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g'))"


HASH = f"""sha256(CASE WHEN deleted THEN CAST(to_json({{'deleted': true, 'id': id, 'owner': owner, 'revision': revision, 'type': type}}) AS VARCHAR) ELSE CAST(to_json({{
  'acl': {{'entitlements': [entitlement], 'groups': [grp], 'subjects': [subject]}}, 'body': {cleaned('body')}, 'canonical_url': nullif(canonical_url, ''), 'deleted': false,
  'facets': {{'duration_seconds': duration, 'followers': followers, 'live': live, 'size': size_bucket}}, 'id': id, 'indexability': {{'decision': decision}}, 'language': nullif(lang, ''), 'owner': owner,
  'publication_state': publication_state, 'revision': revision, 'summary': {cleaned('summary')}, 'title': {cleaned('title')}, 'type': type, 'visibility': visibility}}) AS VARCHAR) END)"""


def ladder(cap: int) -> str:
    """CTEs of the web ladder: m3 (results), x0 to x3 (explain rows)."""
    parts = [
        "rq AS (SELECT event_id AS req, 'q' || event_id % 40 AS q, 2 + event_id % 4 AS lim, ['quick', 'standard', 'deep'][event_id % 3 + 1] AS depth, user_id % 4 <> 0 AS signed FROM events)",
        "an AS (SELECT req, 1 AS step, req % 5 <> 0 AS ok, 0.002 AS cost, i, 'https://o' || (req + 2 * i) % 7 || '.example' AS u FROM rq, range(4) t(i) WHERE i < req % 4 UNION ALL SELECT req, 2, req % 2 = 0, 0.001, i, 'https://d' || i || '.example' FROM rq, range(2) t(i) UNION ALL SELECT req, 3, true, 0.0, 0, 'https://w' || req % 9 || '.example' FROM rq)",
        "m0 AS (SELECT DISTINCT req, 0 AS step, i AS place, 'https://o' || (req + i) % 5 || '.example' AS u FROM rq, range(2) t(i) WHERE i < req % 3 AND i < lim)",
        "x0 AS (SELECT req, 0 AS at, 'open_index' AS step, true AS ok, (SELECT count(*) FROM m0 WHERE m0.req = rq.req) AS count, NULL AS skipped, false AS cached, 0.0 AS cost_usd FROM rq)"]
    for i, (name, paid, had) in enumerate((("exchange", True, 3), ("deepseek", True, 0), ("wikipedia", False, 0)), 1):
        cached = "q IN ('q0', 'q10', 'q20', 'q30')" if i == 1 else "false"
        told = "depth = 'deep' AND EXISTS (SELECT 1 FROM x1 WHERE x1.req = r.req AND x1.ok AND x1.count > 0)" if i == 2 else "false"
        cost, ok = {1: ("0.002", "r.req % 5 <> 0"), 2: ("0.001", "r.req % 2 = 0"), 3: ("0.0", "true")}[i]
        parts += [
            f"""g{i} AS (SELECT r.*, CASE WHEN {told} THEN 'exchange asked it already' WHEN depth <> 'deep' AND coalesce(n, 0) >= least(lim, 3) THEN 'earlier steps answered' WHEN {cached} THEN 'cached' WHEN depth = 'quick' THEN 'quick search reads indexes only'
                WHEN {paid} AND NOT signed THEN 'paid providers need a signed-in person' END AS why FROM rq r LEFT JOIN (SELECT req, count(*) AS n FROM m{i - 1} GROUP BY req) USING (req))""",
            f"a{i} AS (SELECT req FROM g{i} WHERE why IS NULL ORDER BY req {f'LIMIT {cap - had}' if paid else ''})",
            f"n{i} AS (SELECT req, {i} AS step, min(i) AS place, u FROM (SELECT an.req, i, u FROM an JOIN a{i} USING (req) JOIN rq USING (req) WHERE step = {i} AND ok AND i < lim UNION ALL SELECT req, i, 'https://c' || i || '.example' FROM g{i}, range(2) t(i) WHERE why = 'cached') WHERE (req, u) NOT IN (SELECT (req, u) FROM m{i - 1}) GROUP BY req, u)",
            f"m{i} AS (SELECT * FROM m{i - 1} UNION ALL SELECT * FROM n{i})",
            f"""x{i} AS (SELECT r.req, {i} AS at, '{name}' AS step, coalesce(why = 'cached', false) OR (a.req IS NOT NULL AND {ok}) AS ok, CASE WHEN why = 'cached' THEN (SELECT count(*) FROM n{i} n WHERE n.req = r.req) WHEN a.req IS NOT NULL AND {ok} THEN (SELECT count(*) FROM an WHERE an.req = r.req AND step = {i} AND i < r.lim) ELSE 0 END AS count,
                CASE WHEN why = 'cached' OR a.req IS NOT NULL THEN NULL ELSE coalesce(why, 'daily cap reached') END AS skipped, coalesce(why = 'cached', false) AS cached, CASE WHEN a.req IS NOT NULL THEN {cost} ELSE 0.0 END AS cost_usd FROM g{i} r LEFT JOIN a{i} a ON a.req = r.req)"""]
    return "WITH " + ", ".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)


def snippet_words(c: str) -> str:
    return f"list_filter(string_split_regex(lower(replace(replace({c}, chr(1), ''), chr(2), '')), '[^\\p{{L}}\\p{{N}}$.]+'), lambda w: length(w) > 1)"


def shown(c: str, banned: str) -> str:
    """A query as it is shown, null where it may not count."""
    q = f"regexp_replace(trim(regexp_replace(regexp_replace({c}, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g')), '^[\\s\"''`.,;:!?()\\[\\]{{}}<>-]+|[\\s\"''`.,;:!?()\\[\\]{{}}<>-]+$', '', 'g')"
    bad = ["\\S+@\\S+\\.\\S+", "(?:\\+?\\d[\\s().-]*){7,}", "\\d{6,}", "(?i)\\b(?:https?://|www\\.)\\S+", "\\b[A-Za-z0-9_-]{24,}\\b", f"(?i)\\b({banned})\\b"]
    ok = " AND ".join(f"NOT regexp_matches({q}, '{p}')" for p in bad)
    return f"CASE WHEN length({q}) BETWEEN 2 AND 80 AND len(string_split({q}, ' ')) <= 8 AND {ok} THEN {q} END"


def snippets(words, prefix=False, where="") -> str:
    bare = "regexp_replace(strip_accents(lower(w)), '[^\\p{L}\\p{N}]', '', 'g')"
    hit = f"({' OR '.join(f'{bare} = {chr(39)}{w}{chr(39)}' for w in words)}" + (f" OR starts_with({bare}, '{words[-1]}'))" if prefix else ")")
    return search(words, prefix=prefix) + f""", top AS (SELECT rid, title, string_split({spaced("concat_ws(' ', summary, body)")}, ' ') AS wx, string_split({spaced('title')}, ' ') AS wt FROM s ORDER BY rank, importance DESC, recency DESC, rid LIMIT 20),
        ws AS (SELECT rid, title, CASE WHEN len(list_filter(wx, lambda w: {hit})) > 0 THEN wx ELSE wt END AS ws FROM top), spot AS (SELECT *, greatest(1, coalesce(list_position(list_transform(ws, lambda w: {hit}), true), 0) - 4) AS n FROM ws),
        found AS (SELECT rid, title, array_to_string(list_transform(ws[n : n + 15], lambda w: CASE WHEN {hit} THEN concat(chr(1), w, chr(2)) ELSE w END), ' ') AS snippet FROM spot)
        SELECT rid, snippet FROM found {where}"""


def on_site(hosts: str, help_host: str) -> str:
    return f"regexp_matches(coalesce(canonical_url, ''), '(?i)^https?://([a-z0-9-]+\\.)*({hosts})(/|$)|^https?://([a-z0-9-]+\\.)*{help_host}/a/({hosts})(/|$)')"


def near(extra: str, floor: str) -> str:
    return f"nb AS (SELECT x.vec_id AS rid, {COSINE.replace('e.', 'x.')} AS distance FROM embeddings x, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE {extra}), near AS (SELECT * FROM nb WHERE distance <= {floor} ORDER BY distance, rid LIMIT 100)"


def rising(site: str = "true", limit: str = "") -> str:
    return f"""SELECT query, shown, recent, before, people, round(recent * log2(2 + recent / (before / 2 + 1)), 6) AS score, recent > before / 2 AS rising FROM (SELECT query, max(shown) AS shown, count(*) FILTER (hour >= {{now}} - 24) AS recent, count(*) FILTER (hour < {{now}} - 24) AS before FROM b WHERE hour >= {{now}} - 72 AND {site} GROUP BY query)
        JOIN (SELECT query, count(DISTINCT visitor) AS people FROM b WHERE day >= {{now}} // 24 - 1 GROUP BY query) USING (query) WHERE recent > 0 AND people >= 5 ORDER BY score DESC, recent DESC, query {limit}""".replace("{now}", "(SELECT max(hour) FROM b)")


LOOSE = ["idiot", "clown", "moron", "trash", "scum", "stupid", "loser"]
SAVED = """r AS (SELECT 'u' || CAST(user_id % 20 AS STRING) AS subject, rtrim(translate(base64(unhex(sha256('q' || CAST(event_id % 40 AS STRING)))), '+/', '-_'), '=')[1:22] AS hash, event_id AS t FROM events),
  u AS (SELECT subject, hash, min(t) AS created_at FROM r GROUP BY subject, hash QUALIFY row_number() OVER (PARTITION BY subject ORDER BY min(t), hash) <= 12)"""
CODE = """cr AS (SELECT CASE WHEN role = 'user' THEN 0 ELSE 10000000 END + conv_id * 1000 + turn AS position, role AS source, CASE WHEN conv_id % 2 = 0 THEN 'R' ELSE 'r' END || CAST(conv_id % 20 AS STRING) AS repo, CASE WHEN conv_id % 5 <> 0 THEN 'c' || CAST(conv_id % 2 AS STRING) ELSE '' END AS ref,
    'f' || CAST(conv_id % 7 AS STRING) AS path, conv_id % 100 AS stars, turn AS line, CASE WHEN conv_id % 3 <> 0 THEN 'l' || CAST(conv_id % 4 AS STRING) END AS licence, CASE WHEN turn % 2 = 1 THEN 'py' END AS language, conv_id AS last_commit FROM conversations WHERE conv_id % 11 <> 0),
  cs AS (SELECT k, ref, path, string_agg(source, ',' ORDER BY place) AS sources FROM (SELECT lower(repo) AS k, ref, path, source, min(position) AS place FROM cr GROUP BY ALL) GROUP BY ALL),
  cm AS (SELECT lower(repo) AS k, ref, path, arg_min(repo, position) AS repo, max(stars) AS stars, max(last_commit) AS last_commit, arg_min(licence, position) FILTER (licence IS NOT NULL) AS licence, arg_min(language, position) FILTER (language IS NOT NULL) AS language,
    min(line) AS line_start, max(line) AS line_end, count(DISTINCT line) AS n_lines FROM cr GROUP BY lower(repo), ref, path)"""
QUEUE = "pq AS (SELECT event_id AS seq, user_id % 5 AS zone, CASE WHEN event_id % 4 = 0 THEN 'done' ELSE 'pending' END AS state, event_id * 7919 % 10007 AS due_at FROM events)"
NOW_HOUR = "(SELECT max(hour) FROM b)"

SQL = {
    "keyword_and_search": search(["the", "of"]) + TOP,
    "keyword_signed_in": search(["the", "of"], seen("u1", ("g1",), ("e1",))) + TOP,
    "keyword_relaxed": search(["idiot", "clown"], any_word=True, weights=True) + TOP,
    "prefix_search": search(["the", "ing"], prefix=True) + TOP,
    "question_lift": search(["that", "from"][:1] + ["erer"], any_word=True, question=True) + TOP,
    "keyset_page2": search(["the", "of"]) + "SELECT rid, rank, importance, recency FROM s ORDER BY rank, importance DESC, recency DESC, rid LIMIT 20 OFFSET 20",
    "suggest_titles": search(["th"], prefix=True, field=3) + "SELECT rid, title, rank FROM s ORDER BY rank, importance DESC, recency DESC, rid LIMIT 8",
    "facet_filter": search(["the"], extra="AND lang IN ('en', 'de') AND size_bucket IN ('medium')") + TOP,
    "facet_counts": search(["the"]).replace("\nw AS", f"\n{FACETS},\nw AS", 1) + "SELECT key, value, count(*) AS count FROM f WHERE key IN ('lang', 'size', 'live', 'type') AND rid IN (SELECT rid FROM s) GROUP BY key, value QUALIFY row_number() OVER (PARTITION BY key ORDER BY count DESC, value) <= 20",
    "rank_components": search(["the", "of"]) + "SELECT rid, tier, title_words, cover, doc_len, round(relevance, 6) AS relevance FROM k",
    "browse_newest": docs("SELECT rid, sort_at FROM e WHERE exposure = 3 ORDER BY sort_at DESC, rid DESC LIMIT 20"),
    "effective_indexability": docs("SELECT rid, index_decision, array_to_string(reasons, ',') AS reasons FROM i"),
    "exposure_levels": docs("SELECT rid, exposure FROM e"),
    "exposure_counts": docs("SELECT exposure, count(*) AS n, count(*) FILTER (deleted) AS tombstones FROM e GROUP BY exposure"),
    "acl_keys": docs("SELECT rid, 's' AS kind, subject AS value FROM e WHERE exposure = 1 UNION ALL SELECT rid, 'g', grp FROM e WHERE exposure = 1 UNION ALL SELECT rid, 'e', entitlement FROM e WHERE exposure = 1"),
    "facet_pairs": docs(f", {FACETS} SELECT * FROM f").replace("FROM i) , f", "FROM i), f"),
    "visible_anonymous": docs(f"SELECT rid FROM e WHERE {seen()}"),
    "visible_user": docs(f"SELECT rid FROM e WHERE {seen('u2')}"),
    "visible_delegate": docs(f"SELECT rid FROM e WHERE {seen('u9', ('g0', 'g2'), ('e1',))}"),
    "can_view_by_id": docs("SELECT rid, exposure >= 2 OR (exposure = 1 AND (visibility = 'unlisted' OR CASE WHEN visibility = 'private' THEN subject = 'u2' ELSE subject = 'u2' OR grp = 'g1' END)) AS can_view FROM e"),
    "acl_leak_audit": docs(f"SELECT count(*) AS leaks FROM e WHERE {seen()} AND (visibility <> 'public' OR deleted OR publication_state <> 'published')"),
    "postings": f"WITH {DOCS}, {POSTINGS} SELECT rid, audience, field, term, count(*) AS tf FROM p GROUP BY ALL",
    "term_df": f"WITH {DOCS}, {POSTINGS} SELECT term, least(count(DISTINCT rid), 1000) AS df FROM p WHERE audience = 3 GROUP BY term",
    "word_weights": f"WITH {DOCS}, {POSTINGS} SELECT term, round(ln(1 + 10000.0 / (1 + least(count(DISTINCT rid), 1000))), 2) AS weight FROM p WHERE audience = 3 GROUP BY term",
    "index_reconcile": f"WITH {DOCS}, {POSTINGS} SELECT exposure AS audience, count(*) AS n_documents, (SELECT count(DISTINCT rid) FROM p WHERE audience = exposure) AS n_indexed, count(*) <> (SELECT count(DISTINCT rid) FROM p WHERE audience = exposure) AS rebuild FROM e WHERE exposure IN (1, 3) GROUP BY exposure",
    "freshness_boost": docs(f"SELECT rid, round({BOOST}, 6) AS boost FROM d"),
    "importance": docs(f"SELECT rid, {IMPORTANCE} AS importance FROM d"),
    "thin_flag": docs("SELECT rid, CASE WHEN (type <> 'channel' AND length(title) <= 24 AND length(summary) <= 80) OR title = '' THEN -2.0::DOUBLE ELSE 0.0::DOUBLE END AS thin FROM d"),
    "coverage_by_kind": docs("SELECT owner, type, count(*) AS n FROM e WHERE exposure = 3 GROUP BY owner, type"),
    "newest_public": docs("SELECT max(nullif(sort_at, '')) AS newest FROM e WHERE exposure = 3"),
    "shelves_top4": docs("""SELECT owner, place, rid FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY sort_at DESC, rid DESC) AS place
        FROM (SELECT * FROM e WHERE exposure = 3 QUALIFY row_number() OVER (PARTITION BY owner ORDER BY sort_at DESC, rid DESC) <= 12) WHERE length(title) > 3) WHERE place <= 4"""),
    "owner_page": docs("SELECT rid, type, deleted FROM d WHERE owner = 'src3' AND rid > 100 ORDER BY rid LIMIT 21"),
    "knn_cosine": f"WITH {KNN} SELECT rid, distance FROM knn",
    "vector_index_exact": f"WITH {KNN} SELECT rid, distance FROM knn",
    "distance_floor": f"WITH {KNN} SELECT rid, distance FROM knn WHERE distance <= 0.9",
    "rrf_fusion": search(["the", "of"]) + f""", {KNN}, a AS (SELECT rid, row_number() OVER (ORDER BY rank, importance DESC, recency DESC, rid) AS kr FROM s QUALIFY kr <= 100), v AS (SELECT rid, row_number() OVER (ORDER BY distance, rid) AS vr FROM knn)
        SELECT coalesce(a.rid, v.rid) AS rid, round(coalesce(1.0 / (60 + kr), 0.0) + coalesce(1.0 / (60 + vr), 0.0), 9) AS score, kr AS keyword_rank, vr AS vector_rank FROM a FULL JOIN v ON a.rid = v.rid""",
    "revision_outcomes": f"WITH {LOG}, {OUTCOMES} SELECT arrival, key, revision, deleted, {OUTCOME} AS outcome FROM o",
    "latest_documents": f"WITH {LOG} SELECT key, revision, deleted, content FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY revision DESC, deleted DESC, arrival) = 1",
    "inbox_dedupe": "SELECT event_id % 4000 AS event_id, min(event_id) AS arrival FROM events WHERE event_id % 4000 NOT IN (SELECT event_id FROM events WHERE event_id < 500) GROUP BY 1",
    "rejections": """SELECT rid, outcome FROM (SELECT event_id AS rid, CASE WHEN event_type = 'view' THEN 'ignored' WHEN event_type = 'click' THEN 'owner_mismatch' WHEN user_id % 4 = 0 THEN 'owner_not_accepted'
        WHEN event_id % 10 = 3 THEN 'subject_mismatch' WHEN event_id % 10 = 4 THEN 'invalid_document' ELSE 'accepted' END AS outcome FROM events) WHERE outcome NOT IN ('ignored', 'accepted')""",
    "exposure_changes": f"""WITH {LOG}, {OUTCOMES}, a AS (SELECT key, revision, max(CASE WHEN deleted THEN 0 WHEN content = 'view' THEN 1 ELSE 3 END) FILTER (NOT deleted) AS live, bool_or(deleted) AS dead FROM o WHERE {OUTCOME} = 'applied' GROUP BY key, revision),
        v AS (SELECT key, revision, CASE WHEN dead THEN 0 ELSE live END AS exposure FROM a), w AS (SELECT *, coalesce(lag(exposure) OVER (PARTITION BY key ORDER BY revision), 0) AS previous FROM v)
        SELECT key, revision, 'removed' AS event, previous, exposure FROM w WHERE exposure < previous UNION ALL SELECT key, revision, 'indexed', previous, exposure FROM w WHERE exposure > 0""",
    "purge_urls": f"""WITH u AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM pages WHERE url IS NOT NULL), x AS (SELECT url FROM u UNION SELECT concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), p) FROM u, (VALUES ('/'), ('/feed')) t(p)),
        z(zone, suffix) AS (VALUES ('com', 'example.com'), ('net', 'example.net'), ('blog', 'blog.thther.example.net'), ('m', 'm.thther.example.com')),
        y AS (SELECT x.url, z.zone, row_number() OVER (PARTITION BY x.url ORDER BY length(z.suffix) DESC, z.zone DESC) AS n FROM x LEFT JOIN z ON {HOST} = z.suffix OR ends_with({HOST}, '.' || z.suffix))
        SELECT url, zone, CASE WHEN zone IS NULL THEN 'skipped' ELSE 'pending' END AS state FROM y WHERE n = 1""",
    "purge_step": """SELECT event_id, attempts + 1 AS attempts, CASE WHEN status BETWEEN 200 AND 299 THEN 'done' WHEN retry AND attempts + 1 >= 8 THEN 'failed' WHEN retry THEN 'pending' WHEN batch > 1 THEN 'isolate' ELSE 'failed' END AS state,
        CASE WHEN retry AND attempts + 1 < 8 THEN [2, 10, 60, 300, 900, 1800, 3600][attempts + 1] END AS delay
        FROM (SELECT *, status IS NULL OR status IN (408, 429) OR status >= 500 AS retry FROM (SELECT event_id, CAST(event_id % 8 AS INT) AS attempts, CAST(event_id % 3 AS INT) AS batch, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 WHEN 4 THEN NULL ELSE 408 END AS status FROM events))""",
    "trend_hourly": f"WITH {BEACONS} SELECT hour, site, query, count(*) AS n FROM b GROUP BY ALL",
    "trend_visitors": f"WITH {BEACONS} SELECT day, query, count(DISTINCT visitor) AS people FROM b GROUP BY ALL",
    "trend_by_day": f"WITH {BEACONS} SELECT day, count(*) AS n FROM b GROUP BY day",
    "trend_by_site": f"WITH {BEACONS} SELECT site, count(*) AS n FROM b GROUP BY site ORDER BY n DESC, site LIMIT 40",
    "trend_suggestions": docs(f"""SELECT arg_max(t, (sort_at, rid)) AS query, lower(t) AS key FROM (SELECT sort_at, rid, {shown("trim(regexp_replace(regexp_extract(title, '^(.*?)(?:" + chr(92) + "s+[|—·–-]" + chr(92) + "s+.*)?$', 1), '" + chr(92) + "s*[(" + chr(92) + "[][^)" + chr(92) + "]]*[)" + chr(92) + "]]?" + chr(92) + "s*$', ''))", "th" + chr(92) + "w*")} AS t FROM
        (SELECT * FROM e WHERE exposure = 3 AND length(title) BETWEEN 3 AND 48 ORDER BY sort_at DESC, rid DESC LIMIT 200)) WHERE t IS NOT NULL GROUP BY lower(t) ORDER BY sha256(concat('480000|', lower(t))) LIMIT 8"""),
    "model_usage": """SELECT user_id AS answer, CAST(sum(CASE WHEN event_id % 4 <> 0 THEN event_id % 900 ELSE 0 END) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN event_id % 3 <> 0 THEN event_id % 70 ELSE 0 END) AS BIGINT) AS tokens_out, round(sum(CASE WHEN event_id % 5 <> 0 THEN event_id % 7 / 8 ELSE 0 END), 6) AS cost_usd FROM events GROUP BY user_id""",
    "provider_counters": """SELECT CAST(ts AS DATE) AS day, event_type AS provider, count(*) AS calls, count(*) FILTER (user_id % 3 <> 0) AS answered, round(sum(CASE WHEN event_id % 4 <> 0 THEN event_id % 50 ELSE 0 END)::DOUBLE, 6) AS ms, round(sum(event_id % 8 / 4), 6) AS cost FROM events GROUP BY ALL""",
    "trend_lifetimes": f"""WITH {BEACONS}, n AS (SELECT max(hour) AS h FROM b) SELECT 'trends' AS kind, count(*) AS n FROM (SELECT DISTINCT hour, site, query FROM b, n WHERE hour >= h - 192) UNION ALL SELECT 'visitors', count(*) FROM (SELECT DISTINCT day, query, visitor FROM b, n WHERE day >= h // 24 - 2)
        UNION ALL SELECT 'salts', count(*) FROM (SELECT DISTINCT day FROM b, n WHERE day >= h // 24 - 1) UNION ALL SELECT 'telemetry', count(*) FROM b, n WHERE day >= h // 24 - 14""",
    "snippet_html": "SELECT rid, replace(replace(replace(replace(replace(replace(replace('<i> & ' || snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;'), chr(1), '<mark>'), chr(2), '</mark>') AS html FROM (" + snippets(["the"]) + ")",
    "saved_percolate": f"""WITH q AS (SELECT item_id AS saved_id, list_distinct(list_slice({toks('text')}, 1, 3)) AS words FROM benchmark), n AS (SELECT doc_id AS rid, {toks('text')} AS t FROM documents)
        SELECT saved_id, rid FROM q JOIN n ON list_has_all(t, words) WHERE len(words) > 0""",
    "seen_diff": """WITH w AS (SELECT user_id AS watch, list_distinct(list_sort(list(event_type || '-' || CAST(event_id % 7 AS STRING)))) AS urls FROM events GROUP BY user_id), x AS (SELECT watch, list_sort(urls) AS urls, list_sort(list_filter(urls, lambda u: u < 'e')) AS seen FROM w)
        SELECT watch, array_to_string(list_filter(urls, lambda u: NOT list_contains(seen, u)), ',') AS new FROM x""",
    "scope_groups": docs("""SELECT scope, ordinal, position, rid FROM (SELECT scope, ordinal, rid, row_number() OVER (PARTITION BY scope ORDER BY sort_at DESC, rid) AS position FROM e JOIN (VALUES ('videos', 'vod', 0), ('people', 'channel', 1), ('shop', 'offer', 2)) s(scope, type, ordinal) USING (type) WHERE exposure = 3) WHERE position <= 20"""),
    "code_context": """WITH l AS (SELECT conv_id AS file, turn AS line, list_contains(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), 'the') AS match FROM conversations)
        SELECT DISTINCT a.file, a.line FROM l a JOIN l b ON a.file = b.file AND b.match AND abs(a.line - b.line) <= 2""",
    "provider_stats": """WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type AS provider, CAST(value AS DOUBLE) AS ms, user_id % 3 <> 0 AS answered FROM events)
        SELECT day, provider, count(*) AS calls, round(sum(ms) / count(*), 6) AS latency_ms_mean, round(count(*) FILTER (answered) / count(*), 6) AS answered_rate FROM c GROUP BY day, provider""",
    "bench_metrics": """WITH r AS (SELECT event_type AS run, value AS ms, user_id % 12 AS place FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ms) AS n, count(*) OVER (PARTITION BY run) AS total FROM r)
        SELECT run, max(ms) FILTER (n = ceil(total * 0.5)) AS p50, max(ms) FILTER (n = ceil(total * 0.95)) AS p95, round(avg(CASE WHEN place BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END), 6) AS hit10, round(avg(CASE WHEN place > 0 THEN 1.0 / place ELSE 0.0 END), 6) AS mrr FROM o GROUP BY run""",
    "offer_catalogue": """SELECT p_brand AS brand, count(*) AS offers, count(DISTINCT l_suppkey) AS sellers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
    "coverage_rollup": docs("SELECT owner, type, count(*) AS n FROM e WHERE exposure = 3 GROUP BY ROLLUP (owner, type)"),
    "saved_upsert": """WITH r AS (SELECT user_id AS subject, 'n' || CAST(event_id % 9 AS STRING) AS name, rtrim(translate(base64(unhex(sha256('q ' || CAST(event_id % 40 AS STRING)))), '+/', '-_'), '=')[1:22] AS hash, event_id AS t FROM events),
        o AS (SELECT subject, hash, min(t) AS created_at, arg_max(name, t) AS name FROM r GROUP BY subject, hash)
        SELECT subject, hash, created_at, name FROM o QUALIFY row_number() OVER (PARTITION BY subject ORDER BY created_at, hash) <= 12""",
    "query_cache": """WITH c AS (SELECT rtrim(translate(base64(unhex(sha256(concat('q ', CAST(event_id % 500 AS STRING), chr(1), event_type)))), '+/', '-_'), '=') AS key, event_id AS value, event_id + (event_id % 7) * 300 AS expires_at, event_id AS stored_at FROM events)
        SELECT key, value FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY stored_at DESC) = 1) WHERE expires_at > 900""",
    "dashboard_totals": docs("SELECT count(*) AS documents, count(DISTINCT owner) AS owners, count(DISTINCT type) AS kinds FROM e WHERE exposure = 3"),
    "session_queries": f"""WITH {BEACONS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY visitor ORDER BY ts, event_id)),
        k AS (SELECT *, sum(new) OVER (PARTITION BY visitor ORDER BY ts, event_id) AS part FROM g) SELECT visitor, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM k GROUP BY visitor, part""",
    "hybrid_rerank": search(["the", "of"]) + f""", {KNN}, a AS (SELECT *, row_number() OVER (ORDER BY rank, importance DESC, recency DESC, rid) AS kr FROM s QUALIFY kr <= 100), v AS (SELECT rid, row_number() OVER (ORDER BY distance, rid) AS vr FROM knn),
        u AS (SELECT coalesce(a.rid, v.rid) AS rid, round(coalesce(1.0 / (60 + kr), 0.0) + coalesce(1.0 / (60 + vr), 0.0), 9) AS score, kr, vr, a.cover, a.tier, a.title_words FROM a FULL JOIN v ON a.rid = v.rid),
        x AS (SELECT *, row_number() OVER (ORDER BY score DESC, kr ASC NULLS LAST, vr ASC NULLS LAST, rid) AS fused FROM u)
        SELECT rid, row_number() OVER (ORDER BY coalesce(cover, 0) DESC, coalesce(tier, 0) DESC, coalesce(title_words, 0) DESC, fused) AS position FROM x QUALIFY position <= 50""",
    "stream_trend_hourly": f"WITH {BEACONS} SELECT hour, site, query, count(*) AS n FROM b GROUP BY ALL",
    "web_ladder": ladder(1200) + " SELECT req, step, row_number() OVER (PARTITION BY req ORDER BY step, place) AS position, u AS url_key FROM m3 JOIN rq USING (req) QUALIFY position <= lim",
    "web_ladder_explain": ladder(1200) + " SELECT req, step, ok, count, skipped, cached, CAST(cost_usd AS DOUBLE) AS cost_usd FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3)",
    "facet_bitmap_filter": docs("SELECT rid FROM e WHERE exposure > 0 AND (rid % 7 IN (1, 2) OR rid % 5 IN (1, 2)) AND lang IN ('en', 'de')"),
    "facet_bitmap_counts": search(["the"]) + """, v AS (SELECT DISTINCT rid, 'tag' AS key, unnest(['t' || rid % 7, 't' || rid % 5]) AS value FROM s UNION ALL SELECT rid, 'lang', lang FROM s WHERE lang IS NOT NULL)
        SELECT key, value, count FROM (SELECT key, value, count(*) AS count FROM v GROUP BY key, value) QUALIFY row_number() OVER (PARTITION BY key ORDER BY count DESC, value) <= 20""",
    "facet_numbers": """WITH v AS (SELECT doc_id AS rid, unnest([CASE WHEN doc_id % 3 = 0 THEN 'many' ELSE CAST(doc_id % 50 AS VARCHAR) END, CAST(CAST(doc_id % 9 + 0.5 AS DECIMAL(9, 1)) AS VARCHAR), '-4']) AS x FROM documents)
        SELECT rid, 'price' AS key, CAST(min(x) AS DOUBLE) AS number FROM v WHERE regexp_full_match(x, '[0-9]+([.][0-9]+)?') GROUP BY rid""",
    "stream_index": (search(["the", "of"], "exposure = 3 AND rid % 13 <> 0").replace(toks("body"), toks("substr(body, 1, 48000)")).replace("coalesce(published_at, updated_at)", "coalesce(nullif(published_at, 'soon'), updated_at)")
                     + "SELECT rid AS id, rank, importance, recency FROM s ORDER BY rank, importance DESC, recency DESC, rid LIMIT 20"),
    "stream_documents": docs("""SELECT rid AS id, CAST(1 + CAST(rid % 7 = 0 AS INT) + CAST(deleted AS INT) AS BIGINT) AS events, CAST(CAST(rid % 13 <> 0 AS INT) + CAST(deleted AS INT) AS BIGINT) AS applied,
        CAST(CAST(rid % 7 = 0 AND rid % 13 <> 0 AS INT) AS BIGINT) AS stale, CAST(CASE WHEN rid % 13 = 0 THEN 1 + CAST(rid % 7 = 0 AS INT) ELSE 0 END AS BIGINT) AS rejected,
        CASE WHEN rid % 13 <> 0 OR deleted THEN revision END AS revision, CASE WHEN rid % 13 <> 0 OR deleted THEN deleted END AS deleted, CASE WHEN rid % 13 <> 0 OR deleted THEN exposure END AS exposure FROM e"""),
    "watch_stream": docs(f""", q AS (SELECT item_id, list_distinct(list_slice({toks('text')}, 1, 3)) AS words FROM benchmark), t AS (SELECT rid, exposure, subject, {toks('body')} AS t FROM e),
        m AS (SELECT item_id, rid, 1000 + rid % 400 AS w FROM q JOIN t ON len(words) > 0 AND list_has_all(t, words) WHERE (exposure = 3 OR (exposure = 1 AND subject = 'u' || CAST(item_id % 5 AS STRING))) AND rid % 400 > item_id % 300)
        SELECT item_id AS saved_id, (SELECT max(1000 + rid % 400) FROM e) AS watermark, n, first FROM q LEFT JOIN (SELECT item_id, count(*) AS n, arg_min(rid, (-w, rid)) AS first FROM m GROUP BY item_id) USING (item_id) WHERE len(words) > 0 AND (SELECT max(1000 + rid % 400) FROM e) > 1000 + item_id % 300""").replace("FROM i) , q", "FROM i), q"),
    "stream_beacons": f"""WITH RECURSIVE s AS (SELECT event_id, ({CLOCK} + event_id * 20000) AS ms, CASE WHEN event_id % 3 = 0 THEN 'a.example' ELSE 'b.example' END AS site, 'red ' || event_id % 23 AS query, user_id % 60 AS who, event_id % 17 = 0 OR event_id % 19 = 0 OR (event_id % 3 <> 0 AND event_id % 7 = 0) AS out FROM events),
        g AS (SELECT *, ms // 86400000 AS day, ms // 3600000 AS hour FROM s WHERE NOT out AND ms // 86400000 >= (SELECT max(ms) // 86400000 FROM s) - 1), w(who, day, f) AS (SELECT who, day, min(ms) FROM g GROUP BY who, day UNION ALL SELECT w.who, w.day, min(g.ms) FROM w JOIN g ON g.who = w.who AND g.day = w.day AND g.ms >= w.f + 60000 GROUP BY w.who, w.day),
        c AS (SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY g.who, g.day, w.f ORDER BY g.ms, g.event_id) AS k FROM g ASOF JOIN w ON g.who = w.who AND g.day = w.day AND g.ms >= w.f) WHERE k <= 20)
        SELECT hour, site, query, replace(query, 'red', 'Red') AS shown, count(*) AS n, any_value(people) AS people FROM c JOIN (SELECT day, query, count(DISTINCT who) AS people FROM c GROUP BY day, query) USING (day, query) GROUP BY hour, site, query""",
    "stream_inbox": "SELECT event_id, event_type FROM events",
    "stream_revision_merge": f"WITH {LOG} SELECT key, revision, deleted, content FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY revision DESC, deleted DESC, arrival) = 1",
    "snippet": snippets(["the"]),
    "snippet_prefix": snippets(["erth"], True, f"WHERE len({snippet_words('snippet')}) > 0 AND 2 * len(list_filter({snippet_words('snippet')}, lambda x: list_contains({snippet_words('title')}, x))) < len({snippet_words('snippet')})"),
    "normalize_hash": docs(f"SELECT rid, {HASH} AS content_hash FROM d"),
    "embedding_pending": docs("SELECT rid FROM d WHERE NOT deleted AND visibility = 'public' AND publication_state = 'published' AND NOT EXISTS (SELECT 1 FROM embeddings x WHERE x.vec_id = rid AND x.vec_id % 7 <> 0 AND rid % 6 <> 0)"),
    "deals_order": docs(f"""SELECT rid, tier FROM (SELECT rid, CASE WHEN len(list_filter({toks('title')}, lambda t: t = 'the' OR starts_with(t, 'the') OR (length(t) >= 4 AND starts_with('the', t)))) > 0 THEN 0 WHEN rid % 3 = 0 THEN 1 ELSE 2 END AS tier, round(1 / (60 + rid % 17), 9) AS score FROM e WHERE type = 'offer' AND exposure = 3)
        ORDER BY tier, score DESC, CASE WHEN rid % 3 = 0 THEN rid END ASC NULLS LAST, CASE WHEN rid % 3 <> 0 THEN rid END ASC NULLS LAST, rid LIMIT 40"""),
    "trending_rising": f"WITH {BEACONS} " + rising(),
    "trending_list": f"""WITH {BEACONS}, own AS ({rising("site = 'view'", "LIMIT 12")}), net AS ({rising(limit="LIMIT 12")}),
        x AS (SELECT *, 0 AS source FROM own UNION ALL SELECT *, 1 FROM net WHERE query NOT IN (SELECT query FROM own))
        SELECT shown AS query, false AS suggested, rising, row_number() OVER (ORDER BY source, score DESC, recent DESC, shown) AS place FROM x QUALIFY place <= 12""",
    "rate_limit": f"""WITH RECURSIVE {BEACONS}, g AS (SELECT visitor % 3 AS who, visitor, ts, event_id FROM b), w(who, s) AS (SELECT who, min(ts) FROM g GROUP BY who UNION ALL SELECT w.who, min(g.ts) FROM w JOIN g ON g.who = w.who AND g.ts >= w.s + INTERVAL 6 HOURS GROUP BY w.who)
        SELECT visitor, event_id FROM (SELECT g.visitor, g.event_id, row_number() OVER (PARTITION BY g.who, w.s ORDER BY g.ts, g.event_id) AS n FROM g ASOF JOIN w ON g.who = w.who AND g.ts >= w.s) WHERE n <= 5""",
    "url_dedupe_union": f"""WITH u AS (SELECT 0 AS step, page_id AS position, url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 1, page_id, url FROM pages), k AS (SELECT *, {URL_KEY} AS url_key FROM u)
        SELECT url_key, step, position FROM k WHERE url_key <> '' QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY step, position) = 1""",
    "code_lines": """WITH r AS (SELECT CASE WHEN role = 'user' THEN 0 ELSE 10000000 END + conv_id * 1000 + turn AS position, role, conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'R' ELSE 'r' END || conv_id % 20 AS repo, CASE WHEN conv_id % 5 <> 0 THEN 'c' || conv_id % 2 ELSE '' END AS ref,
          'f' || conv_id % 7 || '-' || conv_id % 3 AS path FROM conversations WHERE conv_id % 11 <> 0), x AS (SELECT lower(repo) AS k, ref, path, position, i, CAST(turn + [0, 1, 5][i] AS INTEGER) AS number, role || '-' || conv_id || '-' || [0, 1, 5][i] AS text, (turn + [0, 1, 5][i] + conv_id) % 6 = 0 AS match FROM r, range(1, 4) t(i)),
        l AS (SELECT k, ref, path, number, arg_min(text, (position, i)) AS text, bool_or(match) AS match FROM x GROUP BY ALL), f AS (SELECT lower(repo) AS k, ref, path, arg_min(repo, position) AS repo FROM r GROUP BY ALL), s AS (SELECT k, ref, path, min(number) AS line_start, max(number) AS line_end FROM l GROUP BY ALL),
        n AS (SELECT l.*, row_number() OVER (PARTITION BY k, ref, path ORDER BY number) AS p FROM l WHERE EXISTS (SELECT 1 FROM l m WHERE m.k = l.k AND m.ref = l.ref AND m.path = l.path AND m.match AND abs(m.number - l.number) <= 2))
        SELECT repo, ref, path, line_start, line_end, number, text, match FROM n JOIN f USING (k, ref, path) JOIN s USING (k, ref, path) WHERE p <= 120""",
    "code_merge": f"WITH {CODE} SELECT cm.* EXCLUDE (k), sources FROM cm JOIN cs USING (k, ref, path)",
    "code_filters": f"WITH {CODE} SELECT repo, ref, path FROM cm WHERE lower(language) = 'py' AND lower(licence) = 'l1' AND contains(lower(repo), 'r1')",
    "code_rank": """SELECT repo, path, stars, exact FROM (SELECT 'r' || CAST(conv_id AS STRING) AS repo, 'f' || CAST(turn AS STRING) AS path, conv_id % 100 AS stars, conv_id % 13 AS last_commit, CAST(regexp_matches(coalesce(text, ''), '(^|[^A-Za-z0-9_$])thered([^A-Za-z0-9_$]|$)') AS INTEGER) AS exact FROM conversations)
        ORDER BY exact DESC, stars DESC, last_commit DESC, repo, path LIMIT 50""",
    "source_health": """WITH o AS (SELECT user_id AS source, max((ts, event_id)) FILTER (event_type = 'view') AS ok_at FROM events GROUP BY user_id),
        s AS (SELECT source, source % 11 <> 0 AS enabled, source % 7 <> 0 AS configured, count(*) FILTER (event_type = 'error' AND (ok_at IS NULL OR (ts, event_id) > ok_at)) AS consecutive, any_value(ok_at) IS NOT NULL AS succeeded FROM events JOIN o ON user_id IS NOT DISTINCT FROM source GROUP BY source)
        SELECT source, CASE WHEN NOT enabled THEN 'off' WHEN NOT configured THEN 'unconfigured' WHEN consecutive >= 3 THEN 'down' WHEN consecutive > 0 THEN 'degraded' WHEN succeeded THEN 'ok' ELSE 'unknown' END AS health FROM s""",
    "context_packing": """WITH f AS (SELECT doc_id AS rid, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position, n_chars AS chars FROM documents), t AS (SELECT *, sum(chars) OVER (ORDER BY position) AS total FROM f)
        SELECT rid, position FROM t WHERE position = 1 OR (position <= 12 AND total <= 60000)""",
    "search_folded": either(search(["mas", "la"]), search(["mas", "la"], any_word=True, weights=True)),
    "search_question": search(["erer"], question=True) + TOP,
    "keyword_or_relaxed": either(search(["the", *LOOSE]), search(LOOSE, any_word=True, weights=True)),
    "search_filtered": search(["the", "of"], extra="AND owner = 'src3' AND lang = 'en' AND sort_at > '2024-02-01' AND size_bucket IN ('medium', 'large')") + TOP.replace("LIMIT 20", "LIMIT 50"),
    "search_mine": search(["the"], seen("u1", ("g1",), ("e1",))) + "SELECT rid, rank, importance, recency FROM (" + TOP.replace("LIMIT 20", "LIMIT 50").replace("recency FROM s", "recency, visibility FROM s") + ") WHERE visibility <> 'public'",
    "site_tier": search(["the", "of", "and"], site=on_site("src3\\.example|and\\.example", "src4\\.example")) + TOP,
    "site_candidates": search(["example", "old"], site=on_site("src1\\.example|src2\\.example", "src3\\.example"), site_only=True) + TOP,
    "search_boilerplate": search(["the"], boilerplate="regexp_matches(summary, '[a-m]$')") + TOP,
    "search_undated": search(["the"], fresh=False) + TOP,
    "search_page_cursor": search(["the", "of"]) + TOP.replace("LIMIT 20", "LIMIT 7 OFFSET 14"),
    "browse_cursor": docs("SELECT rid, sort_at FROM e WHERE exposure = 3 ORDER BY sort_at DESC, rid DESC LIMIT 15 OFFSET 15"),
    "index_search": search(["the", "of"]) + TOP,
    "index_search_signed_in": search(["the", "of"], seen("u1", ("g1",), ("e1",))) + TOP,
    "index_relaxed": either(search(["the", *LOOSE]), search(LOOSE, any_word=True, weights=True)),
    "index_merge": f"WITH {DOCS}, {POSTINGS} SELECT audience, term, count(DISTINCT rid) AS n FROM p WHERE rid % 5 <> 0 GROUP BY audience, term",
    "result_projection": docs(f"SELECT rid, owner, type, id, revision, visibility, title, nullif(summary, '') AS summary, canonical_url, lang, sort_at, index_decision = 'index' AS indexable FROM e WHERE {seen('u1')}"),
    "embedding_upsert": docs("SELECT vec_id AS rid, label + CASE WHEN vec_id % 3 = 0 THEN 1000 ELSE 0 END AS version FROM embeddings WHERE vec_id IN (SELECT rid FROM e WHERE exposure = 3)"),
    "embedding_text": docs("SELECT rid, sha256(substr(concat_ws(chr(10), nullif(title, ''), nullif(summary, ''), nullif(body, '')), 1, 2000)) AS text_hash FROM d"),
    "embedding_batches": docs("SELECT count(*) AS documents, true AS bounded FROM e WHERE exposure = 3"),
    "hybrid_search": search(["the", "of"]) + f""", {near("x.vec_id IN (SELECT rid FROM e WHERE exposure = 3)", "0.3")},
        a AS (SELECT rid, row_number() OVER (ORDER BY rank, importance DESC, recency DESC, rid) AS kr FROM s QUALIFY kr <= 100), v AS (SELECT rid, row_number() OVER (ORDER BY distance, rid) AS vr FROM near),
        u AS (SELECT coalesce(a.rid, v.rid) AS rid, round(coalesce(1.0 / (60 + kr), 0.0) + coalesce(1.0 / (60 + vr), 0.0), 9) AS score, kr, vr FROM a FULL JOIN v ON a.rid = v.rid),
        f AS (SELECT u.*, owner, title, tier0, words0, (type <> 'channel' AND length(title) <= 24 AND length(summary) <= 80) OR title = '' AS thin, row_number() OVER (ORDER BY score DESC, kr ASC NULLS LAST, vr ASC NULLS LAST, u.rid) AS fused FROM u JOIN pt USING (rid)),
        o AS (SELECT *, row_number() OVER (ORDER BY tier0 DESC, words0 DESC, thin, fused) AS place FROM f),
        x AS (SELECT rid, place FROM o QUALIFY row_number() OVER (PARTITION BY lower(owner), lower({spaced('title')}) ORDER BY place) = 1)
        SELECT rid, row_number() OVER (ORDER BY place) AS position FROM x QUALIFY position BETWEEN 21 AND 40""",
    "vector_join": docs(f", {KNN} SELECT e.rid, owner, type, distance FROM e JOIN knn USING (rid) WHERE exposure = 3 AND distance <= 0.95").replace("FROM i) , knn", "FROM i), knn"),
    "beacon_normalised": f"SELECT conv_id, turn, lower({shown('text', 'idiot|scum' + chr(92) + 'w*')}) AS query FROM conversations",
    "trend_visitor_hash": "SELECT event_id, sha256(concat_ws('|', CAST(CAST(ts AS DATE) AS STRING), CAST(user_id AS STRING), event_type))[1:24] AS visitor FROM events",
    "trend_retention": f"WITH {BEACONS} SELECT count(*) AS kept FROM (SELECT DISTINCT hour, site, query FROM b WHERE hour >= 473808)",
    "code_streams": "SELECT 'r' || CAST(conv_id AS STRING) AS repo, 'f' || CAST(turn AS STRING) AS path, conv_id % 9 AS stars, turn + 1 AS line FROM conversations WHERE turn % 4 <> 3",
    "code_grep": "SELECT conv_id, turn, 'a/b' || CAST(conv_id AS STRING) || '.py' AS path, turn AS number, 'x: y' AS text FROM conversations WHERE turn % 3 <> 2",
    "code_fragments": "SELECT doc_id AS rid, CAST(len(string_split(substr(text, 1, instr(text, split_part(text, chr(10), 3)) - 1), chr(10))) AS BIGINT) AS line FROM documents WHERE split_part(text, chr(10), 3) <> ''",
    "code_repos": "SELECT p_name AS full_name, p_partkey AS pushed_at FROM part WHERE p_size % 2 <> 0 ORDER BY p_partkey DESC, p_name LIMIT 20",
    "provider_scores": "SELECT conv_id, turn AS position, round(1 - turn / 8.0, 6)::DOUBLE AS score FROM conversations",
    "source_quota": "SELECT event_id AS call_id FROM (SELECT event_id, user_id % 4 AS source, epoch_us(ts) // 1000 // 600 AS t FROM events) QUALIFY row_number() OVER (PARTITION BY source, floor(t / 60000) ORDER BY t, event_id) <= 3",
    "answer_costs": "SELECT user_id AS answer, count(*) AS steps, count(*) FILTER (event_type <> 'error') AS answered, round(sum(CASE WHEN event_id % 5 <> 0 THEN event_id % 7 / 4 ELSE 0.0 END), 6)::DOUBLE AS cost, max(CASE WHEN event_id % 5 <> 0 THEN value ELSE 0.0 END) AS slowest FROM events GROUP BY user_id",
    "web_filters": f"SELECT page_id FROM pages WHERE (page_id % 4 = 0 OR page_id % 60 >= 29) AND ({HOST} = 'example.com' OR ends_with({HOST}, '.example.com'))",
    "document_errors": docs("""SELECT rid, array_to_string(errors, ',') AS errors FROM (SELECT rid, list_filter([
        CASE WHEN NOT regexp_matches(o, '^[a-z][a-z0-9-]{1,39}$') THEN '/owner malformed' END, CASE WHEN rv < 0 THEN '/revision out of range' END,
        CASE WHEN NOT deleted AND t IS NULL THEN '/title required' END, CASE WHEN NOT deleted AND length(t) > 500 THEN '/title too long' END, CASE WHEN NOT deleted AND length(summary) > 4000 THEN '/summary too long' END,
        CASE WHEN NOT deleted AND length(body) > 48000 THEN '/body too long' END, CASE WHEN NOT deleted AND (length(u) > 2048 OR NOT regexp_matches(u, '^https?://')) THEN '/canonical_url malformed' END], lambda x: x IS NOT NULL) AS errors
        FROM (SELECT *, CASE WHEN rid % 7 = 0 THEN 'Not Ok' ELSE owner END AS o, CASE WHEN rid % 11 = 0 THEN -1 ELSE revision END AS rv, CASE WHEN rid % 13 = 0 THEN 'ftp://x' ELSE canonical_url END AS u, CASE WHEN rid % 17 = 0 THEN NULL ELSE title END AS t FROM d)) WHERE len(errors) > 0"""),
    "document_lookup": docs("SELECT rid, revision FROM d WHERE owner = 'src11' AND type = 'vod' AND id = '151'"),
    "path_identity": docs("SELECT rid, owner = 'src11' AND type = 'vod' AND id = '151' AS same FROM d"),
    "delete_requests": f"WITH {LOG}, t AS (SELECT key, revision FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY revision DESC, deleted DESC, arrival) = 1), q AS (SELECT DISTINCT event_id % 500 AS key, CASE WHEN event_id % 3 = 0 THEN event_id END AS revision FROM events) SELECT key, coalesce(q.revision, t.revision, 0) AS revision, true AS deleted FROM q LEFT JOIN t USING (key)",
    "purge_due": f"WITH {QUEUE}, x AS (SELECT * FROM pq WHERE state = 'pending' AND due_at <= 5000 ORDER BY seq LIMIT 200) SELECT seq, zone, CAST((row_number() OVER (PARTITION BY zone ORDER BY seq) - 1) // 30 AS BIGINT) AS batch FROM x",
    "purge_counts": f"WITH {QUEUE} SELECT state, count(*) AS n, count(*) FILTER (state = 'pending' AND due_at <= 5000) AS due FROM pq GROUP BY state",
    "owner_feed": "SELECT event_id AS seq, user_id FROM events WHERE event_type = 'click' AND event_id > 300 ORDER BY event_id LIMIT 51",
    "removal_reasons": docs("SELECT rid, CASE WHEN deleted THEN 'deleted' WHEN visibility = 'draft' THEN 'draft' WHEN publication_state <> 'published' THEN 'not_published' WHEN visibility <> 'public' THEN 'visibility_changed' ELSE 'noindex' END AS reason FROM e WHERE exposure < 3"),
    "indexed_since": docs("SELECT count(*) AS n FROM e WHERE exposure = 3 AND sort_at > '2024-10-01'"),
    "saved_due": "SELECT event_id AS id FROM events ORDER BY CASE WHEN event_id % 3 = 0 THEN event_id * 31 % 997 ELSE event_id * 17 % 1009 END, event_id LIMIT 25",
    "account_export": f"WITH {SAVED} SELECT hash, created_at FROM u WHERE subject = 'u7'",
    "account_erase": f"WITH {SAVED} SELECT subject, count(*) AS n FROM u WHERE subject NOT IN ('u7', 'u9') GROUP BY subject",
    "outbox_relay": "(SELECT event_id AS id, 'send' AS state FROM events WHERE event_id % 3 = 0 ORDER BY event_id LIMIT 20) UNION ALL SELECT event_id, 'prune' FROM events WHERE event_id % 3 <> 0 AND event_id * 1000 <= 1500000",
    "cache_prune": "SELECT key, value FROM (SELECT event_id % 700 AS key, max(event_id) AS value FROM events GROUP BY 1) WHERE value + 4000 > 12800",
    "saved_notify": """WITH s AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_id * 100 END AS lr, event_id * 50 AS ca FROM events WHERE event_id < 60), m AS (SELECT s.id, count(*) AS n, min(event_id) AS first FROM s JOIN events ON event_id % 60 = s.id AND event_id > coalesce(lr, ca) WHERE s.id % 7 <> 0 GROUP BY s.id)
        SELECT s.id, CASE WHEN s.id % 7 = 0 THEN coalesce(lr, 0) ELSE greatest(coalesce(lr, 0), 20000) END AS last_run_at, n, first FROM s LEFT JOIN m USING (id)""",
    "web_watch": """WITH w AS (SELECT user_id AS watch, list_sort(list_distinct(list(event_type || '-' || CAST(event_id % 7 AS STRING)))) AS urls FROM events GROUP BY user_id), x AS (SELECT *, CASE watch % 5 WHEN 0 THEN [] WHEN 1 THEN urls ELSE list_filter(urls, lambda u: u < 'e') END AS seen FROM w),
        y AS (SELECT *, list_filter(urls, lambda u: NOT list_contains(seen, u)) AS fresh FROM x)
        SELECT watch, CASE WHEN len(seen) = 0 THEN 'baseline' WHEN len(fresh) > 0 THEN 'notified' ELSE 'unchanged' END AS outcome, CASE WHEN len(seen) > 0 THEN array_to_string(fresh, ',') ELSE '' END AS new, least(20, len(fresh) + len(seen)) AS n_seen FROM y""",
    "guarded_casts": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_ms(TIMESTAMP '2024-05-01 10:00:00') END AS at FROM events",
    "cleaned_texts": f"SELECT doc_id AS rid, sha256({cleaned('concat(' + chr(39) + ' ' + chr(39) + ', chr(7), text, chr(133), ' + chr(39) + ' ' + chr(39) + ')')}) AS hash FROM documents",
    "seen_urls": "SELECT page_id, translate(base64(unhex(sha256(url))), '+/', '-_')[1:16] AS seen_key FROM pages",
}
SQL |= {
    "stream_visitors": SQL["trend_visitors"],
    "stream_rate_limit": SQL["rate_limit"],
    "stream_percolate": SQL["saved_percolate"],
    "stream_exposure_feed": f"""WITH {LOG}, t AS (SELECT key, revision, CASE WHEN deleted THEN 0 WHEN content = 'view' THEN 1 ELSE 3 END AS exposure FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY revision DESC, deleted DESC, arrival) = 1)
        SELECT key, revision, 'indexed' AS event, 0 AS previous, exposure FROM t WHERE exposure > 0""",
}


def hmac(c: str, key: bytes) -> str:
    """The definition: two hashes with the padded key."""
    pad = lambda x: "from_hex('" + bytes(b ^ x for b in key.ljust(64, b"\0")).hex() + "')"
    return f"sha256({pad(0x5C)} || from_hex(sha256({pad(0x36)} || encode({c}))))"


SQL |= {
    "envelope_documents": """WITH x AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'bad_signature' WHEN event_type = 'view' THEN 'ignored' WHEN user_id % 4 = 0 THEN 'owner_mismatch' WHEN event_id % 10 = 3 THEN 'subject_mismatch' ELSE 'accepted' END AS outcome, event_type = 'error' AS dead FROM events)
        SELECT outcome, CASE WHEN outcome = 'accepted' THEN dead END AS deleted, count(*) AS n, count(DISTINCT CASE WHEN outcome = 'accepted' THEN event_id % 900 END) AS ids, sum(CASE WHEN outcome = 'accepted' THEN event_id END)::BIGINT AS revisions, min(CASE WHEN outcome = 'accepted' AND NOT dead THEN 'T ' || CAST(event_id AS STRING) END) AS title FROM x GROUP BY ALL""",
    "signatures": f"SELECT conv_id, turn, {hmac('text', b'k1')} AS signature FROM conversations",
    "acl_pairs": docs("SELECT DISTINCT rid, kind, value FROM (SELECT rid, 's' AS kind, subject AS value FROM e WHERE exposure = 1 UNION ALL SELECT rid, 's', 'u' || CAST(rid % 3 AS STRING) FROM e WHERE exposure = 1 UNION ALL SELECT rid, 'g', grp FROM e WHERE exposure = 1 AND rid % 4 <> 0 UNION ALL SELECT rid, 'e', entitlement FROM e WHERE exposure = 1)"),
    "acl_sets_visible": docs("SELECT rid FROM e WHERE exposure = 1 AND CASE WHEN visibility = 'private' THEN (subject = 'u2' OR rid % 3 = 2) ELSE (subject = 'u2' OR rid % 3 = 2 OR (rid % 4 <> 0 AND grp = 'g1') OR entitlement = 'e1') END"),
    "facet_map_pairs": docs("SELECT DISTINCT rid, key, value FROM (SELECT rid, 'tag' AS key, 't' || CAST(rid % 7 AS STRING) AS value FROM e WHERE exposure > 0 UNION ALL SELECT rid, 'tag', 't' || CAST(rid % 5 AS STRING) FROM e WHERE exposure > 0 UNION ALL SELECT rid, 'lang', lang FROM e WHERE exposure > 0) WHERE value IS NOT NULL"),
}
