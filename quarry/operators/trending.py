"""Query analytics over beacons: hourly counts, people, rising queries, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import nfkc


def hourly(beacons: DataFrame) -> DataFrame:
    return beacons.groupBy("hour", "site", "query").agg(F.count("*").alias("n"))


def visitors(beacons: DataFrame) -> DataFrame:
    """Distinct people of each query and day (exact: a small threshold is decided on it)."""
    return beacons.groupBy("day", "query").agg(F.countDistinct("visitor").alias("people"))


def rising(beacons: DataFrame, now_hour: int, site: str | None = None, least_people: int = 5, limit: int | None = None) -> DataFrame:
    """(query, shown, recent, before, people, score, rising), best first, of queries that enough people searched.

    people is counted over all sites, the last two days; shown: the greatest of the forms it was typed in; rising: whether more
    often in the last day than in one of the two days before.
    """
    shown = F.max("shown") if "shown" in beacons.columns else F.max("query")
    here = beacons.where(F.col("site") == site) if site else beacons
    recent, before = F.col("hour") >= now_hour - 24, (F.col("hour") >= now_hour - 72) & (F.col("hour") < now_hour - 24)
    counts = here.where(F.col("hour") >= now_hour - 72).groupBy("query").agg(shown.alias("shown"), F.count_if(recent).alias("recent"), F.count_if(before).alias("before"))
    people = beacons.where(F.col("day") >= now_hour // 24 - 1).groupBy("query").agg(F.countDistinct("visitor").alias("people"))
    score = F.round(F.col("recent") * F.log2(2 + F.col("recent") / (F.col("before") / 2 + 1)), 6)
    rows = counts.join(people, "query", "left").where((F.col("recent") > 0) & (F.coalesce("people", F.lit(0)) >= least_people)).select("query", "shown", "recent", "before", "people", score.alias("score"), (F.col("recent") > F.col("before") / 2).alias("rising"))
    rows = rows.orderBy(F.desc("score"), F.desc("recent"), "query")
    return rows.limit(limit) if limit else rows


def rising_counts(trends: DataFrame, visitors: DataFrame, now_hour: int, site: str | None = None, least_people: int = 5, limit: int | None = None) -> DataFrame:
    """What rising() gives, from hourly counts (hour, site, query, shown, n) and the people of each day (day, query, visitor)."""
    here = trends.where(F.col("site") == site) if site else trends
    sum_if = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    recent, before = F.col("hour") >= now_hour - 24, F.col("hour") < now_hour - 24
    counts = here.where(F.col("hour") >= now_hour - 72).groupBy("query").agg(F.max("shown").alias("shown"), sum_if(recent).alias("recent"), sum_if(before).alias("before"))
    people = visitors.where(F.col("day") >= now_hour // 24 - 1).groupBy("query").agg(F.countDistinct("visitor").alias("people"))
    score = F.round(F.col("recent") * F.log2(2 + F.col("recent") / (F.col("before") / 2 + 1)), 6)
    rows = counts.join(people, "query").where((F.col("recent") > 0) & (F.col("people") >= least_people)).select("query", "shown", "recent", "before", "people", score.alias("score"), (F.col("recent") > F.col("before") / 2).alias("rising"))
    rows = rows.orderBy(F.desc("score"), F.desc("recent"), "query")
    return rows.limit(limit) if limit else rows


def site_of(origin: Column, given: Column, sites: list[str]) -> Column:
    """The site a search speaks for: its origin's host where that is one of the sites, else the given one; without www; null for none."""
    known = {s.lower().removeprefix("www.") for s in sites}
    host = lambda c: F.regexp_replace(F.lower(F.when(c.contains("://"), F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)).otherwise(c)), r"^www\.", "")
    one = lambda c: F.when(host(c).isin(*known), host(c))
    return F.coalesce(one(origin), one(given))


def by_day(beacons: DataFrame) -> DataFrame:
    return beacons.groupBy("day").agg(F.count("*").alias("n"))


def by_site(beacons: DataFrame, most: int = 40) -> DataFrame:
    return beacons.groupBy("site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "site").limit(most)


def clean_title() -> Column:
    """A title as a search: its first part, and without a closing part in brackets."""
    first = F.regexp_extract("title", r"^(.*?)(?:\s+[|—·–-]\s+.*)?$", 1)
    return F.trim(F.regexp_replace(first, r"\s*[(\[][^)\]]*[)\]]?\s*$", ""))


def suggestions(docs: DataFrame, hour: int, newest: int = 200, most: int = 8, site: str | None = None, taken: tuple[str, ...] = (), banned: tuple[str, ...] = ()) -> DataFrame:
    """(query, key): titles of the newest listed documents (of a site) in the form searches are counted in, under the same rules; less those taken.

    Each form once, as its newest title shows it, in an order that changes by the hour and is the same for all.
    """
    listed = docs.where((F.col("exposure") == 3) & F.char_length("title").between(3, 48))
    listed = listed.where(F.col("canonical_url").startswith(f"https://{site}/")) if site else listed
    pool = listed.orderBy(F.desc("sort_at"), F.desc("rid")).limit(newest)
    titles = pool.select("sort_at", "rid", shown_query(clean_title(), banned).alias("query")).where("query is not null").withColumn("key", F.lower("query"))
    once = titles.where(~F.col("key").isin(*taken)).groupBy("key").agg(F.max_by("query", F.struct("sort_at", "rid")).alias("query"))
    return once.orderBy(F.sha2(F.concat(F.lit(f"{hour}|"), "key"), 256)).limit(most).select("query", "key")


# What may not be counted: personal data, and words that never trend.
PERSONAL = (r"\S+@\S+\.\S+", r"(?:\+?\d[\s().-]*){7,}", r"\d{6,}", r"(?i)\b(?:https?://|www\.)\S+", r"\b[A-Za-z0-9_-]{24,}\b")


def counted_query(c: Column, banned: tuple[str, ...] = ()) -> Column:
    """The form a query is counted under: shown_query() in lower case."""
    return F.lower(shown_query(c, banned))


def shown_query(c: Column, banned: tuple[str, ...] = ()) -> Column:
    """A query as it is shown: compatibility form, single spaces, no edge punctuation; null where it may not count."""
    edge = "[\\s\"'`.,;:!?()\\[\\]{}<>-]+"
    shown = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(nfkc(c), r"[\x00-\x1f\x7f]", " "), r"\s+", " ")), f"^{edge}|{edge}$", "")
    ok = F.char_length(shown).between(2, 80) & (F.size(F.split(shown, " ")) <= 8)
    for pattern in (*PERSONAL, *((rf"(?i)\b({'|'.join(banned)})\b",) if banned else ())):
        ok = ok & ~shown.rlike(pattern)
    return F.when(ok, shown)


def visitor_hash(salt: Column, address: Column, agent: Column) -> Column:
    """A visitor of a day: nothing links it to another day, whose salt differs."""
    return F.substring(F.sha2(F.concat_ws("|", salt, address, agent), 256), 1, 24)


def trending_list(beacons: DataFrame, docs: DataFrame, now_hour: int, site: str | None = None, limit: int = 10) -> DataFrame:
    """(query, suggested, rising, place): the site's own rising queries, filled with the network's, then with suggestions; limit is 1 to 20."""
    limit = max(1, min(20, limit))
    own = rising(beacons, now_hour, site, limit=limit) if site else rising(beacons, now_hour, limit=limit).where("false")
    lists = [own.withColumn("source", F.lit(0)), rising(beacons, now_hour, limit=limit).withColumn("source", F.lit(1))]
    both = lists[0].unionByName(lists[1]).select(F.lower("shown").alias("key"), F.col("shown").alias("query"), "rising", "source", F.struct(-F.col("score"), -F.col("recent"), "shown").alias("at"))
    w = Window.partitionBy("key").orderBy("source")
    people = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").orderBy("source", "at").limit(limit)
    taken = tuple(r.key for r in people.select("key").collect())  # at most 20
    more = suggestions(docs, now_hour, most=limit, site=site, taken=taken).select("key", "query", F.lit(None).cast("boolean").alias("rising"), F.lit(2).alias("source"), F.struct(F.lit(0.0).alias("a"), F.lit(0).cast("long").alias("b"), F.sha2(F.concat(F.lit(f"{now_hour}|"), "key"), 256).alias("c")).alias("at"))
    every = people.select("key", "query", "rising", "source", F.struct(F.col("at.col1").alias("a"), F.col("at.col2").alias("b"), F.col("at.shown").alias("c")).alias("at")).unionByName(more)
    place = F.row_number().over(Window.orderBy("source", "at"))
    return every.withColumn("place", place).where(F.col("place") <= limit).select("query", (F.col("source") == 2).alias("suggested"), "rising", "place")


LIMITED = "visitor string, event_id long, us long, allowed boolean, until long, n long"


def _windows(per_window: int, micros: int):
    """Arrow batches (visitor, event_id, us, until, n), by visitor and time, -> LIMITED; a row with until is a window that is open before the rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        who, until, n = None, 0, 0  # the window that the last row of the last batch left
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("visitor").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            opened = batch.column("until").is_valid().to_numpy(zero_copy_only=False)
            t = batch.column("us").to_numpy(zero_copy_only=False).astype(np.int64)
            size = len(t)
            new = np.ones(size, bool)
            new[1:] = names[1:] != names[:-1]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            # what each visitor's rows meet: nothing, a window from before, or what the last batch left
            had_until, had_n = np.full(len(first), np.iinfo(np.int64).min), np.zeros(len(first), np.int64)
            marks = np.flatnonzero(opened)
            had_until[group[marks]], had_n[group[marks]] = batch.column("until").take(pa.array(marks)).to_numpy(), batch.column("n").take(pa.array(marks)).to_numpy()
            if batch.column("visitor")[0].as_py() == who:
                had_until[0], had_n[0] = until, n
            real = ~opened
            rows = np.flatnonzero(real)
            if len(rows):
                g, at = group[rows], t[rows]
                inside = at < had_until[g]  # these count in the window that is open
                begin = np.concatenate([[True], g[1:] != g[:-1]])
                place = np.arange(len(rows))
                order = place - np.maximum.accumulate(np.where(begin, place, 0))
                roots = ~inside & (begin | np.concatenate([[True], inside[:-1]]))
                # where the next window would begin if one began here; then which rows are reached from the first ones
                low, wide = int(at.min()), int(at.max() - at.min()) + micros + 1
                if wide * (int(g.max()) + 1) < 1 << 62:
                    key = at - low + g.astype(np.int64) * wide
                    step = np.searchsorted(key, key + micros)
                else:
                    step = np.concatenate([x[0] + np.searchsorted(at[x], at[x] + micros) for x in np.split(place, np.flatnonzero(begin)[1:])])
                end = len(rows)
                over = np.append(g, -1)[np.minimum(step, end)] != g  # behind a visitor's last window comes another visitor
                reached, jump = np.append(roots, False), np.append(np.where(over, end, step), end)
                while (jump[:end] < end).any():
                    reached[jump[np.flatnonzero(reached)]] = True
                    jump = jump[jump]
                reached = reached[:-1] & ~inside
                start = np.maximum.accumulate(np.where(reached, place, -1))
                count = np.where(inside, had_n[g] + order + 1, place - start + 1)
                ends = np.where(inside, had_until[g], at[np.maximum(start, 0)] + micros)
                yield pa.RecordBatch.from_arrays([batch.column("visitor").take(pa.array(rows)), batch.column("event_id").take(pa.array(rows)), pa.array(at), pa.array(count <= per_window), pa.array(ends), pa.array(count)], ["visitor", "event_id", "us", "allowed", "until", "n"])
                until, n = (int(ends[-1]), int(count[-1])) if g[-1] == group[-1] else (int(had_until[-1]), int(had_n[-1]))
            else:
                until, n = int(had_until[-1]), int(had_n[-1])
            who = batch.column("visitor")[size - 1].as_py()

    return run


def limited(searches: DataFrame, per_window: int = 20, seconds: int = 60, opened: DataFrame | None = None) -> DataFrame:
    """searches (visitor, event_id, us) -> the same with allowed, and the window (until, n) that each leaves behind.

    A visitor may search so often in a window, which the first search after the last window opens. opened (visitor, until, n):
    windows from before. Rows are sorted by visitor and time; where windows begin is found for all rows of an Arrow batch at once,
    by doubling jumps, and of a visitor one window is carried on, however many searches there are.
    """
    nothing = F.lit(None).cast("long")
    rows = searches.select(F.col("visitor").cast("string").alias("visitor"), "event_id", "us", nothing.alias("until"), nothing.alias("n"))
    if opened is not None:
        rows = rows.unionByName(opened.select("visitor", F.lit(-1).cast("long").alias("event_id"), F.lit(0).cast("long").alias("us"), "until", "n"))
    return rows.repartition("visitor").sortWithinPartitions("visitor", F.col("until").isNull(), "us", "event_id").mapInArrow(_windows(per_window, seconds * 1_000_000), LIMITED)


def rate_limited(beacons: DataFrame, per_window: int = 20, seconds: int = 60) -> DataFrame:
    """The searches a visitor is allowed: the rows of limited(), with all their columns."""
    found = limited(beacons.select("visitor", "event_id", F.unix_micros("ts").alias("us")), per_window, seconds)
    return beacons.join(found.where("allowed").select("event_id"), "event_id", "left_semi")


# How many days each kind of row is kept.
LIFETIMES = {"trends": 8, "visitors": 2, "salts": 1, "telemetry": 14}


def living(rows: DataFrame, kind: str, now_hour: int) -> DataFrame:
    """The rows of a kind that are still kept: trends by their hour, the others by their day."""
    days = LIFETIMES[kind]
    return rows.where(F.col("hour") >= now_hour - 24 * days) if kind == "trends" else rows.where(F.col("day") >= now_hour // 24 - days)


def retained(rows: DataFrame, now_hour: int, days: int = 8) -> DataFrame:
    return rows.where(F.col("hour") >= now_hour - 24 * days)
