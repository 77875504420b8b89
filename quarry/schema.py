"""Fixed schema of an index document, limits, exposure levels and the ranking profile."""

from __future__ import annotations

import time
from dataclasses import dataclass

# What identities look like, and the limits of a document.
OWNER, TYPE, ID = r"^[a-z][a-z0-9-]{1,39}$", r"^[a-z][a-z0-9_]{1,39}$", r"^[A-Za-z0-9][A-Za-z0-9._:~-]{0,127}$"
LANGUAGE, FACET_KEY = r"^[a-zA-Z]{2,3}(-[A-Za-z0-9]{2,8})*$", r"^[a-z][a-z0-9_]{0,39}$"
MAX_TITLE, MAX_SUMMARY, MAX_BODY, MAX_URL = 500, 4000, 48000, 2048
NONE, RESTRICTED, UNLISTED, LISTED = 0, 1, 2, 3

DOCUMENT = (
    "owner string, type string, id string, revision long, visibility string, acl struct<subjects:array<string>,groups:array<string>,entitlements:array<string>>, canonical_url string, title string, summary string, body string, "
    "facets map<string,array<string>>, language string, authorship string, provenance array<struct<service:string,type:string,id:string,revision:long,label:string,url:string,retrieved_at:string,stub:boolean>>, "
    "publication_state string, published_at string, updated_at string, indexability struct<decision:string,reasons:array<string>>, deleted boolean"
)

# The words that open a question, and the function words that a question or a relaxed query drops.
QUESTION_WORDS = ("how", "what", "why", "when", "where", "which", "who", "can", "do", "does", "is", "are", "should", "will")
FUNCTION_WORDS = QUESTION_WORDS + ("could", "would", "did", "was", "were", "be", "i", "me", "my", "we", "our", "you", "your", "it", "its", "a", "an", "the", "to", "of", "in", "on", "for", "with", "from", "and", "or", "there", "this", "that", "get", "make")


@dataclass(frozen=True)
class Viewer:
    """Who asks: nobody, or a subject with groups and entitlements."""

    subject: str | None = None
    groups: tuple[str, ...] = ()
    entitlements: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    """Weights of the ranking; all of them parameters of the operators."""

    title: float = 1.0
    summary: float = 0.4
    body: float = 0.1
    freshness: float = 1.0
    half_life_days: float = 30.0
    thin: float = -2.0
    answer: float = 50.0
    answer_type: str = "article"
    cover: tuple[float, float, float] = (1.0, 0.6, 0.3)
    #: a channel whose summary ends like this has no relevance but by its title
    boilerplate: str | None = None
    #: the clock that freshness is measured by, in ms since 1970; none: the hour that has begun
    now: int | None = None

    def clock(self) -> int:
        return self.now if self.now is not None else int(time.time()) // 3600 * 3_600_000


@dataclass(frozen=True)
class Sites:
    """A network of sites: the word that names it, the host of another word, hosts by word where they differ, and the help site with pages under /a/<host>/."""

    brand: str
    template: str = "{word}.{brand}"
    aliases: tuple[tuple[str, tuple[str, ...]], ...] = ()
    help_host: str | None = None


@dataclass(frozen=True)
class Filters:
    """What a search is held to; identity never comes from here."""

    owner: str | None = None
    type: str | None = None
    language: str | None = None
    since: str | None = None
    facets: tuple[tuple[str, tuple[str, ...]], ...] = ()
    subject: str | None = None


@dataclass(frozen=True)
class Match:
    """A parsed query: words, whether the last is a prefix, the field it is held to, any word or all, and question form."""

    words: tuple[str, ...]
    prefix: bool = False
    field: int | None = None
    any: bool = False
    question: bool = False
