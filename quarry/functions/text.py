"""Text functions: folding, tokens, query parsing, hosts and keys of URLs."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.schema import FUNCTION_WORDS, QUESTION_WORDS, Match

TOKEN = r"[\p{L}\p{N}]+"


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """NFKD without combining marks, NFC: Spark has no Unicode normalisation of its own."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.category(c).startswith("M"))))


def _icu(method: str, c: Column, compatible: bool) -> Column:
    """ICU's decomposition or composition of a text that is not null; Spark carries the library for its collations."""
    return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), c, F.lit(compatible))


def nfkc(c) -> Column:
    """The compatibility form of a text, composed; null is empty."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_icu("compose", text, True))


def folded(c) -> Column:
    """Lower case without marks, in compatibility form, on the JVM: what fold() gives, of all of Unicode. Texts of ASCII take the short way."""
    text = F.coalesce(c, F.lit(""))
    bare = F.regexp_replace(_icu("decompose", text, True), r"\p{M}+", "")
    return F.lower(F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_icu("compose", bare, False)))


def tokens(c) -> Column:
    return F.regexp_extract_all(folded(c), F.lit(TOKEN), F.lit(0))


def parse_query(q: str, most: int = 16, field: int | None = None) -> Match:
    """Words of a query; a trailing * makes the last a prefix; a question keeps its content words."""
    text = unicodedata.normalize("NFKC", q).lower()
    text = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M")))
    words = tuple(re.findall(r"[^\W_]+", text)[:most])
    match = Match(words, text.rstrip().endswith("*"), field)
    if field is None and len(words) >= 2 and words[0] in QUESTION_WORDS:
        content = tuple(w for w in words if w not in FUNCTION_WORDS)
        if content:
            return Match(content, match.prefix and content[-1] == words[-1], None, False, True)
    return match


def relaxed(match: Match) -> Match:
    """Any of the query's content words (all words, if it has none)."""
    content = tuple(w for w in match.words if w not in FUNCTION_WORDS) or match.words
    return Match(content, match.prefix and content[-1] == match.words[-1], match.field, True, match.question)


def host(url) -> Column:
    """Lower-case host of an http(s) URL, without port."""
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def url_key(url) -> Column:
    """What makes two web results one: the URL as browsers write it, without the fragment and one closing slash; null for none."""
    bare = F.regexp_replace(url, r"#.*$", "")
    origin = F.lower(F.regexp_extract(bare, r"^([Hh][Tt][Tt][Pp][Ss]?://[^/?]*)", 1))
    host_ = F.regexp_replace(F.regexp_replace(origin, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.substring(bare, F.char_length(origin) + 1, F.lit(1 << 30))
    rest = F.when(rest.startswith("/") | (origin == ""), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.regexp_replace(F.concat(host_, rest), r"/$", "")


def clean(c) -> Column:
    """Control characters to spaces, white space to one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), r"\s+", " "))


def clean_text(c) -> Column:
    """Control characters but tab and line end removed, trimmed; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""), r"^\s+|\s+$", "")


def hmac_sha256(c, key: bytes) -> Column:
    """Hex HMAC of a text's bytes, from the built-in hash."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(c, "UTF-8")), 256))), 256)


def parse_time(c) -> Column:
    """Milliseconds since 1970 of an ISO-8601 text, null where it is none; a text without a zone is in UTC, whatever the session's is."""
    zoned = F.when(c.rlike(r"(?i)(Z|[+-]\d\d:?\d\d)$") & (F.char_length(c) > 10), c).when(F.char_length(c) == 10, F.concat(c, F.lit("T00:00:00Z"))).otherwise(F.concat(c, F.lit("Z")))
    return F.unix_millis(F.try_to_timestamp(zoned))


def encode_cursor(**parts) -> str:
    return base64.urlsafe_b64encode(json.dumps(parts, sort_keys=True, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, query_hash: str) -> dict:
    """The parts of a cursor; refused when it was issued for another query."""
    try:
        parts = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("malformed cursor") from e
    if not isinstance(parts, dict) or parts.get("h") != query_hash:
        raise ValueError("cursor of another query")
    return parts
