"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}]"
#: Letters that ASCII-only case folding covers.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only; other letters keep theirs."""
    return F.translate(c, _UPPER, _LOWER)


def sanitize(c: Column, most: int = 500) -> Column:
    """Without control characters but tab and line ends, trimmed, then cut to ``most``. Null gives ''."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.substring(F.regexp_replace(F.coalesce(clean, F.lit("")), rf"^{_SPACE}+|{_SPACE}+$", ""), 1, most)


def strip_mention(c: Column, username: str | None = None) -> Column:
    """Without the mentions of a name; if none is known or nothing is left, without any
    mention; if nothing is left then, the text itself."""
    some = lambda x: F.when(F.trim(x) != "", F.trim(x))
    found = [some(F.regexp_replace(c, rf"(?i)@\Q{username}\E\b", ""))] if username else []
    return F.coalesce(*found, some(F.regexp_replace(c, r"@\w+", "")), c)


def strip_words(c: Column, words: list[str]) -> Column:
    """Each word taken out of the lower-cased text in turn, so that earlier words win; trimmed."""
    c = F.lower(c)
    for w in words:
        c = F.replace(c, F.lit(w), F.lit(""))
    return F.trim(c)


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_")


def html_to_text(c: Column, most: int = 5000) -> Column:
    """Without scripts, styles and tags; white space collapsed; cut to ``most``."""
    c = F.regexp_replace(c, r"(?s)<script[^>]*>.*?</script>", "")
    c = F.regexp_replace(c, r"(?s)<style[^>]*>.*?</style>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " ")
    return F.substring(F.trim(c), 1, most)


def query_words(c: Column, longer_than: int = 2) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) > longer_than)


def or_query(c: Column) -> Column:
    return F.array_join(query_words(c), " OR ")


def display_name(first: Column, last: Column, username: Column, user_id: Column) -> Column:
    """Names joined, else the user name, else the id. Empty strings count as absent."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(some(F.concat_ws(" ", some(first), some(last))), some(username), user_id.cast("string"))


def large_url(c: Column) -> Column:
    """The large form of a photo's address: of the first size that it names; null if it is none."""
    out = None
    for size in ("square", "small", "medium", "original"):
        hit, new = c.contains(f"/{size}."), F.replace(c, F.lit(f"/{size}."), F.lit("/large."))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return F.when(c.startswith("http"), out.otherwise(c))


def redirect_target(c: Column) -> Column:
    """The decoded ``uddg`` parameter of a redirect, or the address itself."""
    found = F.regexp_extract(c, r"[?&]uddg=([^&]+)", 1)
    return F.when(found == "", c).otherwise(F.url_decode(found))


def pieces(c: Column, size: int = 4000) -> Column:
    """The text in pieces of ``size`` characters; an empty text has none."""
    n = F.ceil(F.length(c) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def class_map(c: Column) -> Column:
    """``a:b,c:d`` as a map of trimmed names; entries without a colon are left out, later ones win."""
    entries = F.filter(F.split(c, ","), lambda e: e.contains(":"))
    pair = lambda e: F.struct(F.trim(F.substring_index(e, ":", 1)), F.trim(F.substring(e, F.instr(e, ":") + 1, F.length(e))))
    names = F.transform(entries, lambda e: F.trim(F.substring_index(e, ":", 1)))
    last = F.filter(F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: ~F.array_contains(F.slice(names, x["i"] + 2, F.size(names)), F.trim(F.substring_index(x["e"], ":", 1))))
    return F.map_from_entries(F.transform(last, lambda x: pair(x["e"])))


def mentioned(text: Column, entities: Column, username: str) -> Column:
    """Whether an entity of type mention is the name, in any case. Only entities count, not the text."""
    hit = lambda e: (e["type"] == "mention") & (F.lower(F.substring(text, e["offset"] + 1, e["length"])) == f"@{username.lower()}")
    return F.coalesce(F.exists(entities, hit), F.lit(False))


def contains_any(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(c), w))


def like_folded(c: Column, query: Column) -> Column:
    """``LIKE '%query%'`` with ASCII case folding; wildcards in the query keep their meaning."""
    return F.like(ascii_lower(c), F.concat(F.lit("%"), ascii_lower(query), F.lit("%")))


def is_thumb(c: Column) -> Column:
    return c.rlike(r"(?i)_thumb(?:\s*\(\d+\))?\.jpg$")


def is_photo_ref(c: Column) -> Column:
    return c.startswith("photos/") & F.lower(c).endswith(".jpg") & ~is_thumb(c)


def has_suffix(c: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether the path ends in one of the suffixes, in any case. Which ones count differs by step."""
    return F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1)).isin(*suffixes)


def page_number(c: Column) -> Column:
    """Order of export pages: the first page has no number, other files come last."""
    n = F.regexp_extract(c, r"messages(\d*)\.html$", 1)
    return F.when(c.rlike(r"messages\.html$"), 1).when(n != "", F.try_to_number(n, F.lit("999999999")).cast("int")).otherwise(999999)
