"""Column functions over markup, secrets and identifiers; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character references that texts of the supported sources hold (fixed values); numbered ones besides.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·"}
NUMBERED = {"&#x2F;": "/", "&#x27;": "'", "&#39;": "'", "&#47;": "/", "&#34;": '"'}
#: Names by which secrets are given away in messages (fixed values).
SECRET_NAMES = r"(?i)\b(api[_-]?key|token|secret|password)\s*([:=])\s*([^\s,\"'}\]]+)"


def decode_references(text: Column) -> Column:
    """Character references decoded once: the ampersand last, so that nothing is decoded twice."""
    for name, char in {**NUMBERED, **NAMED}.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def one_line(html: Column) -> Column:
    """Markup as one line of text: scripts and styles gone, ends of blocks as spaces, other tags without a trace."""
    text = decode_references(html)
    text = F.regexp_replace(text, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", " ")
    text = F.regexp_replace(text, r"(?i)</(?:p|div|section|article|li|ul|ol|h[1-6]|tr|table|blockquote|pre)[^>]*>|<br\s*/?>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\s+", " "))


def discussion_text(html: Column) -> Column:
    """Markup of discussion posts: paragraphs as blank lines, a link as its label with the address unless one tells the other."""
    link = r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>([^<]*)</a>'
    # a label that is empty, cut short or the beginning of the address says nothing more than the address
    told = F.regexp_replace(html, r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(?:\s*|\1|[^<]*\.\.\.)</a>', "$1")
    shown = F.regexp_replace(told, link, "$2 ($1)")
    text = decode_references(F.regexp_replace(F.regexp_replace(shown, "(?i)<p>", "\n\n"), "<[^>]*>", ""))
    paragraphs = F.transform(F.split(text, "\n{2,}"), lambda p: F.trim(F.regexp_replace(p, "[ \t]+", " ")))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def redact_urls(text: Column) -> Column:
    """Credentials, query and fragment taken out of every address in the text."""
    bare = F.regexp_replace(text, r"(https?://)[^\s\"'<>/@?#]*@", "$1")
    return F.regexp_replace(bare, r"(https?://[^\s\"'<>?#]*)[?#][^\s\"'<>]*", "$1")


def redact(text: Column) -> Column:
    """Addresses redacted, and values that look like secrets."""
    out = F.regexp_replace(redact_urls(text), r"(?i)\bBearer\s+[^\s\"']+", "Bearer [REDACTED]")
    return F.regexp_replace(F.regexp_replace(out, r"\bsk-[A-Za-z0-9_-]+\b", "[REDACTED]"), SECRET_NAMES, "$1$2[REDACTED]")


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of ASCII text, in hexadecimal digits."""
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(0x01000193), F.lit(1 << 32))
    hashed = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0x811C9DC5).cast("bigint"), step)
    return F.lower(F.hex(hashed))


def fallback_id(*parts: Column) -> Column:
    """An identifier for an entry that has none, from those of its parts that are not empty."""
    kept = F.filter(F.array(*parts), lambda p: F.coalesce(p != "", F.lit(False)))
    return F.concat(F.lit("entry-"), fnv1a(F.when(F.size(kept) == 0, F.lit("unidentified")).otherwise(F.array_join(kept, "\u0000"))))


def media_type(content_type: Column) -> Column:
    """The media type without parameters, in lower case; null stays null."""
    return F.lower(F.trim(F.split(content_type, ";")[0]))


def iso_time(value: Column) -> Column:
    """A full or partial date in one of the customary forms as UTC time; null if it is none."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd", "yyyy-MM", "yyyy", "d MMM yyyy")
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(form)) for form in forms])
