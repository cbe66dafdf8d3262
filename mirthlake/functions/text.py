"""Text functions as column expressions; only Unicode decomposition needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P

ENTITIES = [("&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def words_of(c: Column) -> Column:
    """Runs of a-z and 0-9 in small letters."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def lexical_tokens(c: Column) -> Column:
    """Words of two characters or more that aren't stop words; repeated words stay."""
    stop = F.array(*[F.lit(w) for w in P.LEXICAL_STOP])
    return F.filter(words_of(F.coalesce(c, F.lit(""))), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def simple_name(c: Column) -> Column:
    """Small letters, everything but a-z and 0-9 one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def decode_entities(c: Column) -> Column:
    """Decimal, hexadecimal and the five named entities, of any letter case, each once."""
    def one(m: Column) -> Column:
        low = F.lower(m)
        body = F.regexp_replace(low, "^&#?|;$", "")
        code = F.when(low.startswith("&#x"), F.conv(F.substring(body, 2, 8), 16, 10).cast("bigint")).when(low.startswith("&#"), F.expr("try_cast(null as bigint)")).otherwise(F.expr("try_cast(null as bigint)"))
        code = F.when(low.startswith("&#x"), code).when(low.startswith("&#"), body.try_cast("bigint"))
        char = F.when((code > 0) & (code < 1114112), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        named = F.lit(None).cast("string")
        for name, value in ENTITIES:
            named = F.when(low == name, F.lit(value)).otherwise(named)
        return F.coalesce(char, named, m)

    entity = r"(?i)&(?:#\d{1,7}|#x[0-9a-f]{1,6}|amp|apos|quot|lt|gt);"
    parts = F.split(c, entity, -1)
    found = F.regexp_extract_all(c, F.lit(entity), F.lit(0))
    return F.when(F.size(found) == 0, c).otherwise(F.concat(parts[0], F.array_join(F.transform(found, lambda m, i: F.concat(one(m), F.element_at(parts, i + 2))), "")))


@F.pandas_udf(StringType())
def decomposed(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    def one(t):
        if t is None or t.isascii():
            return t
        return "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))

    return s.map(one, na_action="ignore")


def full_name(c: Column) -> Column:
    """Entities decoded, decomposed without marks, small letters, a-z and 0-9 with single blanks."""
    return simple_name(decomposed(decode_entities(F.coalesce(c, F.lit("")))))


def slug(c: Column, most: int = 48) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.substring(s, 1, most)


def strict_keys(name: Column, aliases: Column | None = None) -> Column:
    """Distinct full names of a record and its aliases."""
    names = F.array(name) if aliases is None else F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    return names


def loose_key(normalised: Column) -> Column:
    """Distinct name words in order, without words that say nothing; null if none is left."""
    plain = F.array(*[F.lit(w) for w in P.BOILERPLATE])
    ws = F.array_sort(F.array_distinct(F.filter(F.split(normalised, " "), lambda w: (w != "") & ~F.array_contains(plain, w))))
    return F.when(F.size(ws) > 0, F.array_join(ws, " "))


def canonical_url(c: Column, image: bool = False) -> Column:
    """One form of a URL: no fragment, host in small letters without www., no default port, no tracking (or size) parameters, parameters sorted, single slashes. What isn't a URL stays, trimmed."""
    c = F.trim(c)
    scheme, host = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))), F.try_parse_url(c, F.lit("HOST"))
    authority = F.try_parse_url(c, F.lit("AUTHORITY"))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    port = F.when((port == "") | (scheme == "https") & (port == "443") | (scheme == "http") & (port == "80"), "").otherwise(F.concat(F.lit(":"), port))
    drop = r"(?i)^(?:utm_[^=]*|fbclid|gclid" + (r"|format|h|height|q|quality|w|width" if image else "") + r")(?:=|$)"
    query = F.try_parse_url(c, F.lit("QUERY"))
    kept = F.array_sort(F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: (p != "") & ~p.rlike(drop)))
    path = F.regexp_replace(F.regexp_replace(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), "/{2,}", "/"), "/$", "")
    path = F.when(path == "", "/").otherwise(path)
    full = F.concat(scheme, F.lit("://"), F.regexp_replace(F.lower(host), r"^www\.", ""), port, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(c.isNull() | (c == ""), "").otherwise(F.coalesce(full, c))


def is_https(c: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))) == "https", F.lit(False))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def title_case(c: Column) -> Column:
    """First character of each run of word characters in capitals, the rest as it is."""
    runs = F.regexp_extract_all(c, F.lit(r"\w+|\W+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), "")


def quoted_items(c: Column) -> Column:
    """Distinct items of a list written as ['a', 'b']."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"'([^']*)'"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != ""))


def clean_caption(c: Column, most: int = 400) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("[INTER_FRAME_SEP]"), F.lit(" ")), r"\s+", " ")
    return F.substring(F.trim(F.regexp_replace(c, "^[-_.,:;]+|[-_.,:;]+$", "")), 1, most)


def sentence(c: Column) -> Column:
    """Trimmed, without < and >, with a mark at the end; empty stays empty."""
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[<>]", "")
    return F.when(t == "", "").when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))


def usable_tag(c: Column) -> Column:
    """A tag in plain form, or null if it is too long or says nothing."""
    v = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), "[^a-z0-9 -]+", " "), r"\s+", " "))
    bad = (v == "") | (F.length(v) > 30) | (F.size(F.split(v, " ")) > 3) | v.rlike(P.PLACEHOLDER) | v.isin(*P.TAG_NOISE, *P.TAG_DROP)
    return F.when(~bad, v)


def repaired_tags(tags: Column, more: Column, most: int = 6, least: int = 3) -> Column:
    """Usable tags of two lists, distinct, most at most; padded by fallbacks to least."""
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(tags, empty), F.coalesce(more, empty))
    kept = F.slice(F.array_distinct(F.filter(F.transform(both, usable_tag), lambda t: t.isNotNull())), 1, most)
    fallback = F.array(*[F.lit(t) for t in P.TAG_FALLBACK])
    padded = F.slice(F.array_distinct(F.concat(kept, fallback)), 1, least)
    return F.when(F.size(kept) >= least, kept).otherwise(padded)


def repaired_field(kind: str, value: Column, name: Column, tags: Column) -> Column:
    """A generated text, or its stock form if it breaks the rule of its kind."""
    one, two = tags[0], tags[1]
    stock = {
        "message": F.concat(F.lit("Use "), name, F.lit(" when "), one, F.lit(" collides with "), two, F.lit(", and that mismatch becomes the point of the conversation.")),
        "relational_pattern": F.concat(name, F.lit(" frames "), one, F.lit(" against "), two, F.lit(", turning the contrast into a concise social reaction.")),
        "example_context": F.concat(F.lit("For example, send "), name, F.lit(" when a conversation moves from "), one, F.lit(" to "), two, F.lit(" and everyone notices the mismatch.")),
        "near_miss_context": F.concat(F.lit("Avoid "), name, F.lit(" when the situation lacks both "), one, F.lit(" and "), two, F.lit("; the image would suggest the wrong relationship.")),
    }[kind]
    v = F.replace(sentence(value), F.concat(F.lit("<"), name, F.lit(">")), name)
    start = {"message": F.startswith(v, F.concat(F.lit("Use "), name, F.lit(" when"))), "relational_pattern": F.lit(True), "example_context": F.startswith(v, F.lit("For example,")), "near_miss_context": F.startswith(v, F.lit("Avoid"))}[kind]
    ok = start & (word_count(v) >= (8 if kind == "relational_pattern" else 10)) & ~v.rlike(P.PLACEHOLDER)
    return F.when(ok, v).otherwise(stock)


def comparable(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def repaired_explanation(reason: Column, name: Column) -> Column:
    """Names the image, ends with a mark and has eight words at least."""
    r = F.trim(reason)
    bare = F.regexp_replace(r, "[.!?]+$", "")
    named = F.when(~F.contains(comparable(r), comparable(name)), F.concat(name, F.lit(" fits because "), F.lower(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 30))).otherwise(r)
    ended = F.when(named.rlike("[.!?]$"), named).otherwise(F.concat(named, F.lit(".")))
    out = F.when(word_count(ended) < 8, F.concat(F.regexp_replace(ended, "[.!?]+$", ""), F.lit(", matching this specific social situation."))).otherwise(ended)
    return F.when((r == "") | name.isNull(), r).otherwise(out)


def complete_explanation(reason: Column, name: Column) -> Column:
    r = F.trim(reason)
    n = word_count(r)
    ok = n.between(8, 40) & ~r.rlike(P.GENERIC_EXPLANATION) & r.rlike("^[A-Z0-9]") & r.rlike("[.!?]$") & F.contains(comparable(r), comparable(name))
    return F.coalesce(ok, F.lit(False))


def semantic_text(name: Column, message: Column, pattern: Column, tags: Column) -> Column:
    """What is embedded for the meaning of a record; tags that are generic or a word of the name are left out, and so are null parts."""
    own = F.split(F.lower(name), "[^a-z0-9]+")
    generic = F.array(*[F.lit(t) for t in P.GENERIC_TAGS])
    plain = lambda t: F.trim(F.lower(t))
    kept = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: (plain(t) != "") & ~F.array_contains(generic, plain(t)) & ~F.array_contains(own, plain(t)))
    line = lambda head, c: F.concat(F.lit(head), c)
    return F.concat_ws("\n", line("Meme: ", name), line("Meaning: ", message), line("Social dynamic: ", pattern), F.when(F.size(kept) > 0, line("Tags: ", F.array_join(kept, ", "))))


def example_text(name: Column, example: Column, pattern: Column) -> Column:
    """What is embedded for the use of a record."""
    line = lambda head, c: F.concat(F.lit(head), c)
    return F.concat_ws("\n", line("Meme: ", name), line("Send it when: ", example), line("Underlying pattern: ", pattern))


def semantic_tokens(c: Column) -> Column:
    """Distinct words of more than two characters that aren't semantic stop words, sorted."""
    stop = F.array(*[F.lit(w) for w in P.SEMANTIC_STOP])
    return F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))))


def plain_letters(c: Column) -> Column:
    """Every character beyond ASCII as ~, so that word boundaries are those of ASCII letters on any Java."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "~")


def serious(c: Column) -> Column:
    c = plain_letters(c)
    return c.rlike(P.HELP_SEEKING) | c.rlike(P.HIGH_RISK) | c.rlike(P.SUPPORT_REQUEST) | c.rlike(P.SERIOUS_TOPIC)


def factual(c: Column) -> Column:
    c = plain_letters(c)
    return c.rlike(P.FACTUAL_REQUEST) & c.rlike(P.FACTUAL_DOMAIN)


def several_perspectives(c: Column) -> Column:
    o = plain_letters(F.regexp_replace(c, P.QUOTED, " "))
    return o.rlike(P.NARRATOR) & (o.rlike(P.DIRECT_PRONOUN) | o.rlike(P.AGENTIVE_THEY) | o.rlike(P.AGENTIVE_THEM) | o.rlike(P.OBSERVED_ACTION) | o.rlike(P.ROLE))


def first_category(c: Column, otherwise: str = "reaction") -> Column:
    c, out = plain_letters(c), None
    for name, pattern in P.CATEGORIES:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(otherwise)
