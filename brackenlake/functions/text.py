"""Text to terms: analysis, identifiers, paths, headings, vocabulary; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def analyse(text: Column) -> Column:
    """Lower-case runs of letters and digits of at most 40 bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= 40))


def split_identifier(name: Column) -> Column:
    """Parts of a camel, Pascal, snake or kebab name in order, then the name itself; lower case, distinct."""
    parts = F.regexp_replace(name, r"([a-z][^A-Za-z_-]*)([A-Z])", "$1 $2")
    parts = F.regexp_replace(parts, r"([A-Z][^a-z_ -]*)([^a-z_ -])([a-z])", "$1 $2$3")
    words = F.filter(F.split(F.lower(parts), "[_ -]+"), lambda t: t != "")
    return F.array_distinct(F.concat(words, F.array(F.lower(name))))


#: A word that is split as an identifier, and how one shows in a whole text.
_COMPOSED = "_|[a-z][^_]*[A-Z]|[A-Z].*[A-Z].*[a-z]"
_ANY_COMPOSED = r"_|[a-z][\p{L}\p{N}]*[A-Z]|[A-Z][\p{L}\p{N}]*[A-Z][\p{L}\p{N}]*[a-z]"


def preprocess(content: Column) -> Column:
    """Each word in lower case with the parts of its identifier, if it has several; texts without such words are only split."""
    words = F.filter(F.split(content, r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    parts = lambda w: F.concat(F.array(F.lower(w)), F.filter(split_identifier(w), lambda p: p != F.lower(w)))
    each = F.flatten(F.transform(words, lambda w: F.when(w.rlike(_COMPOSED), parts(w)).otherwise(F.array(F.lower(w)))))
    return F.when(content.rlike(_ANY_COMPOSED), each).otherwise(F.transform(words, F.lower))


def path_tokens(path: Column) -> Column:
    parts = F.filter(F.split(path, r"[/\\._-]+"), lambda t: t != "")
    return F.array_distinct(F.flatten(F.transform(parts, split_identifier)))


def title(text: Column) -> Column:
    """The first heading of one or two # signs, or ''."""
    return F.trim(F.regexp_extract(text, r"(?m)^[ \t]*#{1,2} +(.+)$", 1))


def headings(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("#"))
    return F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.trim(x), "^#+", ""))), " ")


def query_tokens(query: Column) -> Column:
    """Distinct words of letters, digits and _ in lower case, of two bytes or more, without stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(query), "[^a-z0-9_]+"), lambda t: (F.octet_length(t) >= 2) & ~t.isin(V.STOP_WORDS)))


def canonical(term: Column) -> Column:
    low = F.lower(term)
    plural = (F.octet_length(low) >= 4) & low.endswith("s") & ~low.endswith("ss") & ~low.endswith("us")
    return F.when(plural, F.substr(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def expand(terms: Column, most: int = 20) -> Column:
    """Terms with the synonyms of their canonical forms, sorted, at most so many."""
    table = F.create_map(*[x for k, v in V.SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(table[canonical(t)], F.array().cast("array<string>"))))
    return F.slice(F.sort_array(F.array_union(terms, more)), 1, most)


def token_estimate(text: Column) -> Column:
    """A token count without a tokenizer: bytes / 4 or words * 1.3, whichever is more."""
    words = F.size(F.filter(F.split(text, r"[ \t\n\r\x0B\f]+"), lambda t: t != ""))
    return F.greatest(F.floor(F.octet_length(text) / 4), F.floor(words * 1.3)).cast("long")


def is_test_query(query: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(query), "[^a-z0-9]+"), F.array(*map(F.lit, V.TEST_TERMS)))


def any_of(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def _intent_rules(has, both) -> list:
    """(intent, condition) in order, from what tells that one phrase of a list occurs and what joins conditions by and, or."""
    p = {k: both("and", has(v[0]), has(v[1])) if isinstance(v, tuple) else has(v) for k, v in V.INTENT_PHRASES.items()}
    configured = both("or", p["configure"], p["workspace"])
    return [
        ("Testing", both("or", p["testing"], p["tested"], p["test package"], p["are tested"])),
        ("Procedural", both("or", p["how"], p["how add"])),
        ("Debugging", p["debug"]),
        ("Architecture", both("and", configured, p["organised"])),
        ("Configuration", configured),
        ("Structural", p["structural"]),
        ("Navigation", p["place"]),
        ("Architecture", both("or", p["organised"], p["architecture"])),
        ("Implementation", p["build"]),
        ("Testing", p["running"]),
    ]


def intent(query: Column) -> Column:
    """One of nine intents; the first rule that holds decides."""
    q = F.lower(query)

    def both(how: str, *conditions: Column) -> Column:
        out = conditions[0]
        for c in conditions[1:]:
            out = out & c if how == "and" else out | c
        return out

    out = None
    for name, condition in _intent_rules(lambda phrases: any_of(q, *phrases), both):
        out = F.when(condition, F.lit(name)) if out is None else out.when(condition, F.lit(name))
    return out.otherwise("Informational")


def intent_sql(q: str) -> str:
    has = lambda phrases: "(" + " OR ".join(f"contains({q}, '{x}')" for x in phrases) + ")"
    both = lambda how, *c: "(" + f" {how.upper()} ".join(c) + ")"
    return "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for name, c in _intent_rules(has, both)) + " ELSE 'Informational' END"


# --- queries ---------------------------------------------------------------------------------------


def search_terms(query: Column) -> Column:
    """Terms of a search request: words without stop words, each split as an identifier, with their aliases; distinct, in order.

    Without any the words as they stand, or the request itself if it has none.
    """
    plain = F.regexp_replace(query, r"[:+\-()\"~*?\\^]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda t: t != "")
    bare = F.filter(F.transform(words, lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")), lambda t: (F.octet_length(t) >= 2) & ~F.lower(t).isin(V.STOP_WORDS))
    aliases = F.create_map(*[x for k, v in V.QUERY_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    parts = lambda t: F.concat(F.filter(split_identifier(t), lambda p: F.octet_length(p) >= 2), F.coalesce(aliases[F.lower(t)], F.array().cast("array<string>")))
    found = F.array_distinct(F.flatten(F.transform(bare, parts)))
    return F.when(F.size(found) > 0, found).when(F.size(words) > 0, words).otherwise(F.array(query))


def sanitise(query: Column) -> Column:
    """A request as terms joined by OR; a request without terms stays as it is, without special characters."""
    terms = search_terms(query)
    plain = F.trim(F.regexp_replace(F.regexp_replace(query, r"[:+\-()\"~*?\\^]", " "), r"\s+", " "))
    joined = F.array_join(terms, " OR ")
    none = F.size(F.filter(F.split(plain, " "), lambda t: (F.octet_length(F.regexp_replace(t, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")) >= 2) & ~F.lower(F.regexp_replace(t, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")).isin(V.STOP_WORDS))) == 0
    return F.when(~none, joined).when(plain != "", plain).otherwise(query)


def scan_pattern(query: Column) -> Column:
    """A regular expression of any of a request's words; a request of stop words alone stands for itself, letter by letter."""
    words = F.transform(F.filter(F.split(query, r"\s+"), lambda t: t != ""), lambda t: F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}_]", "")))
    kept = F.filter(words, lambda t: (F.octet_length(t) >= 2) & ~t.isin(V.SCAN_STOP_WORDS))
    literal = F.regexp_replace(query, r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\$1")
    return F.when(F.size(kept) > 0, F.array_join(kept, "|")).otherwise(literal)


def expanded_query(query: Column) -> Column:
    """The expanded terms joined by OR if they are more than the query's tokens, else null: there is nothing to add."""
    tokens = query_tokens(query)
    more = expand(tokens)
    return F.when((F.size(tokens) > 0) & (F.size(more) > F.size(tokens)), F.array_join(more, " OR "))


def preview(payload: Column, most: int) -> Column:
    """A text on one line, cut after so many characters with the number of those left out."""
    line = F.replace(F.replace(payload, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\n"))
    cut = F.concat(F.substr(line, F.lit(1), F.lit(most)), F.lit("… (+"), (F.length(line) - most).cast("string"), F.lit(" chars)"))
    return F.when(F.length(line) <= most, line).otherwise(cut)


def within_limit(text: Column, most: int = 100 * 1024) -> Column:
    return F.octet_length(text) <= most


def wants_enumeration(query: Column) -> Column:
    return any_of(F.lower(query), *V.ENUMERATION_WORDS)


def title_boost(title_: Column, tokens: Column) -> Column:
    """1 to 2, by the share of tokens that a title holds."""
    matched = F.size(F.filter(tokens, lambda t: F.contains(F.lower(title_), t)))
    return F.when((F.size(tokens) == 0) | (title_ == ""), 1.0).otherwise(1 + matched / F.greatest(F.size(tokens), F.lit(1)))
