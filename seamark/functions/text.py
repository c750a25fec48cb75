"""Query and document text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that lexical queries drop.
LEXICAL_STOPS = """a an the in on at to for of with by from as and or but is are was were be have has had do does did how what where
when why which find show get list""".split()
#: Words that late-interaction terms drop.
TERM_STOPS = """a an the is are was were be been being have has had do does did will would could should may might must shall to of in
for on with at by from as into through during before after above below between and but or nor so yet both either neither not only own
same than too very just also this that these those i me my we our you your he she it they them their what which who whom where when why
how""".split()
#: What is trimmed from a query word, and characters for which a term is quoted.
TRIMMED, QUOTED = ".,?!\"'`:;()[]{}*", r'[\^*"():\-]'
#: Intents in the order in which they are tried, and questions about the repository itself.
INTENTS = (
    ("example", r"(?i)\b(example|sample|demo|usage|show\s+me)\b"),
    ("procedural", r"(?i)\b(how\s+to|implement|handle|process|manage|create|make|build)\b"),
    ("definition", r"(?i)\b(type|interface|struct|class|enum|definition|define|what\s+is)\b"),
)
META = r"(?i)\b(what\s+(does|is)\s+(this|the)\s+(repo|repository|project|codebase)|about\s+(this|the)\s+(repo|project)|purpose\s+of\s+(this|the)|overview|introduction)\b"
#: Fixed value: terms of a query.
MAX_TERMS = 8


def words(text: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Runs of letters and decimal digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    """The larger of a quarter of the bytes and 1.3 times the words."""
    by_words = F.floor(F.size(words(text)) * F.lit(1.3).cast("double")).cast("int")
    return F.greatest(F.floor(F.octet_length(text) / 4).cast("int"), by_words)


def estimate_words(text: Column) -> Column:
    return F.floor(F.size(words(text)) * F.lit(1.3).cast("double")).cast("int")


def cost(n_tokens: Column, per_million: float = 3.0) -> Column:
    return n_tokens / 1e6 * per_million


def quote_term(term: Column) -> Column:
    return F.when(term.rlike(QUOTED), F.concat(F.lit('"'), F.replace(term, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(term)


def bare_terms(query: Column) -> Column:
    """Words of a lexical query: trimmed, of 2 bytes or more, no stop words; in order, with repetitions."""
    trimmed = F.transform(words(F.lower(query)), lambda w: F.btrim(w, F.lit(TRIMMED)))
    return F.filter(trimmed, lambda w: (F.octet_length(w) >= 2) & ~w.isin(LEXICAL_STOPS))


def search_terms(query: Column, all_of_them: bool = False) -> Column:
    """A lexical match expression: terms joined by OR, or by a space where all must occur."""
    return F.array_join(F.transform(bare_terms(query), quote_term), " " if all_of_them else " OR ")


def query_terms(query: Column, most: int = MAX_TERMS) -> Column:
    """Late-interaction terms: the whole query, then single words of a short query, or word pairs and words of a longer one."""
    q, w = F.trim(query), tokens(query)
    stop = lambda x: x.isin(TERM_STOPS)
    single = lambda least: F.filter(w, lambda x: (F.octet_length(x) > least) & ~stop(x))
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(~(stop(a) & stop(b)), F.concat_ws(" ", a, b)))
    longer = F.concat(F.filter(pairs, lambda x: x.isNotNull()), single(3))
    terms = F.concat(F.array(q), F.when(F.size(w) <= 3, single(2)).otherwise(longer))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(terms), 1, most))


def intent(query: Column) -> Column:
    out = F.when(query.rlike(INTENTS[0][1]), F.lit(INTENTS[0][0]))
    for name, pattern in INTENTS[1:]:
        out = out.when(query.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("conceptual"))


def is_meta_query(query: Column) -> Column:
    return query.rlike(META)


def truncate_at_boundary(text: Column, most: int) -> Column:
    """At most `most` characters: cut at the last line end beyond three quarters, else at the last space beyond half, else hard."""
    head = F.substring(text, 1, most)
    line_end = F.length(head) - F.locate("\n", F.reverse(head))
    space = F.length(head) - F.locate(" ", F.reverse(head))
    has = lambda c: F.locate(c, head) > 0
    cut = F.when(has("\n") & (line_end > F.floor(F.lit(most) * 3 / 4)), F.substring(head, F.lit(1), line_end)).when(has(" ") & (space > F.floor(F.lit(most) / 2)), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(cut)


def truncate_to_tokens(text: Column, n_tokens: int = 128) -> Column:
    """For an embedder: 3 characters a token."""
    return truncate_at_boundary(text, 3 * n_tokens)


#: Shares of the text that are tried again when an embedder refuses it.
RETRY_RATIOS = (0.75, 0.65, 0.55, 0.45, 0.35, 0.3)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def short_hash(text: Column, digits: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def format_bytes(n: Column) -> Column:
    """B below 1024, then one decimal of KB, MB, GB, TB."""
    out = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for i, unit in enumerate(("KB", "MB", "GB")):
        out = out.when(n < 1024 ** (i + 2), F.format_string(f"%.1f {unit}", F.bround(n / float(1024 ** (i + 1)), 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(n / float(1024**4), 1)))


def pattern_words(query: Column) -> Column:
    """Words of 3 bytes or more for a plain pattern search."""
    return F.filter(F.split(query, "[ ?.,;]+"), lambda w: F.octet_length(w) >= 3)
