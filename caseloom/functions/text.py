"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers, year patterns and labels of date lines.
PLACEHOLDERS = ("CITATION_SUPPRESSED", "REFERENCE_SUPPRESSED", "FRAGMENT_SUPPRESSED")
SCOPE_YEAR = r"\b(18\d{2}|19\d{2}|200\d|201\d|202[0-6])\b"
CASE_YEAR = r"\b(18\d{2}|19\d{2}|20\d{2}|2100)\b"
DATE_LINES = (
    r"(?imd)^\s*Date\s*:\s*(.+)$",
    r"(?imd)^\s*Date of Judgment\s*:\s*(.+)$",
    r"(?imd)^\s*Judgment Rendered\s*:\s*(.+)$",
    r"(?imd)^\s*Released\s*:\s*(.+)$",
    r"(?imd)^\s*Heard(?:\s*:\s*|\s*/\s*Judgment rendered\s*:\s*)(.+)$",
)
NEUTRAL_CITATIONS = (
    r"\[(18\d{2}|19\d{2}|20\d{2}|2100)\]\s*[A-Z]{1,8}[A-Za-z\-]*\s*\d+",
    r"\b(18\d{2}|19\d{2}|20\d{2}|2100)\s+(?:FC|FCA|SCC|QCCA|BCCA|ONCA|ABCA|SKCA|MBCA|NBCA|NSCA|PECA|CanLII)\b",
    r"\((?:[^\n\)]*?;\s*)?(18\d{2}|19\d{2}|20\d{2}|2100)\s+[A-Z]{2,10}\s+\d+\)",
)
DATE_KEYS = ("date", "date_of_judgment", "judgment_rendered", "judgment rendered", "released", "hearing_date", "heard", "decision_date", "judgment_date")
DATE_KEY_PARTS = ("judgment", "released", "decision_date", "hearing")
HEADER_LINES, FRONT_CHARS = 120, 12_000
#: White space as Python knows it: Unicode's, and the four separators.
SPACE = r"(?U)[\s\x1C-\x1F]"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def flattened(c: Column) -> Column:
    """Runs of white space become one space; none at the ends. Null becomes empty."""
    return stripped(F.regexp_replace(or_empty(c), rf"{SPACE}+", " "))


def placeholder_count(c: Column, token: str) -> Column:
    """Whole-word occurrences of a marker in raw text; 0 for null."""
    return F.regexp_count(or_empty(c), F.lit(rf"(?U)\b{token}\b")).cast("int")


def clean_text(c: Column) -> Column:
    """White space flattened and markers, bracketed or not, replaced by a space."""
    one_line = F.translate(or_empty(c), "\t\r\n", "   ")
    spaced = reduce(lambda t, token: F.replace(F.replace(t, F.lit(f"<{token}>"), F.lit(" ")), F.lit(token), F.lit(" ")), PLACEHOLDERS, one_line)
    return flattened(spaced)


def years(c: Column, pattern: str = CASE_YEAR) -> Column:
    return F.transform(F.regexp_extract_all(or_empty(c), F.lit(pattern), F.lit(1)), lambda y: y.cast("int"))


def max_year(c: Column, pattern: str = SCOPE_YEAR) -> Column:
    """Largest year in a text, 0 without one: the year of scope building."""
    return F.coalesce(F.array_max(years(c, pattern)), F.lit(0))


def _first_year(c: Column, pattern: str, group: int) -> Column:
    """Largest year of the first match that holds one."""
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), lambda m: F.array_max(years(m)))
    return F.get(F.filter(found, lambda y: y.isNotNull()), F.lit(0))


def header(c: Column) -> Column:
    return F.array_join(F.slice(F.split(or_empty(c), LINE_BREAK), 1, HEADER_LINES), "\n")


def metadata_year(metadata: Column) -> Column:
    """struct(year, source) of the first entry of a map whose name is that of a date and whose value holds a year (its largest); null without any."""
    name = lambda e: F.replace(F.lower(stripped(e["key"])), F.lit("-"), F.lit("_"))
    dated = lambda e: name(e).isin(*DATE_KEYS) | name(e).rlike("|".join(DATE_KEY_PARTS))
    found = F.transform(F.filter(F.map_entries(metadata), dated), lambda e: F.struct(F.array_max(years(e["value"])).alias("year"), F.concat(F.lit("metadata:"), e["key"]).alias("source")))
    return F.get(F.filter(found, lambda x: x["year"].isNotNull()), F.lit(0))


def case_year(c: Column, metadata: Column | None = None, patterns: bool = False) -> Column:
    """struct(year, source): the year of a case by priority. With ``patterns`` the source of the first two tiers of the text ends in ":" and the pattern.

    Dates of the metadata (a map of strings) if given. Date lines of the header, then neutral citations there, then the most frequent year of the front of the text (the
    larger of equally frequent ones), then the largest year anywhere; -1 and "missing" without any.
    """
    top = header(c)
    explicit = [("header_explicit", p, _first_year(top, p, 1)) for p in DATE_LINES]
    neutral = [("neutral_citation", p, _first_year(top, p, 0)) for p in NEUTRAL_CITATIONS]
    front = years(F.substring(or_empty(c), 1, FRONT_CHARS))
    counted = F.transform(F.array_distinct(front), lambda y: F.struct(F.size(F.filter(front, lambda x: x == y)).alias("n"), y.alias("y")))
    mode = F.array_max(counted)["y"]
    anywhere = F.array_max(years(c))
    shown = lambda tier, p: f"{tier}:{p.replace('(?imd)', '(?im)')}" if patterns else tier
    tiers = (*((shown(tier, p), y) for tier, p, y in (*explicit, *neutral)), ("front_regex", mode), ("fallback_global_max", anywhere))
    pick = [F.when(y.isNotNull(), F.struct(y.alias("year"), F.lit(source).alias("source"))) for source, y in tiers]
    given = [] if metadata is None else [metadata_year(metadata)]
    return F.coalesce(*given, *pick, F.struct(F.lit(-1).alias("year"), F.lit("missing").alias("source")))


def summary(c: Column) -> Column:
    """Text between "Summary:" and the last line break before "- Topic"; null where there is none to be had.

    None: no "Summary:"; "no summary" or the notice of a summary in preparation anywhere; more than 20 line breaks; blank.
    Without "- Topic", or without a line break before it, the slice ends one character short of the text.
    """
    at = F.instr(c, "Summary:")
    rest = F.substring(c, at + 8, F.length(c))
    found = F.instr(rest, "- Topic")
    upto = F.when(found > 0, F.substring(rest, F.lit(1), found - 1)).otherwise(F.substring(rest, F.lit(1), F.length(rest) - 1))
    last = F.length(upto) - F.instr(F.reverse(upto), "\n")
    cut = F.when(F.instr(upto, "\n") > 0, F.substring(upto, F.lit(1), last)).otherwise(F.substring(rest, F.lit(1), F.length(rest) - 1))
    text = stripped(cut)
    usable = (at > 0) & ~F.contains(c, F.lit("no summary")) & ~F.contains(c, F.lit("for this document are in preparation."))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(usable & (breaks <= 20) & (text != ""), text)


def corpus_text(c: Column) -> Column:
    """Lines joined without a separator, as the training corpus is indexed: words at line ends merge."""
    return F.regexp_replace(or_empty(c), r"\r\n|\n|\r", "")


def query_text(c: Column, threshold: int = 30_000, length: int = 10_000) -> Column:
    """Lines stripped, blank ones dropped, joined without a separator; a text beyond the threshold keeps its first characters."""
    lines = F.transform(F.split(or_empty(c), r"\r\n|\n|\r"), lambda line: stripped(F.replace(line, F.lit("\t"), F.lit(" "))))
    text = F.array_join(lines, "")
    return F.when(F.length(text) > threshold, F.substring(text, 1, length)).otherwise(text)


def truncated_query(c: Column, max_terms: int = 900, max_chars: int = 10_000) -> Column:
    """The first characters, then the first terms; terms are joined by one space only where some are dropped. 0: no limit."""
    text = F.substring(or_empty(c), 1, max_chars) if max_chars > 0 else or_empty(c)
    terms = F.split(stripped(text), rf"{SPACE}+")
    return F.when(F.size(terms) > max_terms, F.array_join(F.slice(terms, 1, max_terms), " ")).otherwise(text) if max_terms > 0 else text


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null and blank texts."""
    return F.when(flattened(c) == "", 0).otherwise(F.size(F.split(flattened(c), " ")))


def line_breaks(c: Column) -> Column:
    return F.length(or_empty(c)) - F.length(F.replace(or_empty(c), F.lit("\n"), F.lit("")))


def tokens(c: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """The analyzer: lower case, split at everything but letters and digits."""
    found = F.filter(F.split(F.lower(or_empty(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by a space. Shifted slices are zipped: a lambda over positions would make the words anew for each."""
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), count)
    for i in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(i + 1), count), lambda a, b: F.concat_ws(" ", a, b))
    return out


def entailment_text(c: Column, markers: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """Task-2 text: line breaks to spaces, markers removed, words joined by one space."""
    text = F.replace(or_empty(c), F.lit("\n"), F.lit(" "))
    return flattened(reduce(lambda t, m: F.replace(F.replace(t, F.lit(f"<{m}>"), F.lit("")), F.lit(m), F.lit("")), markers, text))


def relevance_prompt(query: Column, document: Column) -> Column:
    return F.concat(F.lit("Query:"), query, F.lit("Document:"), document, F.lit("Relevant:"))


def with_summary(text: Column, summary_: Column) -> Column:
    """The summary set before a text that has none of its own."""
    return F.when(~F.contains(text, F.lit("Summary:")) & summary_.isNotNull(), F.concat(F.lit("Summary:\n"), summary_, F.lit("\n"), text)).otherwise(text)
