"""Text operators as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.config import DEFAULTS, Settings

# Words that carry no meaning in a question.
STOP_WORDS = (
    "about", "after", "amount", "and", "are", "company", "does", "exact", "filings",
    "from", "have", "into", "is", "its", "of", "or", "please", "show", "tell", "that",
    "the", "their", "there", "this", "what", "when", "where", "which", "with", "would",
)
# Running headers that look like headings.
HEADING_NOISE = (
    "table of contents",
    "united states securities and exchange commission",
    "schedule 14a information",
    "your vote is important",
    "your vote is important!",
)
ITEM_HEADING = r"(?i)^Item\s+\d+[A-Z0-9]*\."
TICKER = r"^[A-Z0-9][A-Z0-9.\-]{0,9}$"
#: Unicode white space; Java's \s alone misses the no-break space.
SPACE = r"(?U)\s+"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), SPACE, " "))


def clean(c: Column) -> Column:
    """Zero-width and no-break spaces as spaces, runs of white space as one, ends trimmed."""
    return collapse(F.translate(text_or_empty(c), "​ ", "  "))


def terms(c: Column) -> Column:
    """Every meaningful term of a text, in order and with repeats: lower case, one plural s off."""
    raw = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9]+"), F.lit(0))
    means = lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS)
    stem = lambda t: F.when(t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.filter(F.transform(F.filter(raw, means), stem), means)


def term_set(c: Column) -> Column:
    return F.array_distinct(terms(c))


def slug(section: Column) -> Column:
    s = F.regexp_replace(F.lower(text_or_empty(section)), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", "document").otherwise(s)


def chunk_id(accession: Column, section: Column, index: Column) -> Column:
    number = text_or_empty(accession)
    return F.concat_ws(":", F.when(number == "", "no-accession").otherwise(number), slug(section), index.cast("string"))


def normalize_quote(c: Column) -> Column:
    """Typographic quotes and dashes as plain ones, white space collapsed, lower case."""
    return F.lower(collapse(F.translate(text_or_empty(c), "’‘“”–—−", "''\"\"---")))


def strip_html(c: Column) -> Column:
    """The markup-free text of raw HTML: scripts and styles out, tags as spaces, entities as they are."""
    out = text_or_empty(c)
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]+>"):
        out = F.regexp_replace(out, pattern, " ")
    return collapse(out)


def sentence_windows(c: Column, limit: int = DEFAULTS.max_chunk_chars) -> Column:
    """Windows of at most ``limit`` characters that end with sentences where they can.

    A sentence joins the open window if both fit, or begins the next; one longer than the limit is cut, each cut
    but the last being a window and the last one open. What is carried along the sentences is the length of the open window and
    where windows begin; texts are put together once, from slices.
    """
    text = text_or_empty(c)
    pieces = lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0)))
    marked = lambda p: F.transform(p, lambda x, i: F.struct(x.alias("text"), F.length(x).alias("n"), (i < F.size(p) - 1).alias("whole")))
    units = F.flatten(F.transform(F.split(text, r"(?<=[.!?])(?U)\s+"), lambda s: marked(pieces(s))))
    # A length past the limit makes the next unit begin a window.
    empty = F.struct(F.array().cast("array<int>").alias("begins"), F.lit(0).alias("i"), F.lit(limit).alias("n"))

    def step(state, unit):
        begins = state["n"] + unit["n"] + 1 > limit
        length = F.when(begins, unit["n"]).otherwise(state["n"] + unit["n"] + 1)
        return F.struct(
            F.when(begins, F.array_append(state["begins"], state["i"])).otherwise(state["begins"]).alias("begins"),
            (state["i"] + 1).alias("i"), F.when(unit["whole"], limit).otherwise(length).alias("n"),
        )

    def windows(units):
        begins = F.aggregate(units, empty, step, lambda s: F.arrays_zip(s["begins"].alias("a"), F.array_append(F.slice(s["begins"], 2, F.size(s["begins"])), s["i"]).alias("b")))
        return F.transform(begins, lambda s: F.array_join(F.transform(F.slice(units, s["a"] + 1, s["b"] - s["a"]), lambda u: u["text"]), " "))

    # Bound by a lambda: what stands in a lambda otherwise is worked out anew for each window.
    found = F.transform(F.array(units), windows)[0]
    # Of white space at the end the text of the last sentence is empty; it is no window of its own.
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.filter(found, lambda w: w != ""))


def is_item_heading(c: Column) -> Column:
    return text_or_empty(c).rlike(ITEM_HEADING)


def is_caps_heading(c: Column, tag: Column, settings: Settings = DEFAULTS) -> Column:
    """A heading in capitals outside of table cells, long enough to be one and not page furniture."""
    text = text_or_empty(c)
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    upper = F.regexp_count(text, F.lit(r"\p{Lu}"))
    bare = F.lower(F.regexp_replace(text, "^[ .:]+|[ .:]+$", ""))
    return (
        ~F.coalesce(tag, F.lit("")).isin("td", "th")
        & (F.length(text) <= settings.max_heading_chars)
        & ~bare.isin(*HEADING_NOISE)
        & (F.size(F.split(F.trim(text), r"(?U)\s+")) >= settings.min_heading_words)
        & (letters >= settings.min_heading_letters)
        & (upper / letters >= settings.min_uppercase_ratio)
    )


def normalize_ticker(c: Column) -> Column:
    return F.upper(F.regexp_replace(text_or_empty(c), r"(?U)^\s+|\s+$", ""))


def is_ticker(c: Column) -> Column:
    return normalize_ticker(c).rlike(TICKER)


def metadata_value(c: Column) -> Column:
    """Scalars as strings, null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def why_it_matters(section: Column, question: Column) -> Column:
    """A plain-English reason to inspect the evidence; the first rule that matches."""
    text = F.lower(F.concat_ws(" ", text_or_empty(section), text_or_empty(question)))
    has = lambda *words: F.greatest(*(text.contains(w) for w in (*words, words[0])))
    return (
        F.when(has("risk"), WHY["risk"])
        .when(has("business", "product", "customer"), WHY["business"])
        .when(has("financial", "revenue", "cash"), WHY["financial"])
        .otherwise(WHY["default"])
    )


# Texts shown to readers.
WHY = {
    "risk": "Risks can affect future results, cash needs, and how predictable the business is.",
    "business": "Understanding how the company makes money is the starting point for judging its prospects.",
    "financial": "This helps you evaluate the company’s financial performance and ability to fund operations.",
    "default": "Read the cited filing section to verify the statement in the company’s own words.",
}
UNSUPPORTED_ANSWER = "I don't see this disclosed in the filings available for this company."
TRY_BROADER = "Try a broader question or add more filings before drawing a conclusion."
NOT_ANSWERED = "The filing text retrieved for this question does not answer it."
FAILURES = (
    ("quota", "daily free-tier quota reached"),
    ("rate", "rate limited"),
    ("down", "the model is temporarily unavailable"),
    ("key", "the API key was rejected"),
    ("missing", "the configured model was not found"),
    ("other", "the generation service could not be reached"),
)


def describe_failure(error: Column) -> Column:
    """A service's error as something a reader can act on; the first rule that matches."""
    text = text_or_empty(error)
    says = dict(FAILURES)
    return (
        F.when(text.contains("PerDay") | F.lower(text).contains("per day"), says["quota"])
        .when(text.contains("429") | text.contains("RESOURCE_EXHAUSTED"), says["rate"])
        .when(text.contains("503") | text.contains("UNAVAILABLE"), says["down"])
        .when(text.rlike("401|403|API key|PERMISSION"), says["key"])
        .when(text.rlike("404|NOT_FOUND"), says["missing"])
        .otherwise(says["other"])
    )


def percent(part: Column, whole: Column) -> Column:
    """Share in per cent to no decimals, or n/a."""
    return F.when(whole == 0, "   n/a").otherwise(F.concat(F.lpad(F.bround(part / whole * 100, 0).cast("long").cast("string"), 5, " "), F.lit("%")))
