"""Column builders over text: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import KINDS, SYMBOL_ROOTS, Config

# Words without meaning for a code search, and the question shapes that need several sources.
SEARCH_STOPWORDS = (
    "a an the is are was were be to of in on for how do does did i you it what when where why which that this "
    "with and or from can could should my me use using implement implemented implementation work works"
).split()
MAX_SEARCH_TERMS = 12
SYMBOL_PATTERN = r"[A-Za-z_][\w.]*[._][\w.]*[A-Za-z0-9_]"
LOOP_SHAPES = (
    r"\b(what|which)\b.{0,60}\b(exist|are there|are available|are supported|does .{0,30}(support|offer|provide)|can i (use|choose))\b",
    r"\blist (all|the|every)\b",
    r"\ball (the|of the|available)\b.{0,40}\b(options|kinds|types|ways|functions|losses|optimizers|schedulers|layers|transforms)\b",
    r"\b(difference|differences) between\b",
    r"\bvs\.?\b|\bversus\b|\bcompared? (to|with)\b|\bpros and cons\b|\btrade-?offs?\b",
    r"\bshould i (use|pick|choose)\b.{0,40}\bor\b",
    r"\b(build|create|write|design|make|train)\b.{0,50}\b(model|network|cnn|rnn|transformer|classifier|detector|gan|autoencoder|pipeline)\b",
    r"\bend[- ]to[- ]end\b|\bfrom scratch\b|\bstep[- ]by[- ]step\b",
    r"\bhow (is|are)\b.{0,40}\bimplemented\b",
    r"\bsource code\b|\bunder the hood\b|\binternals\b",
)


def slug(title: Column) -> Column:
    """Lower case, each run of other characters than a-z and 0-9 one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")


def url_stem(url: Column) -> Column:
    """Last path part without .html."""
    return F.regexp_replace(F.substring_index(url, "/", -1), r"\.html$", "")


def page_path(url: Column) -> Column:
    """Place of a page in a snapshot: no host, ``index`` for the root, .md for .html."""
    path = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    return F.concat(F.regexp_replace(F.when(path == "", "index").otherwise(path), r"\.html$", ""), F.lit(".md"))


def page_kind(url: Column) -> Column:
    return F.when(url.contains("/tutorials/"), KINDS[1]).when(url.contains("/generated/") | url.contains("/docs/"), KINDS[0]).otherwise(KINDS[2])


def symbol_of_url(url: Column) -> Column:
    """The qualified symbol that an API page documents, or ''."""
    stem = url_stem(url)
    return F.when(stem.contains(".") & F.substring_index(stem, ".", 1).isin(*SYMBOL_ROOTS), stem).otherwise("")


def symbol_in_query(query: Column) -> Column:
    """The longest dotted or underscored identifier, the first of equals; NULL if none."""
    found = F.regexp_extract_all(query, F.lit(SYMBOL_PATTERN), F.lit(0))
    best = F.aggregate(found, F.lit(""), lambda a, x: F.when(F.char_length(x) > F.char_length(a), x).otherwise(a))
    return F.nullif(best, F.lit(""))


def is_exact_api(kind: Column, url: Column, symbol: Column) -> Column:
    stem = url_stem(url)
    return F.coalesce((kind == KINDS[0]) & ((stem == symbol) | F.endswith(stem, F.concat(F.lit("."), symbol))), F.lit(False))


def heading_title(raw: Column) -> Column:
    """A heading without its permalink, with markdown escapes undone."""
    return F.trim(F.replace(F.regexp_replace(raw, r'\[[^\]]*\]\(#([^)\s"]+)[^)]*\)', ""), F.lit("\\_"), F.lit("_")))


def heading_anchor(raw: Column) -> Column:
    """The permalink's fragment, or the slug of the title."""
    own = F.regexp_extract(raw, r'\[[^\]]*\]\(#([^)\s"]+)[^)]*\)', 1)
    return F.when(own != "", own).otherwise(slug(heading_title(raw)))


def plain(text: Column) -> Column:
    """Markdown as prose: link texts, no emphasis, single blanks."""
    flat = F.replace(F.replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), F.lit("*"), F.lit("")), F.lit("\\_"), F.lit("_"))
    return F.trim(F.regexp_replace(flat, r"\s+", " "))


def chunk_key(url: Column, anchor: Column, path: Column, part: Column) -> Column:
    """Identity of a chunk: SHA-256 of url, anchor, heading path, and the part from the second on."""
    base = F.concat(url, F.lit("#"), anchor, F.lit("#"), F.array_join(path, " > "))
    return F.sha2(F.when(part > 0, F.concat(base, F.lit("#part"), part.cast("string"))).otherwise(base), 256)


def indexed_text(url: Column, synopsis: Column, gloss: Column, questions: Column, path: Column, content: Column) -> Column:
    """What is embedded and searched: symbol, synopsis, gloss, questions, headings, body; empty ones left out."""
    head = F.array(symbol_of_url(url), synopsis, gloss, F.array_join(questions, " "), F.array_join(path, " > "))
    filled = F.filter(F.transform(head, lambda x: F.coalesce(x, F.lit(""))), lambda x: x != "")
    return F.array_join(F.array_append(filled, content), "\n")


def url_quoted(text: Column) -> Column:
    """Percent-encoded UTF-8 but for letters, digits and ``_.-~/``."""
    quoted = F.url_encode(text)
    for form, char in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        quoted = F.replace(quoted, F.lit(form), F.lit(char))
    return quoted


def search_terms(question: Column) -> Column:
    """Up to twelve words that mean something, or any if none does, URL-quoted."""
    words = F.filter(F.split(F.trim(question), r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[?.,:;()]+|[?.,:;()]+$", "")
    kept = F.filter(words, lambda w: ~bare(w).isin(*SEARCH_STOPWORDS))
    chosen = F.slice(F.when(F.size(kept) > 0, kept).otherwise(words), 1, MAX_SEARCH_TERMS)
    return url_quoted(F.array_join(chosen, " "))


def looks_english(question: Column) -> Column:
    """At most two characters beyond ASCII, or a tenth of all."""
    return F.regexp_count(question, F.lit(r"[^\x00-\x7f]")) <= F.greatest(F.lit(2.0), F.char_length(question) * 0.1)


def needs_loop(question: Column) -> Column:
    """Does the question's shape call for several sources?"""
    return question.rlike("(?i)" + "|".join(f"(?:{p})" for p in LOOP_SHAPES))


def context_body(content: Column, limit: int = Config.section_chars, marker: str = "\n[... truncated]") -> Column:
    return F.when(F.char_length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit(marker))).otherwise(content)


# Fixed value: the instruction that the small English embedding models expect before a query, not before a text.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def query_text(question: Column, prefix: str = QUERY_PREFIX) -> Column:
    """What is embedded for a search."""
    return F.concat(F.lit(prefix), question)


def json_object(reply: Column) -> Column:
    """From the first brace to the last one."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def json_list(reply: Column) -> Column:
    """From the first bracket to the last one."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit(""))


def valid_items(reply: Column, n: Column, value: str, limit: int, most: int | None = None) -> Column:
    """Array of (i, values) from a model's JSON list of objects ``{"i": ..., value: ...}``.

    What stays are items whose index is a whole number of 0 to n - 1 and whose value is a text that is
    not blank, or with ``most`` a list with such texts, the first ``most`` of them; each is cut to
    ``limit`` characters.  Of equal indexes the last counts.  A reply without a list gives NULL.
    """
    items = F.try_parse_json(json_list(reply)).cast("array<variant>")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    part = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    of = lambda x: F.array(part(x, value)) if most is None else F.coalesce(F.try_variant_get(x, f"$.{value}", "array<variant>"), F.array().cast("array<variant>"))
    texts = lambda x: F.transform(F.filter(of(x), lambda v: kind(v) == "STRING"), lambda v: F.trim(F.variant_get(v, "$", "string")))
    clean = lambda x: F.slice(F.transform(F.filter(texts(x), lambda t: t != ""), lambda t: F.left(t, F.lit(limit))), 1, most or 1)
    index = lambda x: F.try_variant_get(x, "$.i", "long")
    sound = lambda x: (kind(part(x, "i")) == "BIGINT") & index(x).between(0, n - 1)
    rows = F.transform(F.filter(items, lambda x: F.coalesce(sound(x), F.lit(False))), lambda x: F.struct(index(x).alias("i"), clean(x).alias("values")))
    rows = F.filter(rows, lambda x: F.size(x["values"]) > 0)
    return F.filter(rows, lambda x, at: ~F.exists(F.slice(rows, at + 2, F.greatest(F.size(rows), F.lit(1))), lambda y: y["i"] == x["i"]))


def redacted(line: Column) -> Column:
    """Bearer headers and key-shaped tokens blanked out."""
    return F.regexp_replace(F.regexp_replace(line, r"(?i)(bearer\s+)\S+", "$1[redacted]"), r"\b(?:sk|key|gsk|AIza)[-_A-Za-z0-9]{8,}", "[redacted]")


def retry_after(header: Column) -> Column:
    return F.try_cast(header, "double") if hasattr(F, "try_cast") else header.try_cast("double")


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def known_kind(kind: Column) -> Column:
    """An unknown search kind means no restriction."""
    return F.when(kind.isin(*KINDS), kind)


def contains_folded(haystack: Column, needle: Column) -> Column:
    """Case-insensitive substring test; no character of the needle is a wildcard."""
    return F.contains(F.lower(haystack), F.lower(needle))


def version_stamp(at: Column) -> Column:
    return F.concat(F.lit("crawl-"), F.date_format(at, "yyyyMMdd-HHmm"))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
