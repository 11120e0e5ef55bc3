"""Text projections over chunks, files and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_CAP, SIGNATURE_CAP, EMBED_CAP, PROMPT_CODE_CAP = 8000, 240, 8000, 2000
CHARS_PER_TOKEN = 4

#: Words too common in questions to rank by.
STOPWORDS = sorted(
    """by can could do does for from get how i in into is it its making my of on or our set should that the they this
    to use using was we were what when where which who why with you your a an and are as be
    """.split()
)

LANGUAGE_SUFFIXES = {
    "go": "go", "java": "java", "javascript": "cjs js jsx mjs", "python": "py pyi", "rust": "rs", "typescript": "ts tsx",
}


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def chunk_id(path: Column, start_byte: Column, end_byte: Column, sha: Column) -> Column:
    """Stable id: the first 16 hex digits of the sha1 of place and content."""
    key = F.concat_ws(":", path, start_byte.cast("string"), end_byte.cast("string"), sha)
    return F.concat(F.lit("chunk_"), F.substring(F.sha1(key.cast("binary")), 1, 16))


def content_sha(content: Column) -> Column:
    return F.sha1(content.cast("binary"))


def signature(code: Column) -> Column:
    """First line that isn't blank, trimmed and capped; empty if there is none."""
    lines = F.filter(F.transform(F.split(code, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.get(lines, 0), F.lit(""))
    return F.when(F.length(first) > SIGNATURE_CAP, F.concat(F.substring(first, 1, SIGNATURE_CAP), F.lit("…"))).otherwise(first)


def truncate_code(code: Column, path: Column, line: Column) -> Column:
    """Code over the cap ends in a pointer to the rest: how many lines are missing and where they are."""
    rest = F.substring(code, CODE_CAP + 1, F.length(code))
    missing = F.length(rest) - F.length(F.replace(rest, F.lit("\n"), F.lit("")))
    note = F.concat(F.lit("\n… (truncated — "), missing.cast("string"), F.lit(" more lines; full source at "), path, F.lit(":"), line.cast("string"), F.lit(")"))
    return F.when(F.length(code) > CODE_CAP, F.concat(F.substring(code, 1, CODE_CAP), note)).otherwise(code)


def embed_text(language: Column, kind: Column, qualified_name: Column, sig: Column, code: Column) -> Column:
    """What is embedded for a chunk: a header, the signature if it says more than the body, the capped body."""
    head = F.concat_ws(" ", language, kind, qualified_name)
    body = F.when(F.octet_length(code) > EMBED_CAP, F.substring(code, 1, EMBED_CAP)).otherwise(code)
    with_sig = F.when((F.coalesce(sig, F.lit("")) != "") & (sig != F.trim(code)), sig)
    return F.concat_ws("\n", head, with_sig, body)


def language_of(path: Column) -> Column:
    """Language by lower-cased suffix; null if unknown."""
    suffix = F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for language, suffixes in LANGUAGE_SUFFIXES.items():
        out = F.when(suffix.isin(*suffixes.split()), F.lit(language)).otherwise(out)
    return out


def token_estimate(text: Column) -> Column:
    """Tokens of a text at four characters each: at least one, none for no text."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / CHARS_PER_TOKEN))).cast("long")


def query_terms(question: Column) -> Column:
    """Terms of a question in order, repeats kept: at least three characters, no stop-words."""
    words = F.split(F.lower(question), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))


def lexical_score(terms: Column, name: Column, path: Column, body: Column) -> Column:
    """Per term: 3 if it is a token of the name, else 2 of the path, else 0.5 if the body's start has it."""
    tokens = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    parts = F.struct(tokens(name).alias("name"), tokens(path).alias("path"), F.lower(F.substring(body, 1, PROMPT_CODE_CAP)).alias("start"))
    value = lambda s, t: F.when(F.array_contains(s["name"], t), 3.0).when(F.array_contains(s["path"], t), 2.0).when(F.contains(s["start"], t), 0.5).otherwise(0.0)
    # The one-element array binds the tokens to a name, so that they are made once a row and not once a term.
    return F.get(F.transform(F.array(parts), lambda s: F.aggregate(terms, F.lit(0.0), lambda a, t: a + value(s, t))), 0)


def slug(label: Column) -> Column:
    """Pack id of a label: letters and digits lower-cased, the rest collapsed to ``_``, one ``pack_`` in front."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(F.startswith(base, F.lit("pack_")), base).otherwise(F.concat(F.lit("pack_"), base))


def humanise(directory: Column) -> Column:
    return F.initcap(F.translate(directory, "-_", "  "))


def lenient_json(raw: Column) -> Column:
    """JSON text of a model's answer: as it is, else in a fence, else from the first brace to the last, else ``{}``."""
    fence = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & bare(c).startswith("{"), bare(c))
    return F.coalesce(ok(raw), ok(fence), ok(braces), F.lit("{}"))
