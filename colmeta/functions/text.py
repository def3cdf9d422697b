"""Text around descriptions: prompts, cache keys, answers, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import is_blank, stripped

#: Characters of context in a prompt, and in a cached answer.
CONTEXT_CHARS, EXCERPT_CHARS = 30_000, 500


def hinted(name: Column, hint: Column) -> Column:
    """A variable's name, with its hint if there is one."""
    return F.when(is_blank(hint), name).otherwise(F.concat(name, F.lit(" (hint: "), hint, F.lit(")")))


def prompt(context: Column, variables: Column) -> Column:
    """The request for a JSON object of descriptions; the context is cut at CONTEXT_CHARS, null is empty."""
    return F.concat(
        F.lit("Describe each variable of a dataset in one sentence, from the context alone.\nAnswer with one JSON object that maps each variable to its description.\nVariables: "),
        F.coalesce(F.array_join(variables, ", "), F.lit("")),
        F.lit("\nContext:\n"),
        F.substring(F.coalesce(context, F.lit("")), 1, CONTEXT_CHARS),
    )


def cache_key(provider: Column, context: Column, variables: Column) -> Column:
    """SHA-256 of provider, context and the names as they are sent; their order counts. What is null counts as empty."""
    given = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat(given(stripped(provider)), F.lit("|"), given(stripped(context)), F.lit("|"), given(F.array_join(variables, ","))), 256)


def json_block(answer: Column) -> Column:
    """From the first { to the last } of an answer, without code fences; empty if there is none."""
    bare = F.regexp_replace(F.regexp_replace(answer, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", "")
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


def parsed_answer(answer: Column) -> Column:
    """Map of an answer's JSON object, null if it has none. Nested values stay JSON text."""
    return F.from_json(F.nullif(json_block(answer), F.lit("")), "map<string,string>", {"mode": "PERMISSIVE"})


def links(uris: Column) -> Column:
    """HTML links to the uris, joined by a comma."""
    return F.array_join(F.transform(uris, lambda u: F.concat(F.lit('<a href="'), u, F.lit('" target="_blank">'), u, F.lit("</a>"))), ", ")


def plain_html(page: Column) -> Column:
    """A page's text for a context: scripts, styles (to their own end tags) and tags out, white space runs to one space."""
    bare = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))
