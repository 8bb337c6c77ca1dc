"""Weighted keyword search over catalogue entries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.functions.values import strip_blank

# Score weights, words that express intent, entry types in order.
PHRASE_EQUALS_LABEL = 160
PHRASE_WEIGHTS = {"label": 100, "description": 55, "aliases": 35, "content": 45}
TOKEN_WEIGHTS = {"label": 30, "description": 16, "content": 14, "aliases": 8}
CONTENT_TOKEN_BONUS = 20
INTENT_TOKENS = [
    "ask", "open", "show", "view", "go", "to", "find", "search", "for", "the",
    "a", "an", "edit", "editing", "manage", "launch", "start", "data", "record", "records",
    "sftp", "server", "servers", "file", "files", "netsuite", "net", "suite", "auth",
    "authentication", "endpoint", "endpoints", "restlet", "config", "configuration",
    "schema", "schemas", "run", "runs", "result", "results", "diff", "history", "saved",
]
TYPE_ORDER = ["run-result", "saved-run", "sftp-server", "netsuite-auth", "netsuite-endpoint", "schema"]


def search_text(col: Column) -> Column:
    """Lower-case words of letters and digits, single-spaced."""
    return F.trim(F.regexp_replace(F.lower(strip_blank(F.coalesce(col, F.lit("")))), "[^a-z0-9]+", " "))


def query_tokens(query: str) -> tuple[str, list[str]]:
    phrase = re.sub("[^a-z0-9]+", " ", (query or "").strip().lower()).strip()
    tokens = [t for t in phrase.split(" ") if len(t) >= 2]
    return phrase, list(dict.fromkeys(tokens))


def relevance_search(
    df: DataFrame, query: str, label: str = "label", description: str | None = "description",
    aliases: str | None = "aliases", content: str | None = "content", type_col: str | None = "type",
    id_col: str = "resultId", page: int = 0, size: int | None = 20, intent_words: list[str] | None = None,
) -> DataFrame:
    """Entries with a positive ``score``, best first.

    The score is a sum of plain contains checks over texts normalised once per
    row: they pass through ``inline``, which the optimizer does not look
    behind, so filters on the score do not repeat the normalising.
    ``size=None`` returns all matches unordered.
    """
    phrase, tokens = query_tokens(query)
    if not tokens:
        return df.withColumn("score", F.lit(0)).filter(F.lit(False))
    intent = set(INTENT_TOKENS if intent_words is None else intent_words)
    names = {"label": label, "description": description, "aliases": aliases, "content": content}
    texts = {part: f"_{part}" for part, name in names.items() if name}
    normalised = F.struct(*[search_text(F.col(names[part])).alias(alias) for part, alias in texts.items()])
    prepared = df.select("*", F.inline(F.array(normalised)))

    def has(part: str, needle: str) -> Column:
        return F.contains(F.col(texts[part]), F.lit(needle)) if part in texts else F.lit(False)

    def points(condition: Column, weight: int) -> Column:
        return F.when(condition, weight).otherwise(0)

    score = points(F.col(texts["label"]) == phrase, PHRASE_EQUALS_LABEL)
    for part, weight in PHRASE_WEIGHTS.items():
        score = score + points(has(part, phrase), weight)
    for token in tokens:
        for part, weight in TOKEN_WEIGHTS.items():
            score = score + points(has(part, token), weight)
    content_tokens = [t for t in tokens if t not in intent]
    relevant = F.lit(not content_tokens)
    for token in content_tokens:
        score = score + points(has("label", token) | has("content", token), CONTENT_TOKEN_BONUS)
        relevant = relevant | has("content", token) | has("label", token) | has("description", token)
    # The score too is bound once: irrelevant entries score zero.
    scored = prepared.select(*df.columns, F.inline(F.array(F.struct(F.when(relevant, score).otherwise(0).alias("score")))))
    found = scored.filter(F.col("score") > 0)
    if size is None:
        return found
    order = [F.col("score").desc()]
    if type_col:
        rank = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col(type_col))
        order.append(F.when(rank > 0, rank).otherwise(len(TYPE_ORDER) + 1))
    order += [F.coalesce(F.col(label), F.lit("")), F.col(id_col)]
    return found.orderBy(*order).offset(max(0, page) * size).limit(size)
