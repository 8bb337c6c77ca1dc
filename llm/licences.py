"""Licence scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences, each sentence is normalised and looked up among
known licence sentences, and the sequence of the found identifiers is matched
against ordered rules: a licence is found when its sentences occur in the
rule's order.  All work is on the row itself: no shuffle, no join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import fresh

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
}

# Public licence identifiers, each with sentences that must occur in this order.
RULES = [
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-header", "apache-comply"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-3.0-only", ["spdx-gpl3"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("BSD-2-Clause", ["bsd-redistribution"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-endorse"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC0-1.0", ["cc0"]),
]

BLANK = r"\n[\t-\r */#;-]*\n"
"""Lines that are empty or hold only the marks of a comment."""
END = r"([.!?;:])[\t-\r ]+"
MARK = "\u0001"
NOT_WORD = "[^A-Za-z0-9]+"


def normalised(sentence: Column) -> Column:
    """Lower-case ASCII letters and digits, all else one space."""
    return F.lower(F.trim(F.regexp_replace(sentence, NOT_WORD, " ")))


def _plain(sentence: str) -> str:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence).split()
    return " ".join(words).lower()


def scan(docs: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None,
         names: tuple[str, str] = ("sentence_ids", "licences")) -> DataFrame:
    """All columns of ``docs`` with the known sentences and the licences found, both as arrays.

    Identifiers stand in the order of the text; a sentence over several lines
    counts whole and its lines for themselves; blank lines end a sentence too,
    and a sentence that has a cut within is found over both parts.  Licences are distinct and
    sorted.  Null and empty texts have none, very long ones are scanned whole.
    Repeated rows stay repeated.  Where ``docs`` has a column of a new one's
    name, the new one's name is lengthened by underscores.
    """
    sentences = SENTENCES if sentences is None else sentences
    rules = RULES if rules is None else rules
    known: dict[str, str] = {}
    for name, sentence in sentences.items():
        if known.setdefault(_plain(sentence), name) != name:
            raise ValueError(f"{name} and {known[_plain(sentence)]} are the same sentence")
    for licence, needed in rules:
        for name in needed:
            if name not in sentences:
                raise ValueError(f"the rule for {licence} needs the unknown sentence {name}")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # Sentences that the cuts go through, by their beginnings: {first part: {rest: name}}
    cut: dict[str, dict[str, str]] = {}
    for name, sentence in sentences.items():
        pieces = re.split(END.replace("(", "(?<=", 1), sentence.strip())
        if len(pieces) > 2:
            raise ValueError(f"{name} has more than one cut")
        if len(pieces) == 2:
            cut.setdefault(_plain(pieces[0]), {})[_plain(pieces[1])] = name
    shortest = min(map(len, known))
    none = F.array().cast("array<string>")

    def named(part: Column) -> Column:
        # the length, a cheap test, comes before the expression; how long a part is says nothing, as spacing is free
        return F.when(F.length(part) >= shortest, F.element_at(table, normalised(part)))

    def lines(part: Column) -> Column:
        return F.when(F.contains(part, F.lit("\n")), F.transform(F.split(part, "\n"), named)).otherwise(none)

    def found(part: Column) -> Column:
        whole = F.concat(F.array(named(part)), lines(part))
        paragraphs = F.flatten(F.transform(F.split(part, BLANK), lambda p: F.concat(F.array(named(p)), lines(p))))
        return F.when(part.rlike(BLANK) & named(part).isNull(), paragraphs).otherwise(whole)

    def over(part: Column, after: Column) -> Column:
        """The sentence that ends a part's last line or paragraph and goes on in the next part's first."""
        def joined(start: str, rests: dict[str, str]) -> Column:
            rest = F.create_map(*[F.lit(x) for pair in rests.items() for x in pair])
            ahead = [after, F.element_at(F.split(after, BLANK), 1), F.element_at(F.split(after, "\n"), 1)]
            behind = [part, F.element_at(F.split(part, BLANK), -1), F.element_at(F.split(part, "\n"), -1)]
            starts = F.array_contains(F.array(*[normalised(x) for x in behind]), F.lit(start))
            return F.when(starts, F.coalesce(*[F.element_at(rest, normalised(x)) for x in ahead]))

        tail = normalised(part)
        return F.coalesce(*[F.when(tail.endswith(F.lit(start)), joined(start, rests)) for start, rests in cut.items()]) if cut else F.lit(None).cast("string")

    parts = F.split(F.regexp_replace(F.coalesce(docs[text].cast("string"), F.lit("")), END, "$1" + MARK), MARK)
    pairs = F.arrays_zip(parts.alias("part"), F.slice(parts, 2, F.size(parts)).alias("after"))
    # Only ':' and ';' are cuts within known sentences.
    both = F.transform(pairs, lambda x: F.concat(found(x["part"]), F.when(x["part"].rlike("[:;]$") & x["after"].isNotNull(), F.array(over(x["part"], x["after"]))).otherwise(none)))
    ids = F.filter(F.flatten(both), lambda x: x.isNotNull())
    first = fresh(docs, names[0])
    second = fresh(docs.withColumn(first, none), names[1])
    told = docs.withColumn(first, ids)
    chain = F.concat(F.lit("<"), F.array_join(F.col(f"`{first}`"), "><"), F.lit(">"))
    plain = lambda n: re.sub(r"([\\%_])", r"\\\1", n)
    hits = [F.when(chain.like("%" + "%".join(f"<{plain(n)}>" for n in needed) + "%"), F.lit(licence)) for licence, needed in rules]
    return told.withColumn(second, F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))))


def oracle(sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> str:
    """DuckDB SQL for the query's rows."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    sentences = SENTENCES if sentences is None else sentences
    rules = RULES if rules is None else rules
    keys = [(_plain(s), n) for n, s in sentences.items()]
    longest, shortest = max(map(len, sentences.values())) * 2, min(len(k) for k, _ in keys)
    pairs = ", ".join(f"({quote(k)}, {quote(n)})" for k, n in keys)
    hits = " UNION ALL ".join(
        f"SELECT doc_id, {quote(licence)} AS licence FROM chains WHERE chain LIKE {quote('%' + '%'.join(f'<{n}>' for n in needed) + '%')}" for licence, needed in rules)
    return f"""
WITH known(norm, id) AS (VALUES {pairs}),
parts AS (
  SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[\\t-\\r ]+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents)),
candidates AS (
  SELECT doc_id, i, 0 AS j, part AS s FROM parts
  UNION ALL
  SELECT doc_id, i, generate_subscripts(string_split(part, chr(10)), 1) AS j, unnest(string_split(part, chr(10))) AS s FROM parts WHERE contains(part, chr(10))),
found AS (
  SELECT doc_id, i, j, id FROM candidates JOIN known ON lower(trim(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))) = norm
  WHERE length(s) BETWEEN {shortest} AND {longest}),
chains AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i, j) AS ids, string_agg('<' || id || '>', '' ORDER BY i, j) AS chain FROM found GROUP BY doc_id),
hits AS ({hits}),
named AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0)::INTEGER AS n_sentences, coalesce(c.ids, '') AS sentence_ids, coalesce(n.licences, '') AS licences
FROM documents d LEFT JOIN chains c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
