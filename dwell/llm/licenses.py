"""Operator 8: licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences; each is normalised (lower case, anything but ASCII letters and
digits becomes one space) and looked up in a fixed table of known licence sentences.  The
identifiers found, in text order, form a sequence; sentences that are not known leave no mark.
Licence rules are ordered identifier sequences, tried from the longest to the shortest; what a
rule has matched is taken out, so a full licence text is not also reported by its parts.

Everything happens inside a row: no shuffle, no join, no skew.

Defined results: a null or empty text, or one without a known sentence, has an empty list of
licences; a sentence that occurs twice counts twice; rows that repeat get equal results; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences in normal form, by identifier.
SENTENCES = {
    "mit-title": "the mit license",
    "mit-title-2": "mit license",
    "mit-short": "released under the mit license",
    "mit-short-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "asis-mit": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache2-short": "licensed under the apache license version 2 0",
    "apache2-head": "licensed under the apache license version 2 0 the license",
    "apache2-head-2": "you may not use this file except in compliance with the license",
    "apache2-head-3": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-head-4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-head-5": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl2-short": "this work is licensed under the gnu general public license version 2",
    "gpl3-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-head": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "ccbync4-short": "licensed under cc by nc 4 0",
    "ccby4-short": "licensed under cc by 4 0",
    "ccbysa4-short": "licensed under cc by sa 4 0",
    "cc0-short": "released under cc0 1 0",
    "unlicense-head": "this is free and unencumbered software released into the public domain",
    "rights-reserved": "all rights reserved",
}
#: Licence rules, sequences of identifiers in the order they must follow each other.
RULES = [
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-hope", "gpl-see", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-see", "gpl-received"]),
    ("Apache-2.0", ["apache2-head", "apache2-head-2", "apache2-head-3", "apache2-head-4", "apache2-head-5"]),
    ("Apache-2.0", ["apache2-head", "apache2-head-2", "apache2-head-4", "apache2-head-5"]),
    ("MIT", ["mit-grant", "mit-notice", "asis-mit", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MPL-2.0", ["mpl2-head", "mpl2-copy"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("GPL-2.0-only", ["gpl2-short"]),
    ("Apache-2.0", ["apache2-head"]),
    ("Apache-2.0", ["apache2-short"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-short-2"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-title-2"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-head"]),
    ("CC-BY-NC-4.0", ["ccbync4-short"]),
    ("CC-BY-SA-4.0", ["ccbysa4-short"]),
    ("CC-BY-4.0", ["ccby4-short"]),
    ("CC0-1.0", ["cc0-short"]),
    ("Unlicense", ["unlicense-head"]),
    ("proprietary-notice", ["rights-reserved"]),
]

#: A sentence ends at a line break that starts a paragraph or list item, or after . ! ? ; : and
#: white space.  A single line break inside a sentence (wrapped licence text) is a space.
_BREAK = "\x1e"
_ENDS = r"([.!?;:][\"')\]]*)[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"
_LINE = "\n"


def normal(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _ordered_rules() -> list[tuple[str, list[str]]]:
    return sorted(RULES, key=lambda r: -len(r[1]))  # stable: equal lengths keep their order


def _known(sentence: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ((text, name) for name, text in SENTENCES.items()) for x in pair])
    return F.try_element_at(known, normal(sentence))


def _lookup(sentences: Column) -> Column:
    return F.filter(F.transform(sentences, _known), lambda x: x.isNotNull())


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``sentence_ids``: the known sentences of each text, in order.  Two readings
    are merged by position: the text with wrapped lines joined, and cut at line breaks as well.
    A piece of the second always lies inside one of the first; so a joined piece that is known
    counts as a whole, and of any other its lines that are known count, at their place."""
    text = F.coalesce("text", F.lit(""))
    joined = F.split(F.regexp_replace(text, _ENDS, "$1" + _BREAK), _BREAK, -1)
    # a text without any word that all known sentences draw on cannot hold one of them
    may = F.lower(text).rlike("licen[cs]e|permi(t|ss)|software|redistribution|released|reserved|mpl")
    out = docs.select("doc_id", F.when(may, joined).alias("_joined"))
    out = out.select("doc_id", F.transform("_joined", lambda s: F.struct(_known(s).alias("id"), s.alias("s"))).alias("_pieces"))
    empty = F.array().cast("array<string>")
    found = F.transform("_pieces", lambda p: F.when(p["id"].isNotNull(), F.array(p["id"]))
                        .when(F.contains(p["s"], F.lit(_LINE)), _lookup(F.split(p["s"], _LINE, -1))).otherwise(empty))
    return out.select("doc_id", F.coalesce(F.flatten(found), empty).alias("sentence_ids"))


def recognise(docs: DataFrame) -> DataFrame:
    """Per row: ``sentence_ids`` and ``licenses``, the distinct licences found, sorted."""
    out = identify(docs).withColumn("_left", F.concat(F.lit(","), F.array_join("sentence_ids", ",,"), F.lit(",")))
    rules = _ordered_rules()
    for k, (_, ids) in enumerate(rules):
        pattern = ",," .join(ids)
        out = (out.withColumn(f"_hit{k}", F.contains(F.col("_left"), F.lit(f",{pattern},")))
               .withColumn("_left", F.when(F.size("sentence_ids") > 0, F.replace("_left", F.lit(f",{pattern},"), F.lit(",;,"))).otherwise(F.col("_left"))))
    found = F.array(*[F.when(F.col(f"_hit{k}"), F.lit(name)) for k, (name, _) in enumerate(rules)])
    return out.select("doc_id", "sentence_ids", F.array_sort(F.array_distinct(F.array_compact(found))).alias("licenses"))


def _sql() -> str:
    """The rules in DuckDB SQL, unrolled as one step each.  It takes for each text the reading that
    knows more sentences, so it differs from ``identify`` where both readings know some of their own."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(t)}, {quote(n)})" for n, t in SENTENCES.items())
    steps, last = [], "s0"
    for k, (_, ids) in enumerate(_ordered_rules()):
        p = quote("," + ",,".join(ids) + ",")
        steps.append(f"s{k + 1} AS (SELECT * REPLACE (replace(rest, {p}, ',;,') AS rest), contains(rest, {p}) AS h{k} FROM {last})")
        last = f"s{k + 1}"
    found = ", ".join(f"CASE WHEN h{k} THEN {quote(name)} END" for k, (name, _) in enumerate(_ordered_rules()))
    norm = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    end = r"""([.!?;:]["'')\]]*)[\x20\x09-\x0D]+"""
    cut = lambda x: f"string_split(regexp_replace({x}, '{end}', '\\1' || chr(30), 'g'), chr(30))"
    ids = lambda n: f"(SELECT doc_id, coalesce(list(id ORDER BY i) FILTER (id IS NOT NULL), []) AS ids FROM (SELECT doc_id, i, id FROM (SELECT doc_id, {norm} AS t, i FROM (SELECT doc_id, unnest({n}) AS s, generate_subscripts({n}, 1) AS i FROM cut)) LEFT JOIN known USING (t)) GROUP BY doc_id)"
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) AS v(t, id)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, {cut(r"regexp_replace(text, '\n[\x20\x09-\x0D]*\n', chr(30), 'g')")} AS by_text,
               {cut("replace(text, chr(10), chr(30))")} AS by_line FROM d),
s0 AS (SELECT doc_id, ids AS sentence_ids, ',' || array_to_string(ids, ',,') || ',' AS rest
       FROM (SELECT a.doc_id, CASE WHEN len(a.ids) > len(b.ids) THEN a.ids ELSE b.ids END AS ids
             FROM {ids('by_text')} a JOIN {ids('by_line')} b USING (doc_id))),
{', '.join(steps)}
SELECT doc_id, array_to_string(sentence_ids, ',') AS sentence_ids,
       array_to_string(list_sort(list_distinct(list_filter([{found}], lambda x: x IS NOT NULL))), ',') AS licenses
FROM {last}
"""


ORACLE_SQL = _sql()
