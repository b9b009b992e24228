"""Licence scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences; each is normalised (lower case, everything but letters,
digits and dots between digits becomes one space) and mapped to the identifier of a known
licence sentence. Within it a run of whole lines may be a known sentence too, since a line
before or after need not end in a sign; of runs that overlap the first and longest counts. A document's identifiers, in order, are then matched against licence
rules: each rule is a sequence of identifiers that must occur side by side. Sentences
that are not known do not part the identifiers around them; the copyright sentence is
dropped from the sequence, since it may stand anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a sentence ends: after one of these signs before a space, at a blank line or at the text's end.
ENDS = r"[.;:!?]+[ \t\r\n]+|\r?\n[ \t]*\r?\n[ \t\r\n]*|[.;:!?]+\z"

# Known sentences, as normalised, by identifier. Public licence texts.
SENTENCES = {
    "mit-named": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "the mit license", "mit license", "this software is released under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "no-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "apache2-named": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "apache license version 2.0", "this project is licensed under the apache license 2.0"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at"],
    "apache2-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "gpl3-named": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "gnu general public license version 3"],
    "gpl2-named": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "gnu general public license version 2"],
    "gpl-grant": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl3-later": ["either version 3 of the license or at your option any later version"],
    "gpl2-later": ["either version 2 of the license or at your option any later version"],
    "bsd-head": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl2-named": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "cc-by-nc4-named": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by4-named": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa4-named": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0"],
    "cc0-named": ["licensed under cc0 1.0", "released under cc0 1.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
# Licence rules as sequences of identifiers.
RULES = [
    ("MIT", ["mit-named"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache2-named"]),
    ("Apache-2.0", ["apache2-comply", "apache2-copy", "apache2-as-is"]),
    ("GPL-3.0-only", ["gpl3-named"]),
    ("GPL-2.0-only", ["gpl2-named"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl-grant", "gpl2-later"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-names"]),
    ("MPL-2.0", ["mpl2-named"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-named"]),
    ("CC-BY-4.0", ["cc-by4-named"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-named"]),
    ("CC0-1.0", ["cc0-named"]),
    ("Unlicense", ["unlicense"]),
]
#: Licences whose rule is a beginning of another's: given only if that other does not match.
SHORTER = [("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"], "BSD-3-Clause")]
#: Every known sentence has one of these; sentences without any are not normalised.
STEMS = ["licen", "software", "copyright", "permission", "disclaimer", "version", "redistribution", "cc0"]
#: Tags are read from the text as it is, since a line break may follow them at once.
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"


def normalised(sentence: Column) -> Column:
    """Lower case A-Z; runs of anything but a-z, 0-9 and dots between digits become a space."""
    low = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.btrim(F.regexp_replace(F.regexp_replace(low, r"\.([^0-9]|$)|[^a-z0-9.]+", " $1"), r"[^a-z0-9.]+|[.]+( |$)", " "))


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence; null if unknown."""
    known = {text: name for name, texts in SENTENCES.items() for text in texts}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.try_element_at(table, sentence)


def runs(sentence: Column) -> Column:
    """The known sentences, as normalised, that are runs of whole lines of a sentence, in order."""
    lines = F.filter(F.transform(F.split(sentence, r"[\r\n]+"), normalised), lambda x: x != "")
    texts = sorted((text for texts in SENTENCES.values() for text in texts), key=len, reverse=True)
    known = "|".join(text.replace(".", "[.]").replace(" ", r"[ \n]") for text in texts)
    found = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(rf"(?:^|\n)({known})(?=\n|\z)"))
    return F.transform(found, lambda x: F.translate(x, "\n", " "))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, licenses, sentence_ids, n_sentences for every row of docs(doc_id, text).

    licenses: the matched licences, sorted and joined by commas (an SPDX tag gives
    `SPDX:` and its name); sentence_ids: the known sentences' identifiers in
    order, joined by commas; n_sentences: sentences with a letter a-z or a digit. Null and empty
    texts, and texts without a known sentence, have empty strings (n_sentences 0 for the
    former). Each row stands for itself, repeated or not; extra columns are ignored.
    One projection over the scan: nothing is shuffled, and no text is exploded into rows.
    """
    ends = F.split(F.coalesce("text", F.lit("")), ENDS)
    tags = F.transform(F.regexp_extract_all("text", F.lit(SPDX)), lambda x: F.concat(F.lit("SPDX:"), x))
    tags = F.when(F.contains("text", F.lit("SPDX-")), tags)
    cut = docs.select("doc_id", tags.alias("tags"), F.filter(ends, lambda x: x.rlike("[A-Za-z0-9]")).alias("sentences"))
    likely = F.filter("sentences", lambda x: reduce(Column.__or__, (F.lower(x).contains(s) for s in STEMS)))
    named = F.transform(F.flatten(F.transform(likely, runs)), identifier)
    ids = cut.select("doc_id", "tags", F.size("sentences").alias("n_sentences"), F.filter(named, lambda x: x.isNotNull()).alias("ids"))
    row = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    has = lambda rule: F.col("row").contains("," + ",".join(rule) + ",")
    found = [F.when(has(rule), F.lit(name)) for name, rule in RULES]
    found += [F.when(has(rule) & ~reduce(Column.__or__, (has(r) for n, r in RULES if n == longer)), F.lit(name)) for name, rule, longer in SHORTER]
    known = F.when(F.size("ids") > 0, F.array_compact(F.array(*found)))
    none = F.array().cast("array<string>")
    licenses = F.array_sort(F.array_distinct(F.concat(F.coalesce(known, none), F.coalesce("tags", none))))
    return ids.withColumn("row", row).select("doc_id", F.array_join(licenses, ",").alias("licenses"), F.array_join("ids", ",").alias("sentence_ids"), "n_sentences")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same scan for DuckDB."""
    known = {text: name for name, texts in SENTENCES.items() for text in texts}
    table = f"MAP {{{', '.join(f'{_quoted(k)}: {_quoted(v)}' for k, v in known.items())}}}"
    has = lambda rule: f"contains(row_, {_quoted(',' + ','.join(rule) + ',')})"
    found = [f"CASE WHEN {has(rule)} THEN {_quoted(name)} END" for name, rule in RULES]
    found += [f"CASE WHEN {has(rule)} AND NOT ({' OR '.join(has(r) for n, r in RULES if n == longer)}) THEN {_quoted(name)} END" for name, rule, longer in SHORTER]
    low = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    norm = rf"trim(regexp_replace(regexp_replace({low}, '\.([^0-9]|$)|[^a-z0-9.]+', ' \1', 'g'), '[^a-z0-9.]+|[.]+( |$)', ' ', 'g'))"
    # every line has a line feed of its own at either end, as there is no looking ahead here
    lines = rf"list_filter(list_transform(regexp_split_to_array(x, '[\r\n]+'), lambda x: {norm}), lambda y: y <> '')"
    texts = "|".join(text.replace(".", "[.]").replace(" ", r"(?: |\n\n)") for text in sorted(known, key=len, reverse=True))
    runs = rf"regexp_extract_all(chr(10) || array_to_string({lines}, chr(10) || chr(10)) || chr(10), '\n({texts})\n', 1)"
    return rf"""
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{ENDS}'), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS raw,
    list_transform(regexp_extract_all(coalesce(text, ''), '{SPDX}', 1), lambda x: 'SPDX:' || x) AS tags
  FROM documents
), named AS (
  SELECT doc_id, tags, len(raw) AS n_sentences,
    list_filter(list_transform(flatten(list_transform(raw, lambda x: {runs})), lambda z: {table}[replace(z, chr(10) || chr(10), ' ')]), lambda x: x IS NOT NULL) AS ids
  FROM cut
), joined AS (
  SELECT *, ',' || coalesce(array_to_string(ids, ','), '') || ',' AS row_ FROM named
)
SELECT doc_id,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL), tags))), ','), '') AS licenses,
  coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  CAST(n_sentences AS INTEGER) AS n_sentences
FROM joined"""
