"""Licence scans by sentence rules, with SQL functions alone.

A text is cut to sentences, at their marks and at blank lines, so a wrapped line goes on in the next one. A sentence is
normalised (lower case, words parted by single spaces) and mapped to the identifiers of the licence sentences it holds, in order.
The identifiers of the text are then matched against licence rules, the strictest first; what a rule has matched is
used up, so a licence's own disclaimer does not count again under a weaker rule. SPDX lines name their licences
themselves. Every document is read in its own row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Identifiers of licence sentences and the normalised sentences they stand for, the first that fits.
SENTENCES = [
    ("ApacheRef2", r"\bapache (software )?licen[sc]e (version |v)?2( 0)?\b"),
    ("ApacheLink2", r"\bwww apache org licenses license 2 0\b"),
    ("ApacheNotice", r"you may not use this file except in compliance with the license"),
    ("ApacheWarranty", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("MitRef", r"\bmit licen[sc]e\b"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included"),
    ("IscGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("Lgpl3Ref", r"\bgnu lesser general public license (as published by the free software foundation )?(either )?(version |v)3\b"),
    ("Lgpl21Ref", r"\bgnu lesser general public license (as published by the free software foundation )?(either )?(version |v)2 1\b"),
    ("Agpl3Ref", r"\bgnu affero general public license (as published by the free software foundation )?(either )?(version |v)3\b"),
    ("Gpl3Ref", r"\bgnu general public license (as published by the free software foundation )?(either )?(version |v)3\b"),
    ("Gpl2Ref", r"\bgnu general public license (as published by the free software foundation )?(either )?(version |v)2\b"),
    ("GplAnyRef", r"\bgnu (lesser |affero )?general public license\b"),
    ("LaterVersion", r"\bor (at your option )?any later version\b|\bor later\b"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdNames", r"\bneither the names? of [a-z0-9 ]*may be used to endorse or promote products\b"),
    ("BsdRef", r"\b(released|licensed|distributed) under the (terms of the )?bsd license\b"),
    ("Mpl2Ref", r"\bmozilla public license (version |v )?2 0\b"),
    ("CcByNcSa4Ref", r"\b(cc by nc sa 4 0|creative commons attribution noncommercial sharealike 4 0)\b"),
    ("CcByNcNd4Ref", r"\b(cc by nc nd 4 0|creative commons attribution noncommercial noderivatives 4 0)\b"),
    ("CcByNc4Ref", r"\b(cc by nc 4 0|creative commons attribution noncommercial 4 0)\b"),
    ("CcBySa4Ref", r"\b(cc by sa 4 0|creative commons attribution sharealike 4 0)\b"),
    ("CcBy4Ref", r"\b(cc by 4 0|creative commons attribution 4 0)\b"),
    ("Cc0Ref", r"\b(cc0 1 0|cc0)\b"),
    ("Unlicense", r"free and unencumbered software released into the public domain"),
    ("AsIs", r"\b(the|this) software is provided (by [a-z0-9 ]*)?as is\b"),
    ("AllRights", r"\ball rights reserved\b"),
    ("SpdxLine", r"\bspdx license identifier\b"),
    ("UnknownLicence", r"\blicen[sc]ed? under\b"),  # counts only where a sentence holds nothing else
]
# Licence names and the sequences of identifiers that show them, in the order in which they are tried.
RULES = [
    ("Apache-2.0", ",ApacheRef2,(ApacheNotice,)?(ApacheLink2,)?(ApacheWarranty,)?"),
    ("Apache-2.0", ",(ApacheNotice,)?ApacheLink2,(ApacheWarranty,)?"),
    ("MIT", ",(MitRef,)?MitGrant,(MitNotice,)?(AsIs,)?"),
    ("MIT", ",MitRef,(AsIs,)?"),
    ("ISC", ",IscGrant,(AsIs,)?"),
    ("BSD-3-Clause", ",(AllRights,)?BsdSource,BsdBinary,BsdNames,(AsIs,)?"),
    ("BSD-2-Clause", ",(AllRights,)?BsdSource,BsdBinary,(AsIs,)?"),
    ("BSD", ",BsdRef,"),
    ("AGPL-3.0-or-later", ",Agpl3Ref,LaterVersion,(GplAnyRef,)*"),
    ("AGPL-3.0", ",Agpl3Ref,(GplAnyRef,)*"),
    ("LGPL-3.0", ",Lgpl3Ref,(LaterVersion,)?(GplAnyRef,)*"),
    ("LGPL-2.1", ",Lgpl21Ref,(LaterVersion,)?(GplAnyRef,)*"),
    ("GPL-3.0-or-later", ",Gpl3Ref,LaterVersion,(GplAnyRef,)*"),
    ("GPL-3.0", ",Gpl3Ref,(GplAnyRef,)*"),
    ("GPL-2.0-or-later", ",Gpl2Ref,LaterVersion,(GplAnyRef,)*"),
    ("GPL-2.0", ",Gpl2Ref,(GplAnyRef,)*"),
    ("GPL", ",GplAnyRef,(LaterVersion,|GplAnyRef,)*"),
    ("MPL-2.0", ",Mpl2Ref,"),
    ("CC-BY-NC-SA-4.0", ",CcByNcSa4Ref,"),
    ("CC-BY-NC-ND-4.0", ",CcByNcNd4Ref,"),
    ("CC-BY-NC-4.0", ",CcByNc4Ref,"),
    ("CC-BY-SA-4.0", ",CcBySa4Ref,"),
    ("CC-BY-4.0", ",CcBy4Ref,"),
    ("CC0-1.0", ",Cc0Ref,"),
    ("Unlicense", ",Unlicense,"),
    ("Proprietary", ",AllRights,"),
    ("Unknown", ",UnknownLicence,"),
]
# A sentence without one of these is no licence sentence; they keep the rules off all other text.
GATE = r"(?i)licen[sc]e|permission|redistribution|copyright|warrant|software|public domain|rights reserved|creative commons|\bcc0\b|\bcc[ -]by\b|later version|neither the name"
# A sentence ends at its mark or at a line without letters and figures.
SENTENCE_END = r"([.;!?])[ \t\r\n]+|\n[^A-Za-z0-9\n]*\n"
CUT = "\x01"
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+-]+)*)"
ANY = "|".join(f"(?:{p})" for _, p in SENTENCES)


def _quoted(pattern: str, engine: str) -> str:
    return pattern.replace("\\", "\\\\") if engine == "spark" else pattern


def identifier(found: str, engine: str) -> str:
    """SQL that names the licence sentence that a match is."""
    test = {"spark": "({x} RLIKE '^(?:{p})$')", "duckdb": "regexp_full_match({x}, '{p}')"}[engine]
    return "CASE " + " ".join(f"WHEN {test.format(x=found, p=_quoted(p, engine))} THEN '{name}'" for name, p in SENTENCES) + " END"


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``_identifiers`` (comma-joined, in text order) and ``_licences`` (names in the order of the rules, each
    once, and then those of SPDX lines).

    Null, empty and licence-free texts have neither. All rows and columns stay, repeated rows and ids too;
    a text of any length is read whole.
    """
    quote = lambda p: _quoted(p, "spark")
    sentences = f"filter(split(regexp_replace(`{text}`, '{quote(SENTENCE_END)}', '$1\\u0001'), '\\u0001', -1), s -> s RLIKE '{quote(GATE)}')"
    normal = f"transform({sentences}, s -> trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ')))"
    own = f"transform(regexp_extract_all(n, '{quote(ANY)}', 0), m -> {identifier('m', 'spark')})"
    known = "CASE WHEN exists(i, x -> x <> 'UnknownLicence') THEN filter(i, x -> x <> 'UnknownLicence') ELSE slice(i, 1, 1) END"
    found = f"flatten(transform(transform({normal}, n -> {own}), i -> {known}))"
    out = documents.withColumn("_identifiers", F.expr(f"CASE WHEN `{text}` RLIKE '{quote(GATE)}' THEN array_join({found}, ',') ELSE '' END"))
    # Between two identifiers a rule needs a comma of its own, so the sequence is held with commas around.
    left = F.concat(F.lit(","), F.col("_identifiers"), F.lit(","))
    named = []
    out = out.withColumn("_left", left)
    for k, (name, pattern) in enumerate(RULES):
        out = out.withColumn(f"_rule_{k}", F.col("_left").rlike(pattern)).withColumn("_left", F.regexp_replace("_left", pattern, ","))
        named.append(F.when(F.col(f"_rule_{k}"), F.lit(name)))
    spdx = F.expr(f"CASE WHEN contains(`{text}`, 'SPDX-License-Identifier:') THEN split(array_join(regexp_extract_all(`{text}`, '{quote(SPDX)}', 1), ' OR '), ' (?:AND|OR|WITH) ') ELSE array() END")
    names = F.array_distinct(F.concat(F.array_compact(F.array(*named)), F.coalesce(F.filter(spdx, lambda x: x != ""), F.array().cast("array<string>"))))
    out = out.withColumn("_licences", F.array_join(names, ","))
    return out.drop("_left", *[f"_rule_{k}" for k in range(len(RULES))])


def report(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences (licence sentences), identifiers, licences."""
    out = scan(documents.select("doc_id", "text"))
    n = F.when(F.col("_identifiers") == "", 0).otherwise(F.size(F.split("_identifiers", ",")))
    return out.select("doc_id", n.cast("long").alias("n_sentences"), F.col("_identifiers").alias("identifiers"), F.col("_licences").alias("licences"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    steps = ["s0 AS (SELECT doc_id, text, identifiers, ',' || identifiers || ',' AS rest FROM ids)"]
    for k, (_, pattern) in enumerate(RULES):
        steps.append(f"s{k + 1} AS (SELECT * EXCLUDE (rest), regexp_matches(rest, '{pattern}') AS r{k}, regexp_replace(rest, '{pattern}', ',', 'g') AS rest FROM s{k})")
    names: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(RULES):
        names.setdefault(name, []).append(k)
    listed = ", ".join(f"CASE WHEN {' OR '.join(f'r{k}' for k in ks)} THEN '{name}' END" for name, ks in names.items())
    cut = f"string_split(regexp_replace(coalesce(text, ''), '{SENTENCE_END}', '\\1' || chr(1), 'g'), chr(1))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text FROM documents), sentences AS (
  SELECT d, unnest({cut}) AS s, generate_subscripts({cut}, 1) AS k FROM docs
), matched AS (
  SELECT d, k, regexp_extract_all(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), '{ANY}') AS ms FROM sentences WHERE regexp_matches(s, '{GATE}')
), each_one AS (SELECT d, k, unnest(ms) AS m, generate_subscripts(ms, 1) AS j FROM matched
), found AS (SELECT d, k, j, {identifier('m', 'duckdb')} AS i FROM each_one
), kept AS (SELECT * FROM found f WHERE i <> 'UnknownLicence' OR j = (SELECT min(j) FROM found g WHERE g.d = f.d AND g.k = f.k) AND NOT EXISTS (SELECT 1 FROM found g WHERE g.d = f.d AND g.k = f.k AND g.i <> 'UnknownLicence')
), ids AS (
  SELECT docs.doc_id, docs.text, coalesce(f.identifiers, '') AS identifiers
  FROM docs LEFT JOIN (SELECT d, string_agg(i, ',' ORDER BY k, j) AS identifiers FROM kept GROUP BY 1) f USING (d)
), {", ".join(steps)}
SELECT doc_id, CASE WHEN identifiers = '' THEN 0 ELSE len(string_split(identifiers, ',')) END::BIGINT AS n_sentences, identifiers,
  array_to_string(list_filter(names, lambda x, n: list_position(names, x) = n), ',') AS licences
FROM (SELECT *, list_concat(list_filter([{listed}], lambda x: x IS NOT NULL),
  list_filter(string_split_regex(array_to_string(regexp_extract_all(text, '{SPDX}', 1), ' OR '), ' (?:AND|OR|WITH) '), lambda x: x <> '')) AS names FROM s{len(RULES)})"""
