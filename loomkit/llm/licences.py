"""Licence scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences, each sentence normalised (ASCII lower case, runs
of anything but letters, digits and ``.+-`` become one blank) and mapped to the
identifiers of the known licence sentences it holds, by position.  The identifiers of
a text, in order, are matched against ordered licence rules: a rule that
matches names a licence and uses up its identifiers, so that a longer notice is
taken before the sentences it is made of.

Everything is a projection over the row: no shuffle, no join, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences (regular expressions over normalised text,
# of those that overlap in the text the first in this list counts) and their identifiers.
SENTENCES = [
    ("spdx_apache2", r"spdx license identifier apache 2.0"),
    ("spdx_mit", r"spdx license identifier mit\b"),
    ("spdx_bsd3", r"spdx license identifier bsd 3 clause"),
    ("spdx_bsd2", r"spdx license identifier bsd 2 clause"),
    ("spdx_agpl3", r"spdx license identifier agpl 3.0"),
    ("spdx_lgpl", r"spdx license identifier lgpl"),
    ("spdx_isc", r"spdx license identifier isc\b"),
    ("spdx_epl2", r"spdx license identifier epl 2.0"),
    ("spdx_gpl3_later", r"spdx license identifier gpl 3.0(\+| or later\b)"),
    ("spdx_gpl2_later", r"spdx license identifier gpl 2.0(\+| or later\b)"),
    ("spdx_gpl3", r"spdx license identifier gpl 3.0"),
    ("spdx_gpl2", r"spdx license identifier gpl 2.0"),
    ("spdx_mpl2", r"spdx license identifier mpl 2.0"),
    ("apache2_under", r"licensed under (the )?apache license,? (version )?2.0"),
    ("apache2_maynot", r"you may not use (this file|this work|it) except in compliance with the license"),
    ("apache2_copy", r"you may obtain a copy of the license"),
    ("apache2_asis", r"distributed under the license is distributed on an as is basis"),
    ("apache2_perms", r"see the license for the specific language governing permissions"),
    ("mit_under", r"(released|licensed|distributed|available) under (the )?(terms of the )?mit licen[sc]e"),
    ("mit_name", r"^(the )?mit licen[sc]e( mit)?$"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"copyright notice and this permission notice shall be included in all copies"),
    ("mit_asis", r"the software is provided as is without warranty of any kind"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"redistributions of source code must retain"),
    ("bsd_binary", r"redistributions in binary form must reproduce"),
    ("bsd_name", r"neither the name of .* may be used to endorse or promote"),
    ("bsd_under", r"(released|licensed|distributed|available) under (the )?(terms of the )?(new |modified |3 clause |2 clause )?bsd"),
    ("agpl3_under", r"gnu affero general public license"),
    ("lgpl_under", r"gnu (lesser|library) general public license"),
    ("gpl3_later", r"gnu general public license.* version 3 or (any )?later|gplv?3\+|gnu gpl v?3 or later"),
    ("gpl2_later", r"gnu general public license.* version 2 or (any )?later|gplv?2\+|gnu gpl v?2 or later"),
    ("gpl3_under", r"gnu general public license,? (version |v)3|gpl ?v3"),
    ("gpl2_under", r"gnu general public license,? (version |v)2|gpl ?v2"),
    ("gpl_under", r"gnu general public license|licensed under (the )?gpl"),
    ("gpl_either", r"either version [23] of the license or"),
    ("mpl2_under", r"mozilla public license,? (version |v\. ?)?2.0"),
    ("cc_by_nc_sa", r"cc by nc sa|creative commons attribution noncommercial sharealike"),
    ("cc_by_nc_nd", r"cc by nc nd|creative commons attribution noncommercial noderiv"),
    ("cc_by_nc", r"cc by nc|creative commons attribution noncommercial"),
    ("cc_by_sa", r"cc by sa|creative commons attribution sharealike"),
    ("cc_by_nd", r"cc by nd|creative commons attribution noderiv"),
    ("cc_by", r"cc by\b|creative commons attribution"),
    ("cc0", r"cc0\b|creative commons zero"),
    ("unlicense", r"free and unencumbered software released into the public domain"),
    ("public_domain", r"(released|placed|dedicated) (in|into|to) the public domain"),
    ("all_rights", r"all rights reserved"),
]

# Licence rules in order, over identifiers written ``,a,b,``.
RULES = [
    ("Apache-2.0", r",(apache2_under|apache2_maynot)(,(apache2_maynot|apache2_copy|apache2_under|apache2_asis|apache2_perms))*,"),
    ("Apache-2.0", r",spdx_apache2,"),
    ("MIT", r",(mit_name,|mit_under,)?mit_grant(,mit_notice)?(,mit_asis)?,"),
    ("MIT", r",(mit_under|mit_name|spdx_mit),"),
    ("BSD-3-Clause", r",bsd_grant,bsd_source,bsd_binary,bsd_name(,mit_asis)?,"),
    ("BSD-2-Clause", r",bsd_grant,bsd_source,bsd_binary(,mit_asis)?,"),
    ("BSD-3-Clause", r",spdx_bsd3,"),
    ("BSD-2-Clause", r",spdx_bsd2,"),
    ("BSD", r",(bsd_under|bsd_grant),"),
    ("ISC", r",isc_grant(,mit_asis)?,"),
    ("ISC", r",spdx_isc,"),
    ("EPL-2.0", r",spdx_epl2,"),
    ("AGPL-3.0", r",(agpl3_under|spdx_agpl3)(,(agpl3_under|gpl_either))*,"),
    ("LGPL", r",(lgpl_under|spdx_lgpl)(,(lgpl_under|gpl_either))*,"),
    ("GPL-3.0-or-later", r",gpl3_later(,(gpl_under|gpl3_under))*,"),
    ("GPL-2.0-or-later", r",gpl2_later(,(gpl_under|gpl2_under))*,"),
    ("GPL-3.0-or-later", r",spdx_gpl3_later,"),
    ("GPL-2.0-or-later", r",spdx_gpl2_later,"),
    ("GPL-3.0", r",(gpl3_under|spdx_gpl3)(,(gpl_under|gpl3_under))*,"),
    ("GPL-2.0", r",(gpl2_under|spdx_gpl2)(,(gpl_under|gpl2_under))*,"),
    ("GPL", r",gpl_under(,(gpl_under|gpl_either))*,"),
    ("MPL-2.0", r",(mpl2_under|spdx_mpl2),"),
    ("CC-BY-NC-SA", r",cc_by_nc_sa,"),
    ("CC-BY-NC-ND", r",cc_by_nc_nd,"),
    ("CC-BY-NC", r",cc_by_nc,"),
    ("CC-BY-SA", r",cc_by_sa,"),
    ("CC-BY-ND", r",cc_by_nd,"),
    ("CC-BY", r",cc_by,"),
    ("CC0", r",cc0,"),
    ("Unlicense", r",unlicense,"),
    ("public-domain", r",public_domain,"),
    ("proprietary", r",all_rights,"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HINT = ("licen|gpl|creative commons|cc by|cc0|permission|redistribution|warrant|as is|public domain|mozilla public"
        "|rights reserved|except in compliance|neither the name|general public|either version")
LIKELY = HINT + "|bsd"  # a sentence with none of these fragments holds no known sentence


def sentences(text: Column) -> Column:
    """Normalised sentences of a text.

    A sentence ends at ``.``, ``!``, ``?`` or ``;`` before white space, at a
    blank line, and at a line end before an SPDX tag or a licence verb ("released
    under"); comment marks at line starts are dropped, so a notice wrapped over
    lines is one sentence.
    """
    t = F.translate(text, _UPPER, _LOWER)
    t = F.regexp_replace(t, r"\n[ \t]*(?:[/*#;%]+|--+|rem\b|dnl\b)[ \t]*", "\n")
    t = F.regexp_replace(t, r"[.!?;][\"')]*[ \t\r\n]+|\n[ \t\r]*\n"
                         r"|\n[ \t]*(?=spdx-license-identifier|(?:released|licensed|distributed|available) under)", "\u0001")
    t = F.regexp_replace(t, r"[^a-z0-9.+\x01]+", " ")
    return F.split(t, "\u0001")


# one private character for each identifier; normalised text has none of them
_MARKS = {chr(0xE000 + i): name for i, (name, _) in enumerate(SENTENCES)}
_MARK = "\ue000-\uf8ff"


def _whole(pattern: str) -> str:
    """A known sentence begins where a word begins."""
    return rf"\b(?:{pattern})"


def _known(s: Column) -> Column:
    """Identifiers of all known sentences in ``s``, by position: in list order
    each takes its places, which later ones cannot use again."""
    for mark, (_, pattern) in zip(_MARKS, SENTENCES):
        # a gap neither spans a place that is taken nor begins another GNU notice
        s = F.regexp_replace(s, F.lit(_whole(pattern).replace(".*", f"(?:(?!gnu general public)[^{_MARK}])*?")), F.lit(mark))
    names = F.create_map(*[F.lit(x) for pair in _MARKS.items() for x in pair])
    return F.transform(F.regexp_extract_all(s, F.lit(f"([{_MARK}])"), F.lit(1)), lambda m: names[m])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, licences, unmatched)`` per document.

    ``n_sentences`` counts known licence sentences (several may stand in one
    sentence of the text), ``sentence_ids`` names them in order, ``licences`` the licences found (rule order, each once), separated by
    commas, and ``unmatched`` the sentences no rule used; all are empty strings
    where there are none.  Null texts have none; repeated rows are scanned each
    by itself, a null id stays null, an empty table gives no rows, other
    columns of ``docs`` are ignored.
    """
    likely = F.filter(sentences(F.coalesce(F.col(text_col), F.lit(""))), lambda s: F.regexp_like(s, F.lit(LIKELY)))
    ids = F.flatten(F.transform(likely, lambda s: _known(F.trim(s))))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("ids"))
    # separators are doubled, so that neighbouring rules need not share one
    out = out.withColumn("rest", F.when(F.size("ids") > 0, F.concat(
        F.lit(","), F.array_join("ids", ","), F.lit(","))).otherwise(""))
    names = []
    for i, (_, pattern) in enumerate(RULES):
        out = out.withColumn(f"hit{i}", F.regexp_like("rest", F.lit(pattern))) \
            .withColumn("rest", F.when(F.col(f"hit{i}"), F.regexp_replace("rest", pattern, ",,")).otherwise(F.col("rest")))
    for name in dict.fromkeys(n for n, _ in RULES):
        hit = F.lit(False)
        for i, (n, _) in enumerate(RULES):
            if n == name:
                hit = hit | F.col(f"hit{i}")
        names.append(F.when(hit, F.lit(name)))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        F.concat_ws(",", *names).alias("licences"),
        F.trim(F.regexp_replace("rest", ",+", ","), F.lit(",")).alias("unmatched"))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the rows of ``scan_licences``."""
    q = lambda s: s.replace("'", "''")
    case = " ".join(f"WHEN regexp_matches(s, '{q(_whole(p))}') THEN '{n}'" for n, p in SENTENCES)
    steps, last = [], "d"
    for i, (_, pattern) in enumerate(RULES):
        steps.append(f"r{i} AS (SELECT *, regexp_matches(rest{i}, '{q(pattern)}') AS hit{i}, "
                     f"regexp_replace(rest{i}, '{q(pattern)}', ',,', 'g') AS rest{i + 1} FROM {last})")
        last = f"r{i}"
    names = ", ".join("CASE WHEN " + " OR ".join(f"hit{i}" for i, (n, _) in enumerate(RULES) if n == name)
                      + f" THEN '{name}' END" for name in dict.fromkeys(n for n, _ in RULES))
    return rf"""
WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
        '\n[ \t]*(?:[/*#;%]+|--+|rem\b|dnl\b)[ \t]*', chr(10), 'g'),
        '[.!?;]["'')]*[ \t\r\n]+|\n[ \t\r]*\n', chr(1), 'g'),
        '[^a-z0-9.+\x01]+', ' ', 'g') AS t FROM {table}),
i AS (SELECT doc_id, list_filter(list_transform(list_filter(string_split(t, chr(1)), lambda s: regexp_matches(s, '{HINT}')),
        lambda x: (list_transform([trim(x)], lambda s: CASE {case} END))[1]), lambda y: y IS NOT NULL) AS ids FROM n),
d AS (SELECT *, CASE WHEN len(ids) > 0 THEN ',' || array_to_string(ids, ',') || ',' ELSE '' END AS rest0 FROM i),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       concat_ws(',', {names}) AS licences,
       trim(regexp_replace(rest{len(RULES)}, ',+', ',', 'g'), ',') AS unmatched FROM {last}"""
