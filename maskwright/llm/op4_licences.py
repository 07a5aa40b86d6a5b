"""Licence scans by sentence rules.

A sentence begins at the start of a line or after . ; : ! ? and space, and ends before the
next such place. It may run over line ends of one paragraph, each of which then counts as
a space, as do comment marks at the start of a line. A sentence is normalised (lower case,
each run of other characters than letters and digits one space) and mapped to the
identifier of a known licence sentence, the longest that begins at a place. The sequence of a document's identifiers,
in order, is matched against the ordered rules; a rule names a licence if its identifiers
stand in the sequence one after the other, unknown sentences between them left out, and a
licence whose rule is a part of a longer matched rule is not named beside it.

One projection with built-in functions, no shuffle; a document without any of the cue
words is not cut at all. The tables of sentences and rules are constants.

Defined cases: null text is the empty text; a document without a known sentence has empty
results; repeated rows are scanned each; a sentence known twice counts twice in sequence;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import let, table, text_or_empty

#: Normalised sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache_under": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this project is licensed under the apache license version 2 0"],
    "apache_use": ["you may not use this file except in compliance with the license"],
    "apache_copy": ["you may obtain a copy of the license at"],
    "as_is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit_under": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit_as_is": ["the software is provided as is without warranty of any kind express or implied"],
    "gpl3_under": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl_free": ["this program is free software"],
    "gpl3_redistribute": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2_redistribute": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "bsd_redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc_by_under": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc_by_sa_under": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc_by_nc_under": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "reserved": ["all rights reserved"],
    "gpl_terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl_terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl_terms": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "either_2": ["either version 2 of the license or at your option any later version"],
    "either_21": ["either version 2 1 of the license or at your option any later version"],
    "either_3": ["either version 3 of the license or at your option any later version"],
    "lgpl21_redistribute": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl3_redistribute": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl3_redistribute": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "mpl_form": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl2_copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "zero_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "isc_as_is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "zlib_as_is": ["this software is provided as is without any express or implied warranty"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "boost_under": ["distributed under the boost software license version 1 0"],
    "epl1_under": ["this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html"],
    "epl2_under": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "cddl_subject": ["the contents of this file are subject to the terms of the common development and distribution license the license"],
    "eupl_under": ["licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence"],
    "wtfpl_terms": ["you can redistribute it and or modify it under the terms of the do what the fuck you want to public license version 2 as published by sam hocevar"],
    "perl_terms": ["you can redistribute it and or modify it under the same terms as perl itself"],
    "artistic2": ["the artistic license 2 0 gpl compatible"],
    "ofl_under": ["this font software is licensed under the sil open font license version 1 1"],
    "mulan_use": ["you can use this software according to the terms and conditions of the mulan psl v2"],
    "ms_pl_under": ["licensed under the microsoft public license ms pl", "licensed under the microsoft public license"],
    "cc0_under": ["licensed under cc0 1 0", "this work is licensed under cc0 1 0"],
    "cc_by_nd_under": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"],
    "cc_by_nc_sa_under": ["licensed under cc by nc sa 4 0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"],
    "cc_by_nc_nd_under": ["licensed under cc by nc nd 4 0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"],
    "cc_by3_under": ["licensed under cc by 3 0", "this work is licensed under a creative commons attribution 3 0 unported license"],
    "cc_by_sa3_under": ["licensed under cc by sa 3 0", "this work is licensed under a creative commons attribution sharealike 3 0 unported license"],
}
#: The whole published sentences of which SENTENCES has the first part.
WHOLE = {
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_as_is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
}
#: Ordered rules, longest of a licence first.
RULES = {
    "Apache-2.0": [["apache_under", "apache_use", "apache_copy", "as_is"], ["apache_under", "apache_use", "apache_copy"], ["apache_under"]],
    "MIT": [["mit_grant", "mit_notice", "mit_as_is"], ["mit_under"]],
    "GPL-3.0": [["gpl_free", "gpl_terms", "either_3"], ["gpl_free", "gpl3_redistribute"], ["gpl3_under"]],
    "GPL-2.0": [["gpl_free", "gpl_terms", "either_2"], ["gpl_free", "gpl2_redistribute"]],
    "BSD-3-Clause": [["bsd_redistribute", "bsd_source", "bsd_binary", "bsd_endorse"]],
    "BSD-2-Clause": [["bsd_redistribute", "bsd_source", "bsd_binary"]],
    "CC-BY-4.0": [["cc_by_under"]],
    "CC-BY-SA-4.0": [["cc_by_sa_under"]],
    "CC-BY-NC-4.0": [["cc_by_nc_under"]],
    "all-rights-reserved": [["reserved"]],
    "LGPL-2.1": [["lgpl_terms", "either_21"], ["lgpl21_redistribute"]],
    "LGPL-3.0": [["lgpl_terms", "either_3"], ["lgpl3_redistribute"]],
    "AGPL-3.0": [["agpl_terms", "either_3"], ["agpl3_redistribute"]],
    "MPL-2.0": [["mpl_form", "mpl2_copy"]],
    "ISC": [["isc_grant", "isc_as_is"]],
    "0BSD": [["zero_grant", "isc_as_is"]],
    "Unlicense": [["unlicense"]],
    "Zlib": [["zlib_as_is", "zlib_grant"]],
    "BSL-1.0": [["boost_under"]],
    "EPL-1.0": [["epl1_under"]],
    "EPL-2.0": [["epl2_under"]],
    "CDDL-1.0": [["cddl_subject", "apache_use"]],
    "EUPL-1.2": [["eupl_under"]],
    "WTFPL": [["wtfpl_terms"]],
    "Perl": [["perl_terms"]],
    "Artistic-2.0": [["artistic2"]],
    "OFL-1.1": [["ofl_under"]],
    "MulanPSL-2.0": [["mulan_use"]],
    "MS-PL": [["ms_pl_under"]],
    "CC0-1.0": [["cc0_under"]],
    "CC-BY-ND-4.0": [["cc_by_nd_under"]],
    "CC-BY-NC-SA-4.0": [["cc_by_nc_sa_under"]],
    "CC-BY-NC-ND-4.0": [["cc_by_nc_nd_under"]],
    "CC-BY-3.0": [["cc_by3_under"]],
    "CC-BY-SA-3.0": [["cc_by_sa3_under"]],
}
#: What stands before the first word of a line, comment marks among it.
MARKS = "(^|\n)[^\\p{L}\\p{N}\n]*(?:(?:rem|dnl)(?![\\p{L}\\p{N}])[^\\p{L}\\p{N}\n]*)?"
CUES = "licen[cs]e|redistribut|permission|free software|copyright|cc by|warrant|rights reserved|public domain|the mpl was|mulan psl"


def _identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = {x: name for table in (SENTENCES, WHOLE) for name, texts in table.items() for x in texts}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # Ends of sentences and paragraphs become \x01; single line ends stay as they are.
    plain = F.regexp_replace(F.lower(text), MARKS, "$1")
    plain = F.regexp_replace(plain, "(?<=[.;:!?])\\s+|\n\n+", "\x01")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, "[^\\p{L}\\p{N}\n\x01]+", " "), " *([\n\x01]) *", "$1"))
    any_of = "|".join(x.replace(" ", "[ \n]") for x in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(plain, F.lit(f"(?<=^|[\n\x01])({any_of})(?=[\n\x01]|$)"), F.lit(1))
    ids = let(names, lambda m: F.transform(found, lambda s: F.try_element_at(m, F.translate(s, "\n", " "))))
    return F.when(F.lower(text).rlike(CUES), ids).otherwise(F.array().cast("array<string>"))


def _matched(ids: Column) -> Column:
    """Licences whose rule is in the sequence, in the order of RULES."""
    within = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    has = lambda seq, rule: seq.contains("," + ",".join(rule) + ",")
    part = lambda a, b: a != b and "," + ",".join(a) + "," in "," + ",".join(b) + ","
    rules = [(name, rule) for name, rules in RULES.items() for rule in rules]

    def named(seq: Column) -> Column:
        # The rules that contain this one are blanked first, so that it must also stand by itself.
        def alone(rule: list[str]) -> Column:
            rest = seq
            for _, longer in rules:
                if part(rule, longer):
                    rest = F.replace(rest, F.lit("," + ",".join(longer) + ","), F.lit(",,"))
            return has(rest, rule)

        picks = []
        for name in RULES:
            found = F.lit(False)
            for own, rule in rules:
                if own == name:
                    found = found | alone(rule)
            picks.append(F.when(found, F.lit(name)))
        return F.filter(F.array(*picks), lambda x: x.isNotNull())

    return F.when(F.size(ids) > 0, let(within, named)).otherwise(F.array().cast("array<string>"))


def licences(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_sentences (known ones), sentence_ids, licences (comma-joined)."""
    rows = docs.select("doc_id", F.inline_outer(F.transform(F.array(_identifiers(text_or_empty())), lambda i: F.struct(i.alias("ids"), _matched(i).alias("names")))))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join("names", ",").alias("licences"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = ", ".join(f"('{text}', '{name}')" for name, texts in SENTENCES.items() for text in texts)
    simple = {name: rule[0] for name, rules in RULES.items() for rule in rules if len(rule) == 1}
    names = ", ".join(f"CASE WHEN list_contains(ids, '{i}') THEN '{name}' END" for name, i in simple.items())
    return f"""
WITH known(plain, id) AS (VALUES {known}),
cut AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.;:!?])\\s+', '\\1' || chr(10), 'g'), '\\n')) AS s,
  generate_subscripts(string_split_regex(regexp_replace(text, '([.;:!?])\\s+', '\\1' || chr(10), 'g'), '\\n'), 1) AS k FROM documents),
hits AS (SELECT doc_id, list(id ORDER BY k) AS ids FROM cut JOIN known ON plain = trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ids), 0) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ','), '') AS licences
FROM documents d LEFT JOIN hits h USING (doc_id)
"""


#: The tables at hand have one-sentence notices only; the longer rules have tests of their own.
ORACLE_SQL = _oracle()
