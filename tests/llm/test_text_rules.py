"""Quality rules, decontamination and licence scans against brute force and SQL."""

import collections
import math
import re

import duckdb

from maskwright.llm import op1_quality as q
from maskwright.llm import op2_decontaminate as d
from maskwright.llm import op4_licences as li
from tests.llm.cases import documents, empty, key


def brute_base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    repeat = len(covered)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, len(words) < 10 or 100 * repeat > 20 * len(words)


def test_quality_base_and_distances(spark):
    docs = documents(spark)
    rows = docs.collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.verdicts(docs).collect())
    assert got == collections.Counter((r.doc_id, *brute_base(r.text)) for r in rows)
    # Distances against references of plain counts.
    language = lambda r: r.lang if r.lang in q.COMMON else "other"
    classes = [re.compile(c) for c in ("[a-zà-ÿ]", "[A-ZÀ-Þ]", "[0-9]", "[ \t-\r]", "[#*$%&|<>]")]
    histogram = lambda t: [len(p.findall(t)) for p in classes]
    total = collections.defaultdict(lambda: [0] * 6)
    for r in rows:
        h = histogram(r.text or "")
        h.append(len(r.text or "") - sum(h))
        if len((r.text or "").split()) >= q.MIN_WORDS:
            total[language(r)] = [a + b for a, b in zip(total[language(r)], h)]
    by_id = {r.doc_id: r for r in q.verdicts(docs).collect() if r.doc_id is not None and r.doc_id != 103}
    for r in rows:
        if r.doc_id in by_id and by_id[r.doc_id].n_words >= q.MIN_WORDS and by_id[r.doc_id].word_chars >= q.MIN_CHARS:
            h = histogram(r.text)
            h.append(len(r.text) - sum(h))
            p, s = [x / sum(h) for x in h], [x / sum(total[language(r)]) for x in total[language(r)]]
            kl = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x)
            assert abs(by_id[r.doc_id].class_distance - math.sqrt(max(0, (kl(p, s) + kl(s, p)) / 2))) < 2e-6
    junk = by_id[109]
    assert not junk.kept and by_id[103 + 1].kept


def test_quality_equals_sql(spark, tmp_path):
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = q.query(spark, str(tmp_path))
    columns = sorted(df.columns)
    plain = lambda x: round(float(x), 5) if isinstance(x, float) else x
    want = [tuple(plain(x) for x in r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({q.ORACLE_SQL})").fetchall()]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == sorted(want, key=key)


def test_quality_stage_keeps_columns_and_rows(spark):
    docs = documents(spark)
    kept = q.quality_rules(docs)
    assert kept.columns == docs.columns
    verdicts = collections.Counter(r.doc_id for r in q.verdicts(docs).filter("kept").collect())
    assert collections.Counter(r.doc_id for r in kept.collect()) == verdicts
    assert q.quality_rules(empty(spark)).count() == 0 and q.verdicts(empty(spark)).count() == 0


ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."


def contamination(spark):
    words = ITEM.split()
    gap = lambda i: " ".join(words[:i] + ["hole"] + words[i:])
    extra = [
        (200, "before it " + ITEM.upper() + " and after", "en"),
        (201, "x " + gap(6), "en"),  # four of sixteen shingles are lost
        (202, "x " + gap(1), "en"),  # one is
        (203, "short item", "en"),
        (204, "a short item inside", "en"),
        (205, ITEM + " " + "filler words " * 3000 + ITEM, "en"),
        (206, "re-repeat re-repeat re-repeat re-repeat re-repeat", "en"),
    ]
    items = spark.createDataFrame([(1, ITEM), (2, "Short item!"), (3, None), (4, ""), (None, ITEM), (5, "repeat re repeat re repeat re repeat re"), (6, ITEM)], "item_id long, text string")
    return documents(spark, extra), items


def test_containment_equals_sql(spark):
    docs, items = contamination(spark)
    con = duckdb.connect()
    con.register("d", docs.toPandas()), con.register("b", items.toPandas())
    con.sql("CREATE VIEW documents AS SELECT * FROM d; CREATE VIEW benchmark AS SELECT * FROM b WHERE item_id IS NOT NULL")
    want = con.sql(d.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in d.contained(docs, items).select("doc_id", "item_id", "n_shared", "n_shingles", "containment").collect()]
    assert sorted(got, key=key) == sorted(((int(a), int(b), *r) for a, b, *r in want), key=key)
    assert {200, 202, 203, 205, 206} == {r[0] for r in got}


def test_decontaminated(spark, monkeypatch):
    docs, items = contamination(spark)
    left = d.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(key, left.collect())) == sorted(key(r) for r in docs.collect() if r.doc_id not in (200, 202, 203, 205, 206))
    assert d.decontaminate(empty(spark), items).count() == 0 and d.contained(docs, items.limit(0)).count() == 0
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    monkeypatch.setattr("maskwright.llm.common.BROADCAST_ROWS", 0)
    assert sorted(map(key, d.decontaminate(docs, items).collect())) == sorted(map(key, left.collect()))


def test_licences(spark):
    full = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."
    extra = [
        (300, "text\nReleased under the MIT License.\nmore", "en"),
        (301, full + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.", "en"),
        (302, full, "en"),
        (303, "Licensed under the Apache License, Version 2.0. Unknown words. You may not use this file except in compliance with the License. You may obtain a copy of the License at", "en"),
        (304, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.", "en"),
    ]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in li.licences(documents(spark, extra)).collect()}
    assert got[300] == ("mit_under", "MIT") and got[301] == ("mit_grant,mit_notice,mit_as_is", "MIT") and got[302] == ("mit_grant", "")
    assert got[303] == ("apache_under,apache_use,apache_copy", "Apache-2.0") and got[304][1] == "GPL-3.0,CC-BY-NC-4.0"
    assert got[100] == ("", "") and li.licences(empty(spark)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_licences_by_their_notices(spark):
    notices = {
        "GPL-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
        "LGPL-2.1": "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.",
        "LGPL-3.0": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
        "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
        "ISC": 'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS. IN NO EVENT',
        "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.',
        "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free",
        "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n",
        "BSL-1.0": "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)",
        "CDDL-1.0": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.',
        "Perl": "This module is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
        "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "MulanPSL-2.0": "X is licensed under Mulan PSL v2.\nYou can use this software according to the terms and conditions of the Mulan PSL v2.",
    }
    notices |= {name: li.SENTENCES[rule[0]][-1] for name, rules in li.RULES.items() if name not in notices for rule in rules if len(rule) == 1}
    got = {r.doc_id: r.licences for r in li.licences(documents(spark, [(i, text, "en") for i, text in enumerate(notices.values())])).collect()}
    assert [got[i] for i in range(len(notices))] == list(notices)
    assert len(li.RULES) >= 30


def test_every_licence_sentence_has_a_cue():
    assert all(re.search(li.CUES, x) for known in (li.SENTENCES, li.WHOLE) for texts in known.values() for x in texts)


def test_wrapped_verbatim_licences(spark):
    texts = {"MIT": MIT, "GPL-3.0": GPL3, "Apache-2.0": APACHE, "BSD-3-Clause": BSD3}
    flat = lambda t: "\n\n".join(" ".join(x.split()) for x in t.split("\n\n"))
    shapes = [lambda t: t, flat, lambda t: t.replace("\n", "\r\n"), *(lambda t, m=m: "".join(f"{m}{x}\n" for x in t.split("\n")) for m in (" * ", "// ", "# ", "; ", "rem ", "dnl ", "-- "))]
    cases = [(300 + i, "code\n\n" + shape(t) + "\nmore", name) for i, (name, t, shape) in enumerate((n, t, s) for n, t in texts.items() for s in shapes)]
    got = {r.doc_id: r for r in li.licences(documents(spark, [(i, t, "en") for i, t, _ in cases])).collect()}
    for i, t, name in cases:
        assert got[i].licences == name, (name, t, got[i])
    assert got[300].sentence_ids == "mit_grant,mit_notice,mit_as_is"


def test_sentences_end_at_paragraphs_and_words(spark):
    extra = [(300, "all rights\n\nreserved", "en"), (301, "nearly all rights reserved", "en"), (302, "all\nrights reserved\nfor now", "en"), (303, "all rights reserved for now", "en"), (304, "notice:\n all rights reserved \nfor now", "en")]
    got = {r.doc_id: r.sentence_ids for r in li.licences(documents(spark, extra)).collect()}
    assert [got[i] for i in range(300, 305)] == ["", "", "reserved", "", "reserved"]


def test_bsd_rules_prefer_the_longer(spark):
    two = " ".join(s[0] + "." for s in (li.SENTENCES["bsd_redistribute"], li.SENTENCES["bsd_source"], li.SENTENCES["bsd_binary"]))
    df = documents(spark, [(400, two, "en"), (401, two + " " + li.SENTENCES["bsd_endorse"][0], "en")])
    got = {r.doc_id: r.licences for r in li.licences(df).collect()}
    assert got[400] == "BSD-2-Clause" and got[401] == "BSD-3-Clause"
