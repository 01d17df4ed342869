import re

from loomkit.llm.licences import LIKELY, SENTENCES, scan_licences
from tests.llm.helpers import docs_frame

APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *     http://www.apache.org/licenses/LICENSE-2.0
 * Unless required by applicable law, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES.  See the License for the specific language governing permissions.
 */"""
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software.

The above copyright notice and this permission notice shall be included in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted. "
       "Redistributions of source code must retain the notice. Redistributions in binary form must reproduce it. ")
CASES = [
    (1, APACHE, "Apache-2.0"), (2, MIT, "MIT"), (3, BSD + "Neither the name of X may be used to endorse or promote.", "BSD-3-Clause"),
    (4, BSD, "BSD-2-Clause"), (5, "Text.\nReleased under the MIT License.", "MIT"), (6, "Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
    (7, "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    (8, "Under the GNU General Public License as published, either version 2 or any later version.", "GPL-2.0-or-later"),
    (9, "SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), (10, "The committee was under review. No terms here.", ""),
    (11, None, ""), (12, "", ""), (13, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "Apache-2.0,MIT"),
    (14, "GNU Affero General Public License v3. " + "filler words " * 20_000, "AGPL-3.0"),
    (15, "The term licence 'by any other name' warrants nothing.", ""), (None, "Released under the MIT License.", "MIT")]


def test_known_notices(spark):
    out = scan_licences(docs_frame(spark, [c[:2] for c in CASES] + [(5, CASES[4][1])]))
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Exchange"))
    rows = out.collect()
    assert len(rows) == len(CASES) + 1
    got = {r.doc_id: r.licences for r in rows}
    assert got == {i: w for i, _, w in CASES}
    assert {r.doc_id: r.unmatched for r in rows}[1] == ""
    assert scan_licences(docs_frame(spark, [])).count() == 0


# one normalised example of every known sentence
EXAMPLES = {
    "spdx_apache2": "spdx license identifier apache 2.0", "spdx_mit": "spdx license identifier mit",
    "spdx_bsd3": "spdx license identifier bsd 3 clause", "spdx_bsd2": "spdx license identifier bsd 2 clause",
    "spdx_agpl3": "spdx license identifier agpl 3.0", "spdx_lgpl": "spdx license identifier lgpl",
    "spdx_isc": "spdx license identifier isc", "spdx_epl2": "spdx license identifier epl 2.0",
    "spdx_gpl3_later": "spdx license identifier gpl 3.0 or later", "spdx_gpl2_later": "spdx license identifier gpl 2.0+",
    "spdx_gpl3": "spdx license identifier gpl 3.0", "spdx_gpl2": "spdx license identifier gpl 2.0",
    "spdx_mpl2": "spdx license identifier mpl 2.0", "apache2_under": "licensed under apache license 2.0",
    "apache2_maynot": "you may not use it except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license",
    "apache2_asis": "distributed under the license is distributed on an as is basis",
    "apache2_perms": "see the license for the specific language governing permissions",
    "mit_under": "available under mit licence", "mit_name": "mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy",
    "mit_notice": "copyright notice and this permission notice shall be included in all copies",
    "mit_asis": "the software is provided as is without warranty of any kind",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd_source": "redistributions of source code must retain",
    "bsd_binary": "redistributions in binary form must reproduce",
    "bsd_name": "neither the name of x may be used to endorse or promote", "bsd_under": "released under the 3 clause bsd",
    "agpl3_under": "gnu affero general public license", "lgpl_under": "gnu library general public license",
    "gpl3_later": "gplv3+", "gpl2_later": "gplv2+", "gpl3_under": "gpl v3", "gpl2_under": "gpl v2",
    "gpl_under": "licensed under gpl", "gpl_either": "either version 2 of the license or",
    "mpl2_under": "mozilla public license 2.0", "cc_by_nc_sa": "cc by nc sa", "cc_by_nc_nd": "cc by nc nd",
    "cc_by_nc": "cc by nc", "cc_by_sa": "cc by sa", "cc_by_nd": "cc by nd", "cc_by": "cc by", "cc0": "cc0",
    "unlicense": "free and unencumbered software released into the public domain",
    "public_domain": "placed in the public domain", "all_rights": "all rights reserved"}


def test_every_known_sentence_passes_the_filter(spark):
    assert list(EXAMPLES) == [n for n, _ in SENTENCES]
    for name, pattern in SENTENCES:
        assert re.search(pattern, EXAMPLES[name]) and re.search(LIKELY, EXAMPLES[name]), name
    texts = ["Released under the 3-clause BSD.", "Available under the BSD terms.", "Distributed under the new BSD."]
    got = scan_licences(docs_frame(spark, list(enumerate(texts)))).collect()
    assert [r.licences for r in got] == ["BSD"] * 3


def test_several_licences_in_one_run(spark):
    cases = [("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0", "spdx_mit,spdx_apache2", "Apache-2.0,MIT"),
             ("Licensed under the MIT License or licensed under the Apache License, Version 2.0", "mit_under,apache2_under",
              "Apache-2.0,MIT"),
             ("MIT License\nReleased under the new BSD", "mit_name,bsd_under", "MIT,BSD"),
             ("Licensed under the GPL v3", "gpl3_under", "GPL-3.0"), ("Under CC BY-NC-SA and CC0", "cc_by_nc_sa,cc0", "CC-BY-NC-SA,CC0"),
             ("GNU General Public License version 2 or GNU General Public License version 3 or later", "gpl2_under,gpl3_later",
              "GPL-3.0-or-later,GPL-2.0")]
    got = scan_licences(docs_frame(spark, [(i, c[0]) for i, c in enumerate(cases)])).orderBy("doc_id").collect()
    assert [(r.sentence_ids, r.licences) for r in got] == [c[1:] for c in cases]


def test_tags_with_later_versions_and_word_starts(spark):
    cases = [("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"), ("SPDX-License-Identifier: GPL-3.0+", "GPL-3.0-or-later"),
             ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("SPDX-License-Identifier: ISC", "ISC"),
             ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"), ("the transcc by-pass accounts", ""), ("macc0unt", ""),
             ("See CC BY 4.0 or CC0.", "CC-BY,CC0")]
    got = scan_licences(docs_frame(spark, [(i, t) for i, (t, _) in enumerate(cases)])).collect()
    assert {r.doc_id: r.licences for r in got} == {i: w for i, (_, w) in enumerate(cases)}
