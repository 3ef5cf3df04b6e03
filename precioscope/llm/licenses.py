"""Op 7: licence recognition by sentence rules.

A text is cut into sentences, each is normalised and looked up among known licence sentences, and
the sequence of their identifiers is matched against ordered rules.  A rule's identifiers must occur
in its order, other sentences may stand between them; a rule gives way to one that contains it.
Line ends of all kinds may stand inside a sentence: a piece that is not known is also tried together
with the one or two that follow it.  Everything is an expression over the document's row, so nothing is shuffled, and the sentence table
has a fixed size.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precioscope.functions.text import let, literals
from precioscope.llm.spdx import LICENSES

#: Names under which licences are given, by the identifier of their notice, and versions. How the word
#: license and a version are written makes no difference (``PLAIN_NAME``).
NAMES: dict[str, tuple[list[str], list[str]]] = {
    "mit-notice": (["MIT", "Expat", "MIT/X11", "MIT open source"], []),
    "isc-notice": (["ISC", "Internet Systems Consortium"], []),
    "bsd2-notice": (["BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "FreeBSD", "BSD 2-Clause Simplified"], []),
    "bsd3-notice": (["BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "Revised BSD", "BSD 3-Clause New or Revised"], []),
    "apache-notice": (["Apache", "Apache Software", "ASL"], ["2.0"]),
    "gpl2-notice": (["GNU General Public", "GNU GPL", "GPL", "GNU Public"], ["2"]),
    "gpl3-notice": (["GNU General Public", "GNU GPL", "GPL", "GNU Public"], ["3"]),
    "lgpl21-notice": (["GNU Lesser General Public", "GNU LGPL", "LGPL"], ["2.1"]),
    "lgpl3-notice": (["GNU Lesser General Public", "GNU LGPL", "LGPL"], ["3"]),
    "agpl-notice": (["GNU Affero General Public", "GNU AGPL", "AGPL", "Affero General Public"], ["3"]),
    "mpl-notice": (["Mozilla Public", "MPL"], ["2.0"]),
    "epl1-notice": (["Eclipse Public", "EPL"], ["1.0"]),
    "epl-notice": (["Eclipse Public", "EPL"], ["2.0"]),
    "boost-notice": (["Boost Software", "Boost"], ["1.0"]),
    "cddl-notice": (["Common Development and Distribution", "CDDL"], ["1.0"]),
    "artistic-notice": (["Artistic", "Perl Artistic"], ["2.0"]),
    "ofl-notice": (["SIL Open Font", "Open Font", "OFL"], ["1.1"]),
    "eupl-notice": (["European Union Public", "EUPL"], ["1.2"]),
    "zlib-notice": (["zlib", "zlib/libpng"], []),
    "wtfpl-notice": (["WTFPL", "Do What The Fuck You Want To Public"], []),
    "unlicense-notice": (["The Unlicense", "Unlicense"], []),
    "cc0-notice": (["CC0", "Creative Commons Zero", "Creative Commons CC0", "CC0 Universal"], ["1.0"]),
}
#: Notices of the GNU licences: identifier, licence, version.
FREE = [("gpl-free", "General", "3"), ("gpl2-free", "General", "2"), ("lgpl21-free", "Lesser General", "2.1"), ("lgpl3-free", "Lesser General", "3"), ("lgpl2-free", "Library General", "2"), ("lgpl2-free", "Lesser General", "2"), ("agpl-free", "Affero General", "3")]
CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
#: Sentences of public licence texts and notices by identifier.
SENTENCES = {
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "Distributed under the MIT License", "This software is released under the MIT License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice-kept": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is-software": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "no-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "isc-title": ["ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-as-is": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-no-endorsement": ["Neither the name of HOLDER nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-notice": ["Licensed under the BSD License", "Released under the BSD License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "apache-title": ["Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"],
    "apache-header": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License', 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'],
    "apache-notice": ['Licensed under the Apache License, Version 2.0 (the "License")', "Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "This project is licensed under the Apache License 2.0"],
    "apache-may-not": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-as-is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0", "Released under the GNU General Public License, version 3"],
    "gpl2-notice": ["Licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl2-only-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "This program is free software; you can redistribute it and/or modify it under the terms and conditions of the GNU General Public License, version 2, as published by the Free Software Foundation"],
    "gpl3-text": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "gpl2-text": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl21-text": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it"],
    "lgpl3-text": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-text": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"],
    "agpl-notice": ["Licensed under the GNU Affero General Public License, version 3"],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "mpl-text": ["Mozilla Public License Version 2.0", '"Covered Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof'],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain"],
    "cc0-notice": ["Released under CC0 1.0", "Licensed under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "cc-by-notice": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-notice": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-notice": ["Licensed under CC BY-ND 4.0"],
    "cc0-text": ["Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"],
    **{
        f"cc-{key}-text": [
            f"Creative Commons {name} 4.0 International Public License",
            f'By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {name} 4.0 International Public License ("Public License")',
        ]
        for key, name in CC.items()
    },
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "boost-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "boost-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'],
    "epl1-text": ["Eclipse Public License - v 1.0"],
    "epl-text": ["Eclipse Public License - v 2.0"],
    "epl-materials": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"],
    "epl1-materials": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "wtfpl-title": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "wtfpl-just": ["You just DO WHAT THE FUCK YOU WANT TO"],
    "cddl-text": ["COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"],
    "artistic-title": ["The Artistic License 2.0"],
    "ofl-text": ["SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
}
#: (licence, identifiers in order); a licence may have several rules.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-notice-kept", "as-is-software"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("MIT", ["mit-notice"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-title", "isc-grant"]),
    ("ISC", ["isc-notice"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-no-endorsement"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-no-endorsement"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-notice"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-may-not", "apache-copy"]),
    ("Apache-2.0", ["apache-may-not", "apache-as-is"]),
    ("Apache-2.0", ["apache-title"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("GPL-2.0-only", ["gpl2-only-free"]),
    ("GPL-2.0", ["gpl2-text"]),
    ("GPL-3.0", ["gpl3-text"]),
    ("GPL-3.0-or-later", ["gpl3-later-notice"]),
    ("GPL-2.0-or-later", ["gpl2-later-notice"]),
    ("LGPL-2.1", ["lgpl21-notice"]),
    ("LGPL-3.0", ["lgpl3-notice"]),
    ("LGPL-2.1-or-later", ["lgpl21-later-notice"]),
    ("LGPL-3.0-or-later", ["lgpl3-later-notice"]),
    ("LGPL-2.0-or-later", ["lgpl2-free"]),
    ("AGPL-3.0-or-later", ["agpl-later-notice"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-2.1", ["lgpl21-text"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-3.0", ["lgpl3-text"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("AGPL-3.0", ["agpl-text"]),
    ("AGPL-3.0", ["agpl-notice"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("MPL-2.0", ["mpl-text"]),
    ("Unlicense", ["unlicense-domain"]),
    ("Unlicense", ["unlicense-anyone"]),
    ("Unlicense", ["unlicense-notice"]),
    ("EPL-1.0", ["epl1-text"]),
    ("EPL-1.0", ["epl1-notice"]),
    ("EPL-1.0", ["epl1-materials"]),
    ("EPL-2.0", ["epl-text"]),
    ("EPL-2.0", ["epl-notice"]),
    ("EPL-2.0", ["epl-materials"]),
    ("BSL-1.0", ["boost-title"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-notice"]),
    ("WTFPL", ["wtfpl-title"]),
    ("WTFPL", ["wtfpl-just"]),
    ("WTFPL", ["wtfpl-notice"]),
    ("CDDL-1.0", ["cddl-text"]),
    ("CDDL-1.0", ["cddl-notice"]),
    ("Artistic-2.0", ["artistic-title"]),
    ("Artistic-2.0", ["artistic-notice"]),
    ("OFL-1.1", ["ofl-text"]),
    ("OFL-1.1", ["ofl-notice"]),
    ("EUPL-1.2", ["eupl-notice"]),
    ("Zlib", ["zlib-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("CC0-1.0", ["cc0-text"]),
    *[(f"CC-{key.upper()}-4.0", [f"cc-{key}-text"]) for key in CC],
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-notice"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
]


def names_of(families: list[str], versions: list[str]) -> list[str]:
    return [f"{f} License, Version {v}" for f in families for v in versions] or families


def _extended() -> dict[str, list[str]]:
    """SENTENCES, the notices that NAMES make, and the free-software notices that FREE make."""
    out = {k: list(v) for k, v in SENTENCES.items()}
    for key, (families, versions) in NAMES.items():
        named = names_of(families, versions)
        out.setdefault(key, []).extend(f"Licensed under the {n}" for n in named)
        if key.startswith(("gpl", "lgpl", "agpl")):
            later = key.replace("-notice", "-later-notice")
            out.setdefault(later, []).extend(f"Licensed under the {n} or later" for n in named)
    for key, kind, v in FREE:
        out.setdefault(key, []).extend(f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {v}{of} or (at your option) any later version" for of in ("", " of the License"))
    return out


SENTENCES = _extended()


def contained(rule: list[str], other: list[str]) -> bool:
    """Do the identifiers of ``rule`` occur in ``other``, in order, and not only they?"""
    rest = iter(other)
    return len(rule) < len(other) and all(k in rest for k in rule)


#: A licence gives way to those of which a rule contains one of its own, if they match too.
GIVES_WAY = {a: others for a in {n for n, _ in RULES} if (others := sorted({b for b, other in RULES if b != a and any(contained(rule, other) for n, rule in RULES if n == a)}))}
#: Sentence ends: . ! ? before white space (not of v.), : at a line's end, blank lines, ends of titles.
MARKS = r"(?m)^[ \t]*(?:#+|//+|/\*+|\*+/?|--|;+|%+|\(\*)[ \t]?"
BREAKS = r"(?<=[.!?])(?<!\bv\.)\s+|(?<=:)[ \t]*\n|\n[ \t]*\n|(?i)(?<=licen[cs]e)[ \t]*\n|(?i)(?<=\(mit\))[ \t]*\n"
#: A copyright line up to its end or to the next sentence on it.
COPYRIGHT = r"(?m)^[ \t]*(?i:copyright\b(?![ \t]+(?:notices?|holders?|owners?|and related)\b)|\(c\)|all rights reserved)(?:[^\n.]|\.(?![ \t]+[\x22'(]?[A-Z]))*+\.?(?:[ \t]*(?i:all rights reserved)\.?)?"
#: An expression: identifiers, in any parentheses, with operators between them. What follows a small
#: operator must look like an identifier, since the tag may stand in prose.
_OPEN, _ID, _CLOSE = r"(?:\([ \t]*)*", r"[A-Za-z0-9.:+-]+", r"(?:[ \t]*\))*"
SPDX_TAG = rf"(?i:SPDX-License-Identifier):[ \t]*({_OPEN}{_ID}{_CLOSE}(?:[ \t]+(?:AND|OR|WITH|(?:and|or|with)(?=[ \t(]+(?:[A-Za-z]*[0-9]|[A-Za-z]+-[A-Za-z0-9]|(?:MIT|ISC|Zlib|Unlicense)\b)))[ \t]+{_OPEN}{_ID}{_CLOSE})*)"
SPDX_MARK = "spdx license identifier "
_LONGEST = (1 << 31) - 1  # of a string

HOLDER = r"(?is)^[^a-z]*neither\s+the\s+name\s+of\s.+?\snor\s+the\s+names\s+of"
#: On normalised sentences: whoever is free software or useful is "this program"; ways to say "licensed under",
#: with or without a subject and "the terms of"; where to read on.
SUBJECT = r"^(?:[a-z0-9+.]+ ){1,6}is (free software you can redistribute it|distributed in the hope that it will be useful)"
VERBS = "licensed|released|distributed|available|published|provided|offered"
LEAD = rf"^(?:(?:[a-z0-9+.]+ ){{1,6}}(?:is|are) )?(?:dual |made )?(?:{VERBS}) under (?:(?:the|a|an) )?(?:terms(?: and conditions)? of (?:(?:the|a|an) )?)?"
TAIL = r"^(licensed under .+?) see(?: [a-z0-9+.]+){1,8} for (?:more |full |the )*(?:details|information|text)$"
NOTICE = "licensed under "
#: Of a name behind NOTICE: what is taken out or written in one way, in this order.
PLAIN_NAME = ((r" license\b", ""), (r"(?<![0-9.]) ?(?:version |v )?v?([0-9])", r" \1"), (r"([0-9])\.0\b", r"\1"), (r" or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", "+"))


def normalise(sentence: str) -> str:
    """The Python twin of the column expression, used to build the table."""
    s = re.sub(HOLDER, "neither the name of holder nor the names of", sentence)
    s = re.sub(r"[^a-z0-9+.]+", " ", s.lower())
    s = re.sub(r"[. ]+$|^(?:[0-9]\.? )?[ ]*", "", s.strip()).strip().replace("licence", "license")
    s = re.sub(LEAD, NOTICE, re.sub(SUBJECT, r"this program is \1", s))
    s = re.sub(TAIL, r"\1", s)
    return reduce(lambda t, r: re.sub(r[0], r[1], t), PLAIN_NAME, s) if s.startswith(NOTICE) else s


def _normalised(s: Column) -> Column:
    s = F.regexp_replace(s, HOLDER, "neither the name of holder nor the names of")
    s = F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9+.]+", " "))
    s = F.replace(F.trim(F.regexp_replace(s, r"[. ]+$|^(?:[0-9]\.? )?[ ]*", "")), F.lit("licence"), F.lit("license"))
    s = F.regexp_replace(F.regexp_replace(s, SUBJECT, "this program is $1"), LEAD, NOTICE)
    named = reduce(lambda t, r: F.regexp_replace(t, r[0], r[1].replace("\\", "$")), PLAIN_NAME, F.regexp_replace(s, TAIL, "$1"))
    return F.when(s.startswith(NOTICE), named).otherwise(s)


def _table() -> dict[str, str]:
    out: dict[str, str] = {}
    for key, texts in SENTENCES.items():
        for text in map(normalise, texts):
            if out.setdefault(text, key) != key:
                raise ValueError(f"{text} is both {out[text]} and {key}")
    return out


#: Words of known sentences that are no help: common ones, and those that normalising puts there.
UNTELLING = {"this", "copy", "public", "version", "holder", "program"}


def telling_words() -> list[str]:
    """Words of which every known sentence but notices has one, by repeated choice of the word that most of the
    sentences left have: a text without any of them, without an SPDX tag, and without a verb of notices before
    "under", has no known sentence."""
    left = [{w for w in s.split() if len(w) >= 4 and w.isalpha()} - UNTELLING or {s.split()[0]} for s in _table() if not s.startswith(NOTICE)]
    out = []
    while left:
        words = sorted({w for s in left for w in s})
        out.append(max(words, key=lambda w: sum(w in s for s in left)))
        left = [s for s in left if out[-1] not in s]
    return out


def _listed(name: Column) -> Column:
    """An identifier of the SPDX list as the list writes it, one of LicenseRef-... as it stands, else null."""
    at = F.array_position(literals([n.lower() for n in LICENSES]), F.lower(name))
    return F.when(at > 0, F.get(literals(LICENSES), (at - 1).cast("int"))).when(F.lower(name).rlike(r"^(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+$"), name)


def spdx_names(expression: Column) -> Column:
    """The licences of an SPDX expression; exceptions (after WITH) are none, and what is not listed is left out."""
    plain = F.regexp_replace(expression, r"(?i)\bwith[ \t(]+[^ \t()]+", "")
    words = F.transform(F.split(plain, r"[\s()]+"), lambda w: F.rtrim(w, F.lit(".:")))
    # A plus (or later) stands for its licence where the list has no name with it.
    return F.array_compact(F.transform(words, lambda w: F.coalesce(_listed(w), F.when(_listed(F.rtrim(w, F.lit("+"))).isNotNull(), F.concat(_listed(F.rtrim(w, F.lit("+"))), F.lit("+"))))))


def sentences_of(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), MARKS, ""), COPYRIGHT, "\n")
    return F.split(F.regexp_replace(plain, SPDX_TAG, f"\n\n{SPDX_MARK}$1\n\n"), BREAKS)


def known_sentences(text: Column, table: Column) -> Column:
    """Identifiers of the known sentences in text order; where a sentence is not known as a whole, it
    may be with the next or next two (a blank line or title's end inside it), or each of its lines may be
    (a notice under a line without a full stop)."""
    look = lambda s: F.element_at(table, s)

    def among(pieces: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            after = [F.get(pieces, i + k)["plain"] for k in (1, 2)]
            two = F.concat(piece["plain"], F.lit(" "), after[0])
            joined = F.when(look(after[0]).isNull(), F.coalesce(look(two), look(F.concat(two, F.lit(" "), after[1]))))
            lines = F.transform(F.split(piece["raw"], "\n"), lambda x: look(_normalised(x)))
            tags = F.transform(spdx_names(F.substring(piece["raw"], len(SPDX_MARK) + 1, _LONGEST)), lambda n: F.concat(F.lit("spdx-"), n))
            return F.when(piece["raw"].startswith(SPDX_MARK), tags).otherwise(let(F.coalesce(look(piece["plain"]), joined), lambda known: F.when(known.isNotNull(), F.array(known)).otherwise(lines)))

        return F.transform(pieces, one)

    pieces = F.transform(sentences_of(text), lambda s: F.struct(s.alias("raw"), _normalised(s).alias("plain")))
    return F.array_compact(F.flatten(let(F.filter(pieces, lambda p: p["plain"] != ""), among)))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, licenses, n_sentences, sentence_ids of every row of ``docs`` (doc_id, text).

    licenses: names of the matched rules, each once, sorted and comma-joined; sentence_ids: the known
    sentences in text order.  Both are empty for null and empty texts and where nothing is known.
    Repeated rows stay, extra columns are ignored, an empty table gives no row.
    """
    table = F.create_map(*[F.lit(x) for pair in _table().items() for x in pair])
    may = "(?i)" + "|".join(["spdx", f"(?:{VERBS})[^a-z0-9+.]+under", *map(re.escape, telling_words())]).replace("license", "licen[cs]e")
    ids = F.when(F.coalesce(F.col("text").rlike(may), F.lit(False)), known_sentences(F.col("text"), table)).otherwise(F.array().cast("array<string>"))
    out = docs.select("doc_id", ids.alias("ids")).withColumn("line", F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")))
    hits = {}
    for name, keys in RULES:
        hit = F.col("line").rlike(".*".join(f",{re.escape(k)}," for k in keys))
        hits[name] = hits[name] | hit if name in hits else hit
    kept = {n: reduce(lambda a, b: a & ~hits[b], GIVES_WAY.get(n, []), h) for n, h in hits.items()}
    tags = F.transform(F.filter("ids", lambda k: k.startswith("spdx-")), lambda k: F.substring(k, 6, _LONGEST))
    names = F.array_sort(F.array_union(F.array_compact(F.array(*[F.when(kept[n], F.lit(n)) for n in sorted(kept)])), tags))
    none = F.array().cast("array<string>")
    return out.select("doc_id", F.array_join(F.when(F.size("ids") > 0, names).otherwise(none), ",").alias("licenses"), F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"))
