"""Known licences: names for notices, sentences of texts and headers, and the ordered rules over them.

Fixed values: identifiers of the SPDX list with the licences' public names, and sentences of
their public texts. Families with versions are built by rule.
"""

from __future__ import annotations

import re

_NAMES = """
MIT: MIT License | Expat License | MIT/X11 License
MIT-0: MIT No Attribution | MIT No Attribution License
X11: X11 License
ISC: ISC License
0BSD: BSD Zero Clause License | Zero-Clause BSD | 0BSD License
BSD-1-Clause: BSD 1-Clause License
BSD-2-Clause: BSD 2-Clause License | 2-Clause BSD License | Simplified BSD License | FreeBSD License | BSD 2-Clause "Simplified" License
BSD-3-Clause: BSD 3-Clause License | 3-Clause BSD License | New BSD License | Modified BSD License | Revised BSD License | BSD 3-Clause "New" or "Revised" License
BSD-3-Clause-Clear: BSD 3-Clause Clear License | Clear BSD License
BSD-4-Clause: BSD 4-Clause License | Original BSD License | BSD 4-Clause "Original" or "Old" License
Apache-1.0: Apache License 1.0 | Apache License, Version 1.0
Apache-1.1: Apache License 1.1 | Apache License, Version 1.1 | Apache Software License 1.1
Apache-2.0: Apache License 2.0 | Apache License, Version 2.0 | Apache License v2.0 | Apache License v2 | Apache 2.0 License | Apache Software License 2.0 | Apache 2
MPL-1.0: Mozilla Public License 1.0 | Mozilla Public License, Version 1.0
MPL-1.1: Mozilla Public License 1.1 | Mozilla Public License, Version 1.1
MPL-2.0: Mozilla Public License 2.0 | Mozilla Public License, Version 2.0 | Mozilla Public License v2.0
EPL-1.0: Eclipse Public License 1.0 | Eclipse Public License, Version 1.0 | Eclipse Public License v1.0
EPL-2.0: Eclipse Public License 2.0 | Eclipse Public License, Version 2.0 | Eclipse Public License v2.0
CPL-1.0: Common Public License 1.0 | Common Public License, Version 1.0
IPL-1.0: IBM Public License v1.0 | IBM Public License Version 1.0
CDDL-1.0: Common Development and Distribution License 1.0 | Common Development and Distribution License, Version 1.0
CDDL-1.1: Common Development and Distribution License 1.1 | Common Development and Distribution License, Version 1.1
EUPL-1.1: European Union Public License 1.1 | European Union Public Licence v1.1
EUPL-1.2: European Union Public License 1.2 | European Union Public Licence v1.2 | EUPL v1.2
Artistic-1.0: Artistic License 1.0
Artistic-2.0: Artistic License 2.0 | Artistic License, Version 2.0
BSL-1.0: Boost Software License 1.0 | Boost Software License, Version 1.0
Zlib: zlib License
libpng-2.0: PNG Reference Library version 2 | libpng License
Unlicense: The Unlicense | Unlicense License
WTFPL: Do What The F*ck You Want To Public License | WTFPL License
CC0-1.0: Creative Commons Zero v1.0 Universal | CC0 1.0 Universal | CC0 1.0 Universal (CC0 1.0) Public Domain Dedication | CC0 License | CC0
CC-PDDC: Creative Commons Public Domain Dedication and Certification
PDDL-1.0: Open Data Commons Public Domain Dedication and License 1.0
ODbL-1.0: Open Data Commons Open Database License v1.0 | Open Database License | Open Database License 1.0
ODC-By-1.0: Open Data Commons Attribution License v1.0 | Open Data Commons Attribution License
OFL-1.0: SIL Open Font License 1.0
OFL-1.1: SIL Open Font License 1.1 | SIL Open Font License, Version 1.1 | Open Font License
MS-PL: Microsoft Public License
MS-RL: Microsoft Reciprocal License
PostgreSQL: PostgreSQL License
PSF-2.0: Python Software Foundation License 2.0 | Python Software Foundation License
Python-2.0: Python License 2.0
Ruby: Ruby License
PHP-3.01: PHP License v3.01 | PHP License 3.01
OpenSSL: OpenSSL License
NCSA: University of Illinois/NCSA Open Source License
AFL-3.0: Academic Free License v3.0 | Academic Free License version 3.0
OSL-3.0: Open Software License 3.0 | Open Software License version 3.0
NPOSL-3.0: Non-Profit Open Software License 3.0
QPL-1.0: Q Public License 1.0
RPL-1.5: Reciprocal Public License 1.5
APSL-2.0: Apple Public Source License 2.0
SPL-1.0: Sun Public License v1.0
Sleepycat: Sleepycat License
SSPL-1.0: Server Side Public License, v 1 | Server Side Public License
BUSL-1.1: Business Source License 1.1
Elastic-2.0: Elastic License 2.0
UPL-1.0: Universal Permissive License v1.0
Vim: Vim License
W3C: W3C Software Notice and License
ZPL-2.1: Zope Public License 2.1
LPPL-1.3c: LaTeX Project Public License v1.3c
CECILL-2.1: CeCILL Free Software License Agreement v2.1
CECILL-B: CeCILL-B Free Software License Agreement
CECILL-C: CeCILL-C Free Software License Agreement
MulanPSL-2.0: Mulan Permissive Software License, Version 2 | Mulan PSL v2
Beerware: Beerware License | Beer-Ware License
curl: curl License
FTL: Freetype Project License | FreeType License
HPND: Historical Permission Notice and Disclaimer
ICU: ICU License
IJG: Independent JPEG Group License
Intel: Intel Open Source License
JSON: JSON License
NTP: NTP License
OGL-UK-3.0: Open Government Licence v3.0
BlueOak-1.0.0: Blue Oak Model License 1.0.0
Parity-7.0.0: The Parity Public License 7.0.0
PolyForm-Noncommercial-1.0.0: PolyForm Noncommercial License 1.0.0
PolyForm-Small-Business-1.0.0: PolyForm Small Business License 1.0.0
Zend-2.0: Zend License v2.0
TCL: TCL/TK License
ECL-2.0: Educational Community License v2.0
EFL-2.0: Eiffel Forum License v2.0
SISSL: Sun Industry Standards Source License v1.1
NASA-1.3: NASA Open Source Agreement 1.3
Watcom-1.0: Sybase Open Watcom Public License 1.0
SimPL-2.0: Simple Public License 2.0
CAL-1.0: Cryptographic Autonomy License 1.0
Hippocratic-2.1: Hippocratic License 2.1
MirOS: MirOS Licence
Fair: Fair License
OLDAP-2.8: Open LDAP Public License v2.8 | OpenLDAP Public License
CDLA-Permissive-2.0: Community Data License Agreement Permissive 2.0
CDLA-Sharing-1.0: Community Data License Agreement Sharing 1.0
OpenRAIL-M: CreativeML Open RAIL-M License | Open RAIL-M License
"""

_GNU = {"GPL": ("General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("Lesser General Public License", ("2.1", "3.0")), "AGPL": ("Affero General Public License", ("3.0",)), "GFDL": ("Free Documentation License", ("1.1", "1.2", "1.3"))}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_KIND = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _named() -> dict[str, list[str]]:
    out = {}
    for line in _NAMES.strip().split("\n"):
        spdx, names = line.split(": ", 1)
        out[spdx] = [spdx, *(x.strip() for x in names.split("|"))]
    for short, (full, versions) in _GNU.items():
        for v in versions:
            forms = [w for x in {v, v.removesuffix(".0")} for w in (f"version {x}", f"v{x}", x)]
            only = [f"{name} {w}" for name in (f"GNU {full}", f"GNU {short}", short) for w in forms]
            out[f"{short}-{v}-only"] = [f"{short}-{v}-only", *only, *(f"{x} only" for x in only)]
            out[f"{short}-{v}-or-later"] = [f"{short}-{v}-or-later", *(f"{x} {w}" for x in only for w in ("or later", "or any later version", "or (at your option) any later version"))]
    for short, full in _CC.items():
        for v, kind in _CC_KIND.items():
            out[f"CC-{short}-{v}"] = [f"CC-{short}-{v}", *(f"Creative Commons {full} {x}{y}" for x in (v, f"{v} {kind}") for y in ("", " License"))]
    return out


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


#: Licences in the order of their notice identifiers, FIRST_NOTICE on; and the identifier of each normalised name.
FIRST_NOTICE = 1000
LICENCES: tuple[str, ...] = tuple(_named())
NAMES: dict[str, int] = {normalised(name).removeprefix("the "): FIRST_NOTICE + i for i, names in enumerate(_named().values()) for name in names}

#: What a notice says before the name, normalised.
NOTICE = (
    r"(?:(?:(?:this|the) (?:work|software|project|program|file|library|code|source code|package|document|repository|content|dataset|data|model) )?(?:is |are )?(?:dual )?"
    r"(?:licensed|released|distributed|published|available|provided|made available) under (?:the terms of )?(?:the |a |an )?|licen[sc]e (?:the )?)"
)
#: The machine-readable tag, normalised; names follow with "or", "and" and "with" between them.
TAG = "spdx license identifier "

#: Sentences by identifier.
SENTENCES: dict[int, str] = {
    1: "Released under the MIT License.",
    2: "Licensed under the MIT License.",
    3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    4: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    5: "Licensed under the Apache License, Version 2.0.",
    6: "Licensed under the Apache License, Version 2.0 (the \"License\");",
    7: "you may not use this file except in compliance with the License.",
    8: "You may obtain a copy of the License at",
    9: "This work is licensed under the GNU General Public License, version 3.",
    10: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    11: "You should have received a copy of the GNU General Public License along with this program.",
    12: "Licensed under CC BY-NC 4.0.",
    13: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    14: "Licensed under CC BY 4.0.",
    15: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    16: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    17: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    18: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    19: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    20: "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    21: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    22: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    23: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    24: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    25: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    26: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    27: "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    28: "This is free and unencumbered software released into the public domain.",
    29: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    30: "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    31: "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    32: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    33: "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    35: "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;",
    36: "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    37: "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    38: "The Software shall be used for Good, not Evil.",
    39: "All rights reserved.",
}
#: The header of GNU licences: (identifier, short name, full name, version), for programs, libraries, files and software.
_HEADERS = [(100 + i, *x) for i, x in enumerate((("GPL", "General Public License", "2"), ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Lesser General Public License", "3"), ("AGPL", "Affero General Public License", "3")))]


def _gnu(thing: str, full: str, version: str, end: str) -> str:
    return normalised(f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {full} as published by the Free Software Foundation, {end.format(version)}")


KNOWN: dict[str, int] = {}
for _i, _text in SENTENCES.items():
    KNOWN.setdefault(normalised(_text), _i)
for _thing in ("program", "library", "file", "software"):
    for _i, _short, _full, _version in [(10, "GPL", "General Public License", "3"), *_HEADERS]:
        KNOWN[_gnu(_thing, _full, _version, "either version {} of the License, or (at your option) any later version")] = _i
        # Sentences that allow one version only stand 100 behind.
        KNOWN[_gnu(_thing, _full, _version, "version {} of the License")] = _i + 100

#: Rules: (licence, identifiers in order). Other sentences may stand between them.
RULES: tuple[tuple[str, tuple[int, ...]], ...] = (
    ("MIT", (3, 4)),
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("MIT-0", (24,)),
    ("JSON", (3, 4, 38)),
    ("Apache-2.0", (6, 7, 8)),
    ("Apache-2.0", (5,)),
    ("GPL-3.0-or-later", (10,)),
    ("GPL-3.0-only", (110,)),
    *((f"{short}-{version if '.' in version else version + '.0'}-{kind}", (i + shift,)) for i, short, _, version in _HEADERS for kind, shift in (("or-later", 0), ("only", 100))),
    ("GPL-3.0-only", (9,)),
    ("CC-BY-NC-4.0", (12,)),
    ("CC-BY-NC-4.0", (13,)),
    ("CC-BY-4.0", (14,)),
    ("CC-BY-4.0", (15,)),
    ("BSD-4-Clause", (16, 17, 18, 22, 19)),
    ("BSD-4-Clause", (16, 17, 18, 22, 36)),
    ("BSD-3-Clause", (16, 17, 18, 19)),
    ("BSD-3-Clause", (16, 17, 18, 36)),
    ("BSD-2-Clause", (16, 17, 18)),
    ("MPL-2.0", (20,)),
    ("ISC", (21,)),
    ("0BSD", (23,)),
    ("BSL-1.0", (25,)),
    ("Zlib", (26, 27)),
    ("Unlicense", (28,)),
    ("CC0-1.0", (29,)),
    ("PostgreSQL", (30,)),
    ("OFL-1.1", (31,)),
    ("EPL-2.0", (32,)),
    ("CDDL-1.0", (33, 7)),
    ("GFDL-1.3-or-later", (35,)),
    ("WTFPL", (37,)),
    ("All-Rights-Reserved", (39,)),
)
#: A licence is not reported beside one whose rule holds all of its own.
PART_OF = (("BSD-2-Clause", "BSD-3-Clause"), ("BSD-2-Clause", "BSD-4-Clause"), ("BSD-3-Clause", "BSD-4-Clause"), ("MIT", "JSON"))
#: Reported only where nothing else is.
ALONE = "All-Rights-Reserved"

#: Every notice and tag, and a sentence of every rule, holds one of these: a text without any needs no cutting.
ANCHOR = "licen|permission|permitted|redistribution|public domain|rights reserved|this software|(?:released|distributed|published|available|provided)[^a-z0-9]{1,12}under"
