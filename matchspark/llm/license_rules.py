"""Signatures of licence statements, as one ordered list.

Patterns are written for text in *normal form*: A-Z lower-cased, every run of
other ASCII characters than letters and digits turned into one space. So "GPL-3.0+"
reads ``gpl 3 0`` and a line break inside a phrase does not matter. Each line is
``label: gate: pattern``; the gate is a word without which the pattern cannot match.
Sections go from the strongest evidence to the weakest, and a section's rank is
the priority of its rules; within a section the earlier rule is the stronger one.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    gate: bytes
    pattern: re.Pattern
    priority: int
    confidence: float


#: Identifiers of the public SPDX list; the tag that carries one is built below. Fixed values.
SPDX_IDS = """
0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0
BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0
CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0
CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only
GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ISC LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later
LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 ODC-By-1.0
OFL-1.1 OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SISSL SSPL-1.0 Unlicense UPL-1.0 Vim
W3C WTFPL X11 Zlib ZPL-2.1
""".split()

#: Words of the licences themselves. Licence texts have these words.
TEXTS = r"""
apache: apache: licensed to the apache software foundation asf under one or more contributor license agreements
apache: apache: apache license version 2 0 january 2004
apache: compliance: you may not use this file except in compliance with the license you may obtain a copy
mit: hereby: permission is hereby granted free of charge to any person obtaining a copy of this software
mit: warranty: the software is provided as is without warranty of any kind express or implied
isc: hereby: permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
bsd: redistributions: redistributions of source code must retain the(?: above)? copyright notice
bsd: redistributions: redistributions in binary form must reproduce the(?: above)? copyright notice
bsd-3-clause: endorse: neither the names? of .{1,80}? may be used to endorse or promote products
bsd-4-clause: advertising: all advertising materials mentioning features or use of this software must display
gpl: redistribute: you can redistribute it and or modify it under the terms of the gnu general public license
gpl: gnu: you should have received a copy of the gnu general public license
gpl: copyleft: the gnu general public license is a free copyleft license
lgpl: lesser: you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl: lesser: you should have received a copy of the gnu lesser general public license
agpl: affero: you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl: affero: you should have received a copy of the gnu affero general public license
mpl: mozilla: this source code form is subject to the terms of the mozilla public license
mpl: mpl: if a copy of the mpl was not distributed with this file you can obtain one
epl: eclipse: this program and the accompanying materials are made available under the terms of the eclipse public license
epl: accompanying: the accompanying program is provided under the terms of this eclipse public license
cddl: common: the contents of this file are subject to the terms of the common development and distribution license
unlicense: unencumbered: this is free and unencumbered software released into the public domain
wtfpl: fuck: do what the fuck you want to public license
zlib: misrepresented: the origin of this software must not be misrepresented
zlib: plainly: altered source versions must be plainly marked as such
boost: organization: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
ncsa: ncsa: university of illinois ncsa open source license
artistic: artistic: the artistic license preamble
ofl: font: this font software is licensed under the sil open font license
ofl: reserved: with reserved font name
cc0: waived: to the extent possible under law .{1,80}? has waived all copyright
cc-by: attribution: this work is licensed under a creative commons attribution(?: \d \d)?(?: (?:international|unported|generic))? license
cc-by-sa: sharealike: this work is licensed under a creative commons attribution sharealike
cc-by-nc: creative: this work is licensed under a creative commons attribution non ?commercial
cc-by-nd: creative: this work is licensed under a creative commons attribution no ?derivatives
cc-by-nc-sa: sharealike: this work is licensed under a creative commons attribution noncommercial sharealike
cc-by-nc-nd: creative: this work is licensed under a creative commons attribution noncommercial no ?derivatives
odbl: database: this .{1,40}? is made available under the open database license
psf: python: psf is making python available to licensee on an as is basis
postgresql: documentation: permission to use copy modify and distribute this software and its documentation for any purpose without fee
openssl: openssl: this product includes software developed by the openssl project
eupl: eupl: licensed under the eupl
sspl: server: you can redistribute it and or modify it under the terms of the server side public license
busl: licensor: licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
proprietary: confidential: this (?:document|file|software) (?:contains|is) (?:the )?confidential
proprietary: proprietary: this (?:document|file|software) (?:contains|is) (?:the )?proprietary
proprietary: unauthorized: unauthorized (?:copying|reproduction|use|distribution) .{1,40}? is (?:strictly )?prohibited
"""

#: Addresses of licence texts. Fixed values.
ADDRESSES = r"""
apache-2.0: apache: apache org licenses license 2 0
apache: apache: apache org licenses
gpl-3.0: gnu: gnu org licenses gpl 3 0
gpl-2.0: gnu: gnu org licenses (?:old licenses )?gpl 2 0
gpl: gnu: gnu org (?:licenses|copyleft)(?: gpl)?
lgpl-3.0: gnu: gnu org licenses lgpl 3 0
lgpl-2.1: gnu: gnu org licenses (?:old licenses )?lgpl 2 1
lgpl: gnu: gnu org licenses lgpl
agpl-3.0: gnu: gnu org licenses agpl(?: 3 0)?
gfdl: gnu: gnu org licenses fdl
mit: mit: opensource org licenses mit(?: license)?
bsd-3-clause: bsd: opensource org licenses bsd 3 clause
bsd-2-clause: bsd: opensource org licenses bsd 2 clause
bsd: bsd: opensource org licenses bsd(?: license)?
isc: isc: opensource org licenses isc(?: license)?
mpl-2.0: mpl: mozilla org (?:en us )?mpl 2 0
mpl: mpl: mozilla org (?:en us )?mpl
epl-2.0: epl: eclipse org (?:org )?(?:documents|legal) epl 2 0
epl: epl: eclipse org (?:org )?(?:documents|legal) epl(?: v10)?
cc-by: creativecommons: creativecommons org licenses by(?: \d \d)?
cc-by-sa: creativecommons: creativecommons org licenses by sa(?: \d \d)?
cc-by-nc: creativecommons: creativecommons org licenses by nc(?: \d \d)?
cc-by-nd: creativecommons: creativecommons org licenses by nd(?: \d \d)?
cc-by-nc-sa: creativecommons: creativecommons org licenses by nc sa(?: \d \d)?
cc-by-nc-nd: creativecommons: creativecommons org licenses by nc nd(?: \d \d)?
cc0: creativecommons: creativecommons org publicdomain zero(?: 1 0)?
public-domain: creativecommons: creativecommons org publicdomain mark
unlicense: unlicense: unlicense org
wtfpl: wtfpl: wtfpl net
boost: boost: boost org license 1 0 txt
ofl: ofl: scripts sil org ofl
odbl: opendatacommons: opendatacommons org licenses odbl
odc-by: opendatacommons: opendatacommons org licenses by
pddl: opendatacommons: opendatacommons org licenses pddl
artistic: perlfoundation: perlfoundation org artistic license
"""

#: What licences are called. Names and versions.
NAMES = r"""
gpl-3.0-or-later: gnu: gnu general public license (?:version |v ?)?3(?: 0)? or (?:any )?later(?: version)?
gpl-2.0-or-later: gnu: gnu general public license (?:version |v ?)?2(?: 0)? or (?:any )?later(?: version)?
gpl-3.0: gnu: gnu general public license (?:version |v ?)3(?: 0)?
gpl-2.0: gnu: gnu general public license (?:version |v ?)2(?: 0)?
gpl-1.0: gnu: gnu general public license (?:version |v ?)1(?: 0)?
gpl: gnu: gnu general public licen[cs]e
gpl-3.0: gplv3: (?:gnu )?gplv3(?: 0)?
gpl-2.0: gplv2: (?:gnu )?gplv2(?: 0)?
gpl-3.0: gpl: (?:gnu )?gpl (?:version |v )?3(?: 0)?
gpl-2.0: gpl: (?:gnu )?gpl (?:version |v )?2(?: 0)?
gpl: gpl: gnu gpl
lgpl-3.0: lesser: gnu lesser general public license (?:version |v ?)?3(?: 0)?
lgpl-2.1: lesser: gnu lesser general public license (?:version |v ?)?2 1
lgpl: lesser: (?:gnu )?lesser general public licen[cs]e
lgpl: library: gnu library general public licen[cs]e
lgpl-3.0: lgplv3: (?:gnu )?lgplv3
lgpl-2.1: lgplv2: (?:gnu )?lgplv2(?: 1)?
lgpl-3.0: lgpl: (?:gnu )?lgpl (?:version |v )?3(?: 0)?
lgpl-2.1: lgpl: (?:gnu )?lgpl (?:version |v )?2 1
lgpl: lgpl: gnu lgpl
agpl-3.0: affero: gnu affero general public license (?:version |v ?)?3(?: 0)?
agpl: affero: (?:gnu )?affero general public licen[cs]e
agpl-3.0: agplv3: (?:gnu )?agplv3
agpl-3.0: agpl: (?:gnu )?agpl (?:version |v )?3(?: 0)?
gfdl: documentation: gnu free documentation licen[cs]e(?: version \d \d)?
apache-2.0: apache: apache (?:software )?license (?:version |v ?)?2(?: 0)?
apache-1.1: apache: apache (?:software )?license (?:version |v ?)?1 1
apache-1.0: apache: apache (?:software )?license (?:version |v ?)?1 0
apache-2.0: apache: apache 2(?: 0)? licen[cs]e
apache: apache: apache (?:software |public )?licen[cs]e
mit-0: mit: mit no attribution(?: license)?
mit: mit: (?:expat )?mit licen[cs]e
mit: expat: expat licen[cs]e
mit: mit: licen[cs]e mit
x11: x11: x11 licen[cs]e
bsd-2-clause: bsd: (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?
bsd-2-clause: freebsd: freebsd licen[cs]e
bsd-3-clause: bsd: (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?
bsd-4-clause: bsd: (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?
0bsd: 0bsd: 0bsd(?: licen[cs]e)?
0bsd: bsd: zero clause bsd(?: licen[cs]e)?
bsd: bsd: bsd (?:style )?licen[cs]e
isc: isc: isc licen[cs]e
mpl-2.0: mozilla: mozilla public license (?:version |v ?)?2(?: 0)?
mpl-1.1: mozilla: mozilla public license (?:version |v ?)?1 1
mpl: mozilla: mozilla public licen[cs]e
mpl-2.0: mpl: mpl (?:version |v )?2(?: 0)?
epl-2.0: eclipse: eclipse public license (?:version |v ?)?2(?: 0)?
epl-1.0: eclipse: eclipse public license (?:version |v ?)?1(?: 0)?
epl: eclipse: eclipse public licen[cs]e
edl: eclipse: eclipse distribution licen[cs]e(?: v? ?1 0)?
cddl-1.1: cddl: cddl (?:version |v )?1 1
cddl-1.0: cddl: cddl (?:version |v )?1 0
cddl: distribution: common development and distribution licen[cs]e(?: version 1 \d)?
cpl: common: common public licen[cs]e(?: version 1 0)?
ipl: ibm: ibm public licen[cs]e
eupl-1.2: eupl: eupl (?:version |v )?1 2
eupl: european: european union public licen[cs]e(?: version 1 \d)?
artistic-2.0: artistic: artistic license (?:version )?2(?: 0)?
artistic: artistic: artistic licen[cs]e
zlib: zlib: zlib(?: libpng)? licen[cs]e
boost: boost: boost software licen[cs]e(?: version)?(?: 1 0)?
unlicense: unlicense: the unlicense
wtfpl: wtfpl: wtfpl(?: version 2)?
psf: python: python software foundation licen[cs]e(?: version 2)?
php: php: php licen[cs]e(?: (?:version )?3 0?1?)?
ruby: ruby: ruby licen[cs]e
postgresql: postgresql: postgresql licen[cs]e
openssl: openssl: openssl licen[cs]e
ncsa: ncsa: (?:university of illinois )?ncsa open source licen[cs]e
ofl: font: (?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?
ofl: ofl: sil ofl
lppl: latex: latex project public licen[cs]e(?: 1 3c?)?
cecill: cecill: cecill(?: [bc])?(?: licen[cs]e)?(?: 2 1)?
ms-pl: microsoft: microsoft public licen[cs]e
ms-rl: microsoft: microsoft reciprocal licen[cs]e
mulan: mulan: mulan (?:permissive software|psl)(?: licen[cs]e)?(?: v2)?
osl: open: open software licen[cs]e(?: (?:version )?3 0)?
afl: academic: academic free licen[cs]e(?: (?:version )?\d \d)?
ecl: educational: educational community licen[cs]e(?: version 2 0)?
upl: universal: universal permissive licen[cs]e(?: (?:version )?1 0)?
w3c: w3c: w3c software(?: notice)?(?: and)? licen[cs]e
zpl: zope: zope public licen[cs]e
qpl: public: q public licen[cs]e
apsl: apple: apple public source licen[cs]e
sissl: industry: sun industry standards source licen[cs]e
blueoak: oak: blue oak model licen[cs]e(?: 1 0 0)?
sspl: server: server side public licen[cs]e(?: (?:version |v ?)?1)?
busl: business: business source licen[cs]e(?: (?:version )?1 1)?
elastic: elastic: elastic licen[cs]e(?: (?:version )?2 0)?
commons-clause: commons: commons clause(?: license condition)?
openrail: rail: (?:creativeml |bigscience |bigcode )?open rail(?: m)?(?: licen[cs]e)?
openrail: openrail: (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[cs]e)?
llama: llama: llama \d(?: \d)? community license(?: agreement)?
cc-by-nc-nd: cc: cc by nc nd(?: \d(?: \d)?)?
cc-by-nc-sa: cc: cc by nc sa(?: \d(?: \d)?)?
cc-by-nc: cc: cc by nc(?: \d(?: \d)?)?
cc-by-nd: cc: cc by nd(?: \d(?: \d)?)?
cc-by-sa: cc: cc by sa(?: \d(?: \d)?)?
cc-by: cc: cc by(?: \d(?: \d)?)?
cc0: cc0: cc0(?: 1 0)?(?: universal)?
cc0: cc: cc zero
cc-by-nc-nd: creative: creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: \d \d)?
cc-by-nc-sa: creative: creative commons attribution non ?commercial share ?alike(?: \d \d)?
cc-by-nc: creative: creative commons attribution non ?commercial(?: \d \d)?
cc-by-nd: creative: creative commons attribution no ?deriv(?:ative)?s(?: \d \d)?
cc-by-sa: creative: creative commons attribution share ?alike(?: \d \d)?
cc-by: creative: creative commons attribution(?: \d \d)?
creative-commons: creative: creative commons licen[cs]e
odbl: database: open database licen[cs]e(?: (?:version |v ?)?1 0)?
odc-by: commons: open data commons attribution licen[cs]e
pddl: public: public domain dedication and licen[cs]e
public-domain: domain: (?:dedicated to|released into|placed in|in) the public domain
ogl: government: open government licen[cs]e(?: (?:version |v ?)?\d(?: \d)?)?
"""

#: Words that point to a licence or reserve rights without naming one.
HINTS = r"""
proprietary: reserved: all rights reserved
proprietary: derechos: todos los derechos reservados
proprietary: droits: tous droits réservés
proprietary: rechte: alle rechte vorbehalten
proprietary: commercial: (?:for )?commercial use (?:is )?(?:strictly )?prohibited
proprietary: eula: end user licen[cs]e agreement eula
copyright: copyright: copyright (?:c )?(?:by )?(?:19|20)\d\d
copyright: copyright: copyright (?:c )?\w{2,30} (?:19|20)\d\d
licensed: licensed: (?:is |are )?(?:dual )?licensed under(?: the)?(?: terms of)?
licensed: released: (?:is |are )?released under(?: the)?(?: terms of)?
licensed: distributed: (?:is |are )?distributed under(?: the)?(?: terms of)?
licensed: license: see (?:the )?(?:accompanying )?license(?: file)?(?: txt| md)? for (?:more )?(?:details|information|terms)
licensed: license: subject to the terms of the license
licensed: copying: see (?:the file )?copying(?: txt)? for (?:details|copying permission)
"""

#: Confidence of each section, strongest first; its priority is its place from the end.
SECTIONS = (("spdx", 1.0), ("texts", 0.95), ("addresses", 0.9), ("names", 0.8), ("hints", 0.4))

#: Phrases that always count, with their labels. Fixed values.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def normal_form(text: str) -> str:
    return re.sub(r"[^0-9a-z]+", " ", text.lower()).strip()


def _spdx_lines() -> list[str]:
    tag = "spdx license identifier "
    return [f"{x.lower()}: spdx: {tag}{normal_form(x)}" for x in sorted(SPDX_IDS, key=len, reverse=True)]


def rules() -> list[Rule]:
    lines = {
        "spdx": _spdx_lines(), "texts": TEXTS.strip().split("\n"), "addresses": ADDRESSES.strip().split("\n"),
        "names": NAMES.strip().split("\n"), "hints": HINTS.strip().split("\n"),
    }
    found = []
    for rank, (section, confidence) in enumerate(SECTIONS):
        for line in lines[section]:
            label, gate, pattern = line.split(": ", 2)
            whole = re.compile(b"(?<![^ ])(?:" + pattern.encode() + b")(?![^ ])")
            found.append(Rule(label, gate.encode(), whole, len(SECTIONS) - rank, confidence))
    return found
