"""Known licence sentences and ordered rules.

Sentences are normalised: lower case, runs of other characters one blank. {} stands for one to eight
words, such as a holder's name.
"""

from __future__ import annotations

SENTENCES = {
    # Apache
    "apache2": "licensed under the apache license version 2 0",
    "apache2.header": "licensed under the apache license version 2 0 the license",
    "apache2.use": "you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at",
    "apache2.title": "apache license version 2 0 january 2004",
    "apache2.grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    # MIT and its kin
    "mit": "released under the mit license",
    "mit.under": "licensed under the mit license",
    "mit.terms": "licensed under the terms of the mit license",
    "mit.made": "distributed under the mit license",
    "mit.title": "the mit license mit",
    "mit.name": "mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit0.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "x11.name": "except as contained in this notice the name of {} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium",
    "isc.name": "isc license",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc.warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "postgresql.grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "zlib.warranty": "this software is provided as is without any express or implied warranty",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost.name": "boost software license version 1 0",
    "boost.header": "distributed under the boost software license version 1 0",
    "boost.title": "boost software license version 1 0 august 17th 2003",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "unlicense.grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl.title": "do what the fuck you want to public license",
    "ncsa.title": "university of illinois ncsa open source license",
    # BSD
    "bsd.under": "licensed under the bsd license",
    "bsd3.under": "licensed under the bsd 3 clause license",
    "bsd2.under": "licensed under the bsd 2 clause license",
    "bsd3.names": "neither the names of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd2.name": "bsd 2 clause license",
    "bsd3.name": "bsd 3 clause license",
    "bsd.governed": "use of this source code is governed by a bsd style license that can be found in the license file",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd.names": "neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    # GNU
    "gpl2": "this work is licensed under the gnu general public license version 2",
    "gpl3": "this work is licensed under the gnu general public license version 3",
    "gpl3.under": "licensed under the gnu general public license v3 0",
    "gpl3.version": "licensed under the gnu general public license version 3",
    "gpl2.version": "licensed under the gnu general public license version 2",
    "gpl2.title": "gnu general public license version 2 june 1991",
    "gpl3.title": "gnu general public license version 3 29 june 2007",
    "lgpl21.title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3.title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3.title": "gnu affero general public license version 3 19 november 2007",
    "gpl.free2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.only2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl.free21": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl.free3": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl.hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.more": "see the gnu general public license for more details",
    "fdl.grant": "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation",
    # Weak copyleft and company licences
    "mpl2.header": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2.copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2.title": "mozilla public license version 2 0",
    "mpl11.header": "the contents of this file are subject to the mozilla public license version 1 1 the license",
    "epl1.title": "eclipse public license v 1 0",
    "epl2.title": "eclipse public license v 2 0",
    "epl2.header": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl1.header": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
    "cddl1.title": "common development and distribution license cddl version 1 0",
    "cddl1.header": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "eupl12.header": "licensed under the eupl version 1 2",
    "eupl12.title": "european union public licence v 1 2",
    "artistic2.title": "the artistic license 2 0",
    "mspl.title": "microsoft public license ms pl",
    "ofl11.header": "this font software is licensed under the sil open font license version 1 1",
    "ofl11.title": "sil open font license version 1 1 26 february 2007",
    "psf2.title": "python software foundation license version 2",
    "bsl11.title": "business source license 1 1",
    "sspl1.title": "server side public license version 1 october 16 2018",
    "elastic2.title": "elastic license 2 0",
    # Creative Commons
    "cc0.header": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc0.title": "cc0 1 0 universal",
    "ccby4": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync4.work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccbynd4": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "ccbyncsa4": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "ccbyncnd4": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "ccbysa3": "this work is licensed under a creative commons attribution sharealike 3 0 unported license",
    "ccby3": "this work is licensed under a creative commons attribution 3 0 unported license",
    "ccbync4": "licensed under cc by nc 4 0",
    "ccby4.short": "licensed under cc by 4 0",
    "ccbysa4.short": "licensed under cc by sa 4 0",
    # Others
    "reserved": "all rights reserved",
    "confidential": "this file is proprietary and confidential",
    "permit": "unauthorized copying of this file via any medium is strictly prohibited",
}

#: Groups of ordered rules, (licence, identifiers that must follow one another, others may stand
#: between them). In a group the first rule that is met gives the licence.
GROUPS = [
    [("Apache-2.0", ("apache2.header", "apache2.use", "apache2.copy", "asis")), ("Apache-2.0", ("apache2.header", "apache2.use")), ("Apache-2.0", ("apache2.header",)), ("Apache-2.0", ("apache2",)), ("Apache-2.0", ("apache2.title",)), ("Apache-2.0", ("apache2.grant",))],
    [("X11", ("mit.grant", "mit.notice", "x11.name")), ("MIT", ("mit.grant", "mit.notice")), ("MIT-0", ("mit0.grant", "mit.warranty")), ("MIT", ("mit.title",)), ("MIT", ("mit",)), ("MIT", ("mit.under",)), ("MIT", ("mit.terms",)), ("MIT", ("mit.made",)), ("MIT", ("mit.name", "mit.grant"))],
    [("ISC", ("isc.grant",)), ("ISC", ("isc.name",)), ("0BSD", ("0bsd.grant", "isc.warranty"))],
    [("PostgreSQL", ("postgresql.grant",))],
    [("Zlib", ("zlib.warranty", "zlib.grant")), ("Zlib", ("zlib.grant",))],
    [("BSL-1.0", ("boost.title",)), ("BSL-1.0", ("boost.header",)), ("BSL-1.0", ("boost.name",))],
    [("Unlicense", ("unlicense.free", "unlicense.grant")), ("Unlicense", ("unlicense.free",))],
    [("WTFPL", ("wtfpl.title",))],
    [("NCSA", ("ncsa.title",))],
    [("BSD-4-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advert")), ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")), ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd3.names")), ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")), ("BSD-3-Clause", ("bsd3.name",)), ("BSD-3-Clause", ("bsd3.under",)), ("BSD-2-Clause", ("bsd2.name",)), ("BSD-2-Clause", ("bsd2.under",)), ("BSD", ("bsd.grant",)), ("BSD", ("bsd.governed",)), ("BSD", ("bsd.under",))],
    [("GPL-3.0", ("gpl.free", "gpl.hope")), ("GPL-3.0", ("gpl.free",)), ("GPL-3.0", ("gpl3",)), ("GPL-3.0", ("gpl3.title",)), ("GPL-3.0", ("gpl3.under",)), ("GPL-3.0", ("gpl3.version",))],
    [("GPL-2.0", ("gpl.free2", "gpl.hope")), ("GPL-2.0", ("gpl.free2",)), ("GPL-2.0-only", ("gpl.only2",)), ("GPL-2.0", ("gpl2",)), ("GPL-2.0", ("gpl2.title",)), ("GPL-2.0", ("gpl2.version",))],
    [("AGPL-3.0", ("agpl.free",)), ("AGPL-3.0", ("agpl3.title",))],
    [("LGPL-3.0", ("lgpl.free3",)), ("LGPL-3.0", ("lgpl3.title",))],
    [("LGPL-2.1", ("lgpl.free21",)), ("LGPL-2.1", ("lgpl21.title",))],
    [("GFDL-1.3", ("fdl.grant",))],
    [("MPL-2.0", ("mpl2.header", "mpl2.copy")), ("MPL-2.0", ("mpl2.header",)), ("MPL-2.0", ("mpl2.copy",)), ("MPL-2.0", ("mpl2.title",))],
    [("MPL-1.1", ("mpl11.header",))],
    [("EPL-2.0", ("epl2.header",)), ("EPL-2.0", ("epl2.title",))],
    [("EPL-1.0", ("epl1.header",)), ("EPL-1.0", ("epl1.title",))],
    [("CDDL-1.0", ("cddl1.header",)), ("CDDL-1.0", ("cddl1.title",))],
    [("EUPL-1.2", ("eupl12.header",)), ("EUPL-1.2", ("eupl12.title",))],
    [("Artistic-2.0", ("artistic2.title",))],
    [("MS-PL", ("mspl.title",))],
    [("OFL-1.1", ("ofl11.header",)), ("OFL-1.1", ("ofl11.title",))],
    [("PSF-2.0", ("psf2.title",))],
    [("BUSL-1.1", ("bsl11.title",))],
    [("SSPL-1.0", ("sspl1.title",))],
    [("Elastic-2.0", ("elastic2.title",))],
    [("CC0-1.0", ("cc0.header",)), ("CC0-1.0", ("cc0.title",))],
    [("CC-BY-NC-4.0", ("ccbync4",)), ("CC-BY-NC-4.0", ("ccbync4.work",))],
    [("CC-BY-4.0", ("ccby4",)), ("CC-BY-4.0", ("ccby4.short",))],
    [("CC-BY-SA-4.0", ("ccbysa4",)), ("CC-BY-SA-4.0", ("ccbysa4.short",))],
    [("CC-BY-ND-4.0", ("ccbynd4",))],
    [("CC-BY-NC-SA-4.0", ("ccbyncsa4",))],
    [("CC-BY-NC-ND-4.0", ("ccbyncnd4",))],
    [("CC-BY-SA-3.0", ("ccbysa3",))],
    [("CC-BY-3.0", ("ccby3",))],
    [("proprietary", ("confidential",)), ("proprietary", ("permit",)), ("proprietary", ("reserved",))],
]

#: Words, or beginnings of words, of which every known sentence has one.
ANCHORS = ("licen", "permission", "redistribution", "warrant", "reserved", "copy", "unencumbered", "advertising", "cc0", "proprietary", "eupl", "mpl", "endorse", "advertis")

#: Identifiers of SPDX lines by the licence that they name, beside the licence's own name.
SPDX = {"Apache-2.0": [], "MIT": [], "MIT-0": [], "X11": [], "ISC": [], "0BSD": [], "PostgreSQL": [], "Zlib": [], "BSL-1.0": [], "Unlicense": [], "WTFPL": [], "NCSA": [], "BSD-4-Clause": [], "BSD-3-Clause": [], "BSD-2-Clause": [], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"], "GPL-2.0": ["GPL-2.0-or-later"], "GPL-2.0-only": [], "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "LGPL-3.0": ["LGPL-3.0-only", "LGPL-3.0-or-later"], "LGPL-2.1": ["LGPL-2.1-only", "LGPL-2.1-or-later"], "MPL-2.0": [], "MPL-1.1": [], "EPL-2.0": [], "EPL-1.0": [], "CDDL-1.0": [], "EUPL-1.2": [], "Artistic-2.0": [], "MS-PL": [], "OFL-1.1": [], "PSF-2.0": ["Python-2.0"], "CC0-1.0": [], "CC-BY-4.0": [], "CC-BY-SA-4.0": [], "CC-BY-NC-4.0": []}

for _group in GROUPS:
    for _name in dict.fromkeys(n for n, _ in _group):
        for _said in [_name, *SPDX[_name]] if _name in SPDX else []:
            SENTENCES[f"spdx.{_said}"] = "spdx license identifier " + _said.lower().replace("-", " ").replace(".", " ")
            _group.append((_name, (f"spdx.{_said}",)))
