"""Signature rules of operator 12, written for texts whose words are lower-cased and joined by one space.

A rule is (keywords, label, kind, pattern): it is tried only where each of its keywords is a word of the text.
` ~ ` in a pattern stands for up to six words between two others.
"""

from __future__ import annotations

# The phrases of the base, and their labels.
BASE = (("gnu", "gpl", "gnu general public license"), ("apache", "apache", "apache license"), ("cc", "cc-by", "cc by"), ("mit", "mit", "mit license"))

#: Kinds by priority, with the weight that a detection of the kind gives to a text's score.
KINDS = {"tag": 1.0, "text": 0.95, "notice": 0.9, "url": 0.8, "name": 0.7, "base": 0.6, "mention": 0.4, "clause": 0.3}

#: Identifiers that a tag "SPDX-License-Identifier: ..." may name.
TAGGED = (
    "0BSD", "AFL-2.1", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.0", "Apache-1.1", "Apache-2.0", "APSL-2.0", "Artistic-1.0", "Artistic-2.0",
    "BlueOak-1.0.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "CC-BY-3.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0", "ECL-2.0",
    "EFL-2.0", "Elastic-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "FTL", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "HPND", "ICU", "IJG", "IPL-1.0", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "LPPL-1.3c", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OpenSSL", "OSL-3.0", "PDDL-1.0",
    "PHP-3.01", "PostgreSQL", "PSF-2.0", "Python-2.0", "QPL-1.0", "Ruby", "SISSL", "SSPL-1.0", "Unicode-3.0", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)

RULES = (
    # MIT and its kin
    ("charge permission", "mit", "text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ~ to deal in the software without restriction"),
    ("charge permission", "mit", "notice", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "mit", "notice", "(?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?mit(?: license)?"),
    ("mit", "mit", "name", "the mit license(?: mit)?"),
    ("mit", "mit", "name", "mit licensed"),
    ("mit", "mit", "name", "licen[sc]e mit"),
    ("mit", "mit", "url", "opensource org licen[sc]es? mit(?: license)?(?: php| html)?"),
    ("mit", "mit", "url", "mit license org"),
    ("mit", "mit", "url", "choosealicense com licenses mit"),
    ("mit", "mit-0", "name", "mit no attribution(?: license)?"),
    ("expat", "mit", "name", "expat (?:mit )?license"),
    ("x11", "x11", "name", "(?:mit )?x11 license"),
    ("consortium", "x11", "notice", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "isc", "name", "(?:the )?isc license"),
    ("isc", "isc", "notice", "(?:released|licensed|distributed) under (?:the )?isc"),
    ("isc", "isc", "url", "opensource org licenses isc"),
    ("fee permission", "isc", "text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("fee permission", "0bsd", "text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "0bsd", "name", "(?:the )?0bsd license"),
    ("fee permission", "hpnd", "text", "permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose ~ is hereby granted without fee"),
    ("liable", "mit", "clause", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("noninfringement", "mit", "clause", "warranties of merchantability fitness for a particular purpose and noninfringement"),
    # BSD
    ("redistribution", "bsd", "notice", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("endorse", "bsd-3-clause", "text", "neither the name of ~ nor the names of (?:its|the) contributors may be used to endorse or promote products derived from this software"),
    ("endorse", "bsd-3-clause", "text", "the names? of ~ may not be used to endorse or promote products derived from this software"),
    ("advertising", "bsd-4-clause", "text", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("freebsd", "bsd-2-clause", "text", "should not be interpreted as representing official policies either expressed or implied of the freebsd project"),
    ("bsd", "bsd", "name", "bsd licen[sc]ed?"),
    ("bsd", "bsd", "name", "bsd style licen[sc]e"),
    ("bsd", "bsd", "notice", "(?:released|licensed|distributed|available) under (?:the |a )?(?:terms of the )?bsd"),
    ("bsd", "bsd-2-clause", "name", "bsd 2 clause(?: licen[sc]e)?"),
    ("bsd", "bsd-3-clause", "name", "bsd 3 clause(?: licen[sc]e)?"),
    ("bsd", "bsd-4-clause", "name", "bsd 4 clause(?: licen[sc]e)?"),
    ("clause bsd", "bsd-2-clause", "name", "(?:2|two) clause bsd(?: licen[sc]e)?"),
    ("clause bsd", "bsd-3-clause", "name", "(?:3|three) clause bsd(?: licen[sc]e)?"),
    ("clause bsd", "bsd-4-clause", "name", "(?:4|four) clause bsd(?: licen[sc]e)?"),
    ("simplified bsd", "bsd-2-clause", "name", "simplified bsd(?: licen[sc]e)?"),
    ("freebsd", "bsd-2-clause", "name", "freebsd licen[sc]e"),
    ("new bsd", "bsd-3-clause", "name", "new bsd licen[sc]e"),
    ("bsd", "bsd-3-clause", "name", "(?:modified|revised) bsd licen[sc]e"),
    ("modified bsd", "bsd-3-clause", "name", "(?:the )?modified bsd licen[sc]e"),
    ("bsd", "bsd-2-clause", "url", "opensource org licenses bsd 2 clause"),
    ("bsd", "bsd-3-clause", "url", "opensource org licenses bsd 3 clause"),
    ("bsd", "bsd", "url", "opensource org licenses bsd license(?: php)?"),
    ("contributors", "bsd", "clause", "this software is provided by (?:the )?copyright holders? and contributors as is"),
    # Apache
    ("apache", "apache-2.0", "text", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "apache-2.0", "text", "apache license version 2 0 january 2004"),
    ("apache", "apache-2.0", "notice", "(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?"),
    ("apache", "apache-2.0", "name", "apache (?:software )?license (?:version |v )?2(?: 0)?"),
    ("apache", "apache-2.0", "name", "apache (?:software )?license v2(?: 0)?"),
    ("apache", "apache-2.0", "name", "apache 2(?: 0)? licen[sc]ed?"),
    ("apache", "apache-2.0", "mention", "apache 2 0"),
    ("apache", "apache-2.0", "url", "apache org licenses license 2 0(?: txt| html)?"),
    ("apache", "apache-2.0", "url", "opensource org licenses apache 2 0"),
    ("apache", "apache-1.1", "name", "apache (?:software )?license (?:version |v )?1 1"),
    ("apache", "apache-1.0", "name", "apache (?:software )?license (?:version |v )?1 0"),
    ("apache", "apache-1.1", "text", "this product includes software developed by the apache software foundation"),
    ("asl", "apache-2.0", "mention", "asl 2 0"),
    ("asf", "apache-2.0", "notice", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("patent perpetual", "apache-2.0", "clause", "perpetual worldwide non exclusive no charge royalty free irrevocable ~ patent license"),
    ("derivative perpetual", "apache-2.0", "clause", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of"),
    # GPL
    ("gnu", "gpl-3.0", "text", "gnu general public license version 3 29 june 2007"),
    ("gnu", "gpl-2.0", "text", "gnu general public license version 2 june 1991"),
    ("gnu", "gpl-1.0", "text", "gnu general public license version 1 february 1989"),
    ("redistribute", "gpl-3.0-or-later", "notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("redistribute", "gpl-2.0-or-later", "notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("redistribute", "gpl-2.0-only", "notice", "you can redistribute it and or modify it under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("redistribute", "gpl", "notice", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gnu", "gpl-3.0", "name", "gnu general public license (?:version |v )?3(?: 0)?"),
    ("gnu", "gpl-3.0", "name", "gnu general public license v3(?: 0)?"),
    ("gnu", "gpl-2.0", "name", "gnu general public license (?:version |v )?2(?: 0)?"),
    ("gnu", "gpl-2.0", "name", "gnu general public license v2(?: 0)?"),
    ("gnu", "gpl-3.0-or-later", "name", "gnu general public license (?:version |v)?3 (?:0 )?or (?:any )?later"),
    ("gnu", "gpl-2.0-or-later", "name", "gnu general public license (?:version |v)?2 (?:0 )?or (?:any )?later"),
    ("gnu", "gpl", "name", "gnu gpl"),
    ("gnu", "gpl-3.0", "name", "gnu gpl ?v?3(?: 0)?"),
    ("gnu", "gpl-2.0", "name", "gnu gpl ?v?2(?: 0)?"),
    ("gpl", "gpl", "notice", "(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl"),
    ("gpl", "gpl", "name", "gpl licen[sc]ed?"),
    ("gpl", "gpl-2.0", "mention", "gpl (?:version |v )?2(?: 0)?"),
    ("gpl", "gpl-3.0", "mention", "gpl (?:version |v )?3(?: 0)?"),
    ("gplv2", "gpl-2.0", "mention", "gplv2"),
    ("gplv3", "gpl-3.0", "mention", "gplv3"),
    ("gpl2", "gpl-2.0", "mention", "gpl2"),
    ("gpl3", "gpl-3.0", "mention", "gpl3"),
    ("gnu", "gpl", "url", "gnu org (?:licenses|copyleft) gpl(?: html| txt)?"),
    ("gnu", "gpl-3.0", "url", "gnu org licenses gpl 3 0(?: html| txt)?"),
    ("gnu", "gpl-2.0", "url", "gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?"),
    ("exception", "gpl-2.0-with-classpath-exception", "notice", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("classpath", "gpl-2.0-with-classpath-exception", "name", "classpath exception"),
    ("linking", "gpl", "clause", "gpl linking exception"),
    ("copyleft", "copyleft", "mention", "copyleft licen[sc]e"),
    ("gnu", "gpl", "clause", "you should have received a copy of the gnu general public license"),
    # LGPL
    ("lesser", "lgpl-2.1-or-later", "notice", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lesser", "lgpl-3.0-or-later", "notice", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lesser", "lgpl-3.0", "text", "gnu lesser general public license version 3 29 june 2007"),
    ("lesser", "lgpl-2.1", "text", "gnu lesser general public license version 2 1 february 1999"),
    ("lesser", "lgpl-3.0", "name", "(?:gnu )?lesser general public license (?:version |v )?3(?: 0)?"),
    ("lesser", "lgpl-2.1", "name", "(?:gnu )?lesser general public license (?:version |v )?2 1"),
    ("lesser", "lgpl", "name", "(?:gnu )?lesser general public license"),
    ("library gnu", "lgpl-2.0", "name", "gnu library general public license(?: version 2)?"),
    ("lgpl", "lgpl", "name", "(?:gnu )?lgpl(?: licen[sc]ed?)?"),
    ("lgpl", "lgpl-2.1", "mention", "lgpl (?:version |v )?2 1"),
    ("lgpl", "lgpl-3.0", "mention", "lgpl (?:version |v )?3(?: 0)?"),
    ("lgplv2", "lgpl-2.1", "mention", "lgplv2(?: 1)?"),
    ("lgplv3", "lgpl-3.0", "mention", "lgplv3"),
    ("gnu", "lgpl", "url", "gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: html| txt)?"),
    ("gnu", "lgpl-2.1", "url", "gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?"),
    ("gnu", "lgpl-3.0", "url", "gnu org licenses lgpl 3 0(?: html| txt)?"),
    # AGPL
    ("affero", "agpl-3.0-or-later", "notice", "under the terms of the gnu affero general public license ~ as published by the free software foundation ~ either version 3 of the license or at your option any later version"),
    ("affero", "agpl-3.0", "text", "gnu affero general public license version 3 19 november 2007"),
    ("affero", "agpl-3.0", "name", "(?:gnu )?affero general public license (?:version |v )?3(?: 0)?"),
    ("affero", "agpl", "name", "(?:gnu )?affero general public license"),
    ("affero", "agpl", "name", "affero gpl"),
    ("agpl", "agpl", "name", "agpl(?: licen[sc]ed?)?"),
    ("agpl", "agpl-3.0", "mention", "agpl (?:version |v )?3(?: 0)?"),
    ("agplv3", "agpl-3.0", "mention", "agplv3"),
    ("gnu", "agpl-3.0", "url", "gnu org licenses agpl 3 0(?: html| txt)?"),
    ("gnu", "agpl", "url", "gnu org licenses agpl(?: html)?"),
    # GFDL
    ("documentation gnu", "gfdl", "name", "gnu free documentation license"),
    ("documentation gnu", "gfdl-1.3", "name", "gnu free documentation license (?:version |v )?1 3"),
    ("documentation gnu", "gfdl-1.2", "name", "gnu free documentation license (?:version |v )?1 2"),
    ("gfdl", "gfdl", "name", "gfdl"),
    ("invariant", "gfdl", "clause", "with no invariant sections no front cover texts and no back cover texts"),
    # Mozilla
    ("mozilla", "mpl-2.0", "text", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mozilla", "mpl-1.1", "text", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mozilla", "mpl-2.0", "name", "mozilla public license (?:version |v )?2(?: 0)?"),
    ("mozilla", "mpl-1.1", "name", "mozilla public license (?:version |v )?1 1"),
    ("mozilla", "mpl", "name", "mozilla public license"),
    ("mpl", "mpl-2.0", "mention", "mpl (?:version |v )?2 0"),
    ("mpl", "mpl-1.1", "mention", "mpl (?:version |v )?1 1"),
    ("mozilla", "mpl-2.0", "url", "mozilla org mpl 2 0"),
    ("mozilla", "mpl", "url", "mozilla org mpl"),
    # Eclipse, CPL, CDDL, EUPL, CeCILL
    ("eclipse", "epl-2.0", "text", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("eclipse", "epl-1.0", "text", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("eclipse", "epl-2.0", "name", "eclipse public license (?:version |v )?2(?: 0)?"),
    ("eclipse", "epl-1.0", "name", "eclipse public license (?:version |v )?1(?: 0)?"),
    ("eclipse", "epl", "name", "eclipse public license"),
    ("eclipse", "epl", "url", "eclipse org legal epl(?: v?[12]0)?(?: html)?"),
    ("eclipse", "edl-1.0", "name", "eclipse distribution license(?: v?1 0)?"),
    ("common license", "cpl-1.0", "name", "common public license(?: version)?(?: v?1 0)?"),
    ("ibm", "ipl-1.0", "name", "ibm public license(?: version)?(?: 1 0)?"),
    ("cddl", "cddl", "name", "cddl(?: 1 [01])?"),
    ("distribution license", "cddl", "name", "common development and distribution license"),
    ("distribution license", "cddl-1.0", "name", "common development and distribution license ~ 1 0"),
    ("distribution license", "cddl-1.1", "name", "common development and distribution license ~ 1 1"),
    ("eupl", "eupl", "name", "eupl(?: v ?1 [12])?"),
    ("european union", "eupl", "name", "european union public licen[sc]e"),
    ("cecill", "cecill", "name", "cecill(?: [bc])?(?: licen[sc]e)?"),
    ("joinup", "eupl", "url", "joinup ec europa eu ~ eupl"),
    # Creative Commons
    ("creative", "cc-by-nc-nd", "name", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("creative", "cc-by-nc-sa", "name", "creative commons attribution non ?commercial share ?alike"),
    ("creative", "cc-by-nc", "name", "creative commons attribution non ?commercial"),
    ("creative", "cc-by-nd", "name", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("creative", "cc-by-sa", "name", "creative commons attribution share ?alike"),
    ("creative", "cc-by", "name", "creative commons attribution"),
    ("creative", "cc-by-4.0", "name", "creative commons attribution 4 0(?: international)?"),
    ("creative", "cc-by-3.0", "name", "creative commons attribution 3 0(?: unported)?"),
    ("creative", "cc-by-sa-4.0", "name", "creative commons attribution share ?alike 4 0(?: international)?"),
    ("creative", "cc-by-sa-3.0", "name", "creative commons attribution share ?alike 3 0(?: unported)?"),
    ("creative", "cc", "name", "creative commons licen[sc]e"),
    ("creative", "cc0-1.0", "name", "creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"),
    ("cc", "cc-by-nc-nd", "mention", "cc by nc nd(?: [1-4] 0)?"),
    ("cc", "cc-by-nc-sa", "mention", "cc by nc sa(?: [1-4] 0)?"),
    ("cc", "cc-by-nc", "mention", "cc by nc(?: [1-4] 0)?"),
    ("cc", "cc-by-nd", "mention", "cc by nd(?: [1-4] 0)?"),
    ("cc", "cc-by-sa", "mention", "cc by sa(?: [1-4] [05])?"),
    ("cc", "cc-by-4.0", "mention", "cc by 4 0"),
    ("cc", "cc-by-3.0", "mention", "cc by 3 0"),
    ("cc0", "cc0-1.0", "name", "cc0(?: 1 0)?(?: universal)?"),
    ("creativecommons", "cc-by", "url", "creativecommons org licenses by"),
    ("creativecommons", "cc-by-4.0", "url", "creativecommons org licenses by 4 0"),
    ("creativecommons", "cc-by-sa", "url", "creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("creativecommons", "cc-by-nc", "url", "creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("creativecommons", "cc-by-nd", "url", "creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("creativecommons", "cc-by-nc-sa", "url", "creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("creativecommons", "cc-by-nc-nd", "url", "creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("creativecommons", "cc0-1.0", "url", "creativecommons org publicdomain zero 1 0"),
    ("creativecommons", "public-domain", "url", "creativecommons org publicdomain mark 1 0"),
    # public domain
    ("unlicense", "unlicense", "name", "(?:the )?unlicense"),
    ("unencumbered", "unlicense", "text", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", "url", "unlicense org"),
    ("wtfpl", "wtfpl", "name", "wtfpl"),
    ("fuck", "wtfpl", "name", "do what the fuck you want to public license"),
    ("domain public", "public-domain", "notice", "(?:released|placed|dedicated|put) (?:in|into|in to|to) the public domain"),
    ("domain public", "public-domain", "mention", "(?:is|are) in the public domain"),
    ("domain public", "public-domain", "mention", "public domain dedication"),
    ("forgiveness", "blessing", "text", "may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("evil", "json", "clause", "the software shall be used for good not evil"),
    ("pddl", "pddl-1.0", "name", "pddl(?: 1 0)?"),
    ("database license", "odbl-1.0", "name", "open database license"),
    ("odbl", "odbl-1.0", "name", "odbl(?: 1 0)?"),
    ("commons license", "odc-by-1.0", "name", "open data commons attribution license"),
    ("commons license", "pddl-1.0", "name", "open data commons public domain dedication(?: and)? license"),
    # other permissive
    ("zlib", "zlib", "name", "zlib(?: libpng)? license"),
    ("misrepresented", "zlib", "text", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("altered", "zlib", "clause", "altered source versions must be plainly marked as such"),
    ("boost", "bsl-1.0", "name", "boost software license(?: version 1 0)?"),
    ("boost", "bsl-1.0", "url", "boost org license 1 0(?: txt)?"),
    ("bsl", "bsl-1.0", "mention", "bsl 1 0"),
    ("artistic license", "artistic-2.0", "name", "artistic license (?:version |v )?2 0"),
    ("artistic license", "artistic-1.0", "name", "artistic license (?:version |v )?1 0"),
    ("artistic license", "artistic", "name", "artistic license"),
    ("perl", "artistic-1.0-or-gpl", "notice", "under the same terms as perl(?: itself)?"),
    ("python license", "psf-2.0", "name", "python software foundation license(?: agreement)?"),
    ("psf", "psf-2.0", "name", "psf license(?: agreement)?"),
    ("postgresql", "postgresql", "name", "postgresql license"),
    ("openssl", "openssl", "name", "openssl license"),
    ("openssl", "openssl", "text", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ncsa", "ncsa", "name", "(?:university of illinois )?ncsa open source license"),
    ("academic license", "afl", "name", "academic free license(?: version)?(?: v ?(?:2 1|3 0)| 2 1| 3 0)?"),
    ("osl", "osl-3.0", "mention", "osl 3 0"),
    ("open software", "osl", "name", "open software license(?: version)?(?: v ?(?:2 1|3 0)| 2 1| 3 0)?"),
    ("educational license", "ecl-2.0", "name", "educational community license(?: version)?(?: 2 0)?"),
    ("w3c", "w3c", "name", "w3c software (?:notice and )?(?:document )?license"),
    ("unicode", "unicode", "name", "unicode (?:inc )?license(?: agreement)?"),
    ("upl", "upl-1.0", "mention", "upl(?: v)? 1 0"),
    ("permissive license", "upl-1.0", "name", "universal permissive license(?: v ?1 0)?"),
    ("php", "php", "name", "php license(?: version)?(?: 3 0 ?1?)?"),
    ("ruby", "ruby", "name", "ruby license"),
    ("vim", "vim", "name", "vim license"),
    ("zope", "zpl", "name", "zope public license(?: version)?(?: 2 [01])?"),
    ("sun license", "sissl", "name", "sun industry standards source license"),
    ("apple", "apsl-2.0", "name", "apple public source license(?: version)?(?: 2 0)?"),
    ("microsoft", "ms-pl", "name", "microsoft public license(?: ms pl)?"),
    ("microsoft", "ms-rl", "name", "microsoft reciprocal license(?: ms rl)?"),
    ("mulan", "mulanpsl-2.0", "name", "mulan (?:psl|permissive software license)(?: v ?2)?"),
    ("blue oak", "blueoak-1.0.0", "name", "blue oak model license(?: 1 0 0)?"),
    ("beerware", "beerware", "name", "(?:the )?beerware license"),
    ("ware", "beerware", "name", "(?:the )?beer ware license"),
    ("beer", "beerware", "text", "you think this stuff is worth it you can buy me a beer in return"),
    ("latex", "lppl", "name", "latex project public license(?: version)?(?: 1 3[ac]?)?"),
    ("lppl", "lppl", "name", "lppl(?: 1 3[ac]?)?"),
    ("freetype", "ftl", "name", "(?:the )?freetype (?:project )?license"),
    ("jpeg", "ijg", "text", "this software is based in part on the work of the independent jpeg group"),
    ("ofl", "ofl-1.1", "name", "(?:sil )?ofl(?: 1 1)?"),
    ("sil font", "ofl-1.1", "name", "sil open font license(?: version)?(?: 1 1)?"),
    ("font license", "ofl-1.1", "name", "open font license"),
    ("q public", "qpl-1.0", "name", "q public license(?: version 1 0)?"),
    ("qpl", "qpl-1.0", "name", "qpl(?: 1 0)?"),
    # source-available and proprietary
    ("business source", "busl-1.1", "name", "business source license(?: 1 1)?"),
    ("busl", "busl-1.1", "mention", "busl 1 1"),
    ("elastic", "elastic-2.0", "name", "elastic license(?: v ?2)?(?: 2 0)?"),
    ("sspl", "sspl-1.0", "name", "sspl(?: v ?1)?"),
    ("side server", "sspl-1.0", "name", "server side public license(?: version)?(?: 1)?"),
    ("confluent", "confluent", "name", "confluent community license"),
    ("commons license", "commons-clause", "name", "commons clause license condition"),
    ("polyform", "polyform", "name", "polyform (?:noncommercial|strict|small business|shield|perimeter) license"),
    ("rights reserved", "proprietary", "mention", "all rights reserved"),
    ("proprietary", "proprietary", "notice", "(?:proprietary and confidential|confidential and proprietary)"),
    ("unauthorized", "proprietary", "notice", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("license", "proprietary", "name", "end user license agreement"),
    ("eula", "proprietary", "mention", "eula"),
    ("commercial license", "commercial", "notice", "(?:licensed|available) under (?:a )?commercial license"),
    ("commercial", "non-commercial", "notice", "for non commercial (?:use|purposes) only"),
    ("noncommercial", "non-commercial", "notice", "for noncommercial (?:use|purposes) only"),
    # models and data
    ("openrail", "openrail", "name", "(?:creativeml |bigscience )?openrail(?: m)?(?: license)?"),
    ("creativeml", "openrail", "name", "creativeml open rail(?: m)?(?: license)?"),
    ("rail", "openrail", "name", "(?:bigscience |responsible ai )(?:open )?rail(?: m)?(?: license)?"),
    ("community license", "community-data", "name", "community data license agreement(?: permissive| sharing)?(?: version)?(?: [12] 0)?"),
    ("cdla", "community-data", "mention", "cdla (?:permissive|sharing)(?: [12] 0)?"),
    ("government open", "ogl", "name", "open government licen[sc]e(?: v ?[123])?(?: 0)?"),
    ("ogl", "ogl", "mention", "ogl (?:v ?)?[123](?: 0)?"),
    # dual and general notices
    ("dual licensed", "dual", "notice", "dual licensed under"),
    ("license", "unknown", "clause", "see (?:the )?license (?:file )?for (?:details|more information|the full text)"),
    ("license", "unknown", "clause", "see the file license"),
    ("copying", "unknown", "clause", "see (?:the )?(?:file )?copying for (?:details|more information)"),
    ("license", "unknown", "clause", "license agreement"),
)
