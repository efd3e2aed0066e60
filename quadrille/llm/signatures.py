"""License signatures: regular expressions over a text's words, written by hand, in order of priority.

A pattern is matched against words in lower case with one space between them; punctuation is
gone, so "Apache-2.0" is `apache 2 0`. Each entry: label, keywords, pattern, weight. Any text
that the pattern matches has one of the keywords as a word of its own (a test makes texts from every alternative).
A label's {v} is what the group v matched, with dots for spaces.
"""

# fmt: off
#: The exact before the loose: of two detections one of which lies within the other, the earlier rule's stays.
SIGNATURES = (
    # --- whole grants and conditions, as they stand in license texts ---
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.98),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit-0", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 0.98),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.96),
    ("isc", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 0.95),
    ("0bsd", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 0.97),
    ("hpnd", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", 0.94),
    ("ntp", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 0.94),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising", 0.96),
    ("x11", "advertising", r"except as contained in this notice the names? of (?:\S+ ){1,10}?shall not be used in advertising or otherwise to promote the sale use or other dealings", 0.92),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.96),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 0.94),
    ("bsd", "redistributions", r"redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer", 0.94),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0.94),
    ("bsd-3-clause", "endorse", r"neither the name of (?:\S+ ){1,12}?nor the names of its contributors may be used to endorse or promote products", 0.96),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:\S+ ){1,12}?may be used to endorse or promote", 0.92),
    ("bsd-3-clause", "endorse", r"the names? of the (?:author|copyright holder|copyright holders|contributors) may not be used to endorse or promote products", 0.92),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 0.96),
    ("bsd-source-code", "redistributions", r"redistributions of source code must retain the above copyright notice and this list of conditions", 0.9),
    ("bsd-patent", "patent", r"bsd (?:2 clause )?plus patent(?: license)?", 0.92),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.97),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 0.94),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 0.96),
    ("libpng", "png libpng 42", r"the contributing authors and group 42 inc disclaim all warranties|this copy of the libpng notices|png reference library license", 0.9),
    ("apache-2.0", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 0.99),
    ("apache-2.0", "apache", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: html| txt)?", 0.96),
    ("apache-2.0", "express", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", 0.9),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 0.9),
    ("apache-1.0", "apache", r"this product includes software developed by the apache group", 0.92),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify", 0.9),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.95),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify", 0.9),
    ("gpl-{v}", "version", r"under the terms of the gnu general public license as published by the free software foundation (?:either )?version (?P<v>[123])(?: of the license)?(?: or at your option any later version)?", 0.97),
    ("lgpl-{v}", "version", r"under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation (?:either )?version (?P<v>2 1|[23])(?: of the license)?(?: or at your option any later version)?", 0.97),
    ("agpl-{v}", "affero", r"under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version (?P<v>3)(?: of the license)?(?: or at your option any later version)?", 0.98),
    ("gpl", "received", r"you should have received a copy of the gnu general public license along with", 0.85),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", 0.85),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public license along with", 0.88),
    ("gpl", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 0.95),
    ("gpl", "preamble", r"gnu general public license version [123] (?:\S+ ){0,40}?preamble", 0.95),
    ("gpl-classpath-exception", "linking", r"linking this library statically or dynamically with other modules is making a combined work based on this library", 0.93),
    ("gpl-classpath-exception", "classpath", r"(?:with (?:the )?)?classpath exception(?: 2 0)?", 0.85),
    ("gcc-exception-3.1", "gcc", r"gcc runtime library exception(?: version 3 1)?", 0.92),
    ("gpl-autoconf-exception", "autoconf", r"(?:with (?:the )?)?autoconf (?:configure script )?exception", 0.85),
    ("mpl-{v}", "mozilla", r"this source code form is subject to the terms of the mozilla public license v (?P<v>2 0)", 0.98),
    ("mpl-{v}", "mozilla", r"the contents of this file are subject to the mozilla public license version (?P<v>1 [01]) the license", 0.97),
    ("mpl", "mozilla", r"if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:www )?mozilla org mpl 2 0", 0.95),
    ("npl-{v}", "netscape", r"the contents of this file are subject to the netscape public license version (?P<v>1 [01])", 0.95),
    ("epl-{v}", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v?(?: ?(?P<v>[12] 0))", 0.97),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 0.92),
    ("edl-1.0", "eclipse", r"eclipse distribution license(?: v| version)? 1 0", 0.95),
    ("cddl-{v}", "development", r"the contents of this file are subject to the terms of (?:either )?the common development and distribution license(?: version (?P<v>1 [01]))", 0.96),
    ("cddl", "development", r"subject to the terms of (?:either )?(?:the )?common development and distribution license", 0.9),
    ("boost-1.0", "boost", r"distributed under the boost software license version 1 0", 0.97),
    ("boost-1.0", "boost", r"(?:https? )?(?:www )?boost org license 1 0 txt", 0.96),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0.98),
    ("unlicense", "unlicense", r"(?:https? )?(?:www )?unlicense org", 0.9),
    ("wtfpl", "fuck", r"do what the fuck you want to public license(?: version [12])?", 0.97),
    ("beerware", "beer", r"as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer", 0.97),
    ("beerware", "beerware beer", r"the beer ware license(?: revision 42)?|beerware license", 0.93),
    ("artistic", "artistic", r"you may (?:copy and )?distribute (?:this package|it) under the (?:same )?terms (?:of the artistic license|as perl itself under the artistic license)", 0.9),
    ("perl", "perl", r"(?:this (?:library|program|module|package) is free software )?you (?:can|may) redistribute it and or modify it under the same terms as perl(?: itself)?", 0.93),
    ("ruby", "ruby", r"(?:distributed|licensed) under the (?:same )?terms (?:of|as) (?:the )?ruby(?: s)?(?: license| itself)?", 0.85),
    ("psf-2.0", "psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license", 0.96),
    ("python", "cnri", r"cnri hereby grants licensee a nonexclusive royalty free world wide license|cnri (?:open source )?license agreement(?: for python)?", 0.93),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 0.96),
    ("ssleay", "ssl cryptographic", r"this product includes cryptographic software written by eric young|this package is an ssl implementation written by eric young", 0.95),
    ("curl", "curl", r"curl (?:and libcurl are licensed under a|is licensed under a) (?:mit x derivate license|license inspired by mit x)", 0.92),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license version 1 1", 0.98),
    ("ofl-1.1", "font", r"sil open font license(?: version| v)? 1 1(?: 26 february 2007)?", 0.96),
    ("ofl-1.0", "font", r"sil open font license(?: version| v)? 1 0", 0.95),
    ("ofl", "ofl", r"(?:https? )?scripts sil org ofl|reserved font name (?:\S+ ){0,4}?ofl", 0.85),
    ("bitstream-vera", "bitstream", r"bitstream vera is a trademark of bitstream inc|bitstream vera fonts copyright", 0.94),
    ("ubuntu-font-1.0", "ubuntu", r"ubuntu font licen[cs]e(?: version)? 1 0", 0.95),
    ("gust-font", "gust", r"gust font (?:source )?license", 0.92),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", 0.94),
    ("freetype", "freetype", r"(?:portions of this software are copyright \S+ the freetype project|the freetype project license|freetype license ftl)", 0.93),
    ("json", "evil", r"the software shall be used for good not evil", 0.97),
    ("sqlite-blessing", "blessing", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing", 0.98),
    ("icu", "icu unicode", r"icu license(?: icu 1 8 1 and later)?|unicode license agreement data files and software|unicode terms of use", 0.9),
    ("unicode-v3", "unicode", r"unicode license v3", 0.95),
    ("ncsa", "illinois", r"developed by (?:\S+ ){1,14}?university of illinois at urbana champaign|university of illinois ncsa open source license", 0.93),
    ("w3c", "w3c", r"w3c software (?:notice and license|and document notice and license)|w3c document license", 0.93),
    ("afl-{v}", "academic", r"(?:licensed under the )?academic free license(?: version| v)? (?P<v>[123] [01])", 0.96),
    ("osl-{v}", "osl software", r"(?:licensed under the )?open software license(?: version| v)? (?P<v>[123] [01])|osl (?:3 0|2 1)", 0.94),
    ("ms-pl", "microsoft ms", r"microsoft public license(?: ms pl)?|ms pl license", 0.93),
    ("ms-rl", "microsoft ms", r"microsoft reciprocal license(?: ms rl)?|ms rl license", 0.93),
    ("ms-lpl", "microsoft", r"microsoft limited public license", 0.93),
    ("ms-eula", "microsoft", r"microsoft software license terms|microsoft end user license agreement", 0.9),
    ("eupl-{v}", "european", r"(?:licensed under the )?european union public licen[cs]e(?: version| v)? (?P<v>1 [012])", 0.96),
    ("cecill-{v}", "cecill", r"cecill (?:free software license agreement )?(?:version |v )?(?P<v>[12] [01])", 0.95),
    ("cecill-b", "cecill", r"cecill b(?: free software license agreement)?", 0.93),
    ("cecill-c", "cecill", r"cecill c(?: free software license agreement)?", 0.93),
    ("cecill", "cecill", r"(?:governed by the )?cecill license", 0.88),
    ("lppl-{v}", "latex", r"latex project public license(?: version| v)? (?P<v>1 [0123]c?)", 0.96),
    ("lppl", "latex lppl", r"latex project public license|lppl", 0.85),
    ("qpl-1.0", "qpl", r"q public license qpl|qpl(?: version)? 1 0", 0.92),
    ("sleepycat", "sleepycat", r"sleepycat(?: software)?(?: public)? license|copyright \S+ (?:\S+ )?sleepycat software", 0.92),
    ("postgresql", "postgresql postgres", r"(?:released under the )?postgresql licen[cs]e|postgresql database management system formerly known as postgres", 0.92),
    ("php-{v}", "php", r"php license(?: version| v)? (?P<v>[23] 0 ?1?)", 0.94),
    ("php", "php", r"this product includes php software freely available from", 0.93),
    ("zope-{v}", "zope zpl", r"zope public license zpl(?: version)? (?P<v>[12] [01])", 0.95),
    ("zope", "zope", r"zope public license", 0.9),
    ("vim", "vim", r"vim license|this is the vim licen[cs]e", 0.88),
    ("tcl", "authors", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", 0.94),
    ("sunpro", "sunpro", r"developed at sunpro a sun microsystems inc business permission to use copy modify and distribute this software is freely granted", 0.95),
    ("sun-bcl", "sun", r"sun microsystems inc binary code license agreement", 0.94),
    ("oracle-otn", "oracle", r"oracle technology network (?:developer )?license(?: agreement| terms)?", 0.93),
    ("oracle-bcl", "oracle", r"oracle binary code license agreement", 0.94),
    ("upl-1.0", "universal", r"(?:the )?universal permissive license(?: upl)?(?: version| v)? ?1 0", 0.96),
    ("ibm-pl-1.0", "ibm", r"ibm public license(?: version| v)? 1 0", 0.95),
    ("cpl-1.0", "common", r"common public license(?: version| v)? 1 0", 0.95),
    ("cpal-1.0", "attribution", r"common public attribution license(?: version| v)? 1 0", 0.96),
    ("apsl-{v}", "apple", r"apple public source license(?: version| v)? (?P<v>[12] [012])", 0.95),
    ("apple-sample", "apple", r"apple grants you a personal non exclusive license under apple s copyrights in this original apple software", 0.95),
    ("intel-bsd", "intel", r"intel (?:simplified|open source) (?:software )?license", 0.9),
    ("nvidia-eula", "nvidia", r"nvidia (?:software |cuda toolkit )?(?:end user )?license agreement", 0.92),
    ("nasa-1.3", "nasa", r"nasa open source agreement(?: version)? 1 3", 0.95),
    ("rpl-{v}", "reciprocal", r"reciprocal public license(?: version)? (?P<v>1 [15])", 0.95),
    ("sissl", "sun", r"sun industry standards source license(?: version 1 [12])?", 0.94),
    ("spl-1.0", "sun", r"sun public license(?: version| v)? 1 0", 0.94),
    ("watcom-1.0", "watcom", r"(?:sybase )?open watcom public license(?: version)? 1 0", 0.95),
    ("ecl-2.0", "educational", r"educational community license(?: version| v)? 2 0", 0.96),
    ("mulanpsl-{v}", "mulan", r"mulan (?:psl|permissive software license)(?: version| v)? ?(?P<v>[12])", 0.95),
    ("blueoak-1.0.0", "oak", r"blue oak model license(?: version)? 1 0 0", 0.96),
    ("hippocratic", "hippocratic", r"hippocratic license(?: version| hl)?(?: [123] [012])?", 0.93),
    ("parity", "parity", r"(?:the )?parity public license(?: [67] 0 0)?", 0.92),
    ("polyform-noncommercial", "polyform", r"polyform noncommercial license(?: 1 0 0)?", 0.95),
    ("polyform", "polyform", r"polyform (?:small business|shield|strict|perimeter|internal use|free trial) license(?: 1 0 0)?", 0.93),
    ("busl-1.1", "business", r"business source license(?: version| v)? ?1 1", 0.96),
    ("sspl-1.0", "server", r"server side public license(?: version| v)? ?1", 0.96),
    ("elastic-{v}", "elastic", r"elastic license(?: version| v)? ?(?P<v>[12](?: 0)?)", 0.95),
    ("confluent", "confluent", r"confluent community license(?: agreement)?", 0.93),
    ("commons-clause", "commons", r"commons clause license condition(?: v| version)? ?1 0|commons clause", 0.88),
    ("timescale", "timescale", r"timescale license(?: agreement)?", 0.9),
    ("redis-sal", "redis", r"redis source available license(?: agreement)?(?: version 2)?", 0.95),
    ("openrail", "rail openrail", r"(?:creativeml |bigscience |bigcode )?open rail (?:m) license|(?:creativeml |bigscience |bigcode )?openrail(?: m|)? license", 0.93),
    ("llama", "llama", r"llama [234](?: [123])? community license(?: agreement)?", 0.95),
    ("gemma", "gemma", r"gemma terms of use", 0.92),
    # --- documents, data, works of art ---
    ("gfdl-{v}", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version (?P<v>1 [123])", 0.98),
    ("gfdl-{v}", "documentation", r"(?:gnu )?free documentation license(?: version| v)? (?P<v>1 [123])", 0.95),
    ("gfdl", "documentation gfdl", r"(?:gnu )?free documentation license|gfdl", 0.85),
    ("fdl", "opl open", r"open publication license(?: v1 0| version 1 0)?|opl v1 0", 0.88),
    ("odbl-1.0", "database odbl", r"(?:odc |open data commons )?open database license(?: odbl)?(?: version| v)? ?1 0|odbl (?:v )?1 0", 0.95),
    ("odbl", "database odbl", r"(?:odc |open data commons )?open database license(?: odbl)?|odbl", 0.85),
    ("odc-by-1.0", "attribution", r"(?:odc|open data commons) attribution license(?: version| v)? ?(?:1 0)?", 0.93),
    ("pddl-1.0", "pddl dedication", r"(?:odc |open data commons )?public domain dedication and license(?: pddl)?(?: v?1 0)?|pddl(?: 1 0)?", 0.92),
    ("cdla-permissive-{v}", "cdla community", r"(?:community data license agreement|cdla) permissive (?:version )?(?P<v>[12] 0)", 0.95),
    ("cdla-sharing-{v}", "cdla community", r"(?:community data license agreement|cdla) sharing (?:version )?(?P<v>1 0)", 0.95),
    ("ogl-uk-{v}", "government", r"open government licen[cs]e(?: version| v)? ?(?P<v>[123](?: 0)?)", 0.94),
    ("ogl-uk", "government", r"contains public sector information licensed under the open government licen[cs]e|open government licen[cs]e", 0.88),
    ("etalab-{v}", "etalab ouverte", r"(?:licence ouverte|etalab)(?: open licen[cs]e)?(?: version| v)? (?P<v>[12] 0)", 0.93),
    ("dl-de-by", "datenlizenz", r"datenlizenz deutschland namensnennung(?: version 2 0)?", 0.94),
    ("dl-de-zero", "datenlizenz", r"datenlizenz deutschland zero(?: version 2 0)?", 0.94),
    ("free-art-1.3", "art", r"free art licen[cs]e(?: version)? 1 3|licence art libre(?: 1 3)?", 0.92),
    ("ccby-npl", "nonprofit", r"for nonprofit educational use only", 0.7),
    # --- creative commons ---
    ("cc-by-nc-sa-{v}", "creative", r"creative commons attribution non ?commercial share ?alike(?: (?:international|unported|generic))?(?: public)?(?: license)?(?: version)? (?P<v>[1-4] [05])(?: (?:international|unported|generic))?(?: public)?(?: license)?", 0.97),
    ("cc-by-nc-nd-{v}", "creative", r"creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)?(?: (?:international|unported|generic))?(?: public)?(?: license)?(?: version)? (?P<v>[1-4] [05])(?: (?:international|unported|generic))?(?: public)?(?: license)?", 0.97),
    ("cc-by-nc-{v}", "creative", r"creative commons attribution non ?commercial(?: (?:international|unported|generic))?(?: public)?(?: license)?(?: version)? (?P<v>[1-4] [05])(?: (?:international|unported|generic))?(?: public)?(?: license)?", 0.96),
    ("cc-by-nd-{v}", "creative", r"creative commons attribution no ?deriv(?:s|atives|ative works)?(?: (?:international|unported|generic))?(?: public)?(?: license)?(?: version)? (?P<v>[1-4] [05])(?: (?:international|unported|generic))?(?: public)?(?: license)?", 0.96),
    ("cc-by-sa-{v}", "creative", r"creative commons attribution share ?alike(?: (?:international|unported|generic))?(?: public)?(?: license)?(?: version)? (?P<v>[1-4] [05])(?: (?:international|unported|generic))?(?: public)?(?: license)?", 0.96),
    ("cc-by-{v}", "creative", r"creative commons attribution(?: (?:international|unported|generic))?(?: public)?(?: license)?(?: version)? (?P<v>[1-4] [05])(?: (?:international|unported|generic))?(?: public)?(?: license)?", 0.95),
    ("cc-by-nc-sa-{v}", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by nc sa (?P<v>[1-4] [05])(?: legalcode| deed(?: [a-z]{2})?)?", 0.97),
    ("cc-by-nc-nd-{v}", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by nc nd (?P<v>[1-4] [05])(?: legalcode| deed(?: [a-z]{2})?)?", 0.97),
    ("cc-by-nc-{v}", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by nc (?P<v>[1-4] [05])(?: legalcode| deed(?: [a-z]{2})?)?", 0.97),
    ("cc-by-nd-{v}", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by nd (?P<v>[1-4] [05])(?: legalcode| deed(?: [a-z]{2})?)?", 0.97),
    ("cc-by-sa-{v}", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by sa (?P<v>[1-4] [05])(?: legalcode| deed(?: [a-z]{2})?)?", 0.97),
    ("cc-by-{v}", "creativecommons", r"(?:https? )?(?:www )?creativecommons org licenses by (?P<v>[1-4] [05])(?: legalcode| deed(?: [a-z]{2})?)?", 0.97),
    ("cc-by-nc-sa-{v}", "cc", r"cc by nc sa (?P<v>[1-4] [05])", 0.96),
    ("cc-by-nc-nd-{v}", "cc", r"cc by nc nd (?P<v>[1-4] [05])", 0.96),
    ("cc-by-nc-{v}", "cc", r"cc by nc (?P<v>[1-4] [05])", 0.96),
    ("cc-by-nd-{v}", "cc", r"cc by nd (?P<v>[1-4] [05])", 0.96),
    ("cc-by-sa-{v}", "cc", r"cc by sa (?P<v>[1-4] [05])", 0.96),
    ("cc-by-{v}", "cc", r"cc by (?P<v>[1-4] [05])", 0.95),
    ("cc0-1.0", "cc0", r"cc0 1 0(?: universal)?(?: public domain dedication)?|creative commons cc0 license(?: version)? 1 0", 0.96),
    ("cc0-1.0", "creative", r"creative commons (?:zero|cc0)(?: license)?(?: version)? 1 0(?: universal)?", 0.96),
    ("cc0-1.0", "creativecommons", r"(?:https? )?(?:www )?creativecommons org publicdomain zero 1 0(?: legalcode| deed(?: [a-z]{2})?)?", 0.97),
    ("cc-pdm-1.0", "creativecommons", r"(?:https? )?(?:www )?creativecommons org publicdomain mark 1 0(?: deed(?: [a-z]{2})?)?", 0.96),
    ("cc-pdm-1.0", "mark", r"(?:creative commons )?public domain mark(?: 1 0)?", 0.9),
    ("cc-by-nc-sa", "creative cc", r"creative commons attribution non ?commercial share ?alike(?: license)?|cc by nc sa", 0.88),
    ("cc-by-nc-nd", "creative cc", r"creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)?(?: license)?|cc by nc nd", 0.88),
    ("cc-by-nc", "creative cc", r"creative commons attribution non ?commercial(?: license)?|cc by nc", 0.86),
    ("cc-by-nd", "creative cc", r"creative commons attribution no ?deriv(?:s|atives|ative works)?(?: license)?|cc by nd", 0.86),
    ("cc-by-sa", "creative cc", r"creative commons attribution share ?alike(?: license)?|cc by sa", 0.86),
    ("cc-by", "creative", r"creative commons attribution(?: license)?", 0.85),
    ("cc-sampling", "sampling", r"creative commons (?:noncommercial )?sampling (?:plus )?(?:license )?1 0", 0.9),
    ("cc0-1.0", "cc0", r"cc0(?: license| waiver)?", 0.75),
    ("cc-devnations", "nations", r"creative commons developing nations(?: license)?(?: 2 0)?", 0.9),
    # --- names with versions ---
    ("apache-{v}", "apache", r"(?:licensed under (?:the )?)?(?:the )?apache(?: software)?(?: public)? licen[cs]e(?: version| v)? ?(?P<v>1 [01]|2 0)", 0.95),
    ("apache-2.0", "apache", r"(?:licensed under (?:the )?)?(?:the )?apache(?: software)?(?: public)? licen[cs]e(?: version| v)? ?v?2", 0.93),
    ("apache-{v}", "apache", r"apache (?:v )?(?P<v>1 [01]|2 0)(?: licen[cs]e)?", 0.88),
    ("apache-2.0", "asl asl2", r"asl 2 0|asl2(?: 0)?", 0.85),
    ("agpl-3.0", "affero", r"(?:gnu )?affero (?:general public|gpl) licen[cs]e(?: version| v)? ?v?3(?: 0)?(?: or (?:any )?later(?: version)?)?", 0.95),
    ("agpl-1.0", "affero", r"affero general public licen[cs]e(?: version| v)? ?1(?: 0)?", 0.93),
    ("agpl-3.0", "agpl agplv3 agpl3", r"agpl(?: version| v)? ?3(?: 0)?(?: only| or later)?|agplv3|agpl3", 0.92),
    ("lgpl-{v}", "lesser library", r"(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?(?P<v>2 [01]|3 0)(?: or (?:any )?later(?: version)?)?", 0.95),
    ("lgpl-2.0", "lesser library", r"(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?v?2(?: or (?:any )?later(?: version)?)?", 0.93),
    ("lgpl-3.0", "lesser library", r"(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?v?3(?: or (?:any )?later(?: version)?)?", 0.93),
    ("lgpl-{v}", "lgpl", r"lgpl(?: version| v)? (?P<v>2 [01]|3 0)(?: only| or later)?", 0.92),
    ("lgpl-2.1", "lgplv2", r"lgplv2 1", 0.92),
    ("lgpl-2.0", "lgplv2 lgpl2 lgpl", r"lgplv2|lgpl2|lgpl(?: version| v)? 2", 0.88),
    ("lgpl-3.0", "lgplv3 lgpl3 lgpl", r"lgplv3|lgpl3|lgpl(?: version| v)? 3", 0.9),
    ("gpl-{v}", "general", r"(?:licensed under (?:the )?)?(?:the )?(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?(?P<v>[123] 0)(?: or (?:any )?later(?: version)?)?", 0.95),
    ("gpl-1.0", "general", r"(?:licensed under (?:the )?)?(?:the )?(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?1", 0.92),
    ("gpl-2.0", "general", r"(?:licensed under (?:the )?)?(?:the )?(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?2(?: or (?:any )?later(?: version)?)?", 0.95),
    ("gpl-3.0", "general", r"(?:licensed under (?:the )?)?(?:the )?(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?v?3(?: or (?:any )?later(?: version)?)?", 0.95),
    ("gpl-{v}", "gpl", r"(?:licensed under (?:the )?)?(?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? (?P<v>[123] 0)(?: only| or later)?", 0.93),
    ("gpl-1.0", "gplv1 gpl1 gpl", r"gplv1|gpl1|(?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? 1", 0.88),
    ("gpl-2.0", "gplv2 gpl2 gpl", r"gplv2|gpl2|(?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? 2(?: only| or later)?", 0.9),
    ("gpl-3.0", "gplv3 gpl3 gpl", r"gplv3|gpl3|(?:gnu )?gpl(?: licen[cs]e)?(?: version| v)? 3(?: only| or later)?", 0.9),
    ("mpl-{v}", "mozilla", r"(?:licensed under (?:the )?)?mozilla public licen[cs]e(?: version| v)? ?(?P<v>1 [01]|2 0)", 0.95),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?2", 0.92),
    ("mpl-{v}", "mpl", r"mpl(?: version| v)? (?P<v>1 [01]|2 0)", 0.88),
    ("mpl-2.0", "mplv2 mpl2", r"mplv2|mpl2", 0.85),
    ("epl-{v}", "eclipse", r"(?:licensed under (?:the )?)?eclipse public licen[cs]e(?: version| v)? ?(?P<v>[12] 0)", 0.95),
    ("epl-{v}", "epl", r"epl(?: version| v)? (?P<v>[12] 0)", 0.88),
    ("cddl-{v}", "development", r"common development and distribution licen[cs]e(?: cddl)?(?: version| v)? ?(?P<v>1 [01])", 0.95),
    ("cddl-{v}", "cddl", r"cddl(?: version| v)? (?P<v>1 [01])", 0.9),
    ("boost-1.0", "boost bsl", r"boost software licen[cs]e(?: version| v)? ?1(?: 0)?|bsl 1 0", 0.92),
    ("artistic-{v}", "artistic", r"(?:the )?(?:perl )?artistic licen[cs]e(?: version| v)? ?(?P<v>[12] 0)", 0.95),
    ("artistic-2.0", "artistic", r"(?:the )?(?:perl )?artistic licen[cs]e(?: version| v)? ?2", 0.92),
    ("psf-2.0", "python psf", r"(?:python software foundation|psf) licen[cs]e(?: agreement)?(?: version| v)? ?2(?: 0)?", 0.94),
    ("ofl-1.1", "font ofl", r"open font licen[cs]e(?: version| v)? ?1 1|ofl 1 1", 0.93),
    ("ncsa", "illinois ncsa", r"university of illinois open source licen[cs]e|ncsa(?: open source)? licen[cs]e", 0.93),
    # --- names without versions ---
    ("mit", "mit", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit(?: x11| expat)? licen[cs]e", 0.93),
    ("mit", "mit", r"(?:the )?mit(?: x11| expat)? licen[cs]e|licen[cs]e mit|mit licensed|mit style licen[cs]e", 0.88),
    ("mit", "opensource", r"(?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php| html)?", 0.94),
    ("mit", "expat", r"expat licen[cs]e", 0.88),
    ("mit-0", "attribution", r"mit no attribution(?: licen[cs]e)?", 0.93),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:simplified|2 clause|two clause) bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: simplified)?(?: licen[cs]e)?", 0.93),
    ("bsd-2-clause", "freebsd opensource", r"freebsd (?:licen[cs]e|copyright)|opensource org licenses bsd 2 clause", 0.88),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:new|revised|modified|3 clause|three clause) bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: new| revised)?(?: licen[cs]e)?", 0.93),
    ("bsd-3-clause", "opensource", r"opensource org licenses bsd (?:3 clause|license)(?: php)?", 0.92),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:original|old|4 clause|four clause) bsd(?: licen[cs]e)?|bsd (?:4|four) clause(?: original| old)?(?: licen[cs]e)?", 0.93),
    ("bsd-1-clause", "bsd", r"(?:1 clause|one clause) bsd(?: licen[cs]e)?|bsd (?:1|one) clause(?: licen[cs]e)?", 0.92),
    ("0bsd", "0bsd bsd", r"0bsd|(?:zero clause|0 clause|free public) bsd(?: licen[cs]e)?|bsd (?:zero|0) clause(?: licen[cs]e)?", 0.92),
    ("bsd", "bsd", r"bsd(?: style| like)? licen[cs]ed?|bsd style", 0.75),
    ("isc", "isc", r"(?:the )?isc licen[cs]ed?|licen[cs]e isc", 0.88),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e", 0.9),
    ("unlicense", "unlicense", r"(?:released under |licensed under )?(?:the )?unlicense", 0.88),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl(?: v?[12])?(?: licen[cs]e)?", 0.9),
    ("openssl", "openssl", r"openssl(?: ssleay)? licen[cs]e", 0.88),
    ("ruby", "ruby", r"ruby licen[cs]e", 0.85),
    ("gpl", "gnu", r"(?:https? )?(?:www )?gnu org (?:licenses|copyleft)(?: (?:old licenses )?a?l?gpl\S*)?(?: html| txt)?", 0.8),
    ("gfdl", "gnu", r"(?:https? )?(?:www )?gnu org licenses fdl(?: html)?", 0.85),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", 0.85),
    ("lgpl", "lesser library", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", 0.85),
    ("gpl", "general", r"gnu general public licen[cs]e", 0.82),
    ("agpl", "agpl", r"(?:gnu )?agpl", 0.7),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", 0.7),
    ("gpl", "gpl gpled", r"(?:gnu )?gpl(?:ed)?", 0.62),
    ("apache", "apache", r"(?:the )?apache(?: style)? licen[cs]ed?", 0.72),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", 0.72),
    ("epl", "eclipse", r"eclipse public licen[cs]e", 0.72),
    ("cddl", "development cddl", r"common development and distribution licen[cs]e|cddl", 0.72),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e", 0.72),
    ("psf", "python psf", r"(?:python software foundation|psf) licen[cs]e(?: agreement)?", 0.78),
    ("boost", "boost", r"boost (?:software )?licen[cs]e", 0.75),
    ("eupl", "eupl european", r"eupl|european union public licen[cs]e", 0.75),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e", 0.78),
    ("cc", "creativecommons", r"(?:https? )?(?:www )?creativecommons org (?:licenses|publicdomain)(?: \S+){0,4}?", 0.75),
    ("cc", "creative", r"creative commons(?: licen[cs]e[ds]?| public licen[cs]e)?", 0.6),
    ("spdx", "spdx", r"spdx license identifier \S+(?: \d+)*(?: (?:only|or later))?(?: with \S+ exception)?", 0.9),
    # --- the public domain ---
    ("public-domain", "domain", r"(?:has been |is |are |was )?(?:hereby )?(?:released|placed|dedicated|put|donated)(?: in| into| to)? the public domain", 0.9),
    ("public-domain", "disclaims disclaim", r"the authors? (?:hereby )?disclaims? (?:all )?copyright(?: to this (?:source code|file|work))?", 0.85),
    ("public-domain", "domain", r"this (?:work|file|program|code|software|page|document) is (?:in the )?public domain", 0.9),
    ("public-domain", "domain", r"no copyright is claimed (?:\S+ ){0,10}?public domain", 0.88),
    ("us-government", "government", r"(?:this is )?a work of the (?:u s|us|united states) government(?: and is not subject to copyright protection)?", 0.88),
    ("public-domain", "domain", r"public domain", 0.5),
    # --- rights kept ---
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary", 0.78),
    ("proprietary", "unauthorized unauthorised", r"unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication|access)(?: \S+){0,8}? (?:is )?(?:strictly )?(?:prohibited|forbidden)", 0.78),
    ("proprietary", "permission", r"no part of this (?:publication|book|work|document|website|site) may be reproduced (?:\S+ ){0,30}?(?:written )?permission", 0.85),
    ("proprietary", "permission", r"(?:may|must) not be (?:copied|reproduced|redistributed|published)(?: \S+){0,12}? without (?:the )?(?:prior |express |written ){0,3}(?:consent or )?permission", 0.8),
    ("proprietary", "consent", r"without (?:the )?(?:prior |express |written ){1,3}consent of (?:the )?(?:author|publisher|copyright (?:holder|owner)|owner)s?", 0.72),
    ("proprietary", "trade", r"(?:contains|constitutes?) (?:valuable )?trade secrets(?: and confidential information)?", 0.75),
    ("eula", "agreement", r"end user licen[cs]e agreement|this (?:software )?licen[cs]e agreement is a legal agreement between you", 0.8),
    ("eula", "eula", r"eula", 0.6),
    ("terms-of-use", "terms", r"by (?:using|accessing) this (?:site|website|service) you agree to (?:be bound by )?(?:these|the|our) terms(?: of (?:use|service))?", 0.7),
    ("personal-use", "personal", r"for (?:your )?personal (?:and )?non ?commercial use only|for personal use only", 0.75),
    ("noncommercial", "commercial noncommercial", r"(?:for )?non ?commercial (?:use|purposes) only|not for commercial use|commercial use (?:is )?(?:strictly )?(?:prohibited|forbidden|not (?:allowed|permitted))", 0.72),
    ("freeware", "freeware", r"(?:this (?:program|software) is )?freeware", 0.65),
    ("shareware", "shareware", r"(?:this (?:program|software) is )?shareware", 0.65),
    ("evaluation", "evaluation trial", r"(?:for )?evaluation (?:purposes|use) only|trial version", 0.6),
    ("patent", "patent patents", r"patents? pending|protected by (?:one or more )?(?:u s |us )?patents?", 0.6),
    # --- warranty, notices ---
    ("warranty", "warranty", r"the software is provided as is without warranty of any kind express or implied", 0.7),
    ("warranty", "warranty", r"without warranty of any kind|without any warranty|provided as is without warranty|there is no warranty for the program", 0.55),
    ("warranty", "warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose", 0.6),
    ("warranty", "warranties", r"without warranties or conditions of any kind|as is and any express or implied warranties", 0.55),
    ("liability", "liable", r"in no event shall (?:the )?(?:\S+ ){1,12}?be liable for any", 0.55),
    ("copyright", "copyright", r"copyright (?:c |© )?(?:19|20)\d\d(?: (?:19|20)\d\d)*(?: present)?", 0.4),
    ("copyright", "copyrighted", r"copyrighted (?:material|work|software|content)", 0.4),
    ("copyright", "copyright", r"copyright(?: c| notice)?", 0.2),
    ("license-notice", "licensed", r"(?:dual |multi |tri )?licensed under (?:the )?(?:terms of (?:the )?)?", 0.3),
    ("license-notice", "license licence", r"see (?:the )?(?:file )?licen[cs]e(?: md| txt)?(?: file)? for (?:details|more information|licen[cs]e (?:details|information)|terms)", 0.4),
    ("license-notice", "license licence", r"licen[cs]e information|licen[cs]e agreement", 0.3),
    ("attribution-required", "attribution", r"attribution (?:is )?required", 0.4),
)
