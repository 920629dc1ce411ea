"""License scans with ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z), reduced to words with single spaces, and put to the
rules if one of GATES occurs in it. Each rule has a keyword that must occur before
its pattern is tried. Rules and their matches carry a priority. Detections are
resolved in the order of the text: one inside another falls (of equal extents the one
of weaker priority; a tie of both falls to the later label), and of two that overlap in
part the one of stronger priority stays, the earlier one at equal priorities. What is left
doesn't overlap. One that fell doesn't come back if what it fell to falls to a later one.

The rules are data: each license has hand-written names, and FORMS turn a name into
signatures of falling confidence. TEXTS are hand-written patterns for grants,
conditions, file notices and links, which need no name.

Null and empty texts have no words and no detections. A text of any length is scanned whole,
in one row of one task. Rows are scanned by themselves, so repeated rows get equal results. An
empty table gives none. An input column named like a result column is left out of the output.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import col
from .quality_rules import let

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Any match of a signature or of BASE holds one of these.
GATES = ("licen", "spdx", "gpl", "cc by", "cc0", "bsd", "public domain", "rights reserved", "software", "hereby granted", "copyright", "redistribution and use", "library exception", "of the mpl was", "gfdl")

#: Label, keyword, and names as patterns over single-spaced words.
NAMES = [
    ("gpl-1.0", "general public", r"gnu general public licen[cs]e (?:version|v) ?1(?: 0)?"),
    ("gpl-2.0", "general public", r"gnu general public licen[cs]e (?:version|v) ?2(?: 0)?"),
    ("gpl-3.0", "general public", r"gnu general public licen[cs]e (?:version|v) ?3(?: 0)?"),
    ("gpl-2.0", "gpl", r"gnu gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"gnu gpl ?v?3(?: 0)?"),
    ("gpl-2.0", "gplv2", r"gplv2"),
    ("gpl-3.0", "gplv3", r"gplv3"),
    ("lgpl-2.0", "library general", r"gnu library general public licen[cs]e(?: (?:version|v) ?2(?: 0)?)?"),
    ("lgpl-2.1", "lesser general", r"gnu lesser general public licen[cs]e (?:version|v) ?2 1"),
    ("lgpl-3.0", "lesser general", r"gnu lesser general public licen[cs]e (?:version|v) ?3(?: 0)?"),
    ("lgpl", "lesser general", r"gnu lesser general public licen[cs]e"),
    ("lgpl-2.1", "lgpl", r"lgplv2 1"),
    ("lgpl-3.0", "lgpl", r"lgplv3"),
    ("agpl-3.0", "affero", r"gnu affero general public licen[cs]e(?: (?:version|v) ?3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"agplv3"),
    ("gfdl", "documentation", r"gnu free documentation licen[cs]e(?: (?:version|v) ?1 [123])?"),
    ("apache-1.0", "apache", r"apache (?:software )?licen[cs]e (?:version|v) ?1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version|v) ?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version|v) ?2(?: 0)?"),
    ("apache-2.0", "apache", r"apache 2 0 licen[cs]e"),
    ("cc-by-1.0", "cc by", r"cc by 1 0"),
    ("cc-by-2.0", "cc by", r"cc by 2 0"),
    ("cc-by-2.5", "cc by", r"cc by 2 5"),
    ("cc-by-3.0", "cc by", r"cc by 3 0"),
    ("cc-by-4.0", "cc by", r"cc by 4 0"),
    ("cc-by-sa-2.0", "cc by sa", r"cc by sa 2 0"),
    ("cc-by-sa-2.5", "cc by sa", r"cc by sa 2 5"),
    ("cc-by-sa-3.0", "cc by sa", r"cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa", r"cc by sa 4 0"),
    ("cc-by-nc-2.0", "cc by nc", r"cc by nc 2 0"),
    ("cc-by-nc-3.0", "cc by nc", r"cc by nc 3 0"),
    ("cc-by-nc-4.0", "cc by nc", r"cc by nc 4 0"),
    ("cc-by-nd-3.0", "cc by nd", r"cc by nd 3 0"),
    ("cc-by-nd-4.0", "cc by nd", r"cc by nd 4 0"),
    ("cc-by-nc-sa-3.0", "cc by nc sa", r"cc by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd-3.0", "cc by nc nd", r"cc by nc nd 3 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", r"cc by nc nd 4 0"),
    ("cc-by-4.0", "commons attribution", r"creative commons attribution 4 0(?: international)?(?: public)? licen[cs]e"),
    ("cc-by-3.0", "commons attribution", r"creative commons attribution 3 0(?: unported)? licen[cs]e"),
    ("cc-by-sa-4.0", "commons attribution", r"creative commons attribution share ?alike 4 0(?: international)?(?: public)? licen[cs]e"),
    ("cc-by-sa-3.0", "commons attribution", r"creative commons attribution share ?alike 3 0(?: unported)? licen[cs]e"),
    ("cc-by-nc-4.0", "commons attribution", r"creative commons attribution non ?commercial 4 0(?: international)? licen[cs]e"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("mit", "mit", r"(?:the )?mit licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("mit-0", "no attribution", r"mit no attribution licen[cs]e"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("bsd-1-clause", "bsd", r"(?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    ("0bsd", "zero clause", r"zero clause bsd licen[cs]e"),
    ("bsd", "bsd", r"bsd licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e (?:version|v) ?1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version|v) ?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: (?:version|v))? ?2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e(?: (?:version|v))? ?1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: (?:version|v))? ?2 0"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: (?:version|v) ?1 0)?"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?: (?:version|v) ?1 0)?"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?: (?:version|v) ?1 0)?"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e (?:version |v )?1 1"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e (?:version |v )?1 2"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e(?: (?:version|v))? ?1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?: (?:version|v))? ?2 0"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: (?:version|v) ?1 0)?"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?: 1 1)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", r"libpng licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("wtfpl", "want to public", r"do what the \w+ you want to public licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("psf-2.0", "python software", r"python software foundation licen[cs]e(?: (?:version|v) ?2)?"),
    ("php-3.01", "php", r"php licen[cs]e(?: (?:version|v) ?3 01)?"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("odbl-1.0", "open database", r"open database licen[cs]e(?: v?1 0)?"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and licen[cs]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: (?:version|v)? ?1 1)?"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: (?:version|v)? ?3 0)?"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: (?:version|v)? ?3 0)?"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: (?:version|v)? ?1 0)?"),
    ("gpl-1.0", "gpl", r"gnu gpl ?v?1(?: 0)?"),
    ("gpl-2.0", "gpl", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"gpl 3 0(?: only| or later)?"),
    ("gpl-2.0-classpath", "classpath exception", r"gpl(?: v?2(?: 0)?)? with (?:the )?classpath exception"),
    ("gpl-3.0-gcc", "runtime library exception", r"gcc runtime library exception"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl ?v?2(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("agpl-1.0", "affero", r"affero general public licen[cs]e (?:version |v ?)?1(?: 0)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gfdl-1.1", "gfdl", r"gfdl ?v?1 1"),
    ("gfdl-1.2", "gfdl", r"gfdl ?v?1 2"),
    ("gfdl-1.3", "gfdl", r"gfdl ?v?1 3"),
    ("apache-2.0", "asl", r"asl ?v?2(?: 0)? licen[cs]e"),
    ("cc-by-nc-1.0", "cc by nc", r"cc by nc 1 0"),
    ("cc-by-nc-2.5", "cc by nc", r"cc by nc 2 5"),
    ("cc-by-nd-2.0", "cc by nd", r"cc by nd 2 0"),
    ("cc-by-nd-2.5", "cc by nd", r"cc by nd 2 5"),
    ("cc-by-nc-sa-2.0", "cc by nc sa", r"cc by nc sa 2 0"),
    ("cc-by-nc-sa-2.5", "cc by nc sa", r"cc by nc sa 2 5"),
    ("cc-by-nc-nd-2.0", "cc by nc nd", r"cc by nc nd 2 0"),
    ("cc-by-nc-nd-2.5", "cc by nc nd", r"cc by nc nd 2 5"),
    ("cc-by-2.0", "commons attribution", r"creative commons attribution 2 0(?: generic)? licen[cs]e"),
    ("cc-by-2.5", "commons attribution", r"creative commons attribution 2 5(?: generic)? licen[cs]e"),
    ("cc-by-sa-2.0", "commons attribution", r"creative commons attribution share ?alike 2 0(?: generic)? licen[cs]e"),
    ("cc-by-nc-3.0", "commons attribution", r"creative commons attribution non ?commercial 3 0(?: unported)? licen[cs]e"),
    ("cc-by-nd-4.0", "commons attribution", r"creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)? licen[cs]e"),
    ("cc-by-nc-sa-4.0", "commons attribution", r"creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)? licen[cs]e"),
    ("cc-by-nc-sa-3.0", "commons attribution", r"creative commons attribution non ?commercial share ?alike 3 0(?: unported)? licen[cs]e"),
    ("cc-by-nc-nd-4.0", "commons attribution", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: public)? licen[cs]e"),
    ("cc-by-nc-nd-3.0", "commons attribution", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s 3 0(?: unported)? licen[cs]e"),
    ("cc0-1.0", "creative commons", r"creative commons (?:zero|cc0)(?: 1 0)?(?: universal)? licen[cs]e"),
    ("cc-pddc", "public domain dedication", r"creative commons public domain dedication(?: and certification)?"),
    ("bsd-2-clause-patent", "bsd", r"bsd 2 clause plus patent(?: licen[cs]e)?"),
    ("bsd-3-clause-clear", "bsd", r"(?:bsd 3 clause clear|clear bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause-lbnl", "bsd", r"(?:lawrence berkeley national labs? bsd|bsd 3 clause lbnl)(?: variant)?(?: licen[cs]e)?"),
    ("bsd-source-code", "bsd", r"bsd source code attribution(?: licen[cs]e)?"),
    ("mpl-2.0", "mpl", r"mpl ?v?2 0 licen[cs]e"),
    ("npl-1.0", "netscape", r"netscape public licen[cs]e(?: (?:version|v))? ?1 0"),
    ("npl-1.1", "netscape", r"netscape public licen[cs]e(?: (?:version|v))? ?1 1"),
    ("cddl-1.1", "common development", r"common development and distribution licen[cs]e (?:version |v ?)?1 1"),
    ("cpal-1.0", "common public attribution", r"common public attribution licen[cs]e(?: (?:version|v)? ?1 0)?"),
    ("ipl-1.0", "ibm public", r"ibm public licen[cs]e(?: (?:version|v)? ?1 0)?"),
    ("lpl-1.02", "lucent", r"lucent public licen[cs]e(?: (?:version|v)? ?1 02)?"),
    ("qpl-1.0", "q public", r"q public licen[cs]e(?: (?:version|v)? ?1 0)?"),
    ("apsl-2.0", "apple public", r"apple public source licen[cs]e(?: (?:version|v)? ?2 0)?"),
    ("sissl", "industry standards", r"sun industry standards source licen[cs]e(?: 1 [12])?"),
    ("spl-1.0", "sun public", r"sun public licen[cs]e(?: (?:version|v)? ?1 0)?"),
    ("rpl-1.5", "reciprocal public", r"reciprocal public licen[cs]e(?: (?:version|v)? ?1 5)?"),
    ("osl-2.1", "open software", r"open software licen[cs]e (?:version |v ?)?2 1"),
    ("afl-2.1", "academic free", r"academic free licen[cs]e (?:version |v ?)?2 1"),
    ("ecl-2.0", "educational community", r"educational community licen[cs]e(?: (?:version|v)? ?2 0)?"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)? licen[cs]e(?: agreement)?(?: (?:version|v)? ?2 1)?"),
    ("cecill-b", "cecill", r"cecill b(?: free software)? licen[cs]e(?: agreement)?"),
    ("cecill-c", "cecill", r"cecill c(?: free software)? licen[cs]e(?: agreement)?"),
    ("mulanpsl-2.0", "mulan", r"mulan permissive software licen[cs]e(?: ?v?2)?"),
    ("lppl-1.3c", "latex project", r"latex project public licen[cs]e(?: (?:version|v)? ?1 3c?)?"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?: (?:version|v)? ?2 1)?"),
    ("w3c", "w3c", r"w3c software(?: and document)?(?: notice and)? licen[cs]e"),
    ("unicode-3.0", "unicode", r"unicode licen[cs]e(?: agreement)?(?: v ?3)?"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("tcl", "tcl", r"tcl(?: tk)? licen[cs]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("nasa-1.3", "nasa", r"nasa open source agreement licen[cs]e(?: 1 3)?"),
    ("intel", "intel", r"intel open source licen[cs]e"),
    ("naist-2003", "nara institute", r"nara institute(?: of science and technology)? licen[cs]e"),
    ("ipa", "ipa font", r"ipa font licen[cs]e"),
    ("bitstream-vera", "bitstream", r"bitstream vera font licen[cs]e"),
    ("freetype", "freetype", r"freetype(?: project)? licen[cs]e"),
    ("ijg", "jpeg group", r"independent jpeg group licen[cs]e"),
    ("beerware", "beer", r"beer ?ware licen[cs]e"),
    ("json", "json", r"json licen[cs]e"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer licen[cs]e"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e(?: v?1 0)?"),
    ("cdla-permissive-2.0", "community data", r"community data licen[cs]e agreement permissive(?: (?:version|v)? ?2 0)?"),
    ("cdla-sharing-1.0", "community data", r"community data licen[cs]e agreement sharing(?: (?:version|v)? ?1 0)?"),
    ("ogl-uk-3.0", "open government", r"open government licen[cs]e(?: v?3 0)?"),
    ("etalab-2.0", "etalab", r"(?:licence ouverte|open licen[cs]e) etalab(?: 2 0)?"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e(?: (?:version|v)? ?1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: (?:version|v)? ?2(?: 0)?)?"),
    ("polyform-noncommercial", "polyform", r"polyform non ?commercial licen[cs]e(?: 1 0 0)?"),
    ("openrail", "rail", r"(?:creativeml )?open rail(?: m)? licen[cs]e"),
    ("bigscience-rail-1.0", "rail", r"bigscience rail licen[cs]e(?: v?1 0)?"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in)?to the public domain"),
    ("all-rights-reserved", "rights reserved", r"all rights reserved"),
]

#: Label, keyword and pattern of texts by which a license is told without its name.
_COPIES = r"(?:this|the) software and associated documentation files(?: the software)?"
_FREE = r"you can redistribute it and or modify it under the terms of the gnu"
_BY_FSF = r"general public licen[cs]e as published by the free software foundation either version"
TEXTS = [
    ("mit", "hereby granted", rf"permission is hereby granted free of charge to any person obtaining a copy of {_COPIES}(?: to deal in the software without restriction)?"),
    ("mit", "copyright", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("x11", "software", r"except as contained in this notice the names? of (?:[^ ]+ ){1,12}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("ncsa", "hereby granted", rf"permission is hereby granted free of charge to any person obtaining a copy of {_COPIES} to deal with the software without restriction"),
    ("bsl-1.0", "hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("ofl-1.1", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("0bsd", "hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "hereby granted", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("postgresql", "hereby granted", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "copyright", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "copyright", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "software", r"neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software(?: without specific prior written permission)?"),
    ("bsd-4-clause", "software", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "licen", r"you may not use this file except in compliance with the licen[cs]e you may obtain a copy of the licen[cs]e at"),
    ("apache-2.0", "software", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache-2.0", "copyright", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("apache-1.1", "software", r"this product includes software developed by the apache software foundation"),
    ("gpl-2.0", "software", rf"this program is free software {_FREE} {_BY_FSF} 2 of the licen[cs]e"),
    ("gpl-3.0", "software", rf"this program is free software {_FREE} {_BY_FSF} 3 of the licen[cs]e"),
    ("gpl-2.0", "software", r"by contrast the gnu general public licen[cs]e is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"),
    ("gpl-3.0", "software", r"the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ("lgpl-2.0", "software", rf"this library is free software {_FREE} library {_BY_FSF} 2 of the licen[cs]e"),
    ("lgpl-2.1", "software", rf"this library is free software {_FREE} lesser {_BY_FSF} 2 1 of the licen[cs]e"),
    ("lgpl-3.0", "software", rf"this (?:library|program) is free software {_FREE} lesser {_BY_FSF} 3 of the licen[cs]e"),
    ("agpl-3.0", "software", rf"this program is free software {_FREE} affero {_BY_FSF} 3 of the licen[cs]e"),
    ("agpl-3.0", "software", r"the gnu affero general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl-2.0", "licen", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-1.1", "licen", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("epl-1.0", "licen", r"made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?1 0"),
    ("epl-2.0", "licen", r"made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?2 0"),
    ("zlib", "software", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "software", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", "copyright", r"to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright and related or neighbou?ring rights"),
    ("bsd-2-clause", "software", r"this software is provided by the (?:copyright holders|regents|authors?) and contributors as is and any express or implied warranties"),
    ("mit", "software", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mpl-2.0", "of the mpl was", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cddl-1.0", "licen", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("apache-2.0", "licen", r"licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("gpl-2.0", "licen", r"you should have received a copy of the gnu general public licen[cs]e along with this program if not write to the free software foundation"),
    ("gpl-3.0", "licen", r"you should have received a copy of the gnu general public licen[cs]e along with this program if not see"),
    ("lgpl", "licen", r"you should have received a copy of the gnu lesser general public licen[cs]e along with this (?:library|program)"),
    ("agpl-3.0", "licen", r"you should have received a copy of the gnu affero general public licen[cs]e along with this program"),
    ("cc-by-4.0", "licen", r"this work is licen[cs]ed under a creative commons attribution 4 0 international licen[cs]e"),
    ("public-domain", "public domain", r"this (?:file|work|software) (?:is|has been placed) in the public domain"),
    ("proprietary", "licen", r"this software (?:contains|includes) confidential and proprietary information (?:[^ ]+ ){1,12}licen[cs]e"),
    ("mit", "opensource org", r"opensource org licen[cs]es? mit"),
    ("apache-2.0", "apache org", r"apache org licen[cs]es licen[cs]e 2 0"),
    ("gpl-2.0", "gnu org", r"gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0"),
    ("gpl-3.0", "gnu org", r"gnu org licen[cs]es gpl 3 0"),
    ("cc-by-4.0", "creativecommons", r"creativecommons org licen[cs]es by 4 0"),
    ("cc-by-sa-4.0", "creativecommons", r"creativecommons org licen[cs]es by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons", r"creativecommons org licen[cs]es by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons", r"creativecommons org licen[cs]es by nc 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons", r"creativecommons org licen[cs]es by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons", r"creativecommons org licen[cs]es by nc nd 4 0"),
]

#: How a name is put, its priority (less is stronger) and its confidence. An SPDX tag names the label.
FORMS = [
    ("spdx license identifier {label}", 1, 1.0),
    ("(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}", 2, 0.95),
    ("{name}", 3, 0.8),
]

_RULE = "array<struct<label:string,keyword:string,pattern:string,priority:int,confidence:double>>"


def signatures() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, confidence) of every rule, in order."""
    out, seen = [], set()
    for form, priority, confidence in FORMS:
        for label, keyword, name in NAMES:
            words = re.sub(r"[^0-9a-z]+", " ", label)
            if "{label}" in form:
                if label in seen:
                    continue
                seen.add(label)
                keyword = "spdx"
            pattern = form.replace("{label}", words).replace("{name}", f"(?:{name})")
            out.append((label, keyword, f"(?<= ){pattern}(?= )", priority, confidence))
    out += [(label, keyword, f"(?<= ){pattern}(?= )", 2, 0.95) for label, keyword, pattern in TEXTS]
    return out


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


#: Signs around a match. BREAK makes spaces of them in a text, so they are nowhere else.
OPEN, CLOSE = "\x01", "\x02"


def _detections(norm: Column, rules: Column) -> Column:
    """Array of (start, minus end, priority, label, confidence) of all matches of all rules, in words.

    A pattern begins and ends at spaces, so a match is marked by signs at its first and last word, and its place
    is the number of that word: one walk over the words, however many matches there are.
    """

    def one(rule: Column) -> Column:
        words = F.split(F.regexp_replace(norm, rule["pattern"], F.lit(f"{OPEN}$0{CLOSE}")), " ", -1)

        def places(w: Column) -> Column:
            first = F.filter(F.transform(w, lambda x, i: F.when(F.startswith(x, F.lit(OPEN)), i)), lambda i: i.isNotNull())
            last = F.filter(F.transform(w, lambda x, i: F.when(F.endswith(x, F.lit(CLOSE)), -(i + 1))), lambda i: i.isNotNull())
            return F.zip_with(first, last, lambda a, b: F.struct(
                a.alias("a"), b.alias("b"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["confidence"].alias("confidence"),
            ))

        return let(words, places)

    active = F.filter(rules, lambda r: F.contains(norm, r["keyword"]) & F.regexp_like(norm, r["pattern"]))
    return F.flatten(F.transform(active, one))


def _resolve(found: Column) -> Column:
    """(labels, confidence) of what is left of the detections: one pass over them in the order of the text."""
    fields = ("a", "b", "priority", "label", "confidence")

    def state(x, end: Column, labels: Column, confidence: Column) -> Column:
        held = {"a": x["a"], "b": end, "priority": x["priority"], "label": x["label"], "confidence": x["confidence"]}
        return F.struct(*(held[f].alias(f) for f in fields), labels.alias("labels"), confidence.alias("best"))

    def closed(acc: Column) -> tuple[Column, Column]:
        """Labels and best confidence with those of the detection held."""
        new = (acc["b"] > 0) & ~F.array_contains(acc["labels"], acc["label"])
        return F.when(new, F.array_append(acc["labels"], acc["label"])).otherwise(acc["labels"]), F.greatest(acc["best"], acc["confidence"])

    def step(acc: Column, x: Column) -> Column:
        end = -x["b"]
        stronger = state(x, end, acc["labels"], acc["best"])
        after = state(x, end, *closed(acc))
        return (
            F.when(end <= acc["b"], acc).when((x["a"] < acc["b"]) & (x["priority"] >= acc["priority"]), acc)
            .when(x["a"] < acc["b"], stronger).otherwise(after)
        )

    nothing = F.struct(
        F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("priority"), F.lit("").alias("label"), F.lit(0.0).alias("confidence"),
        F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"),
    )

    def out(acc: Column) -> Column:
        labels, best = closed(acc)
        return F.struct(labels.alias("labels"), best.alias("confidence"))

    return F.aggregate(F.sort_array(found), nothing, step, out)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` with n_words, n_base, first_word, last_word, base_labels (array), labels (array) and score."""
    # lower() also changes letters beyond A-Z, but those stay word characters, and none of them
    # becomes a letter of a phrase but the Kelvin sign (k), which no phrase holds.
    t = F.lower(F.coalesce(col(text).cast("string"), F.lit("")))
    padded = F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), BREAK, " ")
    rules = F.array(*(F.struct(*map(F.lit, r)) for r in signatures())).cast(_RULE)

    def phrases(norm: Column) -> list[Column]:
        out = []
        for phrase, label in BASE.items():
            n = phrase.count(" ") + 1
            parts = F.split(norm, f"(?<= ){phrase}(?= )", -1)
            hit = F.struct(
                F.lit(label).alias("label"), (F.size(parts) - 1).cast("long").alias("n"),
                (spaces(F.get(parts, F.lit(0))) - 1).cast("long").alias("first"),
                (spaces(norm) - 1 - (spaces(F.element_at(parts, -1)) - 1) - n).cast("long").alias("last"),
            )
            out.append(F.when(F.contains(norm, F.lit(f" {phrase} ")), hit))
        return out

    def base(norm: Column) -> Column:
        return F.filter(F.array(*phrases(norm)), lambda x: x.isNotNull())

    def result(norm: Column) -> Column:
        gate = F.lit(False)
        for g in GATES:
            gate = gate | F.contains(norm, F.lit(g))
        empty = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("confidence"))
        found = F.when(gate, _resolve(_detections(norm, rules))).otherwise(empty)
        hits = F.when(gate, base(norm)).otherwise(F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>"))
        return F.struct((spaces(norm) - 1).cast("long").alias("n_words"), hits.alias("hits"), found.alias("found"))

    names = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    kept = [n for n in keep if n.lower() not in names]
    rows = docs.select(*map(col, kept), let(padded, result).alias("_r"))
    labels = F.array_sort(F.transform("_r.hits", lambda x: x["label"]))
    return rows.select(
        *map(col, kept), F.col("_r.n_words").alias("n_words"),
        F.aggregate("_r.hits", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
        F.array_min(F.transform("_r.hits", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("_r.hits", lambda x: x["last"])).alias("last_word"),
        labels.alias("base_labels"),
        F.array_sort(F.array_union(labels, F.col("_r.found.labels"))).alias("labels"),
        F.greatest(F.col("_r.found.confidence"), F.when(F.size("_r.hits") > 0, 0.8).otherwise(0.0)).alias("score"),
    )
