"""License scans by ordered signature rules, with DataFrame functions only.

A text is brought to lower-case words with one blank before and after each. Rules are the hand-written sentences of
licence texts and notices, each with its own expression, and hand-written names of licences in a few hand-written
contexts. A rule is a regular expression over such words with a keyword, a label and a priority; rules are tried only where their keyword occurs, and the keywords only
where the text has one of a few anchors. Of two detections the one inside the other is dropped; on equal places the
better (smaller) priority stays, then the earlier rule.

Defined cases: a null text counts as empty; texts without words have n_words 0, null places and no labels; a rule's
places don't overlap each other, and all places of the base phrases are counted; repeated rows are treated alike;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_V = r"(?: version)?(?: v ?| )"  # and the number: " 2", " version 2", " v2", " v 2"
_LATER = r"(?: or(?: any)? later(?: version)?| or \(at your option\))?"
#: Label, keyword, priority, expression of the licence's name in normalised words.
FAMILIES = (
    ("agpl-3.0", "affero", 10, rf"(?:gnu )?affero general public licen[sc]e{_V}3(?: 0)?{_LATER}"),
    ("agpl-1.0", "affero", 10, rf"affero general public licen[sc]e{_V}1(?: 0)?"),
    ("agpl", "affero", 30, r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl-3.0", "agpl", 12, rf"(?:gnu )?agpl(?: ?v3(?: 0)?|{_V}3(?: 0)?)(?: only| or later)?"),
    ("agpl", "agpl", 32, r"(?:gnu )?agpl"),
    ("lgpl-3.0", "lesser", 10, rf"(?:gnu )?lesser general public licen[sc]e{_V}3(?: 0)?{_LATER}"),
    ("lgpl-2.1", "lesser", 10, rf"(?:gnu )?lesser general public licen[sc]e{_V}2 1{_LATER}"),
    ("lgpl", "lesser", 30, r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl-2.0", "library general", 10, rf"(?:gnu )?library general public licen[sc]e(?:{_V}2(?: 0)?)?"),
    ("lgpl-3.0", "lgpl", 12, rf"(?:gnu )?lgpl(?: ?v3(?: 0)?|{_V}3(?: 0)?)(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", 12, rf"(?:gnu )?lgpl(?: ?v2 1|{_V}2 1)(?: only| or later)?"),
    ("lgpl", "lgpl", 32, r"(?:gnu )?lgpl"),
    ("gpl-3.0", "general public", 14, rf"(?:gnu )?general public licen[sc]e{_V}3(?: 0)?{_LATER}"),
    ("gpl-2.0", "general public", 14, rf"(?:gnu )?general public licen[sc]e{_V}2(?: 0)?{_LATER}"),
    ("gpl-1.0", "general public", 14, rf"(?:gnu )?general public licen[sc]e{_V}1(?: 0)?{_LATER}"),
    ("gpl", "general public", 34, r"(?:gnu )?general public licen[sc]e"),
    ("gpl-3.0", "gpl", 16, rf"(?:gnu )?gpl(?: ?v3(?: 0)?|{_V}3(?: 0)?)(?: only| or later)?"),
    ("gpl-2.0", "gpl", 16, rf"(?:gnu )?gpl(?: ?v2(?: 0)?|{_V}2(?: 0)?)(?: only| or later)?"),
    ("gfdl-1.3", "free documentation", 12, rf"(?:gnu )?free documentation licen[sc]e{_V}1 3"),
    ("gfdl-1.2", "free documentation", 12, rf"(?:gnu )?free documentation licen[sc]e{_V}1 2"),
    ("gfdl", "free documentation", 30, r"(?:gnu )?free documentation licen[sc]e"),
    ("apache-2", "apache", 10, rf"apache(?: software)? licen[sc]e{_V}2(?: 0)?"),
    ("apache-1.1", "apache", 10, rf"apache(?: software)? licen[sc]e{_V}1 1"),
    ("apache", "apache", 30, r"apache(?: software)? licen[sc]e"),
    ("mit", "mit", 20, r"mit(?: x11)? licen[sc]e"),
    ("mit", "expat", 20, r"expat licen[sc]e"),
    ("x11", "x11", 20, r"x11 licen[sc]e"),
    ("bsd-3-clause", "bsd", 10, r"(?:new bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd|modified bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", 10, r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", 10, r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?"),
    ("0bsd", "bsd", 10, r"(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?"),
    ("bsd", "bsd", 30, r"bsd(?: style)? licen[sc]e"),
    ("mpl-2.0", "mozilla public", 10, rf"mozilla public licen[sc]e{_V}2(?: 0)?"),
    ("mpl-1.1", "mozilla public", 10, rf"mozilla public licen[sc]e{_V}1 1"),
    ("mpl", "mozilla public", 30, r"mozilla public licen[sc]e"),
    ("mpl-2.0", "mpl", 14, rf"mpl(?: ?v2(?: 0)?|{_V}2(?: 0)?)"),
    ("epl-2.0", "eclipse public", 10, rf"eclipse public licen[sc]e{_V}2(?: 0)?"),
    ("epl-1.0", "eclipse public", 10, rf"eclipse public licen[sc]e{_V}1(?: 0)?"),
    ("epl", "eclipse public", 30, r"eclipse public licen[sc]e"),
    ("cddl-1.0", "common development", 12, rf"common development and distribution licen[sc]e(?:{_V}1(?: 0)?)?"),
    ("eupl-1.2", "european union public", 12, rf"european union public licen[sc]e(?:{_V}1 2)?"),
    ("isc", "isc", 22, r"isc licen[sc]e"),
    ("zlib", "zlib", 22, r"zlib(?: libpng)? licen[sc]e"),
    ("bsl-1.0", "boost", 12, rf"boost software licen[sc]e(?:{_V}1(?: 0)?)?"),
    ("artistic-2.0", "artistic", 12, rf"artistic licen[sc]e{_V}2(?: 0)?"),
    ("artistic", "artistic", 30, r"artistic licen[sc]e"),
    ("python-2.0", "python software", 12, rf"python software foundation licen[sc]e(?:{_V}2(?: 0)?)?"),
    ("wtfpl", "wtfpl", 20, r"wtfpl"),
    ("unlicense", "unlicense", 20, r"(?:the )?unlicense"),
    ("ms-pl", "microsoft public", 12, r"microsoft public licen[sc]e"),
    ("ofl-1.1", "open font", 12, rf"(?:sil )?open font licen[sc]e(?:{_V}1 1)?"),
    ("odbl-1.0", "open database", 12, rf"open database licen[sc]e(?:{_V}1(?: 0)?)?"),
    ("odc-by-1.0", "open data commons", 12, r"open data commons attribution licen[sc]e"),
    ("openrail", "openrail", 12, r"(?:bigscience |creativeml )?openrail(?: m)?(?: licen[sc]e)?"),
    ("llama", "llama", 22, r"llama(?: \d)* community licen[sc]e"),
    ("cc0-1.0", "cc0", 12, r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-sa", "cc by nc sa", 8, r"cc by nc sa(?: \d 0)?"),
    ("cc-by-nc-nd", "cc by nc nd", 8, r"cc by nc nd(?: \d 0)?"),
    ("cc-by-nc", "cc by nc", 10, r"cc by nc(?: \d 0)?"),
    ("cc-by-sa", "cc by sa", 10, r"cc by sa(?: \d 0)?"),
    ("cc-by-nd", "cc by nd", 10, r"cc by nd(?: \d 0)?"),
    ("cc-by", "cc by", 20, r"cc by(?: \d 0)?"),
    ("cc-by-nc-sa", "creative commons", 8, r"creative commons attribution non ?commercial share ?alike(?: \d 0)?"),
    ("cc-by-nc-nd", "creative commons", 8, r"creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: \d 0)?"),
    ("cc-by-nc", "creative commons", 10, r"creative commons attribution non ?commercial(?: \d 0)?"),
    ("cc-by-sa", "creative commons", 10, r"creative commons attribution share ?alike(?: \d 0)?"),
    ("cc-by", "creative commons", 20, r"creative commons attribution(?: \d 0)?"),
    ("creative-commons", "creative commons", 40, r"creative commons licen[sc]e"),
    ("public-domain", "public domain", 24, r"(?:dedicated to|placed in|released into|in) the public domain"),
    ("proprietary", "all rights reserved", 44, r"all rights reserved"),
    ("proprietary", "proprietary", 44, r"proprietary(?: and confidential| licen[sc]e| software)"),
)
#: Sentences by which a licence's text or notice is known, whatever it is called: label, keyword, priority, expression, confidence.
NOTICES = (
    ("mit", "hereby granted", 2, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.97),
    ("mit", "deal in the software", 6, r"deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies", 0.95),
    ("mit", "substantial portions", 8, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.9),
    ("x11", "advertising or otherwise", 6, r"the name of [a-z0-9 ]{1,60} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", 0.93),
    ("mit-0", "mit", 4, r"mit no attribution|mit 0 licen[sc]e", 0.92),
    ("bsl-1.0", "hereby granted", 2, r"permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this licen[sc]e", 0.97),
    ("unicode", "data files", 4, r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 0.97),
    ("isc", "fee is hereby", 4, r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that", 0.96),
    ("0bsd", "fee is hereby", 6, r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)", 0.93),
    ("ntp", "fee is hereby", 5, r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 0.93),
    ("hpnd", "without fee", 7, r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 0.93),
    ("postgresql", "without a written agreement", 4, r"without fee and without a written agreement is hereby granted", 0.95),
    ("bsd", "source and binary forms", 12, r"redistribution and use in source and binary forms with or without modification are permitted provided that", 0.9),
    ("bsd-3-clause", "endorse or promote", 6, r"neither the names? of [a-z0-9 ]{1,80} may be used to endorse or promote products derived from this software without specific prior written permission", 0.93),
    ("bsd-3-clause", "endorse or promote", 8, r"the name of the author may not be used to endorse or promote products derived from this software", 0.88),
    ("bsd-4-clause", "advertising materials", 4, r"all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment", 0.96),
    ("bsd-3-clause-clear", "patent", 4, r"no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e", 0.93),
    ("apache-2", "you may not use this file", 2, r"licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e", 0.99),
    ("apache-2", "you may not use this file", 6, r"you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at (?:http|https) www apache org", 0.97),
    ("apache-2", "apache org", 8, r"www apache org licen[sc]es licen[sc]e 2 0", 0.95),
    ("apache-1.1", "apache software foundation", 6, r"this product includes software developed by the apache software foundation", 0.9),
    ("gpl", "free software", 14, r"this (?:program|library|file|software|package) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 0.9),
    ("gpl-2.0", "free software foundation", 6, r"gnu general public licen[sc]e as published by the free software foundation (?:either )?version 2 of the licen[sc]e(?: or at your option any later version)?", 0.97),
    ("gpl-3.0", "free software foundation", 6, r"gnu general public licen[sc]e as published by the free software foundation (?:either )?version 3 of the licen[sc]e(?: or at your option any later version)?", 0.97),
    ("lgpl-2.1", "free software foundation", 6, r"gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 2 1 of the licen[sc]e(?: or at your option any later version)?", 0.97),
    ("lgpl-3.0", "free software foundation", 6, r"gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 3 of the licen[sc]e(?: or at your option any later version)?", 0.97),
    ("lgpl-2.0", "free software foundation", 6, r"gnu library general public licen[sc]e as published by the free software foundation (?:either )?version 2 of the licen[sc]e(?: or at your option any later version)?", 0.97),
    ("agpl-3.0", "free software foundation", 5, r"gnu affero general public licen[sc]e as published by the free software foundation (?:either )?version 3 of the licen[sc]e(?: or at your option any later version)?", 0.97),
    ("gpl", "gnu org", 16, r"www gnu org (?:licen[sc]es|copyleft)(?: gpl(?: html)?)?", 0.8),
    ("lgpl-2.1", "gnu org", 8, r"www gnu org licen[sc]es (?:old licen[sc]es )?lgpl 2 1", 0.93),
    ("gpl-3.0", "gnu org", 8, r"www gnu org licen[sc]es gpl 3 0", 0.93),
    ("classpath-exception", "combined work", 4, r"linking this library statically or dynamically with other modules is making a combined work based on this library", 0.95),
    ("gcc-exception", "runtime library", 6, r"gcc runtime library exception", 0.95),
    ("gfdl", "front cover texts", 6, r"with no invariant sections no front cover texts and no back cover texts", 0.95),
    ("mpl-2.0", "source code form", 2, r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 0.99),
    ("mpl-1.1", "mozilla public", 6, r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 0.98),
    ("mpl-1.0", "the contents of this file", 6, r"the contents of this file are subject to the mozilla public licen[sc]e version 1 0", 0.98),
    ("mpl-2.0", "mozilla org", 8, r"mozilla org mpl 2 0", 0.95),
    ("npl-1.1", "netscape public", 6, r"netscape public licen[sc]e(?: version 1 1)?", 0.93),
    ("epl-2.0", "eclipse org", 6, r"www eclipse org legal epl (?:2 0|v20)", 0.96),
    ("epl-1.0", "eclipse org", 6, r"www eclipse org legal epl v10", 0.96),
    ("edl-1.0", "eclipse distribution", 6, r"eclipse distribution licen[sc]e(?: v 1 0| version 1 0)?", 0.93),
    ("cpl-1.0", "common public", 8, r"common public licen[sc]e(?: version 1 0| v1 0)?", 0.92),
    ("ipl-1.0", "ibm public", 8, r"ibm public licen[sc]e(?: version 1 0)?", 0.92),
    ("cddl-1.0", "common development", 4, r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 0.97),
    ("cddl-1.1", "cddl", 8, r"cddl(?: version| v)? 1 1", 0.93),
    ("cddl-1.0", "cddl", 10, r"cddl(?: version| v)? 1 0", 0.93),
    ("osl-3.0", "open software", 8, r"open software licen[sc]e(?: version| v)? 3 0", 0.95),
    ("afl-3.0", "academic free", 8, r"academic free licen[sc]e(?: version| v)? 3 0", 0.95),
    ("afl-2.1", "academic free", 8, r"academic free licen[sc]e(?: version| v)? 2 1", 0.95),
    ("ecl-2.0", "educational community", 8, r"educational community licen[sc]e(?: version| v)? 2 0", 0.95),
    ("upl-1.0", "universal permissive", 8, r"universal permissive licen[sc]e(?: version| v)?(?: 1 0)?", 0.95),
    ("ncsa", "ncsa", 8, r"(?:university of illinois )?ncsa open source licen[sc]e", 0.95),
    ("zlib", "altered source versions", 4, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.97),
    ("libpng-2.0", "png reference library", 6, r"png reference library licen[sc]e(?: version 2)?", 0.95),
    ("curl", "curl", 10, r"(?:the )?curl licen[sc]e", 0.92),
    ("openssl", "openssl", 6, r"this product includes software developed by the openssl project", 0.96),
    ("openssl", "openssl", 10, r"(?:dual )?openssl (?:and )?ssleay licen[sc]es?|openssl licen[sc]e", 0.93),
    ("ijg", "independent jpeg group", 6, r"this software is based in part on the work of the independent jpeg group", 0.96),
    ("freetype", "freetype", 8, r"(?:the )?freetype (?:project )?licen[sc]e", 0.94),
    ("artistic-1.0", "artistic", 10, r"artistic licen[sc]e 1 0", 0.94),
    ("perl", "perl itself", 6, r"(?:this (?:library|module|program) is free software you can redistribute it and or modify it )?under the same terms as perl itself", 0.94),
    ("ruby", "ruby", 12, r"(?:under the )?ruby(?: s)? licen[sc]e", 0.9),
    ("php-3.01", "php", 8, r"php licen[sc]e(?: version| v)? 3 01", 0.96),
    ("php", "php", 20, r"php licen[sc]e", 0.88),
    ("python-2.0", "psf", 8, r"psf licen[sc]e(?: agreement)?(?: version 2)?", 0.93),
    ("zpl-2.1", "zope public", 8, r"zope public licen[sc]e(?: zpl)?(?: version| v)? 2 1", 0.95),
    ("w3c", "w3c", 8, r"w3c(?: r)? software (?:notice and )?licen[sc]e", 0.94),
    ("lppl-1.3c", "latex project public", 8, r"latex project public licen[sc]e(?: version 1 3c?)?", 0.95),
    ("wtfpl", "what the fuck", 4, r"do what the fuck you want to(?: public licen[sc]e)?", 0.97),
    ("unlicense", "unencumbered software", 2, r"this is free and unencumbered software released into the public domain", 0.99),
    ("unlicense", "unlicense org", 6, r"unlicense org", 0.93),
    ("cc0-1.0", "creativecommons org", 4, r"creativecommons org publicdomain zero 1 0", 0.98),
    ("cc-by-nc-sa", "creativecommons org", 2, r"creativecommons org licen[sc]es by nc sa \d \d", 0.98),
    ("cc-by-nc-nd", "creativecommons org", 2, r"creativecommons org licen[sc]es by nc nd \d \d", 0.98),
    ("cc-by-nc", "creativecommons org", 4, r"creativecommons org licen[sc]es by nc \d \d", 0.98),
    ("cc-by-sa", "creativecommons org", 4, r"creativecommons org licen[sc]es by sa \d \d", 0.98),
    ("cc-by-nd", "creativecommons org", 4, r"creativecommons org licen[sc]es by nd \d \d", 0.98),
    ("cc-by", "creativecommons org", 6, r"creativecommons org licen[sc]es by \d \d", 0.98),
    ("cc0-1.0", "waived all copyright", 4, r"waived all copyright and related or neighbou?ring rights to this work", 0.96),
    ("ofl-1.1", "reserved font name", 4, r"with reserved font name", 0.95),
    ("ofl-1.1", "scripts sil org", 6, r"scripts sil org ofl", 0.95),
    ("odbl-1.0", "open data commons", 8, r"open data commons open database licen[sc]e", 0.96),
    ("odbl-1.0", "opendatacommons", 8, r"opendatacommons org licen[sc]es odbl", 0.96),
    ("pddl-1.0", "public domain dedication", 8, r"public domain dedication and licen[sc]e", 0.95),
    ("pddl-1.0", "opendatacommons", 8, r"opendatacommons org licen[sc]es pddl", 0.95),
    ("cdla-permissive-2.0", "community data", 8, r"community data licen[sc]e agreement permissive(?: version)?(?: 2 0)?", 0.95),
    ("ms-pl", "ms pl", 14, r"ms pl", 0.88),
    ("ms-rl", "microsoft reciprocal", 8, r"microsoft reciprocal licen[sc]e", 0.95),
    ("sspl-1.0", "server side public", 6, r"server side public licen[sc]e(?: version 1)?", 0.96),
    ("elastic-2.0", "elastic", 8, r"elastic licen[sc]e(?: version)?(?: 2 0)?", 0.95),
    ("busl-1.1", "business source", 6, r"business source licen[sc]e(?: version)?(?: 1 1)?", 0.96),
    ("commons-clause", "commons clause", 6, r"commons clause(?: licen[sc]e condition v1 0)?", 0.94),
    ("gemma", "gemma", 14, r"gemma terms of use", 0.94),
    ("responsible-ai", "responsible ai", 10, r"responsible ai (?:source code )?licen[sc]es?", 0.92),
    ("jrl", "research purposes only", 14, r"for (?:internal )?(?:non commercial |academic )?research purposes only", 0.85),
    ("non-commercial", "non commercial use", 20, r"for (?:personal and )?non commercial use only", 0.85),
    ("all-permissive", "in any medium", 8, r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 0.95),
    ("beerware", "beer ware", 4, r"the beer ware licen[sc]e", 0.96),
    ("json", "good not evil", 4, r"the software shall be used for good not evil", 0.97),
    ("proprietary", "proprietary", 30, r"confidential and proprietary (?:information|trade secrets?) of", 0.85),
    ("proprietary", "written consent", 40, r"may not be reproduced (?:or distributed )?without (?:the )?(?:prior |express )*written consent", 0.8),
)
#: How a text says that a name is its licence; the name stands at {}. The number is added to the priority, the last is the confidence.
CONTEXTS = (
    (r"(?:licen[sc]ed|released|distributed|published|made available|available|provided) (?:to you )?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}(?: licen[sc]e)?", -4, 0.98),
    (r"spdx licen[sc]e identifier {}", -6, 1.0),
    (r"(?:under|subject to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}(?: licen[sc]e)?", -2, 0.95),
    (r"licen[sc]e (?:is )?(?:the )?{}", 0, 0.9),
    (r"{}", 4, 0.8),
)
#: A text without any of these has no detection: each rule above has one of them in it, in its keyword or its name.
ANCHORS = (
    "licen", "gpl", "bsd", "mpl", "wtfpl", "openrail", "cc0", "cc by", "creative commons", "creativecommons", "public domain", "publicdomain", "all rights reserved", "proprietary",
    "hereby", "permission", "copyright notice", "redistribut", "free software", "this software", "original software", "distribution", "mit no attribution", "www ", "mozilla org", "combined work",
    "runtime library", "cover texts", "cddl", "perl itself", "what the fuck", "waived all", "reserved font name", "scripts sil", "ms pl", "commons clause", "gemma", "purposes only", "use only", "software developed", "good not evil", "written consent",
)


def rules() -> list[tuple]:
    """(number, keyword, label, priority, confidence, expression): the notices, then every family in every context, in order."""
    made: list[tuple] = []
    for label, keyword, priority, text, confidence in NOTICES:
        made.append((len(made), keyword, label, priority, confidence, f" (?:{text})(?= )"))
    for label, keyword, priority, name in FAMILIES:
        for context, shift, confidence in CONTEXTS:
            made.append((len(made), keyword, label, priority + shift, confidence, f" {context.replace('{}', f'(?:{name})')}(?= )"))
    return made


def words(text: str | Column = "text") -> Column:
    """The text's lower-case words, each with one blank before it and one blank at the end; a single blank if there are none."""
    raw = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # lower() changes other letters too, but makes no ASCII letter of a base phrase and no separator of a word character
    return F.regexp_replace(F.lower(F.concat(F.lit(" "), raw, F.lit(" "))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _once(x: Column) -> Column:
    """The same value by way of a generator, over which the optimizer doesn't copy a costly expression into each of its uses."""
    return F.explode(F.array(x))


def _blanks(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


HIT, BLOCK = "struct<start:int,neg:int,priority:int,rule:int,label:string,confidence:double>", 256


def _scan(items: str, state: str, step: str, made: str) -> str:
    """SQL of the array of all that `made`, an array of hits, gives for the items p in order, while the state y.s goes on by
    `step`. Items come in blocks, so that a long result isn't copied for each of them. items: a name, as it occurs often."""
    blocks = f"transform(sequence(0, cast(greatest(0, size({items}) - 1) div {BLOCK} as int)), k -> slice({items}, k * {BLOCK} + 1, {BLOCK}))"
    one = f"aggregate(c, struct(a.s as s, cast(array() as array<{HIT}>) as out), (y, p) -> struct({step} as s, concat(y.out, {made}) as out))"
    return f"aggregate({blocks}, struct({state} as s, cast(array() as array<array<{HIT}>>) as out), (a, c) -> transform(array({one}), i -> struct(i.s as s, concat(a.out, array(i.out)) as out))[0], a -> flatten(a.out))"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections of every row.

    detections: array of (start, end) in words, label, rule number and confidence, after suppression."""
    norm = F.col("_norm")
    df = docs.select("doc_id", _once(words()).alias("_norm"))
    df = df.withColumn("n_words", _blanks(norm) - 1)
    places = []
    for i, (phrase, _) in enumerate(BASE):
        size = phrase.count(" ") + 1
        df = df.withColumn(f"_p{i}", F.when(F.contains(norm, F.lit(f"{phrase} ")), F.split(norm, f" {phrase}(?= )", -1)))
        parts = F.col(f"_p{i}")
        places.append((F.coalesce(F.size(parts) - 1, F.lit(0)), F.when(F.size(parts) > 1, _blanks(parts[0])), F.when(F.size(parts) > 1, F.col("n_words") - size - (_blanks(F.element_at(parts, -1)) - 1))))
    n_base = sum((p[0] for p in places[1:]), places[0][0]).cast("long")

    table = rules()
    keywords = list(dict.fromkeys(r[1] for r in table))
    literal = F.array(*(
        F.struct(F.lit(k).alias("keyword"), F.array(*(F.struct(F.lit(r[0]).alias("rule"), F.lit(r[2]).alias("label"), F.lit(r[3]).alias("priority"), F.lit(r[4]).alias("confidence"), F.lit(r[5]).alias("regex")) for r in table if r[1] == k)).alias("rules"))
        for k in keywords
    ))
    gate = F.lit(False)
    for a in ANCHORS:
        gate = gate | F.contains(norm, F.lit(a))
    blanks = "cast(length({0}) - length(replace({0}, ' ', '')) as int)"
    found = "transform(flatten(transform(filter(_rules, g -> contains(_norm, g.keyword)), g -> g.rules)), r -> struct(r as r, regexp_extract_all(_norm, r.regex, 0) as m))"
    # for each place of a rule the words between it and the place before, and its own
    sizes = f"zip_with(slice(split(_norm, x.r.regex, -1), 1, size(x.m)), x.m, (p, m) -> struct({blanks.format('p')} as gap, {blanks.format('m')} as n))"
    place = "array(struct(y.s + p.gap as start, -(y.s + p.gap + p.n) as neg, x.r.priority as priority, x.r.rule as rule, x.r.label as label, x.r.confidence as confidence))"
    hits = f"flatten(transform(transform(filter({found}, x -> size(x.m) > 0), x -> struct(x.r as r, {sizes} as w)), x -> {_scan('x.w', '0', 'y.s + p.gap + p.n', place)}))"
    # in the order of start, longer ones first, then priority and rule, a detection lies inside an earlier one if it ends no later than any of those
    kept = _scan("_hits", "-1", "greatest(y.s, -p.neg)", f"case when -p.neg > y.s then array(p) else cast(array() as array<{HIT}>) end")
    kept = f"case when _hits is not null then transform({kept}, x -> struct(x.start as start, -x.neg as end, x.priority as priority, x.rule as rule, x.label as label, x.confidence as confidence)) end"
    base = F.array_sort(F.filter(F.array(*(F.when(p[0] > 0, F.lit(label)) for p, (_, label) in zip(places, BASE, strict=True))), lambda x: x.isNotNull()))
    df = df.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.least(*(p[1] for p in places)).alias("first_word"),
        F.greatest(*(p[2] for p in places)).alias("last_word"),
        base.alias("_base"),
        _once(F.when(gate, norm)).alias("_norm"),
    )
    df = df.withColumn("_rules", F.when(F.col("_norm").isNotNull(), literal))
    df = df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "_base", _once(F.expr(f"case when _norm is not null then array_sort({hits}) end")).alias("_hits"))
    df = df.withColumn("detections", F.coalesce(F.expr(kept), F.expr("cast(array() as array<struct<start:int,end:int,priority:int,rule:int,label:string,confidence:double>>)")))
    found = F.col("detections")
    return df.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("_base"), F.transform(found, lambda x: x["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(found, lambda x: x["confidence"])), F.when(F.size("_base") > 0, F.lit(0.8)), F.lit(0.0)).alias("score"),
        "detections",
    )
