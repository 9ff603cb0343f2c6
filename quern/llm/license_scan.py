"""License scans by ordered signature rules, with DataFrame functions alone.

Hand-written rules for the texts and notices of licenses stand beside rules for what names one: each family of licenses has
hand-written patterns for its name and its address, and forms (identifier tag, grant, address, title, member of a list, short
form with a version, mention) make rules of them, so a form written once holds for all families. A rule runs on a text only if the text holds the rule's keyword,
and none on a text that no rule can match, which the gate tells from the rules themselves. Rules see a text with its white
space, line ends with the comment marks around them included, as one space each. Detections are intervals of characters. A
name that a negation stands before ("not under the ...") is no detection. One that lies inside another of the same or a higher
priority is suppressed; of equal intervals the one with the higher priority, then the earlier rule, stays.

A row is read once and judged in place: no row is sent anywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: label, identifier of the tag, name, address (None: it has none), keywords of which every match of the name holds one.
FAMILIES: tuple[tuple[str, str, str, str | None, str], ...] = (
    ("mit", r"mit", r"mit(?: \(x11\)| x11|/x11)?", r"opensource\.org/licenses?/mit\b", "mit"),
    ("mit-0", r"mit-0", r"mit no attribution", None, "no attribution"),
    ("x11", r"x11", r"x11", None, "x11"),
    ("isc", r"isc", r"isc|internet systems consortium", r"opensource\.org/licenses?/isc\b", "isc|internet systems"),
    ("0bsd", r"0bsd", r"(?:zero[- ]clause|0-clause) bsd", None, "bsd"),
    ("bsd-1-clause", r"bsd-1-clause", r"(?:1|one)[- ]clause bsd|bsd 1-clause", None, "bsd"),
    ("bsd-2-clause", r"bsd-2-clause", r"(?:2|two)[- ]clause bsd|bsd 2-clause|simplified bsd|freebsd", r"opensource\.org/licenses?/bsd-2-clause", "bsd"),
    ("bsd-3-clause", r"bsd-3-clause", r"(?:3|three)[- ]clause bsd|bsd 3-clause|new bsd|modified bsd|revised bsd", r"opensource\.org/licenses?/bsd-3-clause", "bsd"),
    ("bsd-4-clause", r"bsd-4-clause", r"(?:4|four)[- ]clause bsd|bsd 4-clause|original bsd", None, "bsd"),
    ("bsd", r"bsd", r"bsd(?:[- ]style)?", None, "bsd"),
    ("apache-1.1", r"apache-1\.1", r"apache(?: software)?(?: license)?,? (?:version |v\.? ?)?1\.1", r"apache\.org/licenses/license-1\.1", "apache"),
    ("apache-2.0", r"apache-2\.0", r"apache(?: software)?(?: license)?,? (?:version |v\.? ?)?2(?:\.0)?\b", r"apache\.org/licenses/license-2\.0", "apache"),
    ("apache", r"apache", r"apache(?: software)?", r"apache\.org/licenses", "apache"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:gpl|general public license),? ?(?:version |v\.? ?)?1(?:\.0)?\b", None, "gpl|general public"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:gpl|general public license),? ?(?:version |v\.? ?)?2(?:\.0)?\b", r"gnu\.org/(?:old-)?licenses/(?:old-licenses/)?gpl-2\.0", "gpl|general public"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:gpl|general public license),? ?(?:version |v\.? ?)?3(?:\.0)?\b", r"gnu\.org/licenses/gpl-3\.0", "gpl|general public"),
    ("gpl", r"gpl", r"gnu (?:gpl|general public)|gpl", r"gnu\.org/(?:copyleft/|licenses/)gpl", "gpl|general public"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:lgpl|library general public license),? ?(?:version |v\.? ?)?2(?:\.0)?\b", None, "lgpl|general public"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"(?:gnu )?(?:lgpl|lesser general public license),? ?(?:version |v\.? ?)?2\.1", r"gnu\.org/(?:old-)?licenses/(?:old-licenses/)?lgpl-2\.1", "lgpl|general public"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:lgpl|lesser general public license),? ?(?:version |v\.? ?)?3(?:\.0)?\b", r"gnu\.org/licenses/lgpl-3\.0", "lgpl|general public"),
    ("lgpl", r"lgpl", r"gnu (?:lgpl|lesser general public|library general public)|lgpl", r"gnu\.org/(?:copyleft/|licenses/)lgpl", "lgpl|general public"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?(?:agpl|affero general public license),? ?(?:version |v\.? ?)?3(?:\.0)?\b", r"gnu\.org/licenses/agpl-3\.0", "agpl|affero"),
    ("agpl", r"agpl", r"gnu (?:agpl|affero general public)|agpl", r"gnu\.org/licenses/agpl", "agpl|affero"),
    ("gfdl", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu (?:fdl|free documentation)|gfdl", r"gnu\.org/(?:copyleft/|licenses/)fdl", "fdl|documentation"),
    ("mpl-1.1", r"mpl-1\.1", r"mozilla public license,? (?:version |v\.? ?)?1\.1|mpl[- ]1\.1", r"mozilla\.org/mpl/1\.1", "mpl|mozilla"),
    ("mpl-2.0", r"mpl-2\.0", r"mozilla public license,? (?:version |v\.? ?)?2(?:\.0)?\b|mpl[- ]2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0", "mpl|mozilla"),
    ("mpl", r"mpl", r"mozilla public|mpl", r"mozilla\.org/mpl", "mpl|mozilla"),
    ("epl-1.0", r"epl-1\.0", r"eclipse public license,? (?:-? ?v(?:ersion|\.)? ?)?1(?:\.0)?\b", r"eclipse\.org/legal/epl-v10", "eclipse"),
    ("epl-2.0", r"epl-2\.0", r"eclipse public license,? (?:-? ?v(?:ersion|\.)? ?)?2(?:\.0)?\b", r"eclipse\.org/legal/epl-(?:2\.0|v20)", "eclipse"),
    ("edl-1.0", r"bsd-3-clause-edl", r"eclipse distribution license", r"eclipse\.org/org/documents/edl-v10", "eclipse"),
    ("cddl-1.0", r"cddl-1\.0", r"common development and distribution|cddl", r"opensource\.org/licenses?/cddl-?1", "cddl|common development"),
    ("cpl-1.0", r"cpl-1\.0", r"common public license", r"opensource\.org/licenses?/cpl1\.0", "common public"),
    ("eupl-1.2", r"eupl-1\.2", r"european union public|eupl", r"eupl\.eu/1\.2", "eupl|european union"),
    ("artistic-1.0", r"artistic-1\.0", r"artistic license,? (?:version |v\.? ?)?1(?:\.0)?\b|perl artistic", None, "artistic"),
    ("artistic-2.0", r"artistic-2\.0", r"artistic license,? (?:version |v\.? ?)?2(?:\.0)?\b|artistic 2\.0", r"opensource\.org/licenses?/artistic-2\.0", "artistic"),
    ("bsl-1.0", r"bsl-1\.0", r"boost software", r"boost\.org/license_1_0", "boost"),
    ("zlib", r"zlib", r"zlib(?:/libpng)?", r"zlib\.net/zlib_license", "zlib"),
    ("libpng", r"libpng(?:-2\.0)?", r"libpng", None, "libpng"),
    ("unlicense", r"unlicense", r"unlicense", r"unlicense\.org", "unlicense"),
    ("wtfpl", r"wtfpl", r"wtfpl|do what the f\w+ you want to public", r"wtfpl\.net", "wtfpl|do what the f"),
    ("cc0-1.0", r"cc0-1\.0", r"cc0(?: 1\.0)?|creative commons zero", r"creativecommons\.org/publicdomain/zero/1\.0", "cc0|creative commons"),
    ("cc-by", r"cc-by-[1234]\.[05]", r"(?:cc[- ]by|creative commons attribution)(?:[- ][1234]\.[05])?(?![- ](?:nc|nd|sa|non|no|share))", r"creativecommons\.org/licenses/by/", "cc by|cc-by|creative commons"),
    ("cc-by-sa", r"cc-by-sa-[1234]\.[05]", r"cc[- ]by[- ]sa(?:[- ][1234]\.[05])?|creative commons attribution[- ]share[- ]?alike", r"creativecommons\.org/licenses/by-sa/", "cc by|cc-by|creative commons"),
    ("cc-by-nc", r"cc-by-nc-[1234]\.[05]", r"cc[- ]by[- ]nc(?:[- ][1234]\.[05])?(?![- ](?:sa|nd))|creative commons attribution[- ]non[- ]?commercial(?![- ](?:share|no))", r"creativecommons\.org/licenses/by-nc/", "cc by|cc-by|creative commons"),
    ("cc-by-nd", r"cc-by-nd-[1234]\.[05]", r"cc[- ]by[- ]nd(?:[- ][1234]\.[05])?|creative commons attribution[- ]no[- ]?deriv\w*", r"creativecommons\.org/licenses/by-nd/", "cc by|cc-by|creative commons"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-[1234]\.[05]", r"cc[- ]by[- ]nc[- ]sa(?:[- ][1234]\.[05])?|creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike", r"creativecommons\.org/licenses/by-nc-sa/", "cc by|cc-by|creative commons"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-[1234]\.[05]", r"cc[- ]by[- ]nc[- ]nd(?:[- ][1234]\.[05])?|creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv\w*", r"creativecommons\.org/licenses/by-nc-nd/", "cc by|cc-by|creative commons"),
    ("odbl-1.0", r"odbl-1\.0", r"open database|odbl", r"opendatacommons\.org/licenses/odbl", "odbl|open database"),
    ("odc-by-1.0", r"odc-by-1\.0", r"open data commons attribution|odc-by", r"opendatacommons\.org/licenses/by", "odc-by|open data commons"),
    ("pddl-1.0", r"pddl-1\.0", r"public domain dedication and|pddl", r"opendatacommons\.org/licenses/pddl", "pddl|public domain dedication"),
    ("ofl-1.1", r"ofl-1\.1", r"(?:sil )?open font|ofl[- ]1\.1", r"(?:scripts\.sil\.org|openfontlicense\.org)/?(?:ofl)?", "ofl|open font"),
    ("ecl-2.0", r"ecl-2\.0", r"educational community", r"opensource\.org/licenses?/ecl-?2", "educational"),
    ("python-2.0", r"(?:python|psf)-2\.0", r"python software foundation|psf", r"docs\.python\.org/3/license", "psf|python"),
    ("ruby", r"ruby", r"ruby", r"ruby-lang\.org/\w+/about/license", "ruby"),
    ("php-3.01", r"php-3\.01", r"php license,? (?:version |v\.? ?)?3\.01|php 3\.01", r"php\.net/license/3_01", "php"),
    ("openssl", r"openssl", r"openssl", r"openssl\.org/source/license", "openssl"),
    ("ms-pl", r"ms-pl", r"microsoft public|ms-pl", r"opensource\.org/licenses?/ms-pl", "ms-pl|microsoft public"),
    ("ms-rl", r"ms-rl", r"microsoft reciprocal|ms-rl", r"opensource\.org/licenses?/ms-rl", "ms-rl|microsoft reciprocal"),
    ("osl-3.0", r"osl-3\.0", r"open software license(?:,? (?:version |v\.? ?)?3(?:\.0)?)?", r"opensource\.org/licenses?/osl-3\.0", "open software"),
    ("afl-3.0", r"afl-3\.0", r"academic free", r"opensource\.org/licenses?/afl-3\.0", "academic free"),
    ("ncsa", r"ncsa", r"university of illinois/?ncsa|ncsa", r"opensource\.org/licenses?/ncsa", "ncsa"),
    ("postgresql", r"postgresql", r"postgresql", r"postgresql\.org/about/licence", "postgresql"),
    ("busl-1.1", r"busl-1\.1", r"business source", r"mariadb\.com/bsl11", "business source"),
    ("sspl-1.0", r"sspl-1\.0", r"server side public|sspl", r"mongodb\.com/licensing/server-side-public-license", "sspl|server side"),
    ("elastic-2.0", r"elastic-2\.0", r"elastic license,? (?:version |v\.? ?)?2(?:\.0)?\b|elv2", r"elastic\.co/licensing/elastic-license", "elastic|elv2"),
)

#: label, priority, keyword, pattern of what is no family.
OTHERS: tuple[tuple[str, int, str, str], ...] = (
    ("all-rights-reserved", 2, "rights reserved", r"(?:copyright|\(c\)|©)[^\n]{0,120}?all rights reserved|all rights reserved"),
    ("proprietary", 2, "proprietary", r"proprietary (?:and confidential|software|license)"),
    ("public-domain", 2, "public domain", r"(?:released|placed|dedicated|available) (?:in|into|to) the public domain"),
    ("non-commercial", 1, "commercial", r"(?:non-?commercial|not for commercial) use(?: only)?"),
)

#: label, keyword, pattern of sentences that stand in a license itself or in the notice that it asks for.
BODIES: tuple[tuple[str, str, str], ...] = (
    ("mit", "free of charge, to any person obtaining", r"permission is hereby granted, free of charge, to any person obtaining a copy of (?:this|the) (?:software|work|program|font|data)"),
    ("mit", "this permission notice shall be", r"the above copyright notice and this permission notice (?:\([^)]{0,80}\) )?shall be included in all copies"),
    ("x11", "shall not be used in advertising", r"except as contained in this notice, the names?\(?s?\)? of [^.]{1,120}? shall not be used in advertising"),
    ("isc", "with or without fee is hereby granted, provided", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided"),
    ("0bsd", "with or without fee is hereby granted.", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\."),
    ("bsd", "in source and binary forms", r"redistribution and use (?:of this software )?in source and binary forms,? (?:with or without modification,? )?(?:are|is) permitted"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "to endorse or promote products", r"neither the name of [^.]{1,160}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software must display"),
    ("ncsa", "with the software without restriction", r"neither the names of [^.]{1,160}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific"),
    ("apache-2.0", "except in compliance with the license", r"you may not use (?:this file|these files|this work|this software) except in compliance with the license"),
    ("apache-2.0", "agreed to in writing, software distributed", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an .?as is.? basis"),
    ("apache-2.0", "shall mean the terms and conditions for use", r".?license.? shall mean the terms and conditions for use, reproduction, and distribution"),
    ("apache-2.0", "grant of patent license", r"grant of patent license\. subject to the terms and conditions of this license, each contributor hereby grants"),
    ("apache-1.1", "developed by the apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl-2.0", "either version 2 of the license", r"(?:program|file|software) is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public license[^.]{0,80}? either version 2 of the license"),
    ("gpl-3.0", "either version 3 of the license", r"(?:program|file|software) is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public license[^.]{0,80}? either version 3 of the license"),
    ("gpl", "is free software", r"is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl", "a copy of the gnu general public license", r"you should have received a copy of the gnu general public license"),
    ("gpl", "in the hope that it will be useful", r"this program is distributed in the hope that it will be useful, but without any warranty"),
    ("gpl", "verbatim copies of this license document", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("gpl-2.0", "designed to take away your freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "free, copyleft license for software", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("lgpl", "library is free software", r"this library is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "a copy of the gnu lesser general public license", r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl", "library is distributed in the hope", r"this library is distributed in the hope that it will be useful, but without any warranty"),
    ("lgpl-2.1", "first released version of the lesser", r"this is the first released version of the lesser gpl"),
    ("lgpl-3.0", "incorporates the terms and conditions of version 3", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3.0", "specifically designed to ensure cooperation", r"the gnu affero general public license is a free, copyleft license[^.]{0,80}? specifically designed to ensure cooperation"),
    ("agpl", "a copy of the gnu affero general public license", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", "gnu free documentation license", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "source code form is subject to the terms", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "if a copy of the mpl was not distributed", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", "are subject to the mozilla public license", r"the contents of this file are subject to the mozilla public license,? version 1\.1"),
    ("epl-1.0", "eclipse public license v1.0", r"accompanying materials are made available under the terms of the eclipse public license v1\.0"),
    ("epl-2.0", "eclipse public license v", r"accompanying materials are made available under the terms of the eclipse public license v(?:\. )?2\.0"),
    ("epl-1.0", "constitutes recipient's acceptance", r"any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement"),
    ("cddl-1.0", "common development and distribution license", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("bsl-1.0", "to any person or organization obtaining", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "without any express or implied warranty", r"this software is provided .?as-is.?, without any express or implied warranty\. in no event will the authors"),
    ("zlib", "origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original"),
    ("zlib", "altered source versions must be", r"altered source versions must be plainly marked as such"),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy, modify, publish", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", "you just do what the f", r"you just do what the f\w+ you want to"),
    ("cc0-1.0", "to the extent possible under law", r"to the extent possible under law, [^.]{1,160}? (?:has|have) waived all copyright"),
    ("cc0-1.0", "associated a work with this deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "give appropriate credit", r"you must give appropriate credit, provide a link to the license, and indicate if changes were made"),
    ("cc-by-sa", "under the same license as the original", r"if you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", "use the material for commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "distribute the modified material", r"if you remix, transform, or build upon the material, you may not distribute the modified material"),
    ("ofl-1.1", "font software is licensed", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "studied, modified and redistributed freely", r"the ofl allows the licensed fonts to be used, studied, modified and redistributed freely"),
    ("artistic-2.0", "a given free software package", r"this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed"),
    ("artistic-1.0", "the conditions under which a package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("python-2.0", "psf is making python available", r"psf is making python available to licensee on an .?as is.? basis"),
    ("python-2.0", "between the python software foundation", r"this license agreement is between the python software foundation"),
    ("php-3.01", "this product includes php software", r"this product includes php software, freely available from"),
    ("openssl", "developed by the openssl project", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "cryptographic software written by eric young", r"this product includes cryptographic software written by eric young"),
    ("postgresql", "without a written agreement is hereby granted", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("ms-pl", "if you use the software, you accept this license", r"if you use the software, you accept this license\. if you do not accept the license, do not use the software"),
    ("busl-1.1", "make non-production use of the licensed work", r"right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work"),
    ("sspl-1.0", "available to third parties as a service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "as a hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("odbl-1.0", "under the open database license", r"(?:is|are) made available under the open database license"),
    ("eupl-1.2", "licensed under the eupl", r"licensed under the eupl,? (?:version )?1\.2"),
    ("ecl-2.0", "under the educational community license", r"licensed under the educational community license, version 2\.0"),
    ("osl-3.0", "licensed under the open software license", r"licensed under the open software license version 3\.0"),
    ("afl-3.0", "licensed under the academic free license", r"licensed under the academic free license version 3\.0"),
    ("public-domain", "is in the public domain", r"(?:this (?:work|software|file|text|document|code)|it) is in the public domain"),
    ("public-domain", "no known copyright restrictions", r"no known copyright restrictions"),
    ("proprietary", "is strictly prohibited", r"unauthori[sz]ed (?:copying|reproduction|distribution|use|duplication)[^.]{0,80}? is strictly prohibited"),
    ("proprietary", "confidential and proprietary", r"contains? (?:trade secrets|confidential and proprietary information)"),
    ("proprietary", "may be reproduced", r"no part of this (?:publication|document|book|work|website|site) may be reproduced"),
    ("proprietary", "internal use only", r"for internal use only"),
)

GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|governed|redistribute it(?: and/or modify it)?) (?:\w+ ){0,3}?(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
LICENSE = r"(?: public)? licen[sc]e(?:,? version \d(?:\.\d)?)?"
#: What stands right before a name that a text says it is not under.
NEGATION = r"(?:(?<!\w)(?:not|never|no longer|neither|nor|instead of|rather than|other than|unlike)|n['\u2019]t)(?! only)(?: \w+){0,4}?(?: (?:under|by|with|to|in|as|from))?(?: (?:the|a|an|any|its))?(?: terms(?: and conditions)? of(?: the)?)? ?$"
CONFIDENCE = {4: 0.99, 3: 0.95, 2: 0.8, 1: 0.5}
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Line ends with the comment marks of the next line and borders of boxes, and other white space that is not one space.
_GAPS = r"(?:\h++[*#|]++)?\h*+\v[\h\v]*+(?:(?:<!--+|/\*+|//+!?|\*+/?|#+|;+|--+|%+|>+|!+|\|+|dnl(?!\w)|rem(?!\w))[\h\v]*+)*+|\h{2,}+|[\h&&[^ ]]"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str
    also: str = ""


def hosts(url: str) -> list[str]:
    """The hosts of an address pattern, one of which every match holds."""
    return re.sub(r"^\(\?:(.*?)\)", r"\1", url.split("/")[0]).replace("\\b", "").replace("\\.", ".").split("|")


#: Families whose tags, and names with a version, tell a license wherever they stand; words that each of these forms holds.
SHORT = ("gpl", "lgpl", "agpl", "apache", "mpl", "epl", "bsd", "cc")
SHORT_WORDS = ("gpl", "bsd-", "bsd ", "apache", "mpl", "mozilla", "epl-", "eclipse", "general public", "affero", "cc-by", "cc by", "cc0", "creative commons")
#: Names that are words of other things too, so no member of a list is known by them.
COMMON = ("ruby", "openssl", "postgresql", "x11", "libpng", "zlib")


def rules() -> list[Rule]:
    """All rules, in their order. also: what a text has to hold besides a keyword."""
    out = []
    for label, tag, name, url, word in FAMILIES:
        out.append(Rule(label, 4, "spdx", rf"spdx-licen[sc]e-identifier: ?\(*{tag}(?![\w.+-])"))
        out.append(Rule(label, 4, "spdx", rf"(?<![\w.+-])(?:or|and|with) \(*{tag}(?![\w.+-])", "-identifier:"))
        out.append(Rule(label, 3, word, rf"(?<!\w){GRANT}(?:{name})(?:{LICENSE})?(?!\w)"))
        if url:
            out.append(Rule(label, 3, "|".join(hosts(url)), rf"(?:https?://)?(?:www\.)?{url}"))
        out.append(Rule(label, 2, word, rf"(?<!\w)(?:the )?(?:{name}){LICENSE}(?!\w)"))
        if label not in COMMON:
            out.append(Rule(label, 2, word, rf"(?:, (?:or |and )?|(?<!\w)(?:or|and) )(?:the )?(?:{name}|{tag})(?:{LICENSE})?(?!\w)", "ed under "))
        if label.split("-")[0] in SHORT:
            if "-" in tag:
                out.append(Rule(label, 2, word, rf"(?<![\w.-])(?:{tag})(?![\w+-]|\.\w)"))
            later = r"(?:(?<=[1-4]\.[05])| [1-4]\.[05])" if label.startswith("cc-by") else r"(?:\+| or (?:any )?later| only)"
            out.append(Rule(label, 2, word, rf"(?<!\w)(?:{name}){later}(?!\w)"))
        out.append(Rule(label, 1, word, rf"(?:licen[sc]e|lizenz|licencia|licenza) ?[:=] ?[\"'(]{{0,2}}(?:{name}|{tag})(?!\w)"))
        out.append(Rule(label, 1, word, rf"licen[sc]e-(?:{tag})(?![\w-])"))
    out += [Rule(label, 3, word, rf"(?<!\w)(?:{pattern})") for label, word, pattern in BODIES]
    return out + [Rule(label, p, word, rf"(?<!\w)(?:{pattern})(?!\w)") for label, p, word, pattern in OTHERS]


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _word_count(x: Column) -> Column:
    """Words of a text: separators become spaces and runs of them one space, which is cheaper than a regular expression; that counts only where runs are very long."""
    marks = "".join(c for c in map(chr, range(128)) if not c.isalnum())
    flat = F.translate(x, marks, " " * len(marks))
    for run in ("    ", "   ", "  ", "  "):
        flat = F.replace(flat, F.lit(run), F.lit(" "))
    plain = _let(F.trim(flat), lambda y: F.when(F.contains(y, F.lit("  ")), None).when(y == "", 0).otherwise(_spaces(y) + 1))
    return F.coalesce(plain, F.regexp_count(x, F.lit(_CASED_WORD))).cast("long")


def _let(x: Column, f) -> Column:
    """f(x), with x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _own(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def _any(text: Column, words: set[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in sorted(words)])


def _can_match(text: Column) -> Column:
    """Whether a rule can match: tags, titles and mentions hold a form of license, addresses their host, grants the form with a name."""
    names = "|".join(name for _, _, name, _, _ in FAMILIES)
    sites = {h for _, _, _, url, _ in FAMILIES if url for h in hosts(url)}
    named = {w for _, _, word, _ in OTHERS for w in word.split("|")} | {word for _, word, _ in BODIES} | {"license", "licence"}
    addressed = _any(text, {"." + h.rsplit(".", 1)[1] for h in sites}) & _any(text, sites)
    named |= {*SHORT_WORDS, *TONGUES}
    return _any(text, named) | addressed | text.rlike(rf"(?<!\w){GRANT}(?:{names})")


def _may_match(low: Column) -> Column:
    """Whether a rule may match once gaps are one space: one word, which no gap parts, of each way that _can_match knows."""
    sites = {h for _, _, _, url, _ in FAMILIES if url for h in hosts(url)}
    whole = [w for _, _, word, _ in OTHERS for w in word.split("|")] + [word for _, word, _ in BODIES]
    named = {"license", "licence"} | {max(w.split(), key=len) for w in whole if "license" not in w}
    verbs = {"licensed", "licenced", "released", "distributed", "available", "published", "provided", "covered", "governed", "redistribute"}
    short = {max(w.split(" "), key=len) if " " in w.strip() and not w.startswith("cc") else w for w in SHORT_WORDS}
    return _any(low, named | verbs | short | {*TONGUES}) | (_any(low, {"." + h.rsplit(".", 1)[1] for h in sites}) & _any(low, sites))


#: The word license where it is another one.
TONGUES = ("lizenz", "licencia", "licenza")
_BLOCK = 128


def _running(sizes: Column) -> Column:
    """Running sums of an array of numbers, by blocks, so that the work does not grow with the square of its length."""
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")), lambda b: F.slice(sizes, b * _BLOCK + 1, _BLOCK))

    def of(blocks: Column) -> Column:
        return _let(F.transform(blocks, add), lambda sums: F.flatten(F.transform(blocks, lambda x, b: _let(add(F.slice(sums, F.lit(1), b)), lambda before: F.transform(x, lambda _, i: before + add(F.slice(x, F.lit(1), i + 1)))))))

    return F.when(F.size(sizes) > 0, _let(blocks, of)).otherwise(F.array().cast("array<bigint>"))


def detections(text: Column) -> Column:
    """All matches of the rules in a flattened, lower-cased text: an array of (start, less, rank, rule, label, priority, end, negated), sorted so that an
    interval stands after all that it may lie in; less and rank are -end and -priority."""
    told = [F.struct(F.lit(k).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.array(*map(F.lit, r.keyword.split("|"))).alias("words"), F.lit(r.pattern).alias("pattern"), F.lit(r.also).alias("also")) for k, r in enumerate(rules())]

    def of(r: Column) -> Column:
        def spans(found: Column) -> Column:
            gaps = F.slice(F.split(text, r["pattern"], -1), F.lit(1), F.size(found))
            each = F.arrays_zip(found.alias("m"), gaps.alias("g"))
            ends = _running(F.transform(each, lambda x: (F.length(x["m"]) + F.length(x["g"])).cast("long")))

            def one(x: Column) -> Column:
                start, end = x["e"] - F.length(x["m"]), x["e"]
                return F.struct(start.alias("start"), (-end).alias("less"), (-r["priority"]).alias("rank"), r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), end.alias("end"), F.right(x["g"], F.lit(96)).rlike(NEGATION).alias("negated"))

            return F.transform(F.arrays_zip(found.alias("m"), gaps.alias("g"), ends.alias("e")), one)

        return _let(F.regexp_extract_all(text, r["pattern"], F.lit(0)), spans)

    return F.sort_array(F.flatten(F.transform(F.filter(F.array(*told), lambda r: F.contains(text, r["also"]) & F.exists(r["words"], lambda w: F.contains(text, w))), of)))


def surviving(found: Column) -> Column:
    """Distinct (label, priority) of the sorted detections that are neither negated nor inside another of their priority or a higher one that isn't."""
    levels = sorted(CONFIDENCE)
    start = F.struct(*[F.lit(-1).cast("long").alias(f"e{p}") for p in levels], F.array().cast("array<struct<label: string, priority: int>>").alias("live"))

    def step(a: Column, x: Column) -> Column:
        out = F.lit(False)
        for p in levels:
            out = out | ((x["priority"] == p) & (a[f"e{p}"] >= x["end"]))
        seen = [F.when(~x["negated"] & (x["priority"] >= p), F.greatest(a[f"e{p}"], x["end"])).otherwise(a[f"e{p}"]).alias(f"e{p}") for p in levels]
        live = F.array_union(a["live"], F.array(F.struct(x["label"].alias("label"), x["priority"].alias("priority"))))
        return F.struct(*seen, F.when(out | x["negated"], a["live"]).otherwise(live).alias("live"))

    return F.aggregate(found, start, step, lambda a: a["live"])


def _judged(df: DataFrame, text: str, phrases: dict[str, str]) -> DataFrame:
    """df with __low, __flat (with one space for each gap, null where no rule can match), __hit (whether a phrase may be there) and __found (detections)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    longest = {max(p.split(), key=len) for p in phrases}
    told = df.withColumn("__low", F.translate(t, _UPPER, _LOWER)).withColumn("__hit", F.exists(F.array("__low"), lambda x: _any(x, longest)) if longest else F.lit(False))
    told = told.withColumn("__flat", F.when(F.exists(F.array("__low"), _may_match), F.regexp_replace("__low", _GAPS, " ")))
    told = told.withColumn("__flat", _let(F.col("__flat"), lambda x: F.when(_can_match(x), x)))
    none = F.array().cast("array<struct<start: bigint, less: bigint, rank: int, rule: int, label: string, priority: int, end: bigint, negated: boolean>>")
    return told.withColumn("__found", F.when(F.col("__flat").isNotNull(), detections(F.col("__flat"))).otherwise(none))


def license_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """A row a detection: the columns of df, and rule (its number), label, priority, start, end (characters of the lower-cased text with one
    space for each gap, end exclusive), negated. Texts without one give none."""
    own = _own([c for c in df.columns if c not in ("rule", "label", "priority", "start", "end", "negated")])
    found = _judged(df, text, {}).select(*own, F.explode("__found").alias("__x"))
    return found.select(*own, *[F.col(f"__x.{c}").alias(c) for c in ("rule", "label", "priority", "start", "end", "negated")])


def license_scan(df: DataFrame, text: str = "text", phrases: dict[str, str] | None = None) -> DataFrame:
    """df with n_words, n_base, first_word, last_word (long), base_labels, labels (string), score (double).

    Words: runs of letters, digits and all beyond ASCII, A-Z lower-cased. A phrase counts wherever its words stand in
    a row. labels: those of phrases and of surviving detections. score: the highest confidence of a surviving
    detection; 0.9 at least for a phrase of which no name is negated, 0.3 for one of which all detected names are; 0 for nothing.
    Null and empty texts: no words, no labels, score 0. A very long text is scanned whole, in one task. Repeated rows
    are each scanned; an empty table gives an empty one. Columns of df with these names are replaced.
    """
    phrases = PHRASES if phrases is None else phrases
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    own = _own([c for c in df.columns if c not in made])
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    told = _judged(df, text, phrases).withColumn("__n", _word_count(t))
    told = told.withColumn("__norm", F.when(F.col("__hit"), F.concat(F.lit(" "), F.trim(F.regexp_replace("__low", _SEPARATORS, " ")), F.lit(" "))))

    def places_of(phrase: str, label: str) -> Column:
        def at(pieces: Column) -> Column:
            n = F.size(pieces) - 1
            last = F.col("__n") - _spaces(F.element_at(pieces, -1))
            return F.when(n > 0, F.struct(n.cast("long").alias("n"), _spaces(pieces[0]).cast("long").alias("first"), last.cast("long").alias("last"), F.lit(label).alias("label")))

        return _let(F.split("__norm", f" (?={re.escape(phrase)} )", -1), at)

    places = [places_of(phrase, label) for phrase, label in phrases.items()]
    none = F.array().cast("array<struct<n: bigint, first: bigint, last: bigint, label: string>>")
    told = told.withColumn("__base", F.when(F.col("__hit"), F.array_compact(F.array(*places))).otherwise(none) if places else none)
    told = told.withColumn("__live", surviving(F.col("__found")))
    names = F.array_distinct(F.transform("__base", lambda x: x["label"]))
    trust = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.array_max(F.transform("__live", lambda x: x["priority"])))
    said_no = F.transform(F.filter("__found", lambda x: x["negated"]), lambda x: F.substring_index(x["label"], "-", 1))
    sure = F.exists(names, lambda x: ~F.array_contains(said_no, x) | F.exists("__live", lambda y: F.substring_index(y["label"], "-", 1) == x))
    base = F.when(F.size(names) == 0, 0.0).when(sure, 0.9).otherwise(0.3)
    return told.select(
        *own, F.col("__n").alias("n_words"), F.aggregate("__base", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"), F.array_min(F.transform("__base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("__base", lambda x: x["last"])).alias("last_word"), F.array_join(F.array_sort(names), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, F.transform("__live", lambda x: x["label"]))), ",").alias("labels"), F.greatest(F.coalesce(trust, F.lit(0.0)), base).alias("score"),
    )
