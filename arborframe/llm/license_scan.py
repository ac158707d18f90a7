"""License scans by ordered signature rules, in built-in functions only.

A text's words (digits, letters, anything beyond ASCII; A-Z lower-cased) are laid out with a space before and
after each, so that a rule is a pattern of whole words and a place is a count of spaces. Rules are of two sorts:
signatures, written by hand from the wording of licences, their headers and notices; and references, made from
names of licences and ways in which texts refer to them. A first pattern over the raw text spares texts without any
keyword all the rest. Rules are then taken by keyword: one pattern of all rules of a keyword decides whether its
rules are tried one by one.

Of overlapping detections a rule of higher priority suppresses those of lower ones, and at the same priority a
detection suppresses those contained in it (equal ones: the earlier rule stays). Base phrases are not suppressed.
Detections are compared with those around them, by stretches of ``STRETCH`` words.

Everything happens within the row: nothing is shuffled, and a very long document is one row of a scan. Defined
results: null texts count as empty; without words all counts are zero, places null, labels empty, score 0. Rows that
repeat are scanned each, alike. Other columns are not read, so that their names cannot clash. An empty table gives an
empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import running

#: Words of a stretch within which detections are compared.
STRETCH = 256

#: Base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Licences: label, keyword, and the name as words; a word is a pattern, one with ? may be missing.
NAMES = (
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("apache-1.1", "apache", "apache software? license version? v?1 1"),
    ("apache-2.0", "apache", "apache software? license? version? v?2 0?"),
    ("gpl-1.0", "gnu", "gnu general public license version? v?1"),
    ("gpl-2.0", "gnu", "gnu general public license version? v?2"),
    ("gpl-3.0", "gnu", "gnu general public license version? v?3"),
    ("gpl", "gnu", "gnu general public license"),
    ("gpl-2.0", "gpl", "gpl version? v?2 0?"),
    ("gpl-3.0", "gpl", "gpl version? v?3 0?"),
    ("lgpl-2.0", "gnu", "gnu library general public license version? v?2"),
    ("lgpl-2.1", "gnu", "gnu lesser general public license version? v?2 1"),
    ("lgpl-3.0", "gnu", "gnu lesser general public license version? v?3"),
    ("lgpl", "gnu", "gnu lesser|library general public license"),
    ("lgpl", "lgpl", "lgpl version? v?[23]? [01]?"),
    ("agpl-3.0", "affero", "gnu? affero general public license version? v?3?"),
    ("agpl-3.0", "agpl", "agpl version? v?3?"),
    ("gfdl", "documentation", "gnu free documentation license version? v?1? [123]?"),
    ("bsd-2-clause", "bsd", "bsd 2|two clause"),
    ("bsd-3-clause", "bsd", "bsd 3|three clause"),
    ("bsd-2-clause", "bsd", "simplified|freebsd bsd"),
    ("bsd-3-clause", "bsd", "new|revised|modified bsd"),
    ("bsd-4-clause", "bsd", "original bsd"),
    ("bsd", "bsd", "bsd style?"),
    ("0bsd", "0bsd", "0bsd"),
    ("isc", "isc", "isc"),
    ("mpl-1.1", "mozilla", "mozilla public license version? v?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license version? v?2 0?"),
    ("mpl", "mozilla", "mozilla public license"),
    ("epl-1.0", "eclipse", "eclipse public license version? v?1 0?"),
    ("epl-2.0", "eclipse", "eclipse public license version? v?2 0?"),
    ("epl", "eclipse", "eclipse public license"),
    ("cddl-1.0", "distribution", "common development and distribution license version? v?1? 0?"),
    ("cpl-1.0", "common", "common public license version? v?1? 0?"),
    ("artistic-1.0", "artistic", "artistic license version? v?1 0?"),
    ("artistic-2.0", "artistic", "artistic license version? v?2 0?"),
    ("artistic", "artistic", "perl? artistic license"),
    ("zlib", "zlib", "zlib|zlib/libpng libpng?"),
    ("bsl-1.0", "boost", "boost software license version? v?1? 0?"),
    ("unlicense", "unlicense", "the? unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0-1.0", "cc0", "cc0 1? 0? universal?"),
    ("cc0-1.0", "zero", "creative commons zero"),
    ("cc-by-4.0", "attribution", "creative commons attribution 4 0 international?"),
    ("cc-by-3.0", "attribution", "creative commons attribution 3 0 unported?"),
    ("cc-by", "attribution", "creative commons attribution"),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike [1234]? [05]?"),
    ("cc-by-sa", "share", "creative commons attribution share alike [1234]? [05]?"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial [1234]? [05]?"),
    ("cc-by-nc", "non", "creative commons attribution non commercial [1234]? [05]?"),
    ("cc-by-nd", "noderivatives", "creative commons attribution noderivatives|noderivs [1234]? [05]?"),
    ("cc-by-nc-sa", "sharealike", "creative commons attribution noncommercial sharealike [1234]? [05]?"),
    ("cc-by-nc-nd", "noderivatives", "creative commons attribution noncommercial noderivatives|noderivs [1234]? [05]?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa [1234]? [05]?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd [1234]? [05]?"),
    ("cc-by-nc", "cc", "cc by nc [1234]? [05]?"),
    ("cc-by-sa", "cc", "cc by sa [1234]? [05]?"),
    ("cc-by-nd", "cc", "cc by nd [1234]? [05]?"),
    ("cc-by", "cc", "cc by [1234]? [05]?"),
    ("ofl-1.1", "sil", "sil open font license version? v?1? 1?"),
    ("python-2.0", "python", "python software foundation license version? v?2?"),
    ("php-3.01", "php", "php license version? v?3? 0?1?"),
    ("ruby", "ruby", "ruby license"),
    ("eupl-1.2", "european", "european union public licen[cs]e version? v?1? [012]?"),
    ("osl-3.0", "osl", "osl version? v?3? 0?"),
    ("osl-3.0", "software", "open software license version? v?3? 0?"),
    ("afl-3.0", "academic", "academic free license version? v?3? 0?"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("ms-rl", "microsoft", "microsoft reciprocal license"),
    ("ncsa", "ncsa", "university of illinois ncsa open source license"),
    ("postgresql", "postgresql", "postgresql license"),
    ("openssl", "openssl", "openssl license"),
    ("odbl-1.0", "database", "open database license v?1? 0?"),
    ("pddl-1.0", "dedication", "public domain dedication and license"),
    ("busl-1.1", "business", "business source license version? v?1? 1?"),
    ("sspl-1.0", "server", "server side public license version? v?1?"),
    ("elastic-2.0", "elastic", "elastic license version? v?2? 0?"),
    ("w3c", "w3c", "w3c software? notice? and? license"),
    ("x11", "x11", "x11"),
    ("vim", "vim", "vim license"),
    ("curl", "curl", "curl license"),
    ("json", "json", "json license"),
    ("cecill-2.1", "cecill", "cecill version? v?2? 1?"),
    ("mulan-2.0", "mulan", "mulan psl|permissive v?2?"),
    ("upl-1.0", "permissive", "universal permissive license"),
)

#: How texts refer to a licence: priority and words around its name.
FORMS = (
    (40, "spdx license identifier {}"),
    (30, "licensed|released|distributed|available|published under the|a|an? terms? of? the? {} license|licence?"),
    (20, "{} license|licence"),
    (10, "{}"),
)

#: Wording of licences, headers and notices: label and words, <name> being one to six words.
SIGNATURES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "the above copyright notice and this permission notice shall|must be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit-0", "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "permission to use copy modify and|or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is and the author|isc disclaims all warranties with regard to this software"),
    ("isc", "any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", "neither the name of the? <name> nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "this software is provided by the copyright holders|regents|author and contributors? as is and any express or implied warranties"),
    ("bsd", "the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    ("bsd-2-clause", "official policies either expressed or implied of the freebsd project"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause-lbnl", "you are under no obligation whatsoever to provide any bug fixes patches or upgrades"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "you may obtain a copy of the license at https?? www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce"),
    ("apache-2.0", "royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import"),
    ("apache-2.0", "derivative works shall mean any work whether in source or object form that is based on or derived from the work"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("apache-1.1", "the names apache and apache software foundation must not be used to endorse or promote products"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-2.0", "under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "you may convey verbatim copies of the program s source code as you receive it"),
    ("gpl-3.0", "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable"),
    ("gpl-3.0", "to convey a work means any kind of propagation that enables other parties to make or receive copies"),
    ("gpl-3.0", "a user product is either a consumer product which means any tangible personal property"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser|library general public license"),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-2.0", "gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-3.0", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", "see the gnu lesser|library general public license for more details"),
    ("lgpl", "you should have received a copy of the gnu lesser|library general public license"),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("lgpl-2.1", "this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license"),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation"),
    ("agpl-3.0", "your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("gpl-classpath", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-linking", "as a special exception the copyright holders of this library give you permission to link this library"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https?? mozilla org mpl 2 0"),
    ("mpl-1.1", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations"),
    ("mpl-1.1", "the initial developer of the original code is"),
    ("npl-1.1", "the contents of this file are subject to the netscape public license"),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v2|2 0"),
    ("epl-1.0", "the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", "when distributing covered code include this cddl header in each file"),
    ("ipl-1.0", "the accompanying program is provided under the terms of this ibm public license"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic-1.0", "you may make and give away verbatim copies of the source form of the standard version of this package without restriction"),
    ("perl", "this is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("perl", "this program|library|module is free software you can redistribute it and or modify it under the same terms as the? perl"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright"),
    ("cc-by", "this work is licensed under a|the creative commons attribution [1-4]? [05]? international|unported? license"),
    ("cc-by-sa", "this work is licensed under a|the creative commons attribution sharealike|share alike?"),
    ("cc-by-sa", "text is available under the creative commons attribution sharealike license"),
    ("cc-by-nc", "this work is licensed under a|the creative commons attribution noncommercial"),
    ("cc-by-nd", "this work is licensed under a|the creative commons attribution noderivatives|noderivs"),
    ("cc", "to view a copy of this license visit https?? creativecommons org licenses"),
    ("cc-by", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org publicdomain mark 1 0"),
    ("cc", "the work is protected by copyright and or other applicable law any use of the work other than as authorized under this license"),
    ("cc-by", "royalty free non sublicensable non exclusive irrevocable license to exercise the licensed rights in the licensed material"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ofl-1.1", "no modified version of the font software may use the reserved font name"),
    ("python-2.0", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("python-2.0", "psf is making python available to licensee on an as is basis"),
    ("php-3.01", "this source file is subject to version 3 0?1? of the php license"),
    ("php-3.01", "the name php must not be used to endorse or promote products derived from this software"),
    ("php-3.01", "this product includes php software freely available from"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "the names openssl toolkit and openssl project must not be used to endorse or promote products"),
    ("ssleay", "this product includes cryptographic software written by eric young"),
    ("ssleay", "this package is an ssl implementation written by eric young"),
    ("eupl-1.2", "licensed under the eupl version? v1|1 [12]"),
    ("eupl-1.2", "this european union public licence the eupl applies to the work"),
    ("osl-3.0", "licensed under the open software license version 3 0"),
    ("afl-3.0", "licensed under the academic free license version 3 0"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-pl", "each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution"),
    ("ncsa", "neither the names of <name> nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("postgresql", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("odbl-1.0", "this database|<name> is made available under the open database license"),
    ("pddl-1.0", "is made available under the public domain dedication and license"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "the software is provided to you by the licensor under the license as defined below subject to the following condition"),
    ("w3c", "by obtaining and or copying this work you the licensee agree that you have read understood and will comply"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("json", "the software shall be used for good not evil"),
    ("cecill-2.1", "this software is governed by the cecill license under french law"),
    ("cecill-b", "this software is governed by the cecill b license under french law"),
    ("cecill-c", "this software is governed by the cecill c license under french law"),
    ("mulan-2.0", "is licensed under mulan psl v2 you can use this software according to the terms and conditions of the mulan psl v2"),
    ("upl-1.0", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices"),
    ("unicode", "unicode inc license agreement data files and software"),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", "icu license icu 1 8 1 and later"),
    ("libpng", "this copy of the libpng notices is provided for your convenience"),
    ("ijg", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "portions of this software are copyright the freetype project"),
    ("blessing", "may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("blessing", "the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("qpl-1.0", "this file is part of the qt toolkit and may be distributed under the terms of the q public license"),
    ("wxwindows", "wxwindows library licence version 3 1"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies"),
    ("intel", "the intel corporation makes no warranty of any kind with regard to this software"),
    ("sgi-b-2.0", "sgi free software license b version 2 0"),
    ("rpl-1.5", "reciprocal public license version 1 [15]"),
    ("tcl", "this software is copyrighted by the regents of the university of california sun microsystems"),
    ("spencer", "altered versions must be plainly marked as such and must not be misrepresented"),
    ("public-domain", "this work|software|file|code is in the public domain"),
    ("public-domain", "this work|software|file|code has been placed in the public domain"),
    ("public-domain", "the author|authors hereby? disclaims|disclaim copyright to this source code"),
    ("us-government", "this work was prepared by an? officer|employee of the united states government"),
    ("all-rights-reserved", "no part of this publication|document may be reproduced"),
    ("all-rights-reserved", "may not be published broadcast rewritten or redistributed"),
    ("proprietary", "this document|software contains confidential and proprietary information"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
    ("proprietary", "this software is furnished under a license agreement and may be used or copied only in accordance with the terms"),
    ("proprietary", "contains trade secrets and proprietary information"),
    ("proprietary", "end user license agreement"),
    ("shareware", "this program is shareware"),
    ("freeware", "this program|software is freeware"),
    ("research-only", "for non commercial research purposes only"),
    ("research-only", "may be used for academic and research purposes only"),
    ("evaluation-only", "for evaluation purposes only"),
    ("openrail", "use based restrictions as set forth in attachment a"),
    ("openrail-m", "creativeml open rail m"),
    ("llama", "llama [23] community license agreement"),
    ("dual", "dual licensed under the mit and gpl|apache licenses?"),
    ("dual", "licensed under either of apache license version 2 0 or mit license"),
)

#: Rules that name no licence.
OTHERS = (
    ("public-domain", 15, "domain", "public domain"),
    ("public-domain", 25, "domain", "released|dedicated|placed to|into|in the public domain"),
    ("all-rights-reserved", 15, "reserved", "all rights reserved"),
    ("proprietary", 15, "proprietary", "proprietary and confidential"),
    ("unknown-license", 1, "licensed", "licensed under"),
    ("unknown-license", 1, "license", "this work is licensed under"),
)

#: Names too short to stand alone: they need a form with more words.
_SHORT = frozenset(("mit", "expat", "isc", "x11", "bsd style?", "zlib|zlib/libpng libpng?", "osl version? v?3? 0?"))

#: Words by which signatures are taken, in order of choice.
KEYWORDS = ("license", "licence", "licensed", "licensee", "licensor", "licenses", "sublicense", "sublicensable", "permission", "permitted", "redistribution", "redistributions", "redistribute", "redistributed", "warranty", "warranties", "copyright", "copyrighted", "misrepresented", "verbatim", "domain", "creative", "creativecommons", "creativeml", "merchantability", "disclaims", "disclaimed", "endorse", "proprietary", "shareware", "freeware", "copyleft", "foundation", "apache", "openssl", "freebsd", "mozilla", "mulan", "libpng", "jpeg", "freetype", "cryptographic", "patent", "dealings", "consortium", "whatsoever", "advertising", "exemplary", "obligation", "derivative", "propagation", "consumer", "remotely", "invariant", "statically", "developer", "cddl", "compiled", "fuck", "retain", "font", "freely", "ssl", "california", "functionality", "hosted", "evil", "unmodified", "forgiveness", "government", "reproduced", "unauthorized", "research", "evaluation", "attachment")

#: What a text holds whenever its words hold one of these keywords, and a rule of it fits; others stand for themselves.
_RAW = {
    ("licens", "licenc"): ("license", "licence", "licensed", "gnu", "documentation", "mozilla", "eclipse", "common", "distribution", "artistic", "boost", "sil", "python", "php", "ruby", "european", "software", "academic", "microsoft", "ncsa", "postgresql", "openssl", "database", "dedication", "business", "server", "elastic", "w3c", "vim", "curl", "json", "permissive", "affero"),
    ("creative",): ("attribution", "sharealike", "share", "noncommercial", "non", "noderivatives", "zero"),
    ("cc",): ("cc",),
}


def pattern(words: str) -> str:
    """A rule's words as a pattern over laid out words."""
    out = []
    for word in words.split(" "):
        maybe = word.endswith("?") and not word.endswith("v?")
        body = word[:-1] if maybe else word
        out.append("(?: [^ ]+ ){1,6}?" if word == "<name>" else f"(?: (?:{body}) )?" if maybe else f" (?:{body}) ")
    return "".join(out)


def keyword(words: str) -> str:
    """The word of choice that a signature cannot do without."""
    plain = words.split(" ")
    return next(k for k in KEYWORDS if k in plain)


@functools.lru_cache(maxsize=1)
def rules() -> list[tuple[str, int, str, str]]:
    """label, priority, keyword, pattern of every rule, in order."""
    out = [(label, 50, keyword(words), pattern(words)) for label, words in SIGNATURES]
    for priority, form in FORMS:
        for label, word, name in NAMES:
            if form != "{}" or name not in _SHORT:
                out.append((label, priority, word, pattern(form.format(name))))
    return out + [(label, priority, word, pattern(words)) for label, priority, word, words in OTHERS]


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in word)


def _starts(words: set[str]) -> str:
    """A pattern of the words in either case that tries each letter once."""
    if "" in words:
        return ""
    parts = [_any_case(c) + _starts({w[1:] for w in words if w[0] == c}) for c in sorted({w[0] for w in words})]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


_EDGE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"


@functools.lru_cache(maxsize=1)
def gate() -> tuple[str, str, str]:
    """Three patterns: every text that any rule or phrase fits has the first, or the second and the third."""
    signed = {keyword(words) for _, words in SIGNATURES}
    raw: set[str] = set()
    for k in {word for _, _, word, _ in rules()} | {"apache"}:
        # what references hold besides their keyword; signatures hold theirs
        stands = [k] if k in signed else next((r for r, words in _RAW.items() if k in words), [k])
        raw |= {x for x in stands if x != "cc"}
    # names that are words of other kinds too: a reference to them says licence, or under
    alone = raw & {"mit", "expat", "isc", "x11", "zlib", "osl"}
    raw -= alone
    # keywords are whole words; the end of a short one is looked at too
    short = {k for k in raw if len(k) <= 4}
    ends = f"(?:{_EDGE}|$)"
    return f"{_EDGE}(?:{_starts(raw - short)}|[Cc][Cc]{_GAP}[Bb][Yy]|{_starts(short)}{ends})", f"{_EDGE}{_starts(alone)}{ends}", f"{_EDGE}{_any_case('under')}{ends}"


def _passes(text: Column) -> Column:
    """The patterns begin with what stands before a word, so the text gets a space in front."""
    first, *both = (F.rlike(F.concat(F.lit(" "), text), F.lit(p)) for p in gate())
    return first | (both[0] & both[1])


def _laid_out(text: Column) -> Column:
    words = F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "  ")
    return F.concat(F.lit(" "), F.translate(words, _UPPER, _LOWER), F.lit(" "))


def _words(text: Column) -> Column:
    """The number of words in a laid out stretch."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("int")


def _places(rule: Column, kind: str) -> Column:
    """Intervals of words that a rule matches."""
    w, p = F.col("w"), rule["pattern"]
    gaps, found = F.split(w, p, -1), F.regexp_extract_all(w, p, F.lit(0))
    at = running(F.transform(gaps, _words), F.transform(found, _words))
    return F.transform(at, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["n"].alias("n")).cast(kind))


def _matched(rows: list[tuple[str, int, str, str, int]], kind: str) -> Column:
    """What the rules match, taken by keyword. The rules are written as SQL, for the parser is quicker than hundreds of calls."""
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    groups = []
    for word, own in by.items():
        table = ", ".join(f"named_struct('label', {text(label)}, 'priority', {priority}, 'pattern', {text(p)}, 'n', {n})" for label, priority, _, p, n in own)
        groups.append(f"named_struct('keyword', {text(word)}, 'some', {text('|'.join(dict.fromkeys(r[3] for r in own)))}, 'rules', array({table}))")
    w = F.col("w")
    taken = F.filter(F.expr(f"array({', '.join(groups)})"), lambda g: F.contains(w, F.concat(F.lit(" "), g["keyword"], F.lit(" "))) & F.rlike(w, g["some"]))
    found = F.transform(taken, lambda g: F.flatten(F.transform(F.filter(g["rules"], lambda r: F.rlike(w, r["pattern"])), lambda r: _places(r, kind))))
    return F.when(w.isNotNull(), F.flatten(found)).otherwise(F.array().cast(f"array<{kind}>"))


def _stays(d: Column, all_: Column) -> Column:
    over = (all_["s"] < d["e"]) & (d["s"] < all_["e"])
    inside = (all_["s"] <= d["s"]) & (d["e"] <= all_["e"])
    larger = (all_["e"] - all_["s"] > d["e"] - d["s"]) | (all_["n"] < d["n"])
    return (over & (all_["priority"] > d["priority"])) | (inside & larger & (all_["priority"] == d["priority"]))


def _unsuppressed(found: Column) -> Column:
    """Detections that no other one suppresses; each stretch of the text is compared with what reaches into it."""

    def stretch(b: Column) -> Column:
        # a detection is shorter than a stretch: what starts in this one ends in the next at the latest
        near = F.filter(found, lambda x: (F.floor(x["s"] / STRETCH) <= b + 1) & (F.floor((x["e"] - 1) / STRETCH) >= b))
        # bound to a name by an array of one
        return F.flatten(F.transform(F.array(near), lambda own: F.filter(own, lambda x: (F.floor(x["s"] / STRETCH) == b) & ~F.exists(own, lambda y: _stays(x, y)))))

    last = F.floor(F.array_max(F.transform(found, lambda x: x["e"])) / STRETCH)
    return F.when(F.size(found) > 0, F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), last), stretch))).otherwise(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns and the detections that stay."""
    kind = "struct<s:int,e:int,label:string,priority:int,n:int>"
    base_rules = [(label, 0, phrase.split(" ")[0], pattern(phrase), n) for n, (phrase, label) in enumerate(BASE)]
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("doc_id", F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"), F.when(_passes(F.col("t")), _laid_out(F.col("t"))).alias("w"))
    d = d.select("doc_id", "n_words", _matched(base_rules, kind).alias("base"), _matched([(*r, n) for n, r in enumerate(rules())], kind).alias("found"))
    d = d.select("doc_id", "n_words", "base", _unsuppressed(F.col("found")).alias("detections"))
    labels = lambda c: F.transform(c, lambda x: x["label"])
    covered = F.aggregate("detections", F.lit(0), lambda a, x: a + x["e"] - x["s"])
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["s"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels("base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels("base"), labels("detections")))), ",").alias("labels"),
        F.when(F.col("n_words") > 0, F.least(F.lit(1.0), covered / F.col("n_words"))).otherwise(0.0).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    table = [(label, 0, phrase.split(" ")[0], pattern(phrase), -1 - n) for n, (phrase, label) in enumerate(BASE)] + [(*r, n) for n, r in enumerate(rules())]
    values = ", ".join(f"({q(a)}, {b}, {q(c)}, {q(p)}, {n})" for a, b, c, p, n in table)
    words = "CAST((len({0}) - len(replace({0}, ' ', ''))) // 2 AS BIGINT)".format
    return f"""
        WITH r(label, priority, keyword, pattern, n) AS (VALUES {values}),
        d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {q(WORD)}) AS a, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, ' ' || translate(array_to_string(a, '  '), '{_UPPER}', '{_LOWER}') || ' ' AS w FROM d),
        f AS (SELECT doc_id, label, priority, n, string_split_regex(w, pattern) AS g, regexp_extract_all(w, pattern) AS m FROM w, r WHERE contains(w, ' ' || keyword || ' ') AND regexp_matches(w, pattern)),
        u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
        p AS (SELECT doc_id, label, priority, n, {words('m[i]')} AS size,
                     CAST(list_sum(list_transform(g[1:i], lambda x: {words('x')})) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: {words('x')})), 0) AS BIGINT) AS s FROM u),
        k AS (SELECT * FROM p x WHERE n >= 0 AND NOT EXISTS (SELECT 1 FROM p y WHERE y.doc_id = x.doc_id AND y.n >= 0 AND y.s < x.s + x.size AND x.s < y.s + y.size AND (
                  y.priority > x.priority OR (y.priority = x.priority AND y.s <= x.s AND x.s + x.size <= y.s + y.size AND (y.size > x.size OR y.n < x.n))))),
        b AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p WHERE n < 0 GROUP BY doc_id),
        l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, sum(size) FILTER (n >= 0) AS covered FROM (SELECT * FROM k UNION ALL SELECT * FROM p WHERE n < 0) GROUP BY doc_id)
        SELECT d.doc_id, len(a) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, CASE WHEN len(a) > 0 THEN least(1.0::DOUBLE, coalesce(covered, 0)::DOUBLE / len(a)) ELSE 0.0::DOUBLE END AS score
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)"""
