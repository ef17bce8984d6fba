"""License scans: ordered signature rules behind a keyword prefilter.

A text becomes its lower-case words with single spaces between. One pass over it finds keywords, each a run of words that
its rules cannot do without; only the rules of keywords found are run. Rules are bodies and notices of licenses, titles,
sentences that refer to a license by name, and license identifiers, whose expressions give a detection for each identifier
in them. Detections are taken by priority, then length, then place; one that lies within a taken one is suppressed. The
base phrases are rules of the highest priority, so their labels always stay.

A null or empty text has no words and no labels. Equal detections of one label count once. Rows that repeat are scanned one
by one. Time grows with a text's length and its detections: places are looked up by halving, and taken detections that
may contain others are kept in order of their starts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Signatures, in order of priority within their section: label, keyword, pattern over words. A pattern may hold more than
#: its keyword on both sides.
BODIES = [
    ("mit", "any person obtaining a copy of this software and associated documentation files", "permission is hereby granted(?: free of charge)? to any person obtaining a copy of this software and associated documentation files(?: the software)?(?: to deal in the software without restriction)?"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "(?:subject to the following conditions )?the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("mit-0", "mit no attribution", "mit no attribution"),
    ("x11", "shall not be used in advertising or otherwise to promote the sale", "except as contained in this notice the names? of (?:[^ ]+ ){1,12}shall not be used in advertising or otherwise to promote the sale"),
    ("isc", "and this permission notice appear in all copies", "permission to use copy modify(?: and or| and)? distribute this software(?: and its documentation)? for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "for any purpose with or without fee is hereby granted the software is provided", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd-4-clause", "mentioning features or use of this software must display the following acknowledg", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software", "neither the names? of (?:[^ ]+ ){1,14}may be used to endorse or promote products derived from this software(?: without specific prior written permission)?"),
    ("bsd-3-clause", "the names of its contributors may be used to endorse or promote products", "the names of its contributors may be used to endorse or promote products"),
    ("bsd-2-clause", "with the distribution this software is provided by", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license|subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide"),
    ("apache-2", "you may not use this file except in compliance with the license", "(?:licensed under the apache license version 2 0 the license )?you may not use this file except in compliance with the license"),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-1", "developed by the apache group for use in the apache http server project", "this product includes software developed by the apache group for use in the apache http server project"),
    ("gpl-1", "gnu general public license as published by the free software foundation either version 1", "(?:this (?:program|software|file|library) is free software )?(?:you can redistribute it and or modify it under the terms of )?the gnu general public license as published by the free software foundation either version 1"),
    ("gpl-2-or-later", "either version 2 of the license or at your option any later version", "(?:under the terms of )?the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2", "gnu general public license version 2 as published by", "(?:under the terms of )?the gnu general public license version 2(?: only)? as published by the free software foundation"),
    ("gpl-2", "gnu general public license as published by the free software foundation version 2", "the gnu general public license as published by the free software foundation version 2"),
    ("gpl-3-or-later", "either version 3 of the license or at your option any later version", "(?:under the terms of )?the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "gnu general public license as published by the free software foundation version 3", "the gnu general public license as published by the free software foundation version 3"),
    ("lgpl-3-or-later", "gnu lesser general public license as published by the free software foundation either version 3", "the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "gnu lesser general public license as published by the free software foundation either version 2 1", "the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-2-or-later", "gnu library general public license as published by the free software foundation either version 2", "the gnu library general public license as published by the free software foundation either version 2(?: of the license or at your option any later version)?"),
    ("agpl-3-or-later", "gnu affero general public license as published by the free software foundation either version 3", "the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license(?: version 1 [123])?"),
    ("gpl", "this program is free software you can redistribute it and or modify", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license", "you should have received a copy of the gnu general public license along with this (?:program|software|file|library)"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", "you should have received a copy of the gnu lesser general public license along with this (?:program|software|file|library)"),
    ("agpl", "you should have received a copy of the gnu affero general public license", "you should have received a copy of the gnu affero general public license along with this (?:program|software|file)"),
    ("gpl", "the licenses for most software are designed to take away your freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-3", "incorporates the terms and conditions of version 3 of the gnu general public license", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3", "specifically designed to ensure cooperation with the community in the case of network server software", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("classpath-exception", "as a special exception the copyright holders of this library give you permission to link this library", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gcc-exception", "gcc runtime library exception", "gcc runtime library exception(?: version 3 1)?"),
    ("llvm-exception", "llvm exceptions to the apache 2 0 license", "llvm exceptions to the apache 2 0 license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0(?: if a copy of the mpl was not distributed with this file)?"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1", "the contents of this file are subject to the mozilla public license version 1 0", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl-1.1", "the contents of this file are subject to the netscape public license", "the contents of this file are subject to the netscape public license(?: version 1 1)?"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-2", "made available under the terms of the eclipse public license v 2 0", "(?:this program and the accompanying materials are )?made available under the terms of the eclipse public license v 2 0"),
    ("epl-1", "made available under the terms of the eclipse public license v1 0", "(?:this program and the accompanying materials are )?made available under the terms of the eclipse public license v1 0"),
    ("edl-1", "made available under the terms of the eclipse distribution license", "made available under the terms of the eclipse distribution license(?: v ?1 0)?"),
    ("cpl-1", "made available under the terms of the common public license", "made available under the terms of the common public license(?: v ?1 0)?"),
    ("cddl-1", "subject to the terms of the common development and distribution license", "subject to the terms of the common development and distribution license(?: version 1 [01])?"),
    ("cddl-1", "you may not use this file except in compliance with the license you can obtain a copy of the license at usr src opensolaris license", "you may not use this file except in compliance with the license you can obtain a copy of the license at usr src opensolaris license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "changing it is allowed as long as the name is changed", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("wtfpl", "you just do what the fuck you want to", "0 you just do what the fuck you want to"),
    ("cc0-1", "the person who associated a work with this deed has dedicated the work to the public domain", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("pddl-1", "the licensor hereby dedicates the work to the public domain", "the licensor hereby dedicates the work to the public domain"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "(?:this software is provided as is without any express or implied warranty )?in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "the origin of this software must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1", "any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1", "distributed under the boost software license", "distributed under the boost software license version 1 0"),
    ("ncsa", "to deal with the software without restriction", "to deal with the software without restriction including without limitation the rights to use copy modify merge"),
    ("postgresql", "for any purpose without fee and without a written agreement is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "for any purpose and without fee is hereby granted provided that the above copyright notice appear", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appears? in all copies"),
    ("json", "the software shall be used for good not evil", "the software shall be used for good not evil"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("openssl", "for use in the openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "this product includes cryptographic software written by eric young", "this product includes cryptographic software written by eric young"),
    ("psf-2", "psf hereby grants licensee a nonexclusive royalty free", "psf hereby grants licensee a nonexclusive royalty free world ?wide license to reproduce analyze test"),
    ("php-3", "products derived from this software may not be called php", "products derived from this software may not be called php"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction", "you may make and give away verbatim copies of the source form of the software without restriction provided that you"),
    ("artistic-1", "the intent of this document is to state the conditions under which a package may be copied", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "this license establishes the terms under which a given free software package may be copied", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("ofl-1.1", "the goals of the open font license", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("ofl-1.1", "this font software is licensed under the sil open font license", "this font software is licensed under the sil open font license(?: version 1 1)?"),
    ("odbl-1", "is made available under the open database license", "is made available under the open database license"),
    ("odc-by-1", "is made available under the open data commons attribution license", "is made available under the open data commons attribution license"),
    ("sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", "you may not provide the software to third parties as a hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("ms-pl", "if you use the software you accept this license if you do not accept the license do not use the software", "this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software"),
    ("blueoak-1", "everyone as much permission to work with this software as possible", "this license gives everyone as much permission to work with this software as possible while protecting contributors from liability"),
    ("upl-1", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied including but not limited to the warranties", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied including but not limited to the warranties"),
    ("w3c", "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted", "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("eupl-1.2", "licensed under the eupl version 1 2", "licensed under the eupl version 1 2"),
    ("eupl-1.1", "licensed under the eupl version 1 1", "licensed under the eupl version 1 1"),
    ("cecill-2", "this software is governed by the cecill license under french law", "this software is governed by the cecill license under french law"),
    ("mulan-psl-2", "is licensed under mulan psl v2", "(?:[^ ]+ )is licensed under mulan psl v2"),
    ("osl-3", "licensed under the open software license version 3 0", "licensed under the open software license version 3 0"),
    ("afl-3", "licensed under the academic free license version 3 0", "licensed under the academic free license version 3 0"),
    ("bigscience-openrail-m", "use based restrictions as referenced in", "use based restrictions as referenced in (?:paragraph 5|attachment a)"),
    ("llama-community", "llama materials", "(?:by using or distributing any portion or element of the llama materials|llama materials)"),
    ("proprietary", "this software is the confidential and proprietary information of", "this software is the confidential and proprietary information of"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "no part of this publication may be reproduced", "no part of this publication may be reproduced(?: distributed or transmitted| stored in a retrieval system)"),
    ("public-domain", "public domain", "(?:dedicated to|released into|placed in|hereby in|is in) the public domain"),
    ("all-rights-reserved", "all rights reserved", "copyright (?:c )?[0-9]{4}(?: [^ ]+){1,6} all rights reserved"),
]
#: Titles, as license files begin.
TITLES = [
    ("mit", "mit licen", "(?:the )?mit licen[sc]e(?: mit)?"),
    ("isc", "isc license", "(?:the )?isc license(?: isc)?"),
    ("0bsd", "zero clause bsd license", "(?:bsd )?zero clause bsd license"),
    ("bsd-2-clause", "2 clause license", "(?:the )?(?:simplified )?bsd 2 clause license"),
    ("bsd-3-clause", "3 clause license", "(?:the )?bsd 3 clause license"),
    ("bsd-4-clause", "4 clause license", "(?:the )?bsd 4 clause license"),
    ("apache-2", "apache license version 2 0 january 2004", "apache license version 2 0 january 2004"),
    ("apache-1.1", "apache software license version 1 1", "(?:the )?apache software license version 1 1"),
    ("gpl-1", "gnu general public license version 1 february 1989", "gnu general public license version 1 february 1989"),
    ("gpl-2", "gnu general public license version 2 june 1991", "gnu general public license version 2 june 1991"),
    ("gpl-3", "gnu general public license version 3 29 june 2007", "gnu general public license version 3 29 june 2007"),
    ("lgpl-2", "gnu library general public license version 2 june 1991", "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("gfdl-1.1", "gnu free documentation license version 1 1", "gnu free documentation license version 1 1"),
    ("gfdl-1.2", "gnu free documentation license version 1 2", "gnu free documentation license version 1 2"),
    ("gfdl-1.3", "gnu free documentation license version 1 3", "gnu free documentation license version 1 3(?: 3 november 2008)?"),
    ("mpl-1.1", "mozilla public license version 1 1", "mozilla public license version 1 1"),
    ("mpl-2", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("epl-1", "eclipse public license v 1 0", "eclipse public license v 1 0"),
    ("epl-2", "eclipse public license v 2 0", "eclipse public license v 2 0"),
    ("eupl-1.2", "european union public licence v 1 2", "european union public licence v 1 2(?: eupl)?"),
    ("eupl-1.1", "european union public licence v 1 1", "european union public licence v 1 1(?: eupl)?"),
    ("cddl-1.0", "common development and distribution license cddl version 1 0", "common development and distribution license cddl version 1 0"),
    ("cddl-1.1", "common development and distribution license cddl version 1 1", "common development and distribution license cddl version 1 1"),
    ("cpl-1", "common public license version 1 0", "common public license version 1 0"),
    ("bsl-1", "boost software license version 1 0 17th august 2003", "boost software license version 1 0 17th august 2003"),
    ("busl-1.1", "business source license 1 1", "business source license 1 1"),
    ("sspl-1", "server side public license version 1 october 16 2018", "server side public license version 1 october 16 2018"),
    ("artistic-2", "the artistic license 2 0", "the artistic license 2 0"),
    ("artistic-1", "the artistic license preamble", "the artistic license preamble"),
    ("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to public license(?: version 2(?: december 2004)?)?"),
    ("psf-2", "python software foundation license version 2", "python software foundation license version 2"),
    ("php-3", "the php license version 3", "the php license version 3 0[01]?"),
    ("ncsa", "ncsa open source license", "university of illinois ncsa open source license"),
    ("ofl-1.1", "sil open font license version 1 1 26 february 2007", "sil open font license version 1 1 26 february 2007"),
    ("odbl-1", "odc open database license", "odc open database license(?: odbl)?"),
    ("odc-by-1", "odc attribution license", "odc attribution license(?: odc by)?"),
    ("pddl-1", "public domain dedication and license pddl", "public domain dedication and license pddl"),
    ("cc0-1", "cc0 1 0 universal", "(?:creative commons )?cc0 1 0 universal"),
    ("ms-pl", "microsoft public license ms pl", "microsoft public license ms pl"),
    ("ms-rl", "microsoft reciprocal license ms rl", "microsoft reciprocal license ms rl"),
    ("apsl-2", "apple public source license", "apple public source license(?: ver(?:sion)? 2 0)?"),
    ("afl-3", "academic free license afl v 3 0", "academic free license afl v 3 0"),
    ("osl-3", "open software license osl v 3 0", "open software license osl v 3 0"),
    ("ecl-2", "educational community license version 2 0", "educational community license version 2 0"),
    ("upl-1", "the universal permissive license upl version 1 0", "the universal permissive license upl version 1 0"),
    ("elastic-2", "elastic license 2 0", "elastic license 2 0"),
    ("blueoak-1", "blue oak model license version 1 0 0", "blue oak model license version 1 0 0"),
    ("mulan-psl-2", "mulan permissive software license version 2", "mulan permissive software license version 2"),
    ("cecill-2.1", "cecill free software license agreement", "cecill free software license agreement"),
    ("polyform-noncommercial", "polyform noncommercial license", "polyform noncommercial license(?: 1 0 0)?"),
    ("polyform-small-business", "polyform small business license", "polyform small business license(?: 1 0 0)?"),
    ("openrail", "open rail", "(?:creativeml |bigscience |bigcode )?open rail(?: [ms])?(?: license)?"),
    ("llama-community", "community license agreement", "(?:meta )?llama [234](?: [0-9])? (?:version release date )?community license agreement"),
]

#: What follows a license that isn't one of software: a title before one of these words is no title.
OTHERS = "plates?|keys?|numbers?|fees?|servers?|holders?|renewals?|disks?|frames?"

#: Names of licenses as they stand in running text (a regular expression over words) and their identifiers as words. The
#: keywords of a name are what its pattern cannot do without.
NAMES = {
    "mit": ("(?:mit|x11 mit)", "mit"),
    "mit-0": ("mit no attribution", "mit 0"),
    "x11": ("x11", "x11"),
    "isc": ("isc", "isc"),
    "apache-1": ("apache(?: software)?(?: license)?(?: version)? 1(?: [01])?", "apache 1 [01]"),
    "apache-2": ("apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache 2 0"),
    "bsd-1-clause": ("bsd 1 clause", "bsd 1 clause"),
    "bsd-2-clause": ("(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", "bsd 2 clause"),
    "bsd-3-clause": ("(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", "bsd 3 clause"),
    "bsd-4-clause": ("(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)", "bsd 4 clause"),
    "0bsd": ("(?:zero clause bsd|0 clause bsd|0bsd)", "0bsd"),
    "gpl-1": ("(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)?1(?: 0)?", "gpl 1 0"),
    "gpl-2": ("(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)?2(?: 0)?", "gpl 2 0"),
    "gpl-3": ("(?:gnu )?(?:general public license|gpl) ?(?:version |v ?)?3(?: 0)?", "gpl 3 0"),
    "lgpl-2": ("(?:gnu )?(?:library general public license|lgpl) ?(?:version |v ?)?2(?: 0)?", "lgpl 2 0"),
    "lgpl-2.1": ("(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v ?)?2 1", "lgpl 2 1"),
    "lgpl-3": ("(?:gnu )?(?:lesser general public license|lgpl) ?(?:version |v ?)?3(?: 0)?", "lgpl 3 0"),
    "agpl-3": ("(?:gnu )?(?:affero general public license|agpl) ?(?:version |v ?)?3(?: 0)?", "agpl 3 0"),
    "gfdl-1": ("(?:gnu )?(?:free documentation license|gfdl)", "gfdl 1 [123]"),
    "mpl-1": ("(?:mozilla public license|mpl) ?(?:version |v ?)?1(?: [01])?", "mpl 1 [01]"),
    "mpl-2": ("(?:mozilla public license|mpl) ?(?:version |v ?)?2(?: 0)?", "mpl 2 0"),
    "epl-1": ("(?:eclipse public license|epl) ?(?:version |v ?)?1(?: 0)?", "epl 1 0"),
    "epl-2": ("(?:eclipse public license|epl) ?(?:version |v ?)?2(?: 0)?", "epl 2 0"),
    "eupl-1.1": ("(?:european union public licence|eupl) ?(?:version |v ?)?1 1", "eupl 1 1"),
    "eupl-1.2": ("(?:european union public licence|eupl) ?(?:version |v ?)?1 2", "eupl 1 2"),
    "cddl-1": ("(?:common development and distribution license|cddl)", "cddl 1 [01]"),
    "cpl-1": ("(?:common public license|cpl) ?(?:version |v ?)?1(?: 0)?", "cpl 1 0"),
    "bsl-1": ("boost software license", "bsl 1 0"),
    "busl-1.1": ("business source license", "busl 1 1"),
    "sspl-1": ("server side public license", "sspl 1 0"),
    "artistic-1": ("artistic license 1 0", "artistic 1 0"),
    "artistic-2": ("artistic license 2 0", "artistic 2 0"),
    "zlib": ("(?:zlib|zlib libpng)", "zlib"),
    "unlicense": ("(?:the )?unlicense", "unlicense"),
    "wtfpl": ("(?:wtfpl|do what the fuck you want to public license)", "wtfpl"),
    "psf-2": ("(?:python software foundation license|psf)", "psf 2 0"),
    "php-3": ("php license(?: version)? 3(?: 0[01]?)?", "php 3 0[01]?"),
    "ruby": ("ruby", "ruby"),
    "openssl": ("openssl", "openssl"),
    "postgresql": ("postgresql", "postgresql"),
    "ncsa": ("(?:university of illinois ncsa open source|ncsa)", "ncsa"),
    "ofl-1.1": ("(?:sil )?open font license", "ofl 1 1"),
    "odbl-1": ("open database license", "odbl 1 0"),
    "odc-by-1": ("open data commons attribution", "odc by 1 0"),
    "pddl-1": ("public domain dedication and license", "pddl 1 0"),
    "cc0-1": ("(?:cc0|creative commons zero)(?: 1 0)?", "cc0 1 0"),
    "ms-pl": ("(?:microsoft public license|ms pl)", "ms pl"),
    "ms-rl": ("(?:microsoft reciprocal license|ms rl)", "ms rl"),
    "apsl-2": ("apple public source license", "apsl 2 0"),
    "afl-3": ("academic free license", "afl 3 0"),
    "osl-3": ("open software license", "osl 3 0"),
    "ecl-2": ("educational community license", "ecl 2 0"),
    "vim": ("vim", "vim"),
    "curl": ("curl", "curl"),
    "elastic-2": ("elastic license(?: 2 0)?", "elastic 2 0"),
    "cecill-2": ("cecill", "cecill 2 [01]"),
    "blueoak-1": ("blue oak model license", "blueoak 1 0 0"),
    "mulan-psl-2": ("mulan (?:permissive software license|psl)", "mulanpsl 2 0"),
    "upl-1": ("universal permissive license", "upl 1 0"),
    "w3c": ("w3c software(?: notice and)?", "w3c"),
}
#: Creative Commons licenses are made from their elements and versions.
CC_ELEMENTS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_LONG = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Exceptions that stand after "with" in an expression of identifiers.
EXCEPTIONS = ("classpath exception 2 0", "gcc exception 3 1", "llvm exception", "font exception 2 0", "autoconf exception 3 0", "bison exception 2 2", "openssl exception", "linux syscall note")

_UNDER = "(?:licensed|released|distributed|published|available|provided|redistributed|shared) under (?:the )?(?:terms of )?(?:the )?"


class Rule(NamedTuple):
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int
    score: float


def branches(pattern: str) -> list[str]:
    """The alternatives that a name may begin with, an optional first word aside."""
    pattern = re.sub(r"^\(\?:\w+ \)\?", "", pattern)
    return pattern[3 : pattern.index(")")].split("|") if pattern.startswith("(?:") else [pattern]


@cache
def rules() -> tuple[Rule, ...]:
    """The signature rules in order; what refers to a license by name is written out for each name."""
    out = []

    def add(label: str, pattern: str, keywords: tuple[str, ...], priority: int, score: float) -> None:
        out.append(Rule(label, re.compile(f"(?<= )(?:{pattern})(?= )"), keywords, priority, score))

    for phrase, label in BASE.items():
        add(label, phrase, (f" {phrase} ",), 100, 1.0)
    for label, keyword, pattern in BODIES:
        add(label, pattern, (f" {keyword}",), 80, 0.95)
    for label, keyword, pattern in TITLES:
        add(label, f"{pattern}(?! (?:{OTHERS}) )", (f" {keyword}",), 60, 0.8)
    for label, (name, ident) in NAMES.items():
        # the literal words that begin an alternative; a regular expression's signs end them
        keywords = tuple(sorted({" " + re.split(r"[(?\[\\]", b)[0].rstrip() for b in branches(name)}))
        add(label, f"{_UNDER}{name}(?: or later| or any later version| only)?(?: licen[sc]e)?", keywords, 50, 0.9)
        add(label, f"(?:this|the) {name} licen[sc]e (?:applies|governs|agreement|text|file)", keywords, 45, 0.8)
        add(label, f"licen[sc]e(?:d)? (?:is |as )?(?:the )?{name} licen[sc]e", keywords, 40, 0.7)
        begin = ident.split("[")[0].rstrip()
        add(label, f"licen[sc]e {ident}(?: or later| only)", (f" license {begin}", f" licence {begin}"), 35, 0.6)
    for elements in CC_ELEMENTS:
        label = "cc-" + elements.replace(" ", "-")
        long = " ".join(CC_LONG[e] for e in elements.split())
        for version in CC_VERSIONS:
            tail = f"{label}-{version.replace(' ', '.')}"
            add(tail, f"cc {elements} {version}", (f" cc {elements} {version} ",), 58, 0.9)
            add(tail, f"creative commons {long} {version}(?: international| unported| generic)?", (" creative commons attribution",), 58, 0.9)
            add(tail, f"creativecommons org licenses {elements} {version}", (f" creativecommons org licenses {elements} {version} ",), 58, 0.95)
        add(label, f"creative commons {long} licen[sc]e", (" creative commons attribution",), 52, 0.8)
    add("cc0-1", "creativecommons org publicdomain zero 1 0", (" creativecommons org publicdomain zero ",), 58, 0.95)
    return tuple(sorted(out, key=lambda r: -r.priority))


_IDENTIFIER = " spdx license identifier "
#: Priority of what an expression of identifiers says; it stands among bodies and above names.
_SPDX = (90, 1.0)


@cache
def identifiers() -> tuple[re.Pattern, dict[str, str]]:
    """What matches one identifier at a place, longest first, and the label of each group."""
    table = {ident: label for label, (_, ident) in NAMES.items()}
    for elements in CC_ELEMENTS:
        table |= {f"cc {elements} {v}": f"cc-{elements.replace(' ', '-')}-{v.replace(' ', '.')}" for v in CC_VERSIONS}
    table |= {"lgpl 2 1": "lgpl-2.1", "bsd 3 clause clear": "bsd-3-clause-clear", "json": "json", "beerware": "beerware", "hpnd": "hpnd"}
    table |= {e: e.replace(" ", "-") for e in EXCEPTIONS}
    by_length = sorted(table, key=lambda i: (-len(i), i))
    groups = {f"g{k}": table[i] for k, i in enumerate(by_length)}
    one = "|".join(f"(?P<g{k}>{i})" for k, i in enumerate(by_length))
    return re.compile(f"(?:{one})(?: or later| only| plus)?(?= )"), groups


#: An identifier that isn't known has this many words at most.
UNKNOWN = re.compile(r"(?:[^ ]+ ){0,7}?[^ ]+(?= (?:and|or|with) )")
_JOINED = re.compile(" (?:and|or|with) ")


def expression(line: str, at: int) -> list[tuple[int, int, str]]:
    """The identifiers of an expression that begins at ``at``: start, end, label. Parentheses are no words; identifiers are
    joined by and, or, with; an unknown one, of up to eight words, is passed over up to the next of these words."""
    pattern, groups = identifiers()
    out = []
    while True:
        m = pattern.match(line, at)
        if m:
            out.append((m.start(), m.end(), groups[m.lastgroup]))
        passed = m if m and _JOINED.match(line, m.end()) else UNKNOWN.match(line, at)
        if not passed:
            return out
        at = _JOINED.match(line, passed.end()).end()


#: A field that names a license, as manifests and headers have it; what its value is, is read as an expression.
FIELD = re.compile(r"""\blicen[sc]e(?:[ _-]?(?:id|name|expression|type))?["']?[ \t]*[:=]+[ \t]*["'\[{( \t]*(?=[A-Za-z0-9])""", re.IGNORECASE | re.ASCII)
_FIELDS = (" license ", " licence ")
_FIELD = (55, 0.85)


def fields(text: str) -> list[int]:
    """For each license field of ``text`` how many words come before its value."""
    out, words, at = [], 0, 0
    for m in FIELD.finditer(text):
        # what lies between two values holds whole words, since a value begins one
        words += len(text[at : m.end()].encode().translate(_TABLE).split())
        at = m.end()
        out.append(words)
    return out


@cache
def prefilter():
    """Finds which keywords stand in a text, in one pass, and the rules that each opens."""
    import ahocorasick

    found, by = ahocorasick.Automaton(), {}
    for i, r in enumerate(rules()):
        for keyword in r.keywords:
            by.setdefault(keyword, []).append(i)
    by[_IDENTIFIER] = [-1]
    for word in _FIELDS:
        by.setdefault(word, []).append(-2)
    for word, which in by.items():
        found.add_word(word, tuple(which))
    found.make_automaton()
    return found


#: Letters and digits stay, capitals become small, other ASCII characters part words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def suppress(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Those of ``found`` (priority, start, end, label, score) that don't lie within one of a higher rank: by priority, then
    length, then place. ``starts`` and ``ends`` hold the outermost taken ones, both in rising order, so that of those that
    start no later the last one reaches furthest."""
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for one in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        priority, start, end, *_ = one
        i = bisect_right(starts, start)
        inside = i > 0 and ends[i - 1] >= end
        if inside and priority < 100:
            continue
        kept.append(one)
        if inside:
            continue
        if i and starts[i - 1] == start:
            i -= 1
        j = i
        while j < len(ends) and ends[j] <= end:
            j += 1
        starts[i:j], ends[i:j] = [start], [end]
    return kept


def scan(text: str | None) -> tuple:
    """What OUT has of one text, without its doc_id."""
    words = (text or "").encode().translate(_TABLE).split()
    line = (b" " + b" ".join(words) + b" ").decode()
    which = {i for _, some in prefilter().iter(line) for i in some}
    if not which:
        return len(words), 0, None, None, "", "", 0.0, ""
    table = rules()
    found = []
    for i in sorted(which - {-1, -2}):
        r = table[i]
        found += [(r.priority, m.start(), m.end(), r.label, r.score) for m in r.pattern.finditer(line)]
    if -1 in which:
        at = line.find(_IDENTIFIER)
        while at >= 0:
            at += len(_IDENTIFIER)
            found += [(_SPDX[0], a, b, label, _SPDX[1]) for a, b, label in expression(line, at)]
            at = line.find(_IDENTIFIER, at - 1)
    begins = list(accumulate((len(w.decode()) + 1 for w in words), initial=1))
    if -2 in which:
        found += [(_FIELD[0], a, b, label, _FIELD[1]) for k in fields(text) for a, b, label in expression(line, begins[k])]
    kept = suppress(found)
    place = lambda at: bisect_right(begins, at) - 1
    base = [d for d in found if d[0] == 100]
    labels = sorted({d[3] for d in kept})
    spans = ",".join(f"{label}:{place(at)}" for at, label in sorted({(d[1], d[3]) for d in kept}))
    best = max((d[4] for d in kept), default=0.0)
    edges = (place(min(d[1] for d in base)), place(max(d[1] for d in base))) if base else (None, None)
    return len(words), len(base), *edges, ",".join(sorted({d[3] for d in base})), ",".join(labels), best, spans


def detect(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text); see OUT. ``detections`` has label:word, by place."""
    columns = [x.split()[0] for x in OUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            frame = pd.DataFrame([(None, *scan(t)) for t in b["text"]], columns=columns)
            frame["doc_id"] = b["doc_id"].to_numpy()
            for c in ("doc_id", "first_word", "last_word"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return docs.select("doc_id", "text").mapInPandas(run, OUT)
