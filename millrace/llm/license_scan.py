"""License scans by ordered signature rules, with SQL functions only.

A text becomes its words joined by single spaces. `SIGNATURES` are hand-written regexes over that line, in tiers of
priority: sentences of license texts, identifiers, addresses, names with versions, names, notices. A text that holds no
keyword of any rule (`GATE`, made from the keywords) is not looked at further, and a rule runs only if a literal of one
of its keywords occurs.

Detections are resolved rule by rule, highest priority first, then in the order of the rules: the words of a rule's matches are
taken, and a later rule matches only among the words that are left. So whatever lies within, or overlaps, the stretch of
a detection of higher rank is suppressed, whichever of the two begins first. Rules of one tier are in the order of their
specificity, so a name within a longer name goes too.

Defined results. Null text has no words, no labels and score 0. Repeated rows each give a row. A null doc_id is kept.
Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secret_scan import let, plus, running

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Rules by priority, highest first, then in their order: (label, keywords parted by "|", regex). A regex is over whole
#: words; `LICENSE` and `V` stand for ways of writing "license" and "version". Every match holds one of the keywords.
LICENSE = "licen[cs]es?"
V = "(?:(?:version|ver|v) ?)?"
SIGNATURES = (
    # sentences of the license texts themselves
    (9, 1.0, (
        ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
        ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("mit-0", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
        ("x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", "except as contained in this notice the names? of [^ ]+(?: [^ ]+){0,8} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
        ("isc", "permission to use copy modify and", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
        ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
        ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
        ("bsd-3-clause", "may be used to endorse", "neither the names? of [^ ]+(?: [^ ]+){0,12} nor the names of (?:its|their|any|the) contributors may be used to endorse"),
        ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "all advertising materials mentioning features or use of this software must display"),
        ("bsd-2-clause-patent", "hereby grants to those receiving rights under this license", "each copyright holder and contributor hereby grants to those receiving rights under this license"),
        ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license", "no express or implied licenses to any party s patent rights are granted by this license"),
        ("gpl-1.0", "free software foundation either version 1", "it under the terms of the gnu general public license as published by the free software foundation either version 1 or"),
        ("gpl-2.0", "free software foundation either version 2 of the license", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
        ("gpl-3.0", "free software foundation either version 3 of the license", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
        ("agpl-3.0", "it under the terms of the gnu affero general public license", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
        ("lgpl-2.1", "it under the terms of the gnu lesser general public license", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
        ("lgpl-3.0", "it under the terms of the gnu lesser general public license", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
        ("lgpl-2.0", "it under the terms of the gnu library general public license", "it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license"),
        ("gpl", "this program is free software you can redistribute it", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
        ("lgpl", "this library is free software you can redistribute it", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
        ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
        ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it", "the licenses for most software are designed to take away your freedom to share and change it"),
        ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", "the gnu general public license is a free copyleft license for software and other kinds of works"),
        ("agpl-3.0", "the gnu affero general public license is a free copyleft license", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
        ("lgpl-2.1", "this is the first released version of the lesser gpl", "this is the first released version of the lesser gpl"),
        ("lgpl-2.0", "this is the first released version of the library gpl", "this is the first released version of the library gpl"),
        ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
        ("apache-2.0", "you may not use this file except in compliance with the license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
        ("apache-2.0", "licenses this file to you under the apache license", "licenses this file to you under the apache license version 2 0"),
        ("apache-2.0", "terms and conditions for use reproduction and distribution", "apache license version 2 0 january 2004(?: [^ ]+){0,8} terms and conditions for use reproduction and distribution"),
        ("apache-1.1", "this product includes software developed by the apache software foundation", "this product includes software developed by the apache software foundation"),
        ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
        ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
        ("mpl-1.0", "the contents of this file are subject to the mozilla public license version 1 0", "the contents of this file are subject to the mozilla public license version 1 0"),
        ("npl", "the contents of this file are subject to the netscape public license", "the contents of this file are subject to the netscape public license"),
        ("epl-2.0", "made available under the terms of the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
        ("epl-1.0", "made available under the terms of the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
        ("epl", "the accompanying program is provided under the terms of this eclipse public license", "the accompanying program is provided under the terms of this eclipse public license"),
        ("cpl-1.0", "the accompanying program is provided under the terms of this common public license", "the accompanying program is provided under the terms of this common public license"),
        ("eupl", "licensed under the eupl", "licensed under the eupl(?: version)? [^ ]+(?: [^ ]+){0,8} as soon they will be approved by the european commission"),
        ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license"),
        ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages arising from the use of this software"),
        ("zlib", "altered source versions must be plainly marked as such", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
        ("unlicense", "this is free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
        ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
        ("cc0", "to the extent possible under law", "to the extent possible under law [^ ]+(?: [^ ]+){0,12} waived all copyright"),
        ("cc0-1.0", "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights", "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights"),
        ("cc-by-sa-4.0", "you agree to be bound by the terms and conditions of this creative commons", "you agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license"),
        ("cc-by-nc-4.0", "you agree to be bound by the terms and conditions of this creative commons", "you agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license"),
        ("cc-by-nd-4.0", "you agree to be bound by the terms and conditions of this creative commons", "you agree to be bound by the terms and conditions of this creative commons attribution noderivatives 4 0 international public license"),
        ("cc-by-4.0", "you agree to be bound by the terms and conditions of this creative commons", "you agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license"),
        ("wtfpl", "you just do what the fuck you want to", "you just do what the fuck you want to"),
        ("ofl-1.1", "this font software is licensed under the sil open font license", "this font software is licensed under the sil open font license version 1 1"),
        ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied", "the intent of this document is to state the conditions under which a package may be copied"),
        ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed", "this license establishes the terms under which a given free software package may be copied modified distributed"),
        ("openssl", "this product includes software developed by the openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit"),
        ("php", "this product includes php software freely available from", "this product includes php software freely available from"),
        ("python", "psf hereby grants licensee a nonexclusive royalty free world wide license", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
        ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
        ("ncsa", "to deal with the software without restriction", "to deal with the software without restriction including without limitation the rights to use copy modify"),
        ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
        ("ijg", "this software is based in part on the work of the independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
        ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
        ("vim", "vim is charityware", "vim is charityware"),
        ("beerware", "beer in return", "as long as you retain this notice you can do whatever you want with this stuff(?: [^ ]+){0,24} beer in return"),
        ("json", "the software shall be used for good not evil", "the software shall be used for good not evil"),
        ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
        ("w3c", "by obtaining using and or copying this work you the licensee agree", "by obtaining using and or copying this work you the licensee agree"),
        ("ms-pl", "if you use the software you accept this license", "this license governs use of the accompanying software if you use the software you accept this license"),
        ("odbl-1.0", "is a license agreement intended to allow users to freely share modify and use this database", "the open database license odbl is a license agreement intended to allow users to freely share modify and use this database"),
        ("upl-1.0", "the larger works", "subject to the condition set forth below to any person obtaining a copy of this software(?: [^ ]+){0,40} the larger works"),
        ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service", "if you make the functionality of the program or a modified version available to third parties as a service"),
        ("busl-1.1", "make non production use of the licensed work", "to copy modify create derivative works redistribute and make non production use of the licensed work"),
        ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    )),
    # machine-readable identifiers
    (8, 1.0, (
        *((label, f"spdx license identifier {key}", f"spdx license identifier {regex}(?: (?:only|or later))?") for label, key, regex in (
            ("gpl-1.0", "gpl 1", "gpl 1 0"), ("gpl-2.0", "gpl 2", "gpl 2 0"), ("gpl-3.0", "gpl 3", "gpl 3 0"), ("lgpl-2.0", "lgpl 2 0", "lgpl 2 0"), ("lgpl-2.1", "lgpl 2 1", "lgpl 2 1"), ("lgpl-3.0", "lgpl 3", "lgpl 3 0"), ("agpl-1.0", "agpl 1", "agpl 1 0"), ("agpl-3.0", "agpl 3", "agpl 3 0"), ("gfdl", "gfdl", "gfdl 1 [123]"),
        )),
        ("apache-1.1", "spdx license identifier apache", "spdx license identifier apache 1 1"),
        ("apache-2.0", "spdx license identifier apache", "spdx license identifier apache 2 0"),
        ("mit-0", "spdx license identifier mit 0", "spdx license identifier mit 0"),
        ("mit", "spdx license identifier mit", "spdx license identifier mit"),
        ("x11", "spdx license identifier x11", "spdx license identifier x11"),
        ("0bsd", "spdx license identifier 0bsd", "spdx license identifier 0bsd"),
        ("bsd-2-clause", "spdx license identifier bsd 2", "spdx license identifier bsd 2 clause"),
        ("bsd-3-clause", "spdx license identifier bsd 3", "spdx license identifier bsd 3 clause"),
        ("bsd-4-clause", "spdx license identifier bsd 4", "spdx license identifier bsd 4 clause"),
        ("isc", "spdx license identifier isc", "spdx license identifier isc"),
        ("mpl-1.0", "spdx license identifier mpl", "spdx license identifier mpl 1 0"),
        ("mpl-1.1", "spdx license identifier mpl", "spdx license identifier mpl 1 1"),
        ("mpl-2.0", "spdx license identifier mpl", "spdx license identifier mpl 2 0(?: no copyleft exception)?"),
        ("epl-1.0", "spdx license identifier epl", "spdx license identifier epl 1 0"),
        ("epl-2.0", "spdx license identifier epl", "spdx license identifier epl 2 0"),
        ("eupl", "spdx license identifier eupl", "spdx license identifier eupl 1 [012]"),
        ("cddl", "spdx license identifier cddl", "spdx license identifier cddl 1 [01]"),
        ("cpl-1.0", "spdx license identifier cpl", "spdx license identifier cpl 1 0"),
        ("artistic-1.0", "spdx license identifier artistic", "spdx license identifier artistic 1 0(?: perl| cl8)?"),
        ("artistic-2.0", "spdx license identifier artistic", "spdx license identifier artistic 2 0"),
        ("zlib", "spdx license identifier zlib", "spdx license identifier zlib"),
        ("libpng", "spdx license identifier libpng", "spdx license identifier libpng(?: 2 0)?"),
        ("boost", "spdx license identifier bsl", "spdx license identifier bsl 1 0"),
        ("unlicense", "spdx license identifier unlicense", "spdx license identifier unlicense"),
        ("wtfpl", "spdx license identifier wtfpl", "spdx license identifier wtfpl"),
        ("cc0", "spdx license identifier cc0", "spdx license identifier cc0 1 0"),
        ("cc-by-nc-sa", "spdx license identifier cc by nc sa", "spdx license identifier cc by nc sa [1-4] [05]"),
        ("cc-by-nc-nd", "spdx license identifier cc by nc nd", "spdx license identifier cc by nc nd [1-4] [05]"),
        ("cc-by-nc", "spdx license identifier cc by nc", "spdx license identifier cc by nc [1-4] [05]"),
        ("cc-by-nd", "spdx license identifier cc by nd", "spdx license identifier cc by nd [1-4] [05]"),
        ("cc-by-sa", "spdx license identifier cc by sa", "spdx license identifier cc by sa [1-4] [05]"),
        ("cc-by", "spdx license identifier cc by", "spdx license identifier cc by [1-4] [05]"),
        ("openssl", "spdx license identifier openssl", "spdx license identifier openssl"),
        ("php", "spdx license identifier php", "spdx license identifier php 3 01?"),
        ("python", "spdx license identifier psf|spdx license identifier python", "spdx license identifier (?:psf|python) 2 0"),
        ("postgresql", "spdx license identifier postgresql", "spdx license identifier postgresql"),
        ("ruby", "spdx license identifier ruby", "spdx license identifier ruby"),
        ("ofl", "spdx license identifier ofl", "spdx license identifier ofl 1 [01]"),
        ("osl", "spdx license identifier osl", "spdx license identifier osl [123] [01]"),
        ("afl", "spdx license identifier afl", "spdx license identifier afl [123] [012]"),
        ("ms-pl", "spdx license identifier ms pl", "spdx license identifier ms pl"),
        ("ms-rl", "spdx license identifier ms rl", "spdx license identifier ms rl"),
        ("ncsa", "spdx license identifier ncsa", "spdx license identifier ncsa"),
        ("odbl-1.0", "spdx license identifier odbl", "spdx license identifier odbl 1 0"),
        ("odc-by", "spdx license identifier odc by", "spdx license identifier odc by 1 0"),
        ("ijg", "spdx license identifier ijg", "spdx license identifier ijg"),
        ("ecl", "spdx license identifier ecl", "spdx license identifier ecl [12] 0"),
        ("upl-1.0", "spdx license identifier upl", "spdx license identifier upl 1 0"),
        ("sspl-1.0", "spdx license identifier sspl", "spdx license identifier sspl 1 0"),
        ("busl-1.1", "spdx license identifier busl", "spdx license identifier busl 1 1"),
        ("elastic-2.0", "spdx license identifier elastic", "spdx license identifier elastic 2 0"),
        ("spdx-other", "spdx license identifier", "spdx license identifier"),
    )),
    # addresses of license texts
    (7, 0.95, (
        ("apache-2.0", "apache org licenses", "(?:www )?apache org licenses license 2 0"),
        ("gpl-2.0", "gnu org licenses", "gnu org licenses (?:old licenses )?gpl 2 0"),
        ("gpl-3.0", "gnu org licenses", "gnu org licenses gpl 3 0"),
        ("lgpl-2.1", "gnu org licenses", "gnu org licenses (?:old licenses )?lgpl 2 1"),
        ("lgpl-3.0", "gnu org licenses", "gnu org licenses lgpl 3 0"),
        ("agpl-3.0", "gnu org licenses", "gnu org licenses agpl 3 0"),
        ("gfdl", "gnu org licenses", "gnu org licenses fdl(?: 1 3)?"),
        ("lgpl", "gnu org licenses", "gnu org licenses lgpl"),
        ("agpl", "gnu org licenses", "gnu org licenses agpl"),
        ("gpl", "gnu org licenses", "gnu org licenses gpl"),
        ("gpl", "gnu org copyleft gpl", "gnu org copyleft gpl"),
        ("mit", "opensource org licenses", "opensource org licenses mit(?: license)?"),
        ("bsd-2-clause", "opensource org licenses", "opensource org licenses bsd 2 clause"),
        ("bsd-3-clause", "opensource org licenses", "opensource org licenses bsd 3 clause"),
        ("bsd", "opensource org licenses", "opensource org licenses bsd license"),
        ("isc", "opensource org licenses", "opensource org licenses isc(?: license)?"),
        ("apache-2.0", "opensource org licenses", "opensource org licenses apache 2 0"),
        ("osl", "opensource org licenses", "opensource org licenses osl [123] [01]"),
        ("afl", "opensource org licenses", "opensource org licenses afl [123] [012]"),
        ("ms-pl", "opensource org licenses", "opensource org licenses ms pl"),
        ("mpl-2.0", "mozilla org mpl", "mozilla org mpl 2 0"),
        ("mpl", "mozilla org mpl", "mozilla org mpl"),
        ("epl-1.0", "eclipse org legal epl", "eclipse org legal epl v ?10"),
        ("epl-2.0", "eclipse org legal epl", "eclipse org legal epl (?:v ?20|2 0)"),
        ("boost", "boost org license", "boost org license 1 0"),
        ("unlicense", "unlicense org", "unlicense org"),
        ("wtfpl", "wtfpl net", "wtfpl net"),
        ("cc0", "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0"),
        ("public-domain", "creativecommons org publicdomain mark", "creativecommons org publicdomain mark 1 0"),
        ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa [1-4] [05]"),
        ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd [1-4] [05]"),
        ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc [1-4] [05]"),
        ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd [1-4] [05]"),
        ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa [1-4] [05]"),
        ("cc-by", "creativecommons org licenses by", "creativecommons org licenses by [1-4] [05]"),
        ("odbl", "opendatacommons org licenses odbl", "opendatacommons org licenses odbl"),
        ("odc-by", "opendatacommons org licenses by", "opendatacommons org licenses by"),
        ("ofl", "scripts sil org ofl", "scripts sil org ofl"),
        ("php", "php net license", "php net license(?: 3 01)?"),
    )),
    # names with their versions
    (6, 0.95, (
        ("agpl-1.0", "affero general public|agpl", f"(?:gnu )?(?:affero general public {LICENSE}|agpl(?: {LICENSE})?) {V}1(?: 0)?"),
        ("agpl-3.0", "affero general public|agpl|agplv3", f"(?:(?:gnu )?(?:affero general public {LICENSE}|agpl(?: {LICENSE})?) {V}3(?: 0)?|agplv3)"),
        ("lgpl-2.1", "lesser general public|lgpl|lgplv2", f"(?:(?:gnu )?(?:lesser general public {LICENSE}|lgpl(?: {LICENSE})?) {V}2 1|lgplv2 1)"),
        ("lgpl-2.0", "library general public|lgpl|lgplv2", f"(?:(?:gnu )?(?:library general public {LICENSE}|lgpl(?: {LICENSE})?) {V}2(?: 0)?|lgplv2)"),
        ("lgpl-3.0", "lesser general public|lgpl|lgplv3", f"(?:(?:gnu )?(?:lesser general public {LICENSE}|lgpl(?: {LICENSE})?) {V}3(?: 0)?|lgplv3)"),
        ("gpl-1.0", "general public|gpl", f"(?:gnu )?(?:general public {LICENSE}|gpl(?: {LICENSE})?) {V}1(?: 0)?"),
        ("gpl-2.0", "general public|gpl|gplv2", f"(?:(?:gnu )?(?:general public {LICENSE}|gpl(?: {LICENSE})?) {V}2(?: 0)?|gplv2)"),
        ("gpl-3.0", "general public|gpl|gplv3", f"(?:(?:gnu )?(?:general public {LICENSE}|gpl(?: {LICENSE})?) {V}3(?: 0)?|gplv3)"),
        ("gfdl-1.1", "free documentation|gfdl", f"(?:gnu )?(?:free documentation {LICENSE}|gfdl) {V}1 1"),
        ("gfdl-1.2", "free documentation|gfdl", f"(?:gnu )?(?:free documentation {LICENSE}|gfdl) {V}1 2"),
        ("gfdl-1.3", "free documentation|gfdl", f"(?:gnu )?(?:free documentation {LICENSE}|gfdl) {V}1 3"),
        ("apache-1.0", "apache", f"apache(?: software)?(?: {LICENSE})? {V}1 0"),
        ("apache-1.1", "apache", f"apache(?: software)?(?: {LICENSE})? {V}1 1"),
        ("apache-2.0", "apache|apachev2", f"(?:apache(?: software)?(?: {LICENSE})? {V}2(?: 0)?|apachev2)"),
        ("bsd-2-clause", "bsd|simplified bsd", f"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)(?: {LICENSE})?"),
        ("bsd-3-clause", "bsd", f"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: {LICENSE})?"),
        ("bsd-4-clause", "bsd", f"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|(?:original|old) bsd)(?: {LICENSE})?"),
        ("0bsd", "zero clause bsd|bsd zero clause|0bsd", f"(?:zero clause bsd|bsd zero clause|0bsd)(?: {LICENSE})?"),
        ("mpl-1.0", "mozilla public|mpl", f"(?:mozilla public {LICENSE}|mpl) {V}1 0"),
        ("mpl-1.1", "mozilla public|mpl", f"(?:mozilla public {LICENSE}|mpl) {V}1 1"),
        ("mpl-2.0", "mozilla public|mpl", f"(?:mozilla public {LICENSE}|mpl) {V}2(?: 0)?"),
        ("epl-1.0", "eclipse public|epl", f"(?:eclipse public {LICENSE}|epl) {V}1(?: 0)?"),
        ("epl-2.0", "eclipse public|epl", f"(?:eclipse public {LICENSE}|epl) {V}2(?: 0)?"),
        ("eupl-1.0", "european union public|eupl", f"(?:european union public {LICENSE}|eupl) {V}1 0"),
        ("eupl-1.1", "european union public|eupl", f"(?:european union public {LICENSE}|eupl) {V}1 1"),
        ("eupl-1.2", "european union public|eupl", f"(?:european union public {LICENSE}|eupl) {V}1 2"),
        ("cddl-1.0", "common development and distribution|cddl", f"(?:common development and distribution {LICENSE}|cddl) {V}1 0"),
        ("cddl-1.1", "common development and distribution|cddl", f"(?:common development and distribution {LICENSE}|cddl) {V}1 1"),
        ("cpl-1.0", "common public", f"common public {LICENSE} {V}1 0"),
        ("cpal-1.0", "common public attribution|cpal", f"(?:common public attribution {LICENSE}|cpal) {V}1 0"),
        ("artistic-1.0", "artistic", f"artistic(?: {LICENSE})? {V}1 0"),
        ("artistic-2.0", "artistic", f"artistic(?: {LICENSE})? {V}2 0"),
        ("boost-1.0", "boost software|bsl", f"(?:boost software {LICENSE}|bsl) {V}1 0"),
        ("wtfpl-2.0", "do what the fuck you want to public|wtfpl", f"(?:do what the fuck you want to public {LICENSE}|wtfpl) {V}2(?: 0)?"),
        ("cc0-1.0", "cc0", f"cc0(?: {LICENSE})? {V}1 0"),
        ("cc-by-nc-sa-4.0", "cc by nc sa|creative commons attribution", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0"),
        ("cc-by-nc-sa-3.0", "cc by nc sa|creative commons attribution", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 3 0"),
        ("cc-by-nc-nd-4.0", "cc by nc nd|creative commons attribution", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives)) 4 0"),
        ("cc-by-nc-nd-3.0", "cc by nc nd|creative commons attribution", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives)) 3 0"),
        ("cc-by-nc-4.0", "cc by nc|creative commons attribution", "(?:cc by nc|creative commons attribution non ?commercial) 4 0"),
        ("cc-by-nc-3.0", "cc by nc|creative commons attribution", "(?:cc by nc|creative commons attribution non ?commercial) 3 0"),
        ("cc-by-nd-4.0", "cc by nd|creative commons attribution", "(?:cc by nd|creative commons attribution no ?deriv(?:s|atives)) 4 0"),
        ("cc-by-nd-3.0", "cc by nd|creative commons attribution", "(?:cc by nd|creative commons attribution no ?deriv(?:s|atives)) 3 0"),
        ("cc-by-nd-2.5", "cc by nd|creative commons attribution", "(?:cc by nd|creative commons attribution no ?deriv(?:s|atives)) 2 5"),
        ("cc-by-sa-4.0", "cc by sa|creative commons attribution", "(?:cc by sa|creative commons attribution share ?alike) 4 0"),
        ("cc-by-sa-3.0", "cc by sa|creative commons attribution", "(?:cc by sa|creative commons attribution share ?alike) 3 0"),
        ("cc-by-sa-2.5", "cc by sa|creative commons attribution", "(?:cc by sa|creative commons attribution share ?alike) 2 5"),
        ("cc-by-sa-2.0", "cc by sa|creative commons attribution", "(?:cc by sa|creative commons attribution share ?alike) 2 0"),
        ("cc-by-4.0", "cc by|creative commons attribution", "(?:cc by|creative commons attribution) 4 0"),
        ("cc-by-3.0", "cc by|creative commons attribution", "(?:cc by|creative commons attribution) 3 0"),
        ("cc-by-2.5", "cc by|creative commons attribution", "(?:cc by|creative commons attribution) 2 5"),
        ("cc-by-2.0", "cc by|creative commons attribution", "(?:cc by|creative commons attribution) 2 0"),
        ("cc-by-1.0", "cc by|creative commons attribution", "(?:cc by|creative commons attribution) 1 0"),
        ("php-3.01", "php", f"php {LICENSE} {V}3 01"),
        ("python-2.0", "python software foundation|psf", f"(?:python software foundation|psf) {LICENSE} {V}2(?: 0)?"),
        ("ofl-1.1", "open font|ofl", f"(?:(?:sil )?open font {LICENSE}|ofl) {V}1 1"),
        ("osl-3.0", "open software|osl", f"(?:open software {LICENSE}|osl) {V}3 0"),
        ("osl-2.1", "open software|osl", f"(?:open software {LICENSE}|osl) {V}2 1"),
        ("afl-3.0", "academic free|afl", f"(?:academic free {LICENSE}|afl) {V}3 0"),
        ("afl-2.1", "academic free|afl", f"(?:academic free {LICENSE}|afl) {V}2 1"),
        ("qpl-1.0", "q public|qpl", f"(?:q public {LICENSE}|qpl) {V}1 0"),
        ("odbl-1.0", "open database|odbl", f"(?:open database {LICENSE}|odbl) {V}1 0"),
        ("ecl-2.0", "educational community", f"educational community {LICENSE} {V}2 0"),
        ("upl-1.0", "universal permissive", f"universal permissive {LICENSE} {V}1 0"),
        ("sspl-1.0", "server side public|sspl", f"(?:server side public {LICENSE}|sspl) {V}1(?: 0)?"),
        ("busl-1.1", "business source", f"business source {LICENSE} {V}1 1"),
        ("elastic-2.0", "elastic", f"elastic {LICENSE} {V}2 0"),
    )),
    # names alone, and what says that something is licensed
    (5, 0.8, (
        ("agpl", "affero general public|agpl", f"(?:gnu )?(?:affero general public {LICENSE}|agpl)"),
        ("lgpl", "lesser general public|library general public|lgpl", f"(?:gnu )?(?:(?:lesser|library) general public {LICENSE}|lgpl)"),
        ("gpl", "general public", f"(?:gnu )?general public {LICENSE}"),
        ("gpl", "gnu gpl|gpl license|gpl licence|gpl licenses|gpl licences|under the gpl|gpl compatible|under gpl", f"(?:gnu gpl(?: {LICENSE})?|gpl {LICENSE}|under (?:the )?gpl|gpl compatible)"),
        ("gfdl", "free documentation|gfdl", f"(?:gnu )?(?:free documentation {LICENSE}|gfdl)"),
        ("apache", "apache license|apache licence|apache licenses|apache licences|apache software", f"apache(?: software)? {LICENSE}"),
        ("apache", "under the apache|under apache", "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?apache"),
        ("mit", "mit license|mit licence|mit licenses|mit licences|expat license|expat licence|expat licenses|expat licences|mit x11|mit style", f"(?:(?:mit|expat) {LICENSE}|mit x11(?: {LICENSE})?|mit style {LICENSE})"),
        ("mit", "under the mit|under mit|terms of the mit|terms of mit", "(?:under|terms of) (?:the )?mit"),
        ("mit", "license mit|licence mit", "(?:license|licence) mit"),
        ("x11", "x11 license|x11 licence|x11 licenses|x11 licences|x consortium license|x consortium licence|x consortium licenses|x consortium licences", f"(?:x11|x consortium) {LICENSE}"),
        ("bsd", "bsd license|bsd licence|bsd licenses|bsd licences|bsd style|bsd licensed|under the bsd|under bsd|license bsd", f"(?:bsd {LICENSE}|bsd style(?: {LICENSE})?|bsd licensed|under (?:the )?bsd|license bsd)"),
        ("isc", "isc license|isc licence|isc licenses|isc licences|internet systems consortium", f"(?:isc {LICENSE}|internet systems consortium {LICENSE})"),
        ("mpl", "mozilla public|under the mpl|under mpl|terms of the mpl|terms of mpl|mpl license|mpl licence|mpl licenses|mpl licences", f"(?:mozilla public {LICENSE}|(?:under|terms of) (?:the )?mpl|mpl {LICENSE})"),
        ("epl", "eclipse public|under the epl|under epl|epl license|epl licence|epl licenses|epl licences", f"(?:eclipse public {LICENSE}|under (?:the )?epl|epl {LICENSE})"),
        ("eupl", "european union public|eupl", f"(?:european union public {LICENSE}|eupl)"),
        ("cddl", "common development and distribution|cddl", f"(?:common development and distribution {LICENSE}|cddl)"),
        ("cpal", "common public attribution|cpal", f"(?:common public attribution {LICENSE}|cpal)"),
        ("cpl", "common public", f"common public {LICENSE}"),
        ("artistic", "artistic license|artistic licence|artistic licenses|artistic licences", f"(?:perl )?artistic {LICENSE}"),
        ("zlib", "zlib license|zlib licence|zlib licenses|zlib licences|zlib libpng", f"zlib(?: libpng)? {LICENSE}"),
        ("libpng", "libpng license|libpng licence|libpng licenses|libpng licences", f"libpng {LICENSE}"),
        ("boost", "boost software|boost license|boost licence|boost licenses|boost licences", f"boost(?: software)? {LICENSE}"),
        ("unlicense", "the unlicense|under the unlicense|unlicense license", "(?:under )?the unlicense|unlicense license"),
        ("wtfpl", "do what the fuck you want to public|wtfpl", f"(?:do what the fuck you want to public {LICENSE}|wtfpl)"),
        ("cc0", "cc0|creative commons zero|cc zero", f"(?:cc0|creative commons zero|cc zero)(?: {LICENSE})?"),
        ("cc-by-nc-sa", "cc by nc sa|creative commons attribution", "cc by nc sa|creative commons attribution non ?commercial share ?alike"),
        ("cc-by-nc-nd", "cc by nc nd|creative commons attribution", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives)"),
        ("cc-by-nc", "cc by nc|creative commons attribution", "cc by nc|creative commons attribution non ?commercial"),
        ("cc-by-nd", "cc by nd|creative commons attribution", "cc by nd|creative commons attribution no ?deriv(?:s|atives)"),
        ("cc-by-sa", "cc by sa|creative commons attribution", "cc by sa|creative commons attribution share ?alike"),
        ("cc-by", "cc by|creative commons attribution", f"(?:cc by|creative commons attribution)(?: {LICENSE})?"),
        ("creative-commons", "creative commons", f"creative commons {LICENSE}"),
        ("openssl", "openssl license|openssl licence|openssl licenses|openssl licences|ssleay", f"(?:openssl|ssleay) {LICENSE}"),
        ("php", "php license|php licence|php licenses|php licences", f"php {LICENSE}"),
        ("python", "python software foundation|psf license|psf licence|psf licenses|psf licences|python license|python licence|python licenses|python licences", f"(?:python software foundation|psf|python) {LICENSE}"),
        ("postgresql", "postgresql license|postgresql licence|postgresql licenses|postgresql licences", f"postgresql {LICENSE}"),
        ("ruby", "ruby license|ruby licence|ruby licenses|ruby licences|same terms as ruby", f"ruby {LICENSE}|(?:under )?(?:the )?same terms as ruby"),
        ("perl", "same terms as perl", "(?:under )?(?:the )?same terms as perl(?: itself)?"),
        ("ofl", "open font", f"(?:sil )?open font {LICENSE}"),
        ("osl", "open software license|open software licence|open software licenses|open software licences", f"open software {LICENSE}"),
        ("afl", "academic free", f"academic free {LICENSE}"),
        ("qpl", "q public", f"q public {LICENSE}"),
        ("ms-pl", "microsoft public|ms pl", f"(?:microsoft public {LICENSE}|ms pl)"),
        ("ms-rl", "microsoft reciprocal|ms rl", f"(?:microsoft reciprocal {LICENSE}|ms rl)"),
        ("ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {LICENSE}"),
        ("odc-by", "open data commons attribution|odc by", f"(?:open data commons attribution {LICENSE}|odc by)"),
        ("odbl", "open database|odbl", f"(?:open database {LICENSE}|odbl)"),
        ("pddl", "open data commons public domain dedication|pddl", "open data commons public domain dedication(?: and)?(?: license)?|pddl"),
        ("vim", "vim license|vim licence|vim licenses|vim licences", f"vim {LICENSE}"),
        ("w3c", "w3c software|w3c notice|w3c license|w3c licence|w3c licenses|w3c licences|w3c document", f"w3c(?: software| document)?(?: notice and)? {LICENSE}"),
        ("sleepycat", "sleepycat", f"sleepycat {LICENSE}"),
        ("ijg", "independent jpeg group", f"independent jpeg group(?: s)? {LICENSE}"),
        ("curl", "curl license|curl licence|curl licenses|curl licences", f"curl {LICENSE}"),
        ("nasa", "nasa open source agreement", "nasa open source agreement(?: 1 3)?"),
        ("ecl", "educational community", f"educational community {LICENSE}"),
        ("sspl", "server side public|sspl", f"(?:server side public {LICENSE}|sspl)"),
        ("busl", "business source|busl", f"(?:business source {LICENSE}|busl)"),
        ("elastic", "elastic license|elastic licence|elastic licenses|elastic licences", f"elastic {LICENSE}"),
        ("beerware", "beerware|beer ware", "beer ?ware(?: license)?"),
        ("commons-clause", "commons clause", "commons clause(?: license condition)?"),
        ("proprietary", "proprietary and confidential|proprietary license|proprietary licence|proprietary licenses|proprietary licences", f"proprietary and confidential|proprietary {LICENSE}"),
        ("eula", "end user license agreement|end user licence agreement", "end user licen[cs]e agreement"),
    )),
    # notices that tell little
    (4, 0.5, (
        ("public-domain", "the public domain", "(?:released|dedicated|placed|is) (?:to|in|into) the public domain"),
        ("all-rights-reserved", "all rights reserved", "all rights reserved"),
        ("copyleft", "copyleft", f"copyleft {LICENSE}"),
    )),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    regex: str
    priority: int
    confidence: float


#: In the order in which they are applied. A regex begins with the space before its first word and ends before a space.
RULES = tuple(Rule(label, tuple(keywords.split("|")), f" (?:{regex})(?= )", priority, confidence) for priority, confidence, tier in SIGNATURES for label, keywords, regex in tier)
#: What stands for a word that is taken; no rule asks for it.
TAKEN = "#"


def least(literals: list[str]) -> list[str]:
    """The literals (whole words) that hold no other one: one of them occurs wherever one of all does."""
    out: list[str] = []
    for x in sorted(set(literals), key=lambda x: (len(x), x)):
        if not any(f" {y} " in f" {x} " for y in out):
            out.append(x)
    return out


def any_of(literals: list[str]) -> str:
    """A regex that matches one of the literals, parted by their first characters so that few are tried at a place."""
    rest = sorted(x for x in literals if x)
    parts = [re.escape(c) + any_of([x[1:] for x in group]) for c, group in itertools.groupby(rest, key=lambda x: x[0])]
    if len(parts) == 1 and len(rest) == len(literals):
        return parts[0]
    return f"(?:{'|'.join(parts)}){'' if len(rest) == len(literals) else '?'}" if parts else ""


#: The literals of the prefilter, none of them within another: a line that holds a rule's keyword holds one of that keyword's literals.
LITERALS = least([x for rule in RULES for x in rule.keywords])
#: No rule matches a line that this doesn't match.
GATE = f" {any_of(LITERALS)} "
#: Every literal of a line, those that overlap too: at one word no two can begin.
EVERY_LITERAL = f" (?=({any_of(LITERALS)}) )"


def line(text: Column) -> Column:
    """The words of a text, each after a space, and a last space. Lower-casing letters beyond A-Z changes no word's bounds."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def literals_of(rule: Rule) -> list[str]:
    """One of these occurs wherever a keyword of the rule does."""
    return sorted({next(x for x in LITERALS if f" {x} " in f" {keyword} ") for keyword in rule.keywords})


def candidates(words: Column) -> Column:
    """The numbers of the rules that match a line, in order; a rule's regex is tried only if a literal of its keywords occurs."""
    there = lambda held, rule: F.arrays_overlap(held, F.array(*map(F.lit, literals_of(rule))))
    every = F.array_distinct(F.regexp_extract_all(words, F.lit(EVERY_LITERAL), F.lit(1)))
    return let(every, lambda held: F.array_compact(F.array(*(F.when(there(held, rule) & words.rlike(rule.regex), k) for k, rule in enumerate(RULES)))))


def detections(words: Column) -> Column:
    """What remains after suppression: (start, n_words, rule), start in words from 0, in the order of the rules."""
    regexes = F.array(*(F.lit(rule.regex) for rule in RULES))

    def step(state: Column, rule: Column) -> Column:
        def of(regex: Column) -> Column:
            def with_matches(found: Column) -> Column:
                matches, gaps = found["matches"], found["gaps"]
                before = F.slice(gaps, 1, F.size(matches))
                upto = running(F.zip_with(before, matches, lambda g, m: spaces(g) + spaces(m)), plus, F.lit(0))
                spans = F.zip_with(matches, F.slice(upto, 2, F.size(matches)), lambda m, end: F.struct((end - spaces(m)).alias("start"), spaces(m).alias("n_words"), rule.alias("rule")))
                left = F.concat(F.array_join(F.zip_with(before, matches, lambda g, m: F.concat(g, F.regexp_replace(m, "[^ ]+", TAKEN))), ""), F.element_at(gaps, -1))
                return F.when(F.size(matches) > 0, F.struct(left.alias("words"), F.concat(state["spans"], spans).alias("spans"))).otherwise(state)

            return let(F.struct(F.regexp_extract_all(state["words"], regex, F.lit(0)).alias("matches"), F.split(state["words"], regex, -1).alias("gaps")), with_matches)

        return let(F.element_at(regexes, rule + 1), of)

    none = F.array().cast("array<struct<start:int,n_words:int,rule:int>>")
    return F.aggregate(candidates(words), F.struct(words.alias("words"), none.alias("spans")), step, lambda state: state["spans"])


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, words (the line), and `detections`: an array of (start, n_words, label, priority, confidence), start in words from 0."""
    table = F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for r in RULES))
    rows = docs.select(F.col("doc_id").cast("long"), line(F.coalesce("text", F.lit(""))).alias("words"))
    w = F.col("words")
    told = let(table, lambda rules: F.transform(detections(w), lambda d: let(F.element_at(rules, d["rule"] + 1), lambda r: F.struct(d["start"].alias("start"), d["n_words"].alias("n_words"), r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence")))))
    none = F.array().cast("array<struct<start:int,n_words:int,label:string,priority:int,confidence:double>>")
    return rows.select(
        "doc_id",
        F.when(F.length("words") > 2, spaces(w) - 1).otherwise(0).cast("long").alias("n_words"),
        "words",
        F.when(w.rlike(GATE), told).otherwise(none).alias("detections"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = detected(docs)
    w, has = F.col("words"), F.col("has")
    pattern = f" (?:{'|'.join(PHRASES)})(?= )"
    rows = rows.withColumn("has", w.rlike(pattern))
    gaps, matches = F.split(w, pattern, -1), F.regexp_extract_all(w, F.lit(pattern), F.lit(0))
    base = F.array_compact(F.array(*(F.when(F.contains(w, F.lit(f" {p} ")), label) for p, label in PHRASES.items())))
    rows = rows.select(
        "doc_id",
        "n_words",
        F.when(has, F.regexp_count(w, F.lit(pattern))).otherwise(0).cast("long").alias("n_base"),
        F.when(has, spaces(F.get(gaps, F.lit(0)))).cast("long").alias("first_word"),
        F.when(has, F.col("n_words") - (spaces(F.element_at(gaps, -1)) - 1) - spaces(F.element_at(matches, -1))).cast("long").alias("last_word"),
        F.when(has, base).otherwise(F.array().cast("array<string>")).alias("base"),
        "detections",
    )
    labels = F.array_sort(F.array_union("base", F.transform("detections", lambda d: d["label"])))
    best = F.aggregate("detections", F.when(F.size("base") > 0, 0.8).otherwise(0.0), lambda s, d: F.greatest(s, d["confidence"]))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), best.alias("score"))
