"""Signature rules for licence texts: label, priority, keywords that gate the rule, pattern.

A rule is tried on texts that hold one of its keywords (divided by ``|``) as a whole word; every text that the
pattern fits holds one.
Patterns are written in lower case. A space in a pattern stands for any run of ASCII signs between two words, so
one pattern fits ``Apache License, Version 2.0`` and ``apache-license version 2.0`` alike; patterns begin and end at
word boundaries. Higher priority wins where one detection lies inside another.
"""

from __future__ import annotations

#: What separates words: any ASCII character that is neither a digit nor a letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
EDGE_BEFORE = r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
EDGE_AFTER = r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"

#: Any text, over line ends and of any length, to the first of the alternatives behind it; what follows says which it must be.
UP_TO = r"(?>[\s\S]+?(?:"

TAG, TEXT, NAME, LINK, HINT = 90, 80, 70, 60, 10
#: No ASCII sign, so it joins the year to one word: this keyword counts wherever a text holds it.
SIGN = "©"

#: Written by hand: one line a rule. The order breaks ties between equal priorities.
RULES = (
    # notices that quote a licence's own words
    ("mit", TEXT, "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", TEXT, "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", TEXT, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", TEXT, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", TEXT, "endorse", f"neither the name of {UP_TO} may be used to endorse or promote products derived from this software|neither the name of))(?<=software)"),
    ("bsd-4-clause", TEXT, "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", TEXT, "apache", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", TEXT, "license", "you may not use this file except in compliance with the license"),
    ("gpl", TEXT, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0-or-later", TEXT, "gnu", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", TEXT, "gnu", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", TEXT, "lesser", "under the terms of the gnu lesser general public license"),
    ("agpl", TEXT, "affero", "under the terms of the gnu affero general public license"),
    ("mpl-2.0", TEXT, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", TEXT, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", TEXT, "misrepresented", "the origin of this software must not be misrepresented"),
    ("wtfpl", TEXT, "fuck", "do what the fuck you want to"),
    ("cc0-1.0", TEXT, "waived", "waived all copyright and related or neighboring rights"),
    ("cc", TEXT, "creative", "this work is licensed under (?:a|the) creative commons"),
    ("ofl-1.1", TEXT, "font", "this font software is licensed under the sil open font license"),
    ("boost", TEXT, "boost", "distributed under the boost software license version 1 0"),
    ("epl", TEXT, "eclipse", "made available under the terms of the eclipse public license"),
    ("beerware", TEXT, "beer", "you can buy me a beer in return"),
    ("json", TEXT, "evil", "the software shall be used for good not evil"),
    ("gfdl", TEXT, "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("proprietary", TEXT, "confidential", "proprietary and confidential"),
    ("proprietary", TEXT, "reproduced", "no part of this (?:publication|book|work|document|website) may be reproduced"),
    ("proprietary", TEXT, "unauthorized|unauthorised", "unauthori[sz]ed (?:copying|use|reproduction|distribution)"),
    # names
    ("mit", NAME, "mit", "(?:the )?mit licen[cs]e"),
    ("mit", NAME, "mit", "licen[cs]ed under (?:the )?mit"),
    ("mit-0", NAME, "mit", "mit no attribution(?: licen[cs]e)?"),
    ("expat", NAME, "expat", "expat licen[cs]e"),
    ("x11", NAME, "x11", "x11 licen[cs]e"),
    ("isc", NAME, "isc", "isc licen[cs]e"),
    ("bsd", NAME, "bsd", "bsd (?:style )?licen[cs]e"),
    ("bsd", NAME, "berkeley", "berkeley software distribution licen[cs]e"),
    ("0bsd", NAME, "bsd|0bsd", "(?:0bsd|zero clause bsd)(?: licen[cs]e)?"),
    ("bsd-2-clause", NAME, "bsd", "(?:2|two) clause (?:simplified )?bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", NAME, "simplified", "simplified bsd licen[cs]e"),
    ("bsd-2-clause", NAME, "freebsd", "freebsd licen[cs]e"),
    ("bsd-3-clause", NAME, "bsd", "(?:3|three) clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", NAME, "bsd", "(?:new|revised|modified) bsd licen[cs]e"),
    ("bsd-4-clause", NAME, "bsd", "(?:4|four) clause bsd(?: licen[cs]e)?"),
    ("apache", NAME, "apache", "apache (?:software )?licen[cs]e"),
    ("apache-1.0", NAME, "apache", "apache (?:software )?licen[cs]e (?:version |v )?1 0"),
    ("apache-1.1", NAME, "apache", "apache (?:software )?licen[cs]e (?:version |v )?1 1"),
    ("apache-2.0", NAME, "apache", "apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?"),
    ("apache-2.0", NAME, "apache", "licen[cs]ed under apache 2(?: 0)?"),
    ("gpl", NAME, "gnu", "gnu general public licen[cs]e"),
    ("gpl", NAME, "gpl", "licen[cs]ed under (?:the )?gpl"),
    ("gpl-1.0", NAME, "general", "general public licen[cs]e (?:version |v )?1(?: 0)?"),
    ("gpl-2.0", NAME, "general", "general public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("gpl-3.0", NAME, "general", "general public licen[cs]e (?:version |v )?3(?: 0)?"),
    ("gpl-2.0", NAME, "gpl|gpl2|gplv|gplv2|gplversion", "gpl ?(?:version |v ?)?2(?: 0)?"),
    ("gpl-3.0", NAME, "gpl|gpl3|gplv|gplv3|gplversion", "gpl ?(?:version |v ?)?3(?: 0)?"),
    ("gpl-2.0-or-later", NAME, "later", "general public licen[cs]e (?:version |v )?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("gpl-3.0-or-later", NAME, "later", "general public licen[cs]e (?:version |v )?3(?: 0)? or (?:any )?later(?: version)?"),
    ("lgpl", NAME, "lesser", "(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-2.1", NAME, "lesser", "(?:gnu )?lesser general public licen[cs]e (?:version |v )?2 1"),
    ("lgpl-3.0", NAME, "lesser", "(?:gnu )?lesser general public licen[cs]e (?:version |v )?3(?: 0)?"),
    ("lgpl-2.0", NAME, "library", "(?:gnu )?library general public licen[cs]e"),
    ("lgpl", NAME, "lgpl", "licen[cs]ed under (?:the )?lgpl"),
    ("lgpl-2.1", NAME, "lgpl|lgpl2|lgplv|lgplv2", "lgpl ?v? ?2 1"),
    ("lgpl-3.0", NAME, "lgpl|lgpl3|lgplv|lgplv3", "lgpl ?v? ?3(?: 0)?"),
    ("agpl", NAME, "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("agpl-3.0", NAME, "affero", "(?:gnu )?affero general public licen[cs]e (?:version |v )?3(?: 0)?"),
    ("agpl-3.0", NAME, "agpl|agpl3|agplv|agplv3", "agpl ?v? ?3(?: 0)?"),
    ("gfdl", NAME, "documentation", "(?:gnu )?free documentation licen[cs]e"),
    ("gfdl-1.2", NAME, "documentation", "(?:gnu )?free documentation licen[cs]e (?:version |v )?1 2"),
    ("gfdl-1.3", NAME, "documentation", "(?:gnu )?free documentation licen[cs]e (?:version |v )?1 3"),
    ("mpl", NAME, "mozilla", "mozilla public licen[cs]e"),
    ("mpl-1.1", NAME, "mozilla", "mozilla public licen[cs]e (?:version |v )?1 1"),
    ("mpl-2.0", NAME, "mozilla", "mozilla public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("mpl-2.0", NAME, "mpl|mpl2|mplv|mplv2", "mpl ?v? ?2(?: 0)?"),
    ("epl", NAME, "eclipse", "eclipse public licen[cs]e"),
    ("epl-1.0", NAME, "eclipse", "eclipse public licen[cs]e (?:version |v )?1 0"),
    ("epl-2.0", NAME, "eclipse", "eclipse public licen[cs]e (?:version |v )?2 0"),
    ("edl-1.0", NAME, "eclipse", "eclipse distribution licen[cs]e"),
    ("cddl", NAME, "common", "common development and distribution licen[cs]e"),
    ("cddl-1.0", NAME, "cddl", "cddl (?:version |v )?1 0"),
    ("cpl-1.0", NAME, "common", "common public licen[cs]e"),
    ("eupl", NAME, "european", "european union public licen[cs]e"),
    ("eupl-1.2", NAME, "eupl", "eupl (?:version |v )?1 2"),
    ("artistic", NAME, "artistic", "artistic licen[cs]e"),
    ("artistic-1.0", NAME, "artistic", "artistic licen[cs]e (?:version |v )?1(?: 0)?"),
    ("artistic-2.0", NAME, "artistic", "artistic licen[cs]e (?:version |v )?2(?: 0)?"),
    ("perl", NAME, "perl", "same terms as perl(?: itself)?"),
    ("boost", NAME, "boost", "boost software licen[cs]e"),
    ("zlib", NAME, "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("libpng", NAME, "libpng", "libpng licen[cs]e"),
    ("unlicense", NAME, "unlicense", "(?:the )?unlicense"),
    ("wtfpl", NAME, "wtfpl", "wtfpl"),
    ("beerware", NAME, "beer|beerware", "beer ?ware licen[cs]e"),
    ("python", NAME, "python", "python software foundation licen[cs]e"),
    ("psf-2.0", NAME, "psf", "psf licen[cs]e(?: agreement)?"),
    ("php-3.01", NAME, "php", "php licen[cs]e"),
    ("ruby", NAME, "ruby", "ruby licen[cs]e"),
    ("openssl", NAME, "openssl", "openssl licen[cs]e"),
    ("postgresql", NAME, "postgresql", "postgresql licen[cs]e"),
    ("ncsa", NAME, "illinois", "university of illinois(?: ncsa)? open source licen[cs]e"),
    ("ncsa", NAME, "ncsa", "ncsa open source licen[cs]e"),
    ("ofl-1.1", NAME, "font", "(?:sil )?open font licen[cs]e"),
    ("osl-3.0", NAME, "open", "open software licen[cs]e"),
    ("afl-3.0", NAME, "academic", "academic free licen[cs]e"),
    ("ecl-2.0", NAME, "educational", "educational community licen[cs]e"),
    ("ms-pl", NAME, "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", NAME, "microsoft", "microsoft reciprocal licen[cs]e"),
    ("qpl-1.0", NAME, "qpl|q|qt", "q(?:t)? public licen[cs]e|qpl licen[cs]e"),
    ("vim", NAME, "vim", "vim licen[cs]e"),
    ("intel", NAME, "intel", "intel open source licen[cs]e"),
    ("ipl-1.0", NAME, "ibm", "ibm public licen[cs]e"),
    ("apsl", NAME, "apple", "apple public source licen[cs]e"),
    ("sunpl", NAME, "sun", "sun public licen[cs]e"),
    ("w3c", NAME, "w3c", "w3c software (?:notice and )?licen[cs]e"),
    ("mulan-psl-2.0", NAME, "mulan", "mulan (?:permissive software|psl) licen[cs]e"),
    ("cecill", NAME, "cecill", "cecill(?: [abc])?(?: licen[cs]e)?"),
    ("busl-1.1", NAME, "business", "business source licen[cs]e"),
    ("sspl-1.0", NAME, "server", "server side public licen[cs]e"),
    ("elastic-2.0", NAME, "elastic", "elastic licen[cs]e"),
    ("commons-clause", NAME, "commons", "commons clause"),
    ("polyform", NAME, "polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter|free trial) licen[cs]e"),
    ("rail", NAME, "rail|responsible", "(?:open )?(?:responsible ai|rail) licen[cs]e"),
    ("odbl", NAME, "database", "open (?:data commons )?(?:open )?database licen[cs]e"),
    ("odc-by", NAME, "attribution", "open data commons attribution licen[cs]e"),
    ("pddl", NAME, "dedication", "public domain dedication and licen[cs]e"),
    ("ogl", NAME, "government", "open government licen[cs]e"),
    ("etalab", NAME, "etalab|ouverte", "(?:etalab|licence ouverte)(?: 2 0)?"),
    ("dl-de", NAME, "datenlizenz", "datenlizenz deutschland"),
    ("game-ogl", NAME, "game|gaming", "open gam(?:e|ing) licen[cs]e"),
    ("free-art", NAME, "art", "free art licen[cs]e|licence art libre"),
    ("public-domain", NAME, "domain", "(?:released|placed|dedicated|is|are) (?:in|into|to) the public domain"),
    ("public-domain", NAME, "dominio", "dominio p[úu]blico"),
    ("public-domain", NAME, "gemeinfrei", "gemeinfrei"),
    ("public-domain", NAME, "domaine", "domaine public"),
    # creative commons, by name and by short name
    ("cc", NAME, "creative", "creative commons(?: licen[cs]e)?"),
    ("cc-by", NAME, "creative", "creative commons attribution"),
    ("cc-by-sa", NAME, "creative", "creative commons attribution share ?alike"),
    ("cc-by-nd", NAME, "creative", "creative commons attribution no ?deriv(?:s|atives)"),
    ("cc-by-nc", NAME, "creative", "creative commons attribution non ?commercial"),
    ("cc-by-nc-sa", NAME, "creative", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", NAME, "creative", "creative commons attribution non ?commercial no ?deriv(?:s|atives)"),
    ("cc0-1.0", NAME, "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-1.0", NAME, "cc", "cc by 1 0"),
    ("cc-by-2.0", NAME, "cc", "cc by 2 0"),
    ("cc-by-2.5", NAME, "cc", "cc by 2 5"),
    ("cc-by-3.0", NAME, "cc", "cc by 3 0"),
    ("cc-by-4.0", NAME, "cc", "cc by 4 0"),
    ("cc-by-sa", NAME, "cc", "cc by sa"),
    ("cc-by-sa-2.0", NAME, "cc", "cc by sa 2 0"),
    ("cc-by-sa-2.5", NAME, "cc", "cc by sa 2 5"),
    ("cc-by-sa-3.0", NAME, "cc", "cc by sa 3 0"),
    ("cc-by-sa-4.0", NAME, "cc", "cc by sa 4 0"),
    ("cc-by-nc", NAME, "cc", "cc by nc"),
    ("cc-by-nc-2.0", NAME, "cc", "cc by nc 2 0"),
    ("cc-by-nc-3.0", NAME, "cc", "cc by nc 3 0"),
    ("cc-by-nc-4.0", NAME, "cc", "cc by nc 4 0"),
    ("cc-by-nd", NAME, "cc", "cc by nd"),
    ("cc-by-nd-3.0", NAME, "cc", "cc by nd 3 0"),
    ("cc-by-nd-4.0", NAME, "cc", "cc by nd 4 0"),
    ("cc-by-nc-sa", NAME, "cc", "cc by nc sa"),
    ("cc-by-nc-sa-3.0", NAME, "cc", "cc by nc sa 3 0"),
    ("cc-by-nc-sa-4.0", NAME, "cc", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", NAME, "cc", "cc by nc nd"),
    ("cc-by-nc-nd-3.0", NAME, "cc", "cc by nc nd 3 0"),
    ("cc-by-nc-nd-4.0", NAME, "cc", "cc by nc nd 4 0"),
    # machine-readable tags
    ("mit", TAG, "spdx", "spdx license identifier mit"),
    ("apache-2.0", TAG, "spdx", "spdx license identifier apache 2 0"),
    ("bsd-2-clause", TAG, "spdx", "spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", TAG, "spdx", "spdx license identifier bsd 3 clause"),
    ("isc", TAG, "spdx", "spdx license identifier isc"),
    ("0bsd", TAG, "spdx", "spdx license identifier 0bsd"),
    ("gpl-2.0", TAG, "spdx", "spdx license identifier gpl 2 0(?: only)?"),
    ("gpl-2.0-or-later", TAG, "spdx", "spdx license identifier gpl 2 0 or later"),
    ("gpl-3.0", TAG, "spdx", "spdx license identifier gpl 3 0(?: only)?"),
    ("gpl-3.0-or-later", TAG, "spdx", "spdx license identifier gpl 3 0 or later"),
    ("lgpl-2.1", TAG, "spdx", "spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", TAG, "spdx", "spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", TAG, "spdx", "spdx license identifier agpl 3 0(?: only| or later)?"),
    ("mpl-2.0", TAG, "spdx", "spdx license identifier mpl 2 0"),
    ("epl-2.0", TAG, "spdx", "spdx license identifier epl 2 0"),
    ("cc0-1.0", TAG, "spdx", "spdx license identifier cc0 1 0"),
    ("cc-by-4.0", TAG, "spdx", "spdx license identifier cc by 4 0"),
    ("cc-by-sa-4.0", TAG, "spdx", "spdx license identifier cc by sa 4 0"),
    ("unlicense", TAG, "spdx", "spdx license identifier unlicense"),
    ("boost", TAG, "spdx", "spdx license identifier bsl 1 0"),
    ("busl-1.1", TAG, "spdx", "spdx license identifier busl 1 1"),
    ("zlib", TAG, "spdx", "spdx license identifier zlib"),
    ("wtfpl", TAG, "spdx", "spdx license identifier wtfpl"),
    # links
    ("mit", LINK, "opensource", "opensource org licen[cs]es? mit(?: license(?: php)?)?"),
    ("bsd-2-clause", LINK, "opensource", "opensource org licen[cs]es? bsd 2 clause"),
    ("bsd-3-clause", LINK, "opensource", "opensource org licen[cs]es? bsd 3 clause"),
    ("isc", LINK, "opensource", "opensource org licen[cs]es? isc"),
    ("apache-2.0", LINK, "apache", "apache org licen[cs]es license 2 0"),
    ("gpl", LINK, "gnu", "gnu org (?:licen[cs]es|copyleft) gpl"),
    ("gpl-2.0", LINK, "gnu", "gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0"),
    ("gpl-3.0", LINK, "gnu", "gnu org licen[cs]es gpl 3 0"),
    ("lgpl", LINK, "gnu", "gnu org (?:licen[cs]es|copyleft) lgpl"),
    ("agpl", LINK, "gnu", "gnu org licen[cs]es agpl"),
    ("gfdl", LINK, "gnu", "gnu org (?:licen[cs]es|copyleft) fdl"),
    ("mpl-2.0", LINK, "mozilla", "mozilla org (?:en us )?mpl 2 0"),
    ("epl", LINK, "eclipse", "eclipse org (?:legal|org documents) epl"),
    ("unlicense", LINK, "unlicense", "unlicense org"),
    ("boost", LINK, "boost", "boost org license 1 0 txt"),
    ("cc0-1.0", LINK, "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", LINK, "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("cc-by-2.0", LINK, "creativecommons", "creativecommons org licenses by 2 0"),
    ("cc-by-3.0", LINK, "creativecommons", "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", LINK, "creativecommons", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-3.0", LINK, "creativecommons", "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", LINK, "creativecommons", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", LINK, "creativecommons", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", LINK, "creativecommons", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", LINK, "creativecommons", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", LINK, "creativecommons", "creativecommons org licenses by nc nd 4 0"),
    ("odbl", LINK, "opendatacommons", "opendatacommons org licen[cs]es odbl"),
    # hints: something about rights is said, no licence named
    ("reserved", HINT, "reserved", "all rights reserved"),
    ("reserved", HINT, "reservados", "todos los derechos reservados"),
    ("reserved", HINT, "réservés", "tous droits réservés"),
    ("reserved", HINT, "vorbehalten", "alle rechte vorbehalten"),
    ("copyright", HINT, "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("copyright", HINT, SIGN, "© ?(?:19|20)[0-9][0-9]"),
    ("unknown-license", HINT, "licensed|licenced", "(?:is|are) (?:freely )?licen[cs]ed under"),
)


def regex(pattern: str) -> str:
    """The Java pattern: gaps for spaces (also those that a group makes optional), between word edges."""
    return f"{EDGE_BEFORE}(?:{pattern.replace(' ?', f'(?:{GAP})?').replace(' ', GAP)}){EDGE_AFTER}"


def required(pattern: str) -> list[str]:
    """Words that every text the pattern fits holds: those that stand plainly between gaps, outside groups."""
    depth, out = 0, []
    for part in pattern.replace(" ?", "?").split(" "):
        if depth == 0 and part.isascii() and part.isalnum():
            out.append(part)
        depth += part.count("(") - part.count(")")
        if depth == 0 and "|" in part and "(" not in part:
            return []
    return sorted(set(out))
