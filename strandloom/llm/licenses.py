"""License scans by ordered signature rules, with DataFrame functions alone.

A rule is a regular expression over a text's words (A-Z lower-cased, one space
between), with the words that must be there before it is tried, a priority and a
label.  Sentences of licenses and notices are written out; rules for names are written
once for a template and once for a license family, and made by filling the families into
the templates.  Of the detections, one that lies within
another of the same or a higher priority is suppressed: ``cc by`` within ``cc by nc 4 0``.

No shuffle: a row's detections are arrays in the row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of raw text
_MARK = "\x01"
_CHUNK = 256


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keys: tuple[str, ...]
    priority: int
    base: bool = False


#: Phrases that are reported by themselves, whatever else is found there.
BASE = (
    Rule("mit", "mit license", ("mit license",), 2, True),
    Rule("apache", "apache license", ("apache license",), 2, True),
    Rule("gpl", "general public license", ("general public license",), 2, True),
)

#: label, name, version, and a piece that every spelling of the name has (empty: they share none).
FAMILIES = (
    ("mit", "mit", "", "mit"),
    ("mit", "expat", "", "expat"),
    ("x11", "x11|x consortium", "", "x"),
    ("apache", "apache(?: software)?", "1 [01]|2(?: 0)?", "apache"),
    ("gpl", "(?:gnu )?general public", "[123](?: 0)?", "general public"),
    ("gpl", "(?:gnu )?gpl(?:v[123])?", "[123](?: 0)?", "gpl"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", "2 [01]|[23](?: 0)?", "general public"),
    ("lgpl", "(?:gnu )?lgpl(?:v[23])?", "2 [01]|[23](?: 0)?", "lgpl"),
    ("agpl", "(?:gnu )?affero general public", "[13](?: 0)?", "affero"),
    ("agpl", "(?:gnu )?agpl(?:v[13])?", "[13](?: 0)?", "agpl"),
    ("gfdl", "(?:gnu )?free documentation", "1 [123]", "free documentation"),
    ("bsd", "(?:(?:new|modified|simplified|revised|original|[0234] clause) )*bsd(?: [0234] clause)?", "", "bsd"),
    ("mpl", "mozilla public", "1 [01]|2(?: 0)?", "mozilla"),
    ("mpl", "mpl", "1 [01]|2(?: 0)?", "mpl"),
    ("epl", "eclipse public", "[12](?: 0)?", "eclipse"),
    ("epl", "epl", "[12](?: 0)?", "epl"),
    ("edl", "eclipse distribution", "1(?: 0)?", "eclipse"),
    ("cddl", "common development and distribution|cddl", "1 [01]", "d"),
    ("cpl", "common public", "0 5|1 0", "common public"),
    ("isc", "isc|internet systems consortium", "", ""),
    ("zlib", "zlib(?: libpng)?", "", "zlib"),
    ("libpng", "libpng|png reference library", "[12](?: 0)?", "png"),
    ("artistic", "(?:clarified )?artistic", "1 0|2(?: 0)?", "artistic"),
    ("boost", "boost(?: software)?", "1(?: 0)?", "boost"),
    ("unlicense", "unlicense", "", "unlicense"),
    ("wtfpl", "wtfpl|do what the fuck you want to public", "[12]", "w"),
    ("ofl", "(?:sil )?open font|ofl", "1 [01]", "o"),
    ("afl", "academic free", "1 [12]|2 [01]|3(?: 0)?", "academic"),
    ("osl", "open software", "1 [01]|2 [01]|3(?: 0)?", "open software"),
    ("eupl", "european union public|eupl", "1 [012]", "eu"),
    ("ms-pl", "microsoft public|ms pl", "", "m"),
    ("ms-rl", "microsoft reciprocal|ms rl", "", "m"),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "", "ncsa"),
    ("psf", "python(?: software foundation)?", "2(?: 0)?", "python"),
    ("ruby", "ruby", "", "ruby"),
    ("php", "php", "3 0[01]?", "php"),
    ("openssl", "openssl", "", "openssl"),
    ("postgresql", "postgresql", "", "postgresql"),
    ("sleepycat", "sleepycat", "", "sleepycat"),
    ("w3c", "w3c(?: software)?", "", "w3c"),
    ("zpl", "zope public", "1 1|2 [01]", "zope"),
    ("ecl", "educational community", "[12](?: 0)?", "educational"),
    ("upl", "universal permissive", "1(?: 0)?", "universal"),
    ("busl", "business source", "1 [01]", "business source"),
    ("sspl", "server side public", "1", "server side"),
    ("elastic", "elastic", "2(?: 0)?", "elastic"),
    ("odbl", "open (?:data commons )?(?:open )?database", "1(?: 0)?", "database"),
    ("beerware", "beer ?ware", "", "beer"),
    ("ftl", "freetype(?: project)?", "", "freetype"),
    ("ijg", "independent jpeg group", "", "jpeg"),
    ("nasa", "nasa open source", "1 3", "nasa"),
    ("curl", "curl", "", "curl"),
    ("vim", "vim", "", "vim"),
    ("json", "json", "", "json"),
)

#: pattern with {n}ame and {v}ersion, the piece that it has besides the name, priority.
TEMPLATES = (
    ("(?:licen[sc]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:{n})(?: licen[cs]e)?{v}", "under", 4),
    ("spdx licen[cs]e identifier (?:{n}){v}", "spdx", 4),
    ("(?:{n}) licen[cs]e{w}", "licen", 3),
    ("(?:{n}) licen[cs]es?", "licen", 2),
    ("(?:under|by) (?:the )?terms of the (?:{n})", "terms of", 3),
    ("licen[cs]e (?:is )?(?:the )?(?:{n})", "licen", 1),
)

CREATIVE = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
_SPELLED = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
_CC_VERSION = "(?:(?:version )?[1234] [05])"

#: Texts and notices that name no family.
NOTICES = (
    Rule("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("hereby granted",), 4),
    Rule("isc", "permission to use copy modify and(?: or)? distribute this software", ("permission to use",), 4),
    Rule("bsd", "redistribution and use in source and binary forms", ("redistribution and use",), 4),
    Rule("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",), 4),
    Rule("zlib", "provided as is without any express or implied warranty in no event will the authors", ("in no event will",), 4),
    Rule("public-domain", "(?:dedicated to|released into|placed in|in) the public domain", ("public domain",), 3),
    Rule("cc0", "cc0(?: 1 0)?|cc zero", ("cc",), 3),
    Rule("cc0", "creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?", ("creative commons",), 3),
    Rule("proprietary", "all rights reserved", ("rights reserved",), 1),
    Rule("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", ("copyright",), 1),
    Rule("copyright", "copyrighted (?:work|material)", ("copyrighted",), 1),
    Rule("disclaimer", "without (?:any )?warrant(?:y|ies)(?: of any kind)?", ("warrant",), 1),
)

#: Sentences of the licenses' own texts and of the notices that they ask for: label, words, a word that few other texts have.
SIGNATURES = (
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", "sublicense"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial portions"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "copyright holders"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "merchantability"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", "furnished"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising", "consortium"),
    ("x11", "except as contained in this notice the names? of (?:the )?above copyright holders? shall not be used in advertising", "advertising"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "hereby granted"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", "disclaims"),
    ("isc", "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever", "consequential"),
    ("0bsd", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is", "hereby granted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("bsd", "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", "contributors"),
    ("bsd", "this software is provided by the regents and contributors as is", "regents"),
    ("bsd", "even if advised of the possibility of such damage", "advised"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising"),
    ("bsd-clear", "no express or implied licenses to any party s patent rights are granted by this license", "patent rights"),
    ("bsd-patent", "each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable", "irrevocable"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "agreed to in writing"),
    ("apache", "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations", "governing permissions"),
    ("apache", "terms and conditions for use reproduction and distribution", "reproduction"),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "irrevocable"),
    ("apache", "this product includes software developed (?:by|at) the apache software foundation", "apache software"),
    ("apache-1.1", "products derived from this software may not be called apache nor may apache appear in their name", "apache appear"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute"),
    ("gpl", "as published by the free software foundation either version [123](?: 0)? of the license or at your option any later version", "free software foundation"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "general public"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty", "in the hope"),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it", "freedom to share"),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works", "copyleft"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim"),
    ("gpl", "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program", "derived from the program"),
    ("gpl", "each time you redistribute the program or any work based on the program the recipient automatically receives a license", "recipient automatically"),
    ("gpl", "you may convey a work based on the program or the modifications to produce it from the program", "convey"),
    ("gpl-exception", "as a special exception the (?:copyright holders|free software foundation|author) (?:of this (?:library|program) )?gives? (?:you )?(?:unlimited )?permission", "special exception"),
    ("gpl-exception", "the classpath exception", "classpath"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this library", "general public"),
    ("lgpl", "a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it", "derivative"),
    ("lgpl", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "lesser general"),
    ("agpl", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network", "interacting"),
    ("agpl", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation", "affero"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "free documentation"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", "invariant"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("mpl", "the contents of this file are subject to the mozilla public license version", "mozilla"),
    ("mpl", "this source code form is incompatible with secondary licenses as defined by the mozilla public license", "secondary licenses"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license agreement", "eclipse"),
    ("cpl", "the accompanying program is provided under the terms of this common public license agreement", "common public"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common development"),
    ("cddl", "when distributing covered code include this cddl header in each file", "cddl"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "held liable"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "plainly marked"),
    ("zlib", "this notice may not be removed or altered from any source distribution", "altered"),
    ("libpng", "the contributing authors and group 42 inc disclaim all warranties", "contributing authors"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation"),
    ("boost", "distributed under the boost software license version 1 0", "boost software"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", "semblance"),
    ("artistic", "you may redistribute it and or modify it under the same terms as perl itself", "perl itself"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "compiled binary"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest", "jurisdictions"),
    ("unlicense", "for more information please refer to https? (?:www )?unlicense org", "unlicense"),
    ("wtfpl", "you just do what the fuck you want to", "fuck"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "whatever you want"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "font software"),
    ("ofl", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", "stimulate"),
    ("ofl", "the fonts including any derivative works can be bundled embedded redistributed and or sold with any software", "bundled"),
    ("afl", "licensed under the academic free license version", "academic free"),
    ("osl", "licensed under the open software license version", "open software"),
    ("eupl", "licensed under the eupl version 1 [012](?: only| or)?", "eupl"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", "governs use"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "deal with the software"),
    ("psf", "this license agreement is between the python software foundation psf and the individual or organization licensee", "python software"),
    ("psf", "psf is making python available to licensee on an as is basis", "licensee"),
    ("php", "this product includes php software freely available from", "php software"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"),
    ("openssl", "this product includes cryptographic software written by eric young", "cryptographic"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "written agreement"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear", "notice appear"),
    ("hpnd", "makes no representations about the suitability of this software for any purpose", "suitability"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software", "db software"),
    ("w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply", "licensee agree"),
    ("w3c", "permission to copy modify and distribute this (?:software|work) (?:and its documentation )?with or without modification for any purpose and without fee or royalty is hereby granted", "royalty"),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "jpeg group"),
    ("ftl", "portions of this software are copyright (?:c )?(?:[0-9 ]+ )?the freetype project", "freetype"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear", "permission notice"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim", "unmodified copies"),
    ("json", "the software shall be used for good not evil", "not evil"),
    ("ruby", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl", "bsdl"),
    ("nasa", "this agreement is entered into between the united states government", "states government"),
    ("upl", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data", "condition set forth"),
    ("busl", "effective on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the licensed work", "fourth anniversary"),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "production use"),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available", "functionality"),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service", "hosted or managed"),
    ("commons-clause", "without limiting other conditions in the license the grant of rights under the license will not include and the license does not grant to you the right to sell the software", "grant of rights"),
    ("odbl", "this (?:database|data) is made available under the open database license", "open database"),
    ("odbl", "any rights in individual contents of the database are licensed under the database contents license", "database contents"),
    ("pddl", "made available under the public domain dedication and license v1 0", "domain dedication"),
    ("cc0", "to the extent possible under law (?:[^ ]+ ){1,8}has waived all copyright and related or neighboring rights", "waived"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving", "deed"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format", "medium or format"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made", "appropriate credit"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", "remix"),
    ("cc-by-nc", "you may not use the material for commercial purposes", "commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", "remix"),
    ("cc", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons", "licensed rights"),
    ("cc", "this work is licensed under (?:a|the) creative commons", "creative commons"),
    ("public-domain", "this (?:file|work|software|code|program) (?:is|has been put|was placed|is placed|has been placed) (?:in|into) the public domain", "public domain"),
    ("public-domain", "the author disclaims copyright to this source code", "disclaims copyright"),
    ("public-domain", "no copyright is claimed", "is claimed"),
    ("us-government", "this (?:software|work) (?:was|is a work) (?:prepared|of|developed) by (?:an agency|employees) of the (?:united states|u s) government", "government"),
    ("proprietary", "this (?:software|document|material) is (?:the )?confidential and proprietary", "confidential"),
    ("proprietary", "you shall not disclose such confidential information", "confidential"),
    ("proprietary", "unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|document|material)(?: via any medium)? is strictly prohibited", "unauthorized"),
    ("proprietary", "no part of this (?:publication|work|document|book) may be reproduced", "reproduced"),
    ("proprietary", "use of this (?:software|source code) is governed by the terms of (?:the|your) (?:end user )?license agreement", "license agreement"),
    ("proprietary", "reverse engineer(?:ing)? decompil(?:e|ation) or disassembl(?:e|y)", "reverse engineer"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", "bsd style"),
    ("mit", "use of this source code is governed by an mit style license", "mit style"),
    ("apache-or-mit", "licensed under either of apache license version 2 0 or mit license at your option", "either of"),
    ("dual", "(?:dual|triple|multi) licen[cs]ed under", "licen"),
    ("dual", "alternatively (?:this software|the contents of this file) may be (?:distributed|used) under the terms of", "alternatively"),
)


def rules() -> list[Rule]:
    """All rules in order; the earlier of two equal detections stands."""
    out = list(BASE)
    for label, name, version, key in FAMILIES:
        v = f"(?: (?:version |v )?(?:{version}))?(?: (?:or later|only))?" if version else ""
        w = f" (?:version |v )?(?:{version})(?: (?:or later|only))?" if version else ""
        for pattern, piece, priority in TEMPLATES:
            if "{w}" not in pattern or w:
                out.append(Rule(label, pattern.replace("{n}", name).replace("{v}", v).replace("{w}", w), (key, piece), priority))
    for kind in CREATIVE:
        spelled = " ".join(_SPELLED[x] for x in kind.split())
        label = "cc-" + kind.replace(" ", "-")
        out.append(Rule(label, f"cc {kind} {_CC_VERSION}", ("cc by",), 4))
        out.append(Rule(label, f"cc {kind}", ("cc by",), 2))
        out.append(Rule(label, f"creative commons (?:{kind}|{spelled})(?: licen[cs]e)?(?: {_CC_VERSION})?(?: (?:international|unported))?", ("creative commons",), 3))
    out.extend(NOTICES)
    out.extend(Rule(label, words, (key,), 4) for label, words, key in SIGNATURES)
    return out


def _gate(all_rules: list[Rule]) -> str:
    """A pattern over raw text that every text with a detection matches: few pieces of words, one of which each rule needs.

    Pieces are taken that most rules still without one need; a rule needs the words of its
    keys and, if it is plain, all of its own.
    """
    need = [{w for k in r.keys for w in k.split()} | (set(r.pattern.split()) if re.fullmatch("[a-z0-9 ]+", r.pattern) else set()) for r in all_rules]
    words = sorted({w for n in need for w in n if len(w) > 3 or any(n == {w} for n in need)})
    named, left, pieces = {w for r in all_rules for k in r.keys for w in k.split()}, need, []
    while left:
        held = {p: [any(p in w for w in n) for n in left] for p in words}
        best = max(words, key=lambda p: (sum(held[p]) / 2.0 ** max(0, 6 - len(p)), p in named, len(p), p))  # short pieces are in many texts
        pieces.append(best)
        left = [n for n, h in zip(left, held[best]) if not h]
    by = {c: [p[1:] for p in pieces if p[0] == c] for c in sorted({p[0] for p in pieces})}
    return "(?i)" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())  # a letter, then what can follow it


def _normal(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, a space before and after each."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), _SPLIT, " ")


def _detections(normal: Column, all_rules: list[Rule]) -> Column:
    """All places of all rules, as structs (start, end, priority, rank, label, base), words counted from 0, end exclusive."""
    table = F.array(*[
        F.struct(F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(n).alias("rank"), F.lit(r.label).alias("label"), F.lit(r.base).alias("base"))
        for n, r in enumerate(all_rules)
    ])
    keys = sorted({k for r in all_rules for k in r.keys if k})
    # Which keys are there is found out once; a rule is then tried by a literal pattern, which is compiled once.
    present = F.array(*[F.contains(normal, F.lit(k)) for k in keys])

    def tried(p: Column) -> Column:
        gates = [reduce(Column.__and__, [F.get(p, F.lit(keys.index(k))) for k in r.keys if k], F.lit(True)) for r in all_rules]
        return F.filter(F.array(*[F.when(gate & F.rlike(normal, F.lit(f"(?<= )(?:{r.pattern})(?= )")), n) for n, (r, gate) in enumerate(zip(all_rules, gates))]), lambda n: n.isNotNull())

    hits = F.transform(F.flatten(F.transform(F.array(present), tried)), lambda n: F.get(table, n))

    def places(r: Column) -> Column:
        words = F.split(F.regexp_replace(normal, r["pattern"], F.lit(_MARK + "$0")), " ", -1)
        starts = F.filter(F.transform(words, lambda w, i: F.when(w.startswith(_MARK), i - 1)), lambda i: i.isNotNull())
        found = F.regexp_extract_all(normal, r["pattern"], F.lit(0))
        return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.size(F.split(m, " "))).alias("end"), r["priority"].alias("priority"), r["rank"].alias("rank"), r["label"].alias("label"), r["base"].alias("base")))

    return F.flatten(F.transform(hits, places))


def _unsuppressed(found: Column, highest: int) -> Column:
    """The detections that no other of the same or a higher priority contains.

    They are taken by start, the longer and then the higher first, so whatever contains
    one comes before it; what is kept track of is how far each priority has reached.
    Arrays grow by the chunk, which keeps a text with very many detections linear.
    """
    ordered = F.transform(
        F.sort_array(F.transform(found, lambda d: F.struct(d["start"].alias("a"), (-d["end"]).alias("b"), (-d["priority"]).alias("c"), d["rank"].alias("r"), d["label"].alias("label")))),
        lambda x: F.struct(x["a"].alias("start"), (-x["b"]).alias("end"), (-x["c"]).alias("priority"), x["label"].alias("label")),
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int,priority:int,label:string>>)")

    def step(acc: Column, d: Column) -> Column:
        reach = F.transform(acc["reach"], lambda x, i: F.when((i < d["priority"]) & (d["end"] > x), d["end"]).otherwise(x))
        inside = F.get(acc["reach"], d["priority"] - 1) >= d["end"]
        return F.struct(reach.alias("reach"), F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    def chunk(ds: Column, acc: Column, c: Column) -> Column:
        inner = F.aggregate(F.slice(ds, c * _CHUNK + 1, F.lit(_CHUNK)), F.struct(acc["reach"].alias("reach"), none.alias("kept")), step)
        joined = F.transform(F.array(inner), lambda x: F.struct(x["reach"].alias("reach"), F.concat(acc["kept"], x["kept"]).alias("kept")))
        return F.element_at(joined, 1)

    start = F.struct(F.array_repeat(F.lit(-1), highest).alias("reach"), none.alias("kept"))
    whole = F.transform(F.array(ordered), lambda ds: F.aggregate(F.sequence(F.lit(0), F.floor(F.size(ds) / _CHUNK).cast("int")), start, lambda acc, c: chunk(ds, acc, c), lambda acc: acc["kept"]))
    return F.element_at(whole, 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_rules: list[Rule] | None = None) -> DataFrame:
    """(id, n_words, found, kept) for every row.

    ``found``: all places of all rules; ``kept``: those that are left after suppression,
    by start.  Null and empty texts have no words.  Null ids are carried along, repeated
    rows are all returned, other columns are not read; an empty table gives no rows.
    """
    all_rules = rules() if all_rules is None else all_rules
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", F.size(F.array_remove(F.split("text", _BETWEEN), "")).cast("long").alias("n_words"), F.when(F.col("text").rlike(_gate(all_rules)), _normal(F.col("text"))).otherwise(" ").alias("normal"))
    rows = rows.select("id", "n_words", F.when(F.col("normal") != " ", _detections(F.col("normal"), all_rules)).otherwise(F.slice(_detections(F.lit(" "), all_rules[:1]), 1, 0)).alias("found"))
    highest = max((r.priority for r in all_rules), default=1)
    return rows.select(F.col("id").alias(id_col), "n_words", "found", _unsuppressed(F.col("found"), highest).alias("kept"))


def summary(scanned: DataFrame) -> DataFrame:
    """A scan's digest: base places, labels, and how sure the best detection is (0: none)."""
    base = F.filter("found", lambda d: d["base"])
    labels = lambda ds: F.transform(ds, lambda d: d["label"])
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    highest = F.array_max(F.transform("kept", lambda d: d["priority"]))
    return scanned.withColumns({
        "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(starts),
        "last_word": F.array_max(starts),
        "base_labels": joined(labels(base)),
        "labels": joined(F.concat(labels(base), labels(F.col("kept")))),
        "score": F.coalesce(F.when(highest == 1, 0.4).when(highest == 2, 0.7).when(highest == 3, 0.9).when(highest >= 4, 1.0), F.lit(0.0)),
    })
