"""Licence scans: an ordered table of signature rules over normalised words, in native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pedolith.llm.common import LOWER, UPPER, let

#: Runs that separate words, A-Z not yet in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: (label, keyword that must occur, names as regexes over words, SPDX-like identifiers as words)
FAMILIES = (
    ("mit", "mit", ["mit license", "mit licence", "mit x11 license"], ["mit"]),
    ("apache-1.1", "apache", ["apache software license (?:version |v)?1 1"], ["apache 1 1"]),
    ("apache-2", "apache", ["apache license,? (?:version |v )?2(?: 0)?", "apache license v2(?: 0)?", "apache 2(?: 0)? license", "apache software license (?:version |v )?2(?: 0)?"], ["apache 2 0", "asl 2 0"]),
    ("gpl-1", "gnu", ["gnu general public license (?:version |v )?1", "gnu gpl v?1"], ["gpl 1 0", "gpl 1 0 only", "gpl 1 0 or later"]),
    ("gpl-2", "gnu", ["gnu general public license (?:version |v )?2", "gnu general public license v2", "gnu gpl (?:version |v )?2", "gnu gplv2"], ["gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"]),
    ("gpl-3", "gnu", ["gnu general public license (?:version |v )?3", "gnu general public license v3", "gnu gpl (?:version |v )?3", "gnu gplv3"], ["gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"]),
    ("lgpl-2.1", "lesser", ["gnu lesser general public license (?:version |v )?2(?: 1)?", "lesser general public license v2 1"], ["lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"]),
    ("lgpl-3", "lesser", ["gnu lesser general public license (?:version |v )?3", "lesser general public license v3"], ["lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"]),
    ("lgpl-2", "library", ["gnu library general public license(?: version 2)?"], ["lgpl 2 0", "lgpl 2 0 only"]),
    ("agpl-3", "affero", ["gnu affero general public license(?: version| v)?(?: 3)?", "affero general public license v3"], ["agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"]),
    ("gfdl", "documentation", ["gnu free documentation license(?: version 1 [123])?"], ["gfdl 1 1", "gfdl 1 2", "gfdl 1 3"]),
    ("bsd-2-clause", "bsd", ["bsd 2 clause(?: license)?", "simplified bsd license", "free bsd license"], ["bsd 2 clause"]),
    ("bsd-3-clause", "bsd", ["bsd 3 clause(?: license)?", "new bsd license", "modified bsd license", "revised bsd license"], ["bsd 3 clause"]),
    ("bsd-4-clause", "bsd", ["bsd 4 clause(?: license)?", "original bsd license"], ["bsd 4 clause"]),
    ("0bsd", "bsd", ["zero clause bsd(?: license)?", "bsd zero clause license"], ["0bsd"]),
    ("isc", "isc", ["isc license"], ["isc"]),
    ("isc", "internet", ["internet systems consortium license"], []),
    ("mpl-1.1", "mozilla", ["mozilla public license (?:version |v )?1 1"], ["mpl 1 1"]),
    ("mpl-2", "mozilla", ["mozilla public license (?:version |v )?2(?: 0)?"], ["mpl 2 0"]),
    ("epl-1", "eclipse", ["eclipse public license (?:version |v )?1(?: 0)?"], ["epl 1 0"]),
    ("epl-2", "eclipse", ["eclipse public license (?:version |v )?2(?: 0)?"], ["epl 2 0"]),
    ("cddl-1", "common", ["common development and distribution license(?: version 1(?: [01])?)?"], ["cddl 1 0", "cddl 1 1"]),
    ("cpl-1", "common", ["common public license(?: version 1(?: 0)?)?"], ["cpl 1 0"]),
    ("eupl", "european", ["european union public licen[cs]e(?: (?:version |v )?1 [12])?"], ["eupl 1 1", "eupl 1 2"]),
    ("artistic-1", "artistic", ["artistic license (?:version )?1(?: 0)?"], ["artistic 1 0"]),
    ("artistic-2", "artistic", ["artistic license (?:version )?2(?: 0)?"], ["artistic 2 0"]),
    ("boost-1", "boost", ["boost software license(?: version 1(?: 0)?)?"], ["bsl 1 0"]),
    ("zlib", "zlib", ["zlib license", "zlib libpng license"], ["zlib"]),
    ("unlicense", "unlicense", ["the unlicense", "unlicense license"], ["unlicense"]),
    ("wtfpl", "what", ["do what the f\\w+ you want to public license(?: version 2)?"], ["wtfpl"]),
    ("cc0", "cc0", ["cc0(?: 1 0)?(?: universal)?"], ["cc0 1 0"]),
    ("cc0", "creative", ["creative commons zero(?: v?1 0)?(?: universal)?"], []),
    ("cc-by", "cc", ["cc by(?: [1-4] [05])?(?! (?:sa|nc|nd))"], ["cc by 2 0", "cc by 3 0", "cc by 4 0"]),
    ("cc-by-sa", "cc", ["cc by sa(?: [1-4] [05])?"], ["cc by sa 2 0", "cc by sa 3 0", "cc by sa 4 0"]),
    ("cc-by-nd", "cc", ["cc by nd(?: [1-4] [05])?"], ["cc by nd 3 0", "cc by nd 4 0"]),
    ("cc-by-nc", "cc", ["cc by nc(?: [1-4] [05])?(?! (?:sa|nd))"], ["cc by nc 3 0", "cc by nc 4 0"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa(?: [1-4] [05])?"], ["cc by nc sa 3 0", "cc by nc sa 4 0"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd(?: [1-4] [05])?"], ["cc by nc nd 3 0", "cc by nc nd 4 0"]),
    ("cc-by", "creative", ["creative commons attribution(?: [1-4] [05])?(?: international| generic| unported)?(?: public)? licen[cs]e"], []),
    ("cc-by-sa", "creative", ["creative commons attribution share ?alike(?: [1-4] [05])?(?: international| generic| unported)?(?: public)?(?: licen[cs]e)?"], []),
    ("cc-by-nd", "creative", ["creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"], []),
    ("cc-by-nc", "creative", ["creative commons attribution non ?commercial(?! (?:share|no))(?: [1-4] [05])?(?: international| generic| unported)?(?: public)?(?: licen[cs]e)?"], []),
    ("cc-by-nc-sa", "creative", ["creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"], []),
    ("cc-by-nc-nd", "creative", ["creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"], []),
    ("odbl", "database", ["open database license(?: v?1 0)?"], ["odbl 1 0"]),
    ("ofl", "font", ["sil open font license(?: (?:version )?1 1)?"], ["ofl 1 1"]),
    ("postgresql", "postgresql", ["postgresql license"], ["postgresql"]),
    ("psf-2", "python", ["python software foundation license(?: version 2)?"], ["psf 2 0", "python 2 0"]),
    ("ms-pl", "microsoft", ["microsoft public license"], ["ms pl"]),
    ("public-domain", "domain", ["released into the public domain", "dedicated to the public domain", "placed in the public domain"], []),
    ("proprietary", "reserved", ["all rights reserved"], []),
)

#: Sentences of licence texts, grants, disclaimers and file headers, each by hand: (label, keyword, pattern over
#: words). Public wordings of the licences themselves.
TEXTS = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "merge", "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "arising", "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    ("mit", "expat", "(?:the )?expat licen[cs]e"),
    ("mit-0", "attribution", "mit no attribution"),
    ("x11", "consortium", "except as contained in this notice the name of (?:the )?x consortium shall not be used in advertising"),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "apache", "(?:https? )?www apache org licenses license 2 0"),
    ("apache-2", "basis", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("apache-2", "contributor", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials"),
    ("bsd-2-clause", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", "neither the name of (?:\\w+ ){1,12}nor the names of (?:its|the) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "bsd", "bsd style licen[cs]e that can be found in the license file"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause", "contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd-2-clause", "exemplary", "direct indirect incidental special exemplary or consequential damages"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "the author disclaims all warranties with regard to this software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("libpng", "reference", "the png reference library is supplied as is"),
    ("boost-1", "boost", "distributed under the boost software license version 1 0"),
    ("boost-1", "boost", "(?:https? )?www boost org license 1 0 txt"),
    ("boost-1", "accompanying", "software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "unlicense", "for more information please refer to (?:https? )?unlicense org"),
    ("wtfpl", "everyone", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("beerware", "beer", "(?:the )?beer ?ware licen[cs]e"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("gpl-2", "redistribute", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3", "redistribute", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-1", "redistribute", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1"),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license along with this"),
    ("gpl", "gnu", "see the gnu general public license for more details"),
    ("gpl", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-2.1", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3", "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    ("lgpl-2", "library", "under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license along with this"),
    ("agpl-3", "affero", "under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3", "affero", "you should have received a copy of the gnu affero general public license along with this"),
    ("agpl-3", "remotely", "all users interacting with it remotely through a computer network an opportunity to receive the corresponding source"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mozilla", "if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-2", "incompatible", "incompatible with secondary licenses"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "rights", "for the specific language governing rights and limitations under the license"),
    ("epl-1", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0"),
    ("epl-2", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("cddl-1", "common", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1", "common", "the accompanying program is provided under the terms of this common public license"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("artistic-1", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "establishes", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "perl", "under the same terms as perl itself"),
    ("ruby", "ruby", "(?:under )?the same terms as ruby"),
    ("php-3", "php", "this source file is subject to version 3 01 of the php license"),
    ("python-2", "licensee", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("postgresql", "university", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("curl", "permission", "copyright and permission notice (?:\\w+ ){1,14}permission to use copy modify and distribute"),
    ("icu", "unicode", "unicode inc license agreement data files and software"),
    ("ncsa", "illinois", "university of illinois ncsa open source license"),
    ("llvm-exception", "llvm", "apache 2 0 with llvm exceptions?"),
    ("classpath-exception", "classpath", "gnu general public license (?:version 2 )?with (?:the )?classpath exception"),
    ("ms-rl", "reciprocal", "microsoft reciprocal license"),
    ("ofl", "font", "this font software is licensed under the sil open font license"),
    ("ofl", "reserved", "reserved font names?"),
    ("cc-by", "creativecommons", "(?:https? )?(?:www )?creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", "(?:https? )?(?:www )?creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons", "(?:https? )?(?:www )?creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons", "(?:https? )?(?:www )?creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", "(?:https? )?(?:www )?creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", "(?:https? )?(?:www )?creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc0", "creativecommons", "(?:https? )?(?:www )?creativecommons org publicdomain zero 1 0"),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights"),
    ("public-domain", "domain", "this (?:work|file|code|software) is in the public domain"),
    ("public-domain", "claimed", "no copyright is claimed"),
    ("odbl", "database", "made available under the open database license"),
    ("odbl", "contents", "any rights in individual contents of the database are licensed under the database contents license"),
    ("elastic-2", "elastic", "(?:the )?elastic license (?:v ?)?2(?: 0)?"),
    ("sspl-1", "server", "server side public license(?: v(?:ersion )?1)?"),
    ("busl-1.1", "business", "business source license(?: 1 1)?"),
    ("commons-clause", "commons", "commons clause license condition"),
    ("polyform-nc", "polyform", "polyform noncommercial license"),
    ("openrail", "openrail", "openrail m(?: license)?"),
    ("openrail", "rail", "open rail m(?: license)?"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) (?:of this file |or distribution )?(?:\\w+ ){0,6}is strictly prohibited"),
    ("proprietary", "evaluation", "for (?:internal )?evaluation purposes only"),
)

#: (template over a name or identifier, priority, confidence); the first kinds win an overlap.
NAME_FORMS = (
    ("(?:re)?licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{}", 5, 1.0),
    ("(?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{}", 4, 0.95),
    ("under (?:the )?{}", 3, 0.9),
    ("{}", 2, 0.7),
)
ID_FORMS = (
    ("spdx license identifier {}", 6, 1.0),
    ("license (?:id |type |name )?{}", 1, 0.6),
)


def signature_rules() -> list[tuple[str, str, int, str, float]]:
    """(label, keyword, priority, pattern, confidence), in order; patterns run over " w1 w2 ... wn "."""
    rules = [(label, keyword, 7, f" {body}(?= )", 1.0) for label, keyword, body in TEXTS]
    for label, keyword, names, ids in FAMILIES:
        for forms, bodies in ((NAME_FORMS, names), (ID_FORMS, ids)):
            for form, priority, sure in forms:
                rules += [(label, keyword if forms is NAME_FORMS else body.split(" ")[0], priority, " " + form.format("(?:" + body + ")") + "(?= )", sure) for body in bodies]
    return rules


#: No rule can match, and no base phrase stand, in words without one of these: what names and identifiers
#: hold, and for sentences of TEXTS that hold none of it the whole sentence, or its keyword if it is a pattern.
COMMON = ("licens", "licenc", "gnu", "bsd", "creative", "cc0", "domain", "reserved", " cc by")
GATE = (*COMMON, *sorted({keyword if set(body) & set("(?[\\") else f" {body} " for _, keyword, body in TEXTS if not any(k in re.sub(r"\(\?:[^()]*\)\?", "", body) for k in (*COMMON, "licen[cs]"))}))


def _any_of(t: Column) -> Column:
    """Plain substring searches over words."""
    hit = F.contains(t, F.lit(GATE[0]))
    for keyword in GATE[1:]:
        hit = hit | F.contains(t, F.lit(keyword))
    return hit


def _base(t: Column) -> Column:
    """Places of the base phrases in " w1 ... wn ": their number, first and last start, labels."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        mark = f" {phrase}"
        n = F.size(F.regexp_extract_all(t, F.lit(mark + "(?= )"), F.lit(0)))
        spaces = lambda upto: F.length(F.substring(t, F.lit(1), upto)) - F.length(F.replace(F.substring(t, F.lit(1), upto), F.lit(" "), F.lit("")))
        first = F.instr(t, mark + " ")
        last = F.length(t) - F.instr(F.reverse(t), (mark + " ")[::-1]) - len(mark) + 1
        counts.append(n)
        firsts.append(F.when(n > 0, spaces(first).cast("long") - 1))
        lasts.append(F.when(n > 0, spaces(last).cast("long") - 1))
        labels.append(F.when(n > 0, F.lit(label)))
    total = counts[0]
    for n in counts[1:]:
        total = total + n
    return F.struct(
        total.cast("long").alias("n"),
        F.array_min(F.array(*firsts)).alias("first"),
        F.array_max(F.array(*lasts)).alias("last"),
        F.array_compact(F.array(*labels)).alias("labels"),
    )


def _spans(t: Column, r: Column) -> Column:
    """All matches of rule r in t as (start, end, ...): the lengths of what stands between the matches and
    of the matches themselves, summed."""

    def placed(x):
        step = lambda acc, y: F.struct((acc["at"] + y["gap"] + y["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + y["gap"]).alias("start"), (acc["at"] + y["gap"] + y["len"]).alias("stop")))).alias("out"))
        both = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), x["hits"], lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
        spans = F.aggregate(both, start, step, lambda acc: acc["out"])
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("minus_stop"), (-r["priority"]).alias("minus_priority"), r["label"].alias("label"), r["sure"].alias("sure")))

    return let(F.struct(F.split(t, r["pattern"]).alias("gaps"), F.regexp_extract_all(t, r["pattern"], F.lit(0)).alias("hits")), placed)


def _resolved(hits: Column) -> Column:
    """One sweep over the detections by start, then longest, then priority: a detection inside the
    current one is suppressed, one that overlaps it replaces it if of higher priority."""
    kinds = "struct<start:int,stop:int,priority:int,label:string,sure:double>"
    start = F.struct(F.lit(None).cast(kinds).alias("now"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("sure"))

    def step(acc, h):
        new = F.struct(h["start"].alias("start"), (-h["minus_stop"]).alias("stop"), (-h["minus_priority"]).alias("priority"), h["label"].alias("label"), h["sure"].alias("sure"))
        now = acc["now"]
        keeps = F.struct(now.alias("now"), acc["labels"].alias("labels"), acc["sure"].alias("sure"))
        takes = F.struct(new.alias("now"), acc["labels"].alias("labels"), acc["sure"].alias("sure"))
        settles = F.struct(new.alias("now"), F.array_union(acc["labels"], F.array(now["label"])).alias("labels"), F.greatest(acc["sure"], now["sure"]).alias("sure"))
        return (
            F.when(now.isNull(), takes)
            .when(h["start"] >= now["stop"], settles)
            .when(-h["minus_stop"] <= now["stop"], keeps)
            .when(-h["minus_priority"] > now["priority"], takes)
            .otherwise(keeps)
        )

    def end(acc):
        now = acc["now"]
        return F.struct(
            F.when(now.isNull(), acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(now["label"]))).alias("labels"),
            F.greatest(acc["sure"], F.coalesce(now["sure"], F.lit(0.0))).alias("sure"),
        )

    return F.aggregate(F.sort_array(hits), start, step, end)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A text is gated by keywords of all rules, then the rules of each keyword by that; only then do
    regexes run. Labels are arrays, distinct and sorted; score is the confidence of the best detection that
    was not suppressed, 1 where a base phrase stands, else 0. Null text counts as empty: no words,
    no labels, score 0. Rows stand alone: no shuffle, no state; other columns are ignored.
    """
    by_keyword: dict[str, list[Column]] = {}
    for label, keyword, priority, pattern, sure in signature_rules():
        by_keyword.setdefault(keyword, []).append(F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(pattern).alias("pattern"), F.lit(sure).alias("sure")))
    groups = F.array(*[F.struct(F.lit(f" {keyword}").alias("keyword"), F.array(*rules).alias("rules")) for keyword, rules in by_keyword.items()])

    def found(t):
        live = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(t, g["keyword"])), lambda g: g["rules"]))
        hits = F.flatten(F.transform(F.filter(live, lambda r: F.rlike(t, r["pattern"])), lambda r: _spans(t, r)))
        return F.struct(_base(t).alias("base"), _resolved(hits).alias("more"))

    def judged(t):
        n_words = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) - 1
        return F.struct(n_words.cast("long").alias("n_words"), F.when(_any_of(t), found(t)).alias("found"))

    text = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS, " ")
    words = F.concat(F.rtrim(F.translate(text, UPPER, LOWER)), F.lit(" "))  # " w1 w2 ... wn "
    out = docs.select(F.col(id_col), let(words, judged).alias("_row"))
    out = out.select(F.col(id_col), F.col("_row.n_words").alias("n_words"), F.col("_row.found").alias("_found"))
    base, more = F.col("_found.base"), F.col("_found.more")
    none = F.array().cast("array<string>")
    return out.select(
        F.col(id_col),
        "n_words",
        F.coalesce(base["n"], F.lit(0).cast("long")).alias("n_base"),
        base["first"].alias("first_word"),
        base["last"].alias("last_word"),
        F.coalesce(F.sort_array(F.array_distinct(base["labels"])), none).alias("base_labels"),
        F.coalesce(F.sort_array(F.array_union(base["labels"], more["labels"])), none).alias("labels"),
        F.coalesce(F.when(base["n"] > 0, F.lit(1.0)).otherwise(more["sure"]), F.lit(0.0)).alias("score"),
    )
