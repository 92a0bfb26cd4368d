"""Operator 4: license scans by ordered signature rules, with SQL functions only.

A text is reduced to its words (A-Z lower-cased), joined by single spaces. Rules are regular expressions over that
form, some hundreds of them: sentences of single
licenses' own texts, and license names in sentence patterns, all written by hand. Rules are gated by
keywords: most texts hold none and are done after one look; in the others only the rules with a keyword there are run.
A detection has the rule's priority. One that lies within another of higher priority, or within a longer one of equal
priority, is suppressed; the base phrases are detected apart from this and always stay.

Places are word numbers: a match begins after as many words as there are spaces before it.

Defined cases: a null text has no words, no labels and score 0; repeated rows are scanned each; an empty table gives
an empty result; input columns are kept and the operator's own columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, fresh, swept, table

# Fixed pattern of what stands between words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Fixed base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: What may stand between the name of a GNU license and its version.
BY = "(?: as published by the free software foundation)?(?: either)?"
#: label -> (keywords, pattern of its name in words: full, short and SPDX forms). One of a name's keywords, as a whole
#: word, must occur in any text that the name matches (tested on samples of every rule).
NAMES = {
    "mit": ("mit", "mit"),
    "x11": ("x11", "x11"),
    "isc": ("isc", "isc"),
    "zlib": ("zlib", "zlib(?: libpng)?"),
    "bsd-2-clause": ("bsd freebsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)"),
    "bsd-3-clause": ("bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)"),
    "bsd-4-clause": ("bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)"),
    "bsd": ("bsd", "bsd"),
    "apache-1": ("apache apachev1", "(?:apache(?: software)?(?: license)? (?:version |v ?)?1|apachev1)(?: [01])?"),
    "apache-2": ("apache apachev2 apache2", "(?:apache(?: software)?(?: license)? (?:version |v ?)?2|apachev2|apache2)(?: 0)?"),
    "gpl-2": ("general gpl gplv2 gpl2", f"(?:gnu )?(?:general public license(?: gpl)?{BY} (?:version |v ?)2|gpl(?: license)? (?:version |v ?)?2|gplv2|gpl2)(?: 0)?"),
    "gpl-3": ("general gpl gplv3 gpl3", f"(?:gnu )?(?:general public license(?: gpl)?{BY} (?:version |v ?)3|gpl(?: license)? (?:version |v ?)?3|gplv3|gpl3)(?: 0)?"),
    "lgpl-2.1": ("lesser lgpl lgplv2", f"(?:gnu )?(?:lesser general public license(?: lgpl)?{BY} (?:version |v ?)2|lgpl(?: license)? (?:version |v ?)?2|lgplv2) 1"),
    "lgpl-3": ("lesser lgpl lgplv3 lgpl3", f"(?:gnu )?(?:lesser general public license(?: lgpl)?{BY} (?:version |v ?)3|lgpl(?: license)? (?:version |v ?)?3|lgplv3|lgpl3)(?: 0)?"),
    "agpl-3": ("affero agpl agplv3 agpl3", f"(?:gnu )?(?:affero general public license(?: agpl)?(?:{BY} (?:version |v ?)3)?|agpl(?: license)? (?:version |v ?)?3|agplv3|agpl3)(?: 0)?"),
    "gpl": ("gpl", "(?:gnu )?gpl"),
    "lgpl": ("lgpl", "(?:gnu )?lgpl"),
    "agpl": ("agpl", "(?:gnu )?agpl"),
    "gfdl": ("documentation gfdl", "(?:(?:gnu )?free documentation license|gfdl)"),
    "mpl-1.1": ("mozilla mpl mplv1", "(?:mozilla public license(?: mpl)? (?:version |v ?)?1|mpl (?:version |v ?)?1|mplv1) 1"),
    "mpl-2": ("mozilla mpl mplv2", "(?:mozilla public license(?: mpl)?(?: (?:version |v ?)?2)?|mpl (?:version |v ?)?2|mplv2)(?: 0)?"),
    "epl-1": ("eclipse epl", "(?:eclipse public license(?: epl)?|epl) (?:version |v ?)?1(?: 0)?"),
    "epl-2": ("eclipse epl", "(?:eclipse public license(?: epl)?|epl) (?:version |v ?)?2(?: 0)?"),
    "cddl": ("distribution cddl", "(?:common development and distribution license|cddl)"),
    "cpl": ("common cpl", "(?:common public license|cpl 1 0)"),
    "artistic": ("artistic", "(?:(?:perl )?artistic license|artistic [12] 0)"),
    "boost": ("boost bsl", "(?:boost software license|bsl 1 0)"),
    "unlicense": ("unlicense", "(?:the )?unlicense"),
    "wtfpl": ("wtfpl", "wtfpl"),
    "cc0": ("cc0", "(?:creative commons )?cc0(?: 1 0)?"),
    "cc-by": ("cc", "cc by"),
    "cc-by-sa": ("cc", "cc by sa"),
    "cc-by-nd": ("cc", "cc by nd"),
    "cc-by-nc": ("cc", "cc by nc"),
    "cc-by-nc-sa": ("cc", "cc by nc sa"),
    "cc-by-nc-nd": ("cc", "cc by nc nd"),
    "cc-by-long": ("creative", "creative commons attribution"),
    "cc-by-sa-long": ("creative", "creative commons attribution share ?alike"),
    "cc-by-nc-long": ("creative", "creative commons attribution non ?commercial"),
    "cc-by-nc-sa-long": ("creative", "creative commons attribution non ?commercial share ?alike"),
    "cc-by-nc-nd-long": ("creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    "odbl": ("database odbl", "(?:open database license|odbl)"),
    "ofl": ("font ofl", "(?:(?:sil )?open font license|ofl 1 [01])"),
    "eupl": ("european eupl", "(?:european union public license|eupl)"),
    "ms-pl": ("microsoft ms", "(?:microsoft public license|ms pl)"),
    "openssl": ("openssl", "openssl"),
    "postgresql": ("postgresql", "postgresql"),
    "python": ("python psf", "(?:python(?: software foundation)?|psf 2 0)"),
    "php": ("php", "php"),
    "ruby": ("ruby", "ruby"),
    "vim": ("vim", "vim"),
    "json": ("json", "json"),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    "proprietary": ("proprietary", "proprietary"),
    "elastic-2": ("elastic", "elastic (?:license|2 0)"),
    "sspl": ("server sspl", "(?:server side public license|sspl)"),
    "bsl-1.1": ("business busl", "(?:business source license|busl)(?: 1 1)?"),
}
#: (priority, confidence, sentence pattern; {} is the name). Higher priority is more specific.
SENTENCES = [
    (90, 1.00, "spdx license identifier {}(?: only| or later)?"),
    (80, 0.98, "(?:this|the) (?:work|file|project|program|software|library|package|code|document) is (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?{}(?: license| licence)?"),
    (70, 0.95, "(?:dual |is |are )?(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{}(?: license| licence)?"),
    (60, 0.90, "(?:subject to|governed by|according to|in accordance with) (?:the )?(?:terms of (?:the )?)?{}(?: license| licence)?"),
    (50, 0.85, "(?:license|licence|licensing)(?: is)?(?: the)? {}"),
    (40, 0.75, "{} (?:license|licence)(?: agreement| terms| notice)?"),
]
#: Names that are plain enough to stand alone, with less confidence.
ALONE = (30, 0.6)
PLAIN = {"mit", "x11", "isc", "bsd", "proprietary", "python", "php", "ruby", "vim", "json", "openssl", "postgresql", "boost"}


#: Sentences of single licenses' own texts: label -> (keyword, pattern) pairs. They name no license and are as sure as one that does.
NOTICES = {
    "mit": [
        ("hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
        ("sublicense", "use copy modify merge publish distribute sublicense and or sell copies of the software"),
        ("substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("noninfringement", "fitness for a particular purpose and noninfringement(?: of third party rights)? in no event shall the authors or copyright holders be liable"),
    ],
    "isc": [
        ("permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("disclaims", "the author disclaims all warranties with regard to this software including all implied warranties"),
    ],
    "bsd": [
        ("redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
        ("redistributions", "redistributions of source code must retain the above copyright notice"),
        ("redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ],
    "bsd-3-clause": [("endorse", "neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software")],
    "bsd-4-clause": [("advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment")],
    "zlib": [
        ("misrepresented", "the origin of this software must not be misrepresented"),
        ("altered", "altered source versions must be plainly marked as such"),
    ],
    "apache-2": [
        ("compliance", "you may not use this file except in compliance with the license"),
        ("apache", "www apache org licenses license 2 0"),
        ("contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
        ("distributed", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ],
    "apache-1": [("apache", "this product includes software developed by the apache (?:software foundation|group)")],
    "gpl": [
        ("redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
        ("gnu", "you should have received a copy of the gnu general public license along with this"),
        ("freedom", "when we speak of free software we are referring to freedom not price"),
    ],
    "lgpl": [
        ("lesser", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
        ("lesser", "you should have received a copy of the gnu lesser general public license along with this"),
        ("library", "you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ],
    "agpl": [
        ("affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
        ("affero", "you should have received a copy of the gnu affero general public license along with this"),
        ("remotely", "users interacting with it remotely through a computer network"),
    ],
    "gfdl": [("invariant", "with no invariant sections no front cover texts and no back cover texts")],
    "mpl-2": [("mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"), ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at")],
    "mpl-1.1": [("initial", "the initial developer of the original code is"), ("contents", "the contents of this file are subject to the mozilla public license version 1 1")],
    "epl-1": [("eclipse", "www eclipse org legal epl v10")],
    "epl-2": [("eclipse", "www eclipse org legal epl (?:v20|2 0)")],
    "cddl": [("distribution", "the contents of this file are subject to the terms of the common development and distribution license")],
    "cpl": [("recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement")],
    "artistic": [("perl", "under the same terms as perl itself")],
    "boost": [("boost", "www boost org license 1 0"), ("executable", "unless such copies or derivative works are solely in the form of machine executable object code")],
    "unlicense": [("unencumbered", "this is free and unencumbered software released into the public domain"), ("unlicense", "unlicense org")],
    "wtfpl": [("fuck", "do what the fuck you want to")],
    "cc0": [("waived", "(?:has|have) waived all copyright and related or neighboring rights"), ("publicdomain", "creativecommons org publicdomain zero 1 0")],
    "cc-by": [("creativecommons", "creativecommons org licenses by [1234] [05]")],
    "cc-by-sa": [("creativecommons", "creativecommons org licenses by sa [1234] [05]")],
    "cc-by-nd": [("creativecommons", "creativecommons org licenses by nd [1234] [05]")],
    "cc-by-nc": [("creativecommons", "creativecommons org licenses by nc [1234] [05]")],
    "cc-by-nc-sa": [("creativecommons", "creativecommons org licenses by nc sa [1234] [05]")],
    "cc-by-nc-nd": [("creativecommons", "creativecommons org licenses by nc nd [1234] [05]")],
    "odbl": [("opendatacommons", "opendatacommons org licenses odbl 1 0")],
    "ofl": [("font", "this font software is licensed under the sil open font license"), ("reserved", "copyright (?:c )?(?:[^ ]+ ){1,12}with reserved font name")],
    "eupl": [("eupl", "licensed under the eupl"), ("eupl", "joinup ec europa eu (?:[^ ]+ ){0,6}eupl")],
    "openssl": [("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit")],
    "postgresql": [("documentation", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted")],
    "python": [("psf", "psf is making python available to licensee on an as is basis")],
    "vim": [("vim", "maintainers of vim are not bound by")],
    "json": [("evil", "the software shall be used for good not evil")],
    "ncsa": [("contributors", "neither the names of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse")],
    "proprietary": [
        ("confidential", "(?:proprietary and confidential|confidential and proprietary)"),
        ("reserved", "all rights reserved(?: worldwide)?"),
        ("prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: or distribution)? of this (?:file|document|software|work|material) (?:via any medium )?is strictly prohibited"),
        ("permission", "may not be (?:copied|reproduced|distributed)(?: or distributed)? without (?:the )?(?:prior|express)(?: written)? permission"),
    ],
    "public-domain": [
        ("domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
        ("domain", "(?:this|the) (?:work|file|program|software|document) is in the public domain"),
        ("domain", "public domain dedication"),
    ],
}
#: Priority and confidence of a notice.
NOTICE = (75, 0.97)


def rules() -> list[tuple[list[str], str, str, int, float]]:
    """(keywords, pattern, label, priority, confidence) of every rule, in order of priority: the notices as written, and
    every name in every sentence."""
    made = [([keyword], pattern, label, *NOTICE) for label, listed in NOTICES.items() for keyword, pattern in listed]
    for name, (listed, pattern) in NAMES.items():
        label, keywords = name.removesuffix("-long"), listed.split()
        made += [(keywords, s.replace("{}", pattern), label, priority, sure) for priority, sure, s in SENTENCES]
        if name not in PLAIN:
            made.append((keywords, pattern, label, *ALONE))
    return sorted(made, key=lambda r: (-r[3], r[2], r[1]))


def _rule_table() -> Column:
    """The rules as one constant array, read from a JSON text so that the plan stays small."""
    import json

    listed = [{"keywords": k, "pattern": f"(?<= ){p}(?= )", "label": label, "priority": priority, "sure": sure} for k, p, label, priority, sure in rules()]
    return F.from_json(F.lit(json.dumps(listed)), "array<struct<keywords:array<string>,pattern:string,label:string,priority:int,sure:double>>")


def places(joined: Column, pattern: Column) -> Column:
    """Word numbers (first, last) of a pattern's matches in the joined words: matches are marked, and the marks counted off by word."""
    marked = F.split(F.trim(F.regexp_replace(joined, pattern, F.lit("\u0001$0\u0002"))), " ")

    def ends(words: Column) -> Column:
        at = lambda held: F.filter(F.transform(words, lambda w, i: F.when(held(w), i)), lambda i: i.isNotNull())
        return F.arrays_zip(at(lambda w: F.startswith(w, F.lit("\u0001"))).alias("first"), at(lambda w: F.endswith(w, F.lit("\u0002"))).alias("last"))

    return bound(marked, ends)


_KIND = "struct<first:int,last:int,label:string,priority:int,sure:double>"


def unsuppressed(found: Column) -> Column:
    """The detections that lie neither within one of higher priority nor within a longer one of equal priority.

    One sweep in order of their beginnings, longer ones first: the carry has for each priority the farthest end so far
    and the beginning of the detection that reached it first.
    """
    levels = sorted({r[3] for r in rules()})
    number = lambda d: F.array_position(F.array(*map(F.lit, levels)), d["priority"]).cast("int") - 1
    before = lambda x, y: (
        F.when(x["first"] != y["first"], x["first"] - y["first"])
        .when(x["last"] != y["last"], y["last"] - x["last"])
        .when(x["priority"] != y["priority"], y["priority"] - x["priority"])
        .otherwise(F.when(x["label"] < y["label"], -1).when(x["label"] > y["label"], 1).otherwise(0))
    )
    start = F.array(*(F.struct(F.lit(-1).alias("end"), F.lit(-1).alias("from")) for _ in levels))

    def step(reach: Column, d: Column):
        own = number(d)
        same = F.get(reach, own)
        longer = (same["end"] > d["last"]) | ((same["end"] == d["last"]) & (same["from"] != d["first"]))
        higher = F.exists(F.transform(reach, lambda r, i: (i > own) & (r["end"] >= d["last"])), lambda x: x)
        now = F.struct(d["last"].alias("end"), d["first"].alias("from"))
        after = F.transform(reach, lambda r, i: F.when((i == own) & (d["last"] > r["end"]), now).otherwise(r))
        return after, F.when(longer | higher, F.array().cast(f"array<{_KIND}>")).otherwise(F.array(d))

    return swept(F.array_sort(found, before), start, step, _KIND)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, base and found: arrays of (first, last, label, priority, sure), suppression applied to found."""
    # a letter that isn't ASCII stays one, so that only A-Z come to match; of all letters only the Kelvin sign wouldn't
    lower = F.lower(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))
    own = [c for c in docs.columns if c not in ("n_words", "base", "found")]
    words, keys, joined, every = fresh(docs, "words", "keys", "joined", "every")
    keywords = sorted({k for r in rules() for k in r[0]})
    none = F.array().cast(f"array<{_KIND}>")
    out = docs.withColumn(words, F.array_remove(F.split(lower, GAPS), ""))
    # the keywords that the text holds; a base phrase holds one too
    out = out.select(*own, words, F.size(words).cast("long").alias("n_words"), F.array_intersect(words, F.array(*map(F.lit, keywords))).alias(keys))
    out = out.withColumn(joined, F.when(F.size(keys) > 0, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))).drop(words)

    def detections(pattern: Column, label: Column, priority: Column, sure: Column) -> Column:
        full = lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), label.alias("label"), priority.alias("priority"), sure.alias("sure"))
        return F.transform(places(F.col(joined), pattern), full)

    base = [
        F.when(F.contains(joined, F.lit(f" {p} ")), detections(F.lit(f"(?<= ){p}(?= )"), F.lit(label), F.lit(100), F.lit(1.0))).otherwise(none)
        for p, label in BASE.items()
    ]
    active = F.filter(_rule_table(), lambda r: F.arrays_overlap(r["keywords"], F.col(keys)) & F.regexp_like(F.col(joined), r["pattern"]))
    found = F.flatten(F.transform(active, lambda r: detections(r["pattern"], r["label"], r["priority"], r["sure"])))
    out = out.withColumn("base", F.concat(*base)).withColumn(every, F.when(F.size(keys) > 0, found).otherwise(none))
    return out.select(*own, "n_words", "base", F.when(F.size(every) > 0, unsuppressed(F.col(every))).otherwise(none).alias("found"))


def op4_licenses(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    firsts = F.transform("base", lambda b: b["first"].cast("long"))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda b: b["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform(F.concat("base", "found"), lambda d: d["sure"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.concat("base", "found")).alias("labels"), score.alias("score"),
    )
