"""License scans by sentence rules.

A text is cut into sentences, at blank lines and at a full stop, ! or ? before white space; wrapped lines stay together. A known
licence sentence begins and ends at the start and end of a sentence, a line or a part before a semicolon, and may
run over several of them. All are normalised. Sentences of fixed words are looked up by how they open, names of
licences in a table of names, and the few sentences with parts that vary are patterns. This gives a sequence of
sentence identifiers. Ordered rules match runs of that sequence: at each place the first rule that matches takes its
run, and the scan goes on behind it. A sentence that is known but taken by no rule is reported as `unmatched`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches

#: What may stand before the name of a licence.
LEAD = r"(?:this .{1,60} is )?"
UNDER = r"(?:released|licensed|distributed|available|provided|published)(?: under| by)(?: the terms of)?(?: the| an?)?"
#: Known sentences of fixed words, normalised, by identifier (fixed values: sentences of the licences' texts and notices).
FIXED = {
    "afl_grant": "licensed under the academic free license version 3 0",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_copy": "you may not use this file except in compliance with the license",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost_see": "distributed under the boost software license version 1 0",
    "bsd_ad": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cddl_notice": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "epl_notice_1": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
    "epl_notice_2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "epl_notice_at": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_grant_old": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "library_hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_grant_free": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "mpl_old": "the contents of this file are subject to the mozilla public license version 1 1 the license",
    "ofl": "this font software is licensed under the sil open font license version 1 1",
    "postgres_grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_use": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "zero_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib_altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib_notice": "this notice may not be removed or altered from any source distribution",
    "zlib_origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
}
#: Names, normalised and without "license" at the end, of licences that the patterns below don't name (fixed values).
NAMES_OF = {
    "0BSD": ["0bsd", "bsd zero clause", "zero clause bsd"],
    "AFL-3.0": ["academic free license 3 0", "academic free license version 3 0"],
    "APSL-2.0": ["apple public source license 2 0", "apple public source license version 2 0"],
    "Artistic-1.0": ["artistic license 1 0", "artistic"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "BSL-1.0": ["boost software", "boost software license 1 0", "boost software license version 1 0", "bsl 1 0"],
    "BUSL-1.1": ["business source license 1 1", "business source license version 1 1", "busl 1 1"],
    "BlueOak-1.0.0": ["blue oak model license 1 0 0"],
    "CDDL-1.0": ["cddl 1 0", "common development and distribution license 1 0", "common development and distribution license version 1 0"],
    "CDDL-1.1": ["cddl 1 1", "common development and distribution license 1 1"],
    "CECILL-2.1": ["cecill 2 1", "cecill free software license agreement v2 1"],
    "CPL-1.0": ["common public license 1 0", "common public license version 1 0"],
    "ECL-2.0": ["educational community license version 2 0"],
    "EPL-1.0": ["eclipse public license 1 0", "eclipse public license v1 0", "eclipse public license version 1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license v 2 0", "eclipse public license version 2 0", "epl 2 0"],
    "EUPL-1.1": ["eupl 1 1", "european union public licence 1 1"],
    "EUPL-1.2": ["eupl 1 2", "european union public licence 1 2", "european union public licence version 1 2"],
    "Elastic-2.0": ["elastic license 2 0"],
    "GFDL-1.3": ["gnu free documentation license 1 3", "gnu free documentation license version 1 3"],
    "HPND": ["historical permission notice and disclaimer"],
    "IPL-1.0": ["ibm public license 1 0", "ibm public license version 1 0"],
    "ISC": ["isc"],
    "LPPL-1.3c": ["latex project public license 1 3c", "latex project public license version 1 3c", "lppl 1 3c"],
    "MIT-0": ["mit 0", "mit no attribution"],
    "MPL-1.1": ["mozilla public license 1 1", "mozilla public license version 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla public license 2 0", "mozilla public license v2 0", "mozilla public license v 2 0", "mozilla public license version 2 0", "mpl 2 0", "mpl v2 0"],
    "MS-PL": ["microsoft public", "ms pl"],
    "MS-RL": ["microsoft reciprocal", "ms rl"],
    "NCSA": ["ncsa", "university of illinois ncsa open source"],
    "ODbL-1.0": ["odbl 1 0", "open data commons open database license v1 0", "open database license 1 0"],
    "OFL-1.1": ["ofl 1 1", "sil open font", "sil open font license 1 1", "sil open font license version 1 1"],
    "OSL-3.0": ["open software license 3 0", "open software license version 3 0"],
    "OpenSSL": ["openssl"],
    "PHP-3.01": ["php license 3 01", "php license version 3 01"],
    "PSF-2.0": ["psf", "python software foundation", "python software foundation license version 2"],
    "PostgreSQL": ["postgresql"],
    "QPL-1.0": ["q public license 1 0", "q public license version 1 0"],
    "Ruby": ["ruby"],
    "SSPL-1.0": ["server side public license 1", "server side public license version 1", "sspl 1 0"],
    "UPL-1.0": ["universal permissive license 1 0", "universal permissive license v 1 0"],
    "Unlicense": ["unlicense"],
    "Vim": ["vim"],
    "W3C": ["w3c software notice and"],
    "WTFPL": ["do what the fuck you want to public", "wtfpl"],
    "X11": ["x11"],
    "Zlib": ["zlib", "zlib libpng"],
}
_ID = {name: of for of, names in NAMES_OF.items() for name in names}
_ANY = "|".join(sorted(_ID, key=lambda x: (-len(x), x)))
_GPL = r"(?:(?:gnu )?(?P<kind>lesser general|library general|affero general|general) public licen[sc]e|(?:gnu )?(?P<short>[la]?gpl))"
_GPL_VERSION = r"(?: as published by the free software foundation)?(?: ?(?:version |v)? ?(?P<v>[123](?: [01])?))?(?P<later> or (?:\(?at your option\)? )?(?:any )?later(?: version)?)?(?: only)?"
#: Known sentences with parts that vary, normalised, by identifier (fixed values: patterns that one or more whole lines of a sentence must match).
SENTENCES = {
    "spdx": r"spdx license identifier (?P<id>[a-z0-9 .+-]+?)",
    "mit_name": LEAD + rf"(?:{UNDER} mit|(?:{UNDER} |the )?mit licen[sc]e)(?: licen[sc]e)?(?: mit)?",
    "as_is": r"(?:the|this) software is provided (?:by the .{1,80} )?as is .*",
    "no_liability": r"in no event (?:shall|will) (?:the )?(?:authors?|copyright|regents|.{1,60} be liable) .*",
    "apache_name": LEAD + rf"(?:{UNDER} )?apache(?: licen[sc]e)?(?: version)? ?v?2(?: 0)?(?: licen[sc]e)?(?: the license)?",
    "apache_obtain": r"you may obtain a copy of the license at(?: .*)?",
    "bsd_name": LEAD + rf"(?:{UNDER} )?(?:the )?(?:terms of the )?(?:new |modified |simplified )?(?:bsd|(?P<n>[234]) clause bsd|bsd (?P<m>[234]) clause) licen[sc]e",
    "bsd_endorse": r"neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl_name": LEAD + rf"(?:{UNDER} {_GPL}{_GPL_VERSION}(?: licen[sc]e)?|{_GPL.replace('<kind>', '<kind2>').replace('<short>', '<short2>')}{_GPL_VERSION.replace('<v>', '<v2>').replace('<later>', '<later2>')} licen[sc]e)",
    "gpl_free": r"(?:this program|this library|this file|.{1,60}) is free software you can redistribute it and or modify it under the terms of the gnu (?P<kind>lesser general|library general|affero general|general) public license as published by the free software foundation either version (?P<v>[123](?: [01])?) of the license or at your option any later version",
    "gpl_see": r"see the gnu (?:lesser general|library general|affero general|general) public license for more details",
    "cc_name": LEAD + r"(?:licensed|released|distributed|available) under (?:an? |the )?(?:creative commons |cc )(?P<cc>by(?: (?:nc sa|nc nd|nc|sa|nd))?|attribution(?: (?:non ?commercial|share ?alike|no ?derivatives))*)(?: (?P<v>[1234] [05]))?(?: international| unported)?(?: license)?",
    "cc_zero": r"(?:(?:this work is )?(?:licensed|released|dedicated) (?:under|to) )?(?:the )?(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?(?: license)?",
    "name": LEAD + rf"(?:{UNDER} (?P<name>{_ANY})(?: licen[sc]e)?|(?:the )?(?P<name2>{_ANY}) licen[sc]e)(?: the license)?(?: see .*)?",
    "public_domain": r"(?:this .{1,40} is |released |placed |dedicated )(?:into |in |to )?the public domain",
    "all_rights": r"(?:copyright .{0,80} )?all rights reserved",
}
#: Ordered rules: the licence, and the sentence identifiers it takes; a trailing ? makes one optional. {x} is a named part of a sentence.
RULES = (
    ("SPDX:{id}", ("spdx",)),
    ("BSD-4-Clause", ("bsd_name?", "bsd_grant", "bsd_source", "bsd_binary", "bsd_ad", "bsd_endorse?", "as_is?", "no_liability?")),
    ("BSD-3-Clause", ("bsd_name?", "bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "as_is?", "no_liability?")),
    ("BSD-2-Clause", ("bsd_name?", "bsd_grant", "bsd_source", "bsd_binary", "as_is?", "no_liability?")),
    ("MIT", ("mit_name?", "mit_grant", "mit_notice?", "as_is?", "no_liability?")),
    ("MIT-0", ("name=MIT-0?", "mit_grant_free", "as_is?", "no_liability?")),
    ("BSL-1.0", ("name=BSL-1.0?", "boost_grant", "as_is?", "no_liability?")),
    ("BSL-1.0", ("boost_see",)),
    ("ISC", ("name=ISC?", "isc_grant", "as_is?", "no_liability?")),
    ("ISC", ("name=ISC?", "isc_grant_old", "as_is?", "no_liability?")),
    ("0BSD", ("name=0BSD?", "zero_grant", "as_is?", "no_liability?")),
    ("PostgreSQL", ("name=PostgreSQL?", "postgres_grant", "no_liability?")),
    ("Zlib", ("name=Zlib?", "zlib_as_is?", "no_liability?", "zlib_grant", "zlib_origin?", "zlib_altered?", "zlib_notice?")),
    ("Unlicense", ("name=Unlicense?", "unlicense_free", "unlicense_use?", "as_is?", "no_liability?")),
    ("WTFPL", ("name=WTFPL?", "wtfpl")),
    ("Apache-2.0", ("apache_name", "apache_copy?", "apache_obtain?", "apache_as_is?", "apache_see?")),
    ("{kind}-{v}-or-later", ("gpl_free", "gpl_hope?", "library_hope?", "gpl_see?")),
    ("{kind}-{v}{later}", ("gpl_name", "gpl_hope?", "library_hope?", "gpl_see?")),
    ("AFL-3.0", ("afl_grant",)),
    ("CC0-1.0", ("cc_zero",)),
    ("CC-{cc}-{v}", ("cc_name",)),
    ("CDDL", ("cddl_notice",)),
    ("EPL-1.0", ("epl_notice_1",)),
    ("EPL-2.0", ("epl_notice_2",)),
    ("EPL-2.0", ("epl_notice_at",)),
    ("MPL-2.0", ("mpl", "mpl_copy?")),
    ("MPL-1.1", ("mpl_old",)),
    ("OFL-1.1", ("ofl",)),
    ("MIT", ("mit_name",)),
    ("BSD{n}", ("bsd_name",)),
    ("{name}", ("name",)),
    ("Public-Domain", ("public_domain",)),
    ("All-Rights-Reserved", ("all_rights",)),
)
#: A text without any of these can't hold a known sentence. Words of one may stand in two lines.
HINT = re.compile(r"licen|permi(?:ss|tt)|\b(?:mit|[la]?gpl|mpl|epl|wtfpl)|this[^a-z0-9+]+(?:software|notice)|altered[^a-z0-9+]+source|advertising[^a-z0-9+]+material|unencumbered|anyone[^a-z0-9+]+is[^a-z0-9+]+free|public[^a-z0-9+]+domain|redistribut|rights[^a-z0-9+]+reserved|as[^a-z0-9+]+is|cc0|creative[^a-z0-9+]+commons|liab|warrant|free[^a-z0-9+]+software|applicable[^a-z0-9+]+law|gnu[^a-z0-9+]", re.I)
#: Between sentences: white space behind an end mark (not that of "v. 2.0"), or lines without a letter or digit (of ASCII: known sentences have no others).
END = re.compile(r"(?<=[.!?])(?<!\W[vV]\.)\s+|(?:\r\n?+|\n)(?:[^A-Za-z0-9\r\n]*+(?:\r\n?+|\n))+")
#: Between the lines and parts of a sentence.
SOFT = re.compile(r"(?<=;)\s+|[\r\n]+")
NAMES = {"general": "GPL", "lesser general": "LGPL", "library general": "LGPL", "affero general": "AGPL", "gpl": "GPL", "lgpl": "LGPL", "agpl": "AGPL"}


def _over_lines(pattern: str) -> re.Pattern[bytes]:
    """The pattern over the lines of a sentence, which MORE or KNOWN joins, ending with a line: its spaces match both, its dots no KNOWN."""
    each = {" ": r"[ \n|]", ".": r"[^|]"}
    # character classes and escapes stay as they are
    lines = re.sub(r"\[[^]]*\]|\\.|[ .]", lambda m: each.get(m[0], m[0]), pattern)
    return re.compile(f"(?:{lines})(?=[\\n|]|\\Z)".encode())


#: What stands before a line: at a line with which a known sentence begins, KNOWN.
MORE, KNOWN = b"\n|"
_known = [(name, _over_lines(p)) for name, p in SENTENCES.items()]
#: The fixed sentences by their first letters, longest first.
OPENING = 12
_fixed: dict[bytes, list[tuple[bytes, str]]] = {}
for _name_, _sentence in sorted(FIXED.items(), key=lambda x: (-len(x[1]), x[0])):
    _fixed.setdefault(_sentence.encode()[:OPENING], []).append((_sentence.encode(), _name_))
#: The mark of an item of a list.
ITEM = re.compile(rb"(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})[ \n|]")


def _look_up(plain: bytes, ends: set[int], at: int) -> tuple[str, int] | None:
    """Identifier and end of the fixed sentence that begins at a place and ends with a line."""
    for sentence, name in _fixed.get(plain[at : at + OPENING], ()):
        if at + len(sentence) in ends and plain.startswith(sentence, at):
            return name, at + len(sentence)
    return None


def normalise(sentence: str) -> str:
    """Lower case; comment marks, quotes and punctuation as spaces; one space between words."""
    return " ".join(re.findall(r"[a-z0-9+]+", sentence.lower()))


def _pieces(text: str, cut: re.Pattern[str], at: int, end: int) -> Iterator[tuple[int, int]]:
    """Start and end of what cut leaves of text[at:end]."""
    for m in cut.finditer(text, at, end):
        yield at, m.start()
        at = m.end()
    yield at, end


def sentence_ids(text: str) -> list[tuple[str, dict[str, str], int, int]]:
    """Identifier, named parts, start and end (code points) of each known sentence of a text, in order."""
    found = []
    if not HINT.search(text):
        return found
    for at, stop in _pieces(text, END, 0, len(text)):
        if HINT.search(text, at, stop):
            found += _in_sentence(text, at, stop)
    return found


def _in_sentence(text: str, at: int, stop: int) -> list[tuple[str, dict[str, str], int, int]]:
    lines = [(s, e, norm.encode()) for s, e in _pieces(text, SOFT, at, stop) if (norm := normalise(text[s:e]))]
    buffer = bytearray(bytes([MORE]).join(x[2] for x in lines))
    begins, hits, k = [], {}, 0
    for x in lines:
        begins.append(k)
        k += len(x[2]) + 1
    # the separators as spaces, and where lines end
    plain, ends = bytes(buffer).replace(b"\n", b" "), {b - 1 for b in begins[1:]} | {len(buffer)}
    # from the last line on: what a wildcard takes ends before a line with which a known sentence begins
    for i in range(len(lines) - 1, -1, -1):
        item = ITEM.match(plain, begins[i])
        for at in (begins[i], item.end()) if item else (begins[i],):
            fixed = _look_up(plain, ends, at)
            if fixed:
                hits[i] = (fixed[0], {}, bisect_left(begins, fixed[1]))
                break
            hit = next(((name, m) for name, pattern in _known if (m := pattern.match(buffer, at))), None)
            if hit:
                name, m = hit
                hits[i] = (name, {k.rstrip("2"): re.sub(r"[\n|]", " ", v.decode()) for k, v in m.groupdict().items() if v}, bisect_left(begins, m.end()))
                break
        if i in hits and i:
            buffer[begins[i] - 1] = KNOWN
    found, i = [], 0
    while i < len(lines):
        if i in hits:
            name, parts, after = hits[i]
            (first, _, _), (last, end, _) = lines[i], lines[after - 1]
            start = end - len(text[first:end].lstrip())
            found.append((name, parts, start, last + len(text[last:end].rstrip())))
            i = after
        else:
            i += 1
    return found


def _name(pattern: str, parts: dict[str, str]) -> str:
    value = {
        "kind": NAMES.get(parts.get("kind", parts.get("short", "")), "GPL"),
        "name": _ID.get(parts.get("name", ""), ""),
        "n": f"-{parts.get('n', parts.get('m', ''))}-Clause" if "n" in parts or "m" in parts else "",
        "v": parts.get("v", "").replace(" ", "."),
        "later": "-or-later" if "later" in parts else "-only",
        "id": parts.get("id", "").replace(" ", "-").upper(),
        "cc": parts.get("cc", "").upper().replace("ATTRIBUTION", "BY").replace("NONCOMMERCIAL", "NC").replace("NON COMMERCIAL", "NC").replace("SHAREALIKE", "SA").replace("SHARE ALIKE", "SA").replace("NODERIVATIVES", "ND").replace("NO DERIVATIVES", "ND").replace(" ", "-"),
    }
    if pattern.startswith("{kind}"):
        full = value["v"] if "." in value["v"] else value["v"] + ".0" if value["v"] else ""
        value["v"] = full
        if not full:
            return value["kind"]
    return pattern.format(**value).rstrip("-")


def match_rules(found: list[tuple[str, dict[str, str], int, int]]) -> list[tuple[str, int, int]]:
    """Licence (or `unmatched`), start and end of each run that a rule takes."""
    out, i = [], 0
    while i < len(found):
        for name, rule in RULES:
            j, parts = i, {}
            for want in rule:
                id_, _, of = want.rstrip("?").partition("=")
                if j < len(found) and found[j][0] == id_ and (not of or _ID.get(found[j][1].get("name", "")) == of):
                    parts |= found[j][1]
                    j += 1
                elif not want.endswith("?"):
                    break
            else:
                if j > i:
                    out.append((_name(name, parts), found[i][2], found[j - 1][3]))
                    i = j
                    break
        else:
            out.append(("unmatched", found[i][2], found[i][3]))
            i += 1
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, licenses (distinct, sorted), sentence_ids (in order) and spans (license, start, end) of every row of docs.

    Whole texts are read. Null and empty texts, and texts without a known sentence, have empty lists. Rows repeated are
    rows of their own; other columns are left aside, whatever their names; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            ids, names, spans = [], [], []
            for x in batch.column(1):
                found = sentence_ids(x.as_py() or "")
                runs = match_rules(found)
                ids.append([f[0] for f in found])
                names.append(sorted({r[0] for r in runs} - {"unmatched"}))
                spans.append([{"license": a, "start": s, "end": e} for a, s, e in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(span))], names=["id", "licenses", "sentence_ids", "spans"])

    return rows.mapInArrow(scan, f"id {kind}, licenses array<string>, sentence_ids array<string>, spans array<struct<license:string,start:int,end:int>>").withColumnRenamed("id", id_col)
