"""Licence scans by canonical digests, in built-in functions only.

A text is brought to a canonical form (case, quotes and dashes, copyright lines, punctuation,
equivalent spellings, white space); its digest is looked up among those of known licences. Whole
texts meet whole licences; each line of a text meets the notices of one line.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal (pattern, replacement).
SPELLINGS = [
    ("licence", "license"),
    ("(^| )sub license", "$1sublicense"),
    ("(^| )non commercial", "$1noncommercial"),
    ("(^| )per cent( |$)", "$1percent$2"),
    ("(^| )copyright owner", "$1copyright holder"),
    ("isation( |$)", "ization$1"),
    ("ise( |$)", "ize$1"),
    ("(^| )favour", "$1favor"),
    ("(^| )judgement", "$1judgment"),
    ("(^| )whilst( |$)", "$1while$2"),
    ("(^| )https ", "$1http "),
]

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
# Texts of public licences and notices of one line.
KNOWN = [
    (
        "MIT",
        "text",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.\n\n" + _WARRANTY,
    ),
    (
        "ISC",
        "text",
        "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all "
        "copies.\n\n" + _ISC_WARRANTY,
    ),
    ("0BSD", "text", "BSD Zero Clause License\n\n" + _ISC_GRANT + ".\n\n" + _ISC_WARRANTY),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
]

_COPYRIGHT_LINE = "(^|\\n)[^\\n]*(copyright[ \\t]*(\\(c\\)|\u00a9|[0-9])|\\(c\\)[ \\t]*[0-9]|\u00a9|all rights reserved)[^\\n]*"
_STEPS = [
    (_COPYRIGHT_LINE, "$1"),
    ("[^a-z0-9\u00df-\u00f6\u00f8-\u024f\u0370-\u1fff\u3040-\ud7ff]+", " "),
    *SPELLINGS,
]


# Where a text has no line breaks, a copyright statement ends with its sentence or before the grant.
_COPYRIGHT_SENTENCE = (
    "(?:copyright[ \t]*(?:\\(c\\)|\u00a9|[0-9])|\\(c\\)[ \t]*[0-9]|\u00a9|all rights reserved)(?:[^.]|\\.(?=\\S)|(?<=\\W[a-z])\\.){0,300}?"
    "(?:(?<!\\W[a-z])\\.(?=\\s|$)|$|(?=\\b(?:permission|redistribution|all rights|licensed|released|distributed|this (?:software|work|program|is)|everyone|copyright[ \t]*(?:\\(c\\)|\u00a9|[0-9]))))"
)
# Canonical start of a notice; what follows is the name of a licence.
_LEAD = (
    "^(?:(?:this|the|our|all) (?:\\w+ ){1,3}?(?:is|are) )?(?:(?:dual )?(?:licensed|released|distributed|published|available|provided|covered|made available|free software) (?:under|by)"
    "|spdx license identifier|license) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
)
_MAY_NOTE = "(?i)licen[cs]|(?:released|distributed|published|available|provided|covered)\\s+(?:under|by)"
#: Tables of whole licences up to this many rows are sent to all tasks; larger ones are joined.
SENT_LICENCES = 50_000


def canonical(text: Column) -> Column:
    """Canonical form; a null text is empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    lines, sentence = _STEPS[0], _COPYRIGHT_SENTENCE
    out = F.when(F.contains(out, F.lit("\n")), F.regexp_replace(out, *lines)).otherwise(F.regexp_replace(out, sentence, " "))
    for pattern, to in _STEPS[1:]:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def canonical_sql(text: str) -> str:
    """The same in the SQL of the tests (patterns read alike there)."""
    out = f"lower(coalesce({text}, ''))"
    for pattern, to in _STEPS:
        named = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{named}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim({out}, ' ')"


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licences(spark: SparkSession, rows=None) -> DataFrame:
    """Digests of a list of (licence, ``text`` or ``notice`` or ``name``, text); by default the shipped table."""
    if rows is None:
        from .licence_table import rows as shipped

        rows = shipped()
    df = spark.createDataFrame(rows, "licence string, kind string, text string")
    form = canonical(F.col("text"))
    return df.select(digest(F.col("text")).alias("digest"), "licence", "kind", F.length(form).alias("size"), form.contains("license").alias("licensed"), F.when(F.col("kind") == "name", form).alias("name"))


def _map(of: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(of)), "map<string,string>")


def scan(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, licence, notices`` of every row: the licence whose canonical text the
    whole text is (else null), and the licences that its lines give notice of, sorted, distinct and
    joined by blanks (empty, if none).

    ``known`` is made by ``known_licences``; of several
    licences with one digest the first by name counts. A null or blank text has the digest of the
    empty text and no licence. Repeated rows and rows without an id stay rows of their own.
    """
    known = known if known is not None else known_licences(df.sparkSession)
    best = known.where("size > 0").groupBy("digest", "kind").agg(F.min("licence").alias("licence"))
    whole = best.where("kind = 'text'").select("digest", "licence")
    # The notices are a short fixed list, looked up in place.
    notices = known.where("kind = 'notice' and size > 0").select("digest", "licence", "licensed").collect()
    names = {r.name: r.licence for r in known.where("kind = 'name' and size > 0").select("name", "licence").orderBy(F.desc("licence")).collect()}
    found = {r.digest: r.licence for r in sorted(notices, key=lambda r: r.licence, reverse=True)}
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if found or names:
        table = _map(found)
        lines = F.split("text", "\n")
        if all(r.licensed for r in notices):  # then only lines with this word, or with the lead of a name, can be one of them
            lines = F.filter(lines, lambda x: x.rlike(_MAY_NOTE if names else "(?i)licen[cs]e"))
        forms = F.transform(lines, canonical)
        named = F.transform(forms, lambda x: F.try_element_at(table, F.sha2(x.cast("binary"), 256)))
        if names:
            led = F.filter(forms, lambda x: x.rlike(_LEAD))
            named = F.concat(named, F.transform(led, lambda x: F.try_element_at(_map(names), F.regexp_replace(x, _LEAD, ""))))
        noted = F.array_join(F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))), " ")
    else:
        noted = F.lit("")
    rows = rows.select("doc_id", digest(F.col("text")).alias("digest"), noted.alias("notices"))
    return rows.join(F.broadcast(whole) if whole.count() <= SENT_LICENCES else whole, "digest", "left").select("doc_id", "digest", "licence", "notices")
