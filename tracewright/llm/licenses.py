"""Licence scans by sentence rules: known sentences become identifiers, and sequences of identifiers are matched against ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Identifier of a sentence, and its form after normalising. A sentence takes the first that matches.
SENTENCES = (
    ("apache-2-grant", r"^(this (work|file|software|project|code) is )?(licensed|released|distributed) under the (terms of the )?apache license version 2(\.0)?( the license)?$"),
    ("apache-2-comply", r"^you may not use this file except in compliance with the license$"),
    ("apache-2-copy", r"^you may obtain a copy of the license at( |$)"),
    ("apache-2-basis", r"^unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mit-grant", r"^(this (work|file|software|project|code) is )?(licensed|released|distributed) under the (terms of the )?mit license$"),
    ("mit-permission", r"^permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-notice", r"^the above copyright notice and this permission notice shall be included in all copies"),
    ("as-is", r"^the software is provided as is without warranty of any kind"),
    ("no-liability", r"^in no event shall the (authors|copyright holders|authors or copyright holders|copyright holder or contributors) be liable for any"),
    ("gpl-2-grant", r"^(this (work|file|software|project|code) is )?(licensed|released|distributed) under the (terms of the )?gnu general public license version 2$"),
    ("gpl-3-grant", r"^(this (work|file|software|project|code) is )?(licensed|released|distributed) under the (terms of the )?gnu general public license version 3$"),
    ("gpl-free", r"^this (program|library|file) is free software:? you can redistribute it and/or modify it under the terms of the gnu (lesser |affero )?general public license"),
    ("gpl-no-warranty", r"^this (program|library|file) is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-copy", r"^you should have received a copy of the gnu (lesser |affero )?general public license"),
    ("lgpl-grant", r"^(this (work|file|software|project|code) is )?(licensed|released|distributed) under the (terms of the )?gnu lesser general public license"),
    ("bsd-redistribution", r"^redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-endorse", r"^neither the name of .* nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-as-is", r"^this software is provided by the (copyright holders and contributors|authors?) as is and any express or implied warranties"),
    ("mpl-2-grant", r"^this source code form is subject to the terms of the mozilla public license v\. ?2\.0$"),
    ("cc-by-nc-4", r"^(this (work|text|document) is )?licensed under (a )?(cc|creative commons) (by-nc|attribution-noncommercial) 4\.0( international)?( license)?$"),
    ("cc-by-sa-4", r"^(this (work|text|document) is )?licensed under (a )?(cc|creative commons) (by-sa|attribution-sharealike) 4\.0( international)?( license)?$"),
    ("cc-by-4", r"^(this (work|text|document) is )?licensed under (a )?(cc|creative commons) (by|attribution) 4\.0( international)?( license)?$"),
    ("public-domain", r"^this (work|file|software|program) (is|has been) (placed |released )?in(to)? the public domain$"),
    ("spdx-apache-2", r"spdx-license-identifier: apache-2\.0$"),
    ("spdx-mit", r"spdx-license-identifier: mit$"),
    ("spdx-gpl-3", r"spdx-license-identifier: gpl-3\.0(-only)?$"),
    ("reserved", r"^all rights reserved$"),
)
#: Licence and the sequence of sentence identifiers that states it. Earlier rules win where several start at the same sentence.
RULES = (
    ("Apache-2.0", ("apache-2-grant", "apache-2-comply", "apache-2-copy", "apache-2-basis")),
    ("Apache-2.0", ("apache-2-grant", "apache-2-comply", "apache-2-copy")),
    ("Apache-2.0", ("apache-2-grant",)),
    ("MIT", ("mit-permission", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-permission", "mit-notice", "as-is")),
    ("MIT-notice-only", ("mit-permission", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0", ("gpl-3-grant",)),
    ("GPL-2.0", ("gpl-2-grant",)),
    ("GPL-family", ("gpl-free", "gpl-no-warranty", "gpl-copy")),
    ("GPL-family", ("gpl-free", "gpl-no-warranty")),
    ("GPL-family", ("gpl-free",)),
    ("LGPL", ("lgpl-grant",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-as-is")),
    ("MPL-2.0", ("mpl-2-grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("public-domain", ("public-domain",)),
    ("Apache-2.0", ("spdx-apache-2",)),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0", ("spdx-gpl-3",)),
    ("proprietary", ("reserved",)),
)
#: Every sentence form above holds one of these.
HINT = r"(?i)licen[sc]e|permission|warrant|liable|redistribut|copyright|free software|gnu |endorse|public domain|rights reserved"
SPLIT = r"[\r\n]+|[.!?]+[ \t\x0B\f\r\n]+"
#: One letter for each identifier, so that a document's sequence is a string and the rules one alternation; '.' is any other sentence.
LETTER = {name: chr(ord("A") + k) if k < 26 else chr(ord("a") + k - 26) for k, (name, _) in enumerate(SENTENCES)}
PATTERN = "|".join("".join(LETTER[s] for s in rule) for _, rule in RULES)


#: Parts of a text that aren't words of it: comment leaders and list numbers at the start of a line, comment ends at its end.
LEADER = r"(?m)^[ \t]*(?:(?://+|/\*+|\*+/?|#+|;+|--+|<!--|%+|REM\b|dnl\b)[ \t]*)?(?:\(?[0-9]{1,2}[.)][ \t]+)?|[ \t]*(?:\*+/|-->)[ \t]*$"
#: The address that ends "a copy of the License at" may stand on a line of its own, and "you may not" may follow a semicolon.
ADDRESS = r"(?i)(license at):?[ \t]*\n\s*<?(https?://[^\s>]+)>?[ \t]*(?=\n|$)"
GRANT_END = r"(?i);\s+(?=you\s+may\s+not\s)"
#: A sentence ends here, or with a paragraph; a single line break may be a blank.
ENDS = r"\n(?:[ \t]*\n)+|[.!?]+[ \t\x0B\f\n]+"
#: Conditions that stand between the sentences of a licence and don't part them.
BETWEEN = (r"^redistributions of source code must retain the above copyright", r"^redistributions in binary form must reproduce the above copyright")


def wrapped(form: str) -> str:
    """A form over whole lines; its blanks may be line breaks. A form with an open end takes the rest of its line."""
    body = form.replace(" ?", "[ \\n]?").replace(" (", "[ \\n](").replace(".*", "[^<>]*?")
    body = "".join("[ \\n]" if c == " " else c for c in body.replace("[ \\n]", "\0")).replace("\0", "[ \\n]")
    return "(?m)" + ("" if form.startswith("^") else r"^[^\n<]*") + body + ("" if form.endswith("$") else r"[^\n<]*$")


def normalise(part: Column) -> Column:
    """Lower case; other signs than . + : / - become one blank; no blanks or dots at the ends of lines; no empty lines."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(part), r"[^a-z0-9.+:/\n-]+", " "), r"(?m)^ +|[ .]+$", ""), r"^\n+|\n+$|(?<=\n)\n+", "")


def letters(text: Column) -> Column:
    """The document's sentences as letters. A form may start at the start of any line and, where it has an end, end with any line, so both wrapped sentences and one-line statements are found."""
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), LEADER, "")
    parts = F.split(F.regexp_replace(F.regexp_replace(text, ADDRESS, "$1 $2\n\n"), GRANT_END, ";\n"), ENDS)
    open_ends = "".join(LETTER[name] for name, form in SENTENCES if not form.endswith("$"))

    def part(p: Column) -> Column:
        out = normalise(p)
        for name, form in SENTENCES:
            out = F.regexp_replace(out, wrapped(form), f"<{LETTER[name]}>")
        for form in BETWEEN:
            out = F.regexp_replace(out, wrapped(form), "<_>")
        out = F.regexp_replace(out, rf"(<[{open_ends}_]>)(?:\n[^<\n]+)+", "$1")
        return F.regexp_replace(F.regexp_replace(out, r"(?m)^[^<\n]+$", "."), r"[<>_\n]", "")

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(HINT), part(p)).when(F.trim(F.regexp_replace(p, r"\s+", " ")) == "", "").otherwise(".")), "")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_known (licence sentences), sentences (their identifiers in order), licenses (of the rules that match in order, leftmost first, no sentence twice), one row per row.

    Sentences of a rule must follow each other without another sentence between. Sentences may be wrapped over lines and stand in comments; the SQL knows them on single lines only. Only whole texts with a hint of a licence are split. Null or empty text: nothing found. Null doc_id and repeated rows stay. Other columns are not read. Empty table: no rows. Nothing is shuffled.
    """
    d = pick(docs, doc_id="long", text="string").withColumn("seq", F.when(F.col("text").rlike(HINT), letters(F.col("text"))).otherwise(F.lit("")))
    names = F.create_map(*[F.lit(v) for pair in [(c, n) for n, c in LETTER.items()] for v in pair])
    rules = F.create_map(*[F.lit(v) for pair in dict((("".join(LETTER[s] for s in rule)), lic) for lic, rule in RULES).items() for v in pair])
    known = F.regexp_replace("seq", r"\.", "")
    found = F.transform(F.regexp_extract_all("seq", F.lit(f"({PATTERN})"), F.lit(1)), lambda m: rules[m])
    return d.select(
        "doc_id", F.coalesce(F.length(known), F.lit(0)).cast("long").alias("n_known"),
        F.coalesce(F.array_join(F.transform(F.filter(F.split(known, ""), lambda c: c != ""), lambda c: names[c]), ","), F.lit("")).alias("sentences"),
        F.coalesce(F.array_join(found, ","), F.lit("")).alias("licenses"),
    )


def _sql() -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_matches(s, {quote(form)}) THEN '{LETTER[name]}'" for name, form in SENTENCES)
    names = ", ".join(f"'{c}': '{n}'" for n, c in LETTER.items())
    rules = ", ".join(f"'{k}': '{v}'" for k, v in dict((("".join(LETTER[s] for s in rule)), lic) for lic, rule in RULES).items())
    return f"""
WITH s AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '{SPLIT}'), lambda x: trim(x) <> ''), []) AS parts FROM documents),
n AS (SELECT doc_id, list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '{HINT}') THEN regexp_replace(regexp_replace(lower(x), '[^a-z0-9.+:/-]+', ' ', 'g'), '^ +|[ .]+$', '', 'g') ELSE '.' END) AS forms FROM s),
q AS (SELECT doc_id, array_to_string(list_transform(list_filter(forms, lambda f: f <> ''), lambda s: CASE WHEN s = '.' THEN '.' {cases} ELSE '.' END), '') AS seq FROM n)
SELECT doc_id, CAST(length(replace(seq, '.', '')) AS BIGINT) AS n_known,
  coalesce(array_to_string(list_transform(list_filter(string_split(replace(seq, '.', ''), ''), lambda c: c <> ''), lambda c: MAP {{{names}}}[c]), ','), '') AS sentences,
  coalesce(array_to_string(list_transform(regexp_extract_all(seq, '({PATTERN})', 1), lambda m: MAP {{{rules}}}[m]), ','), '') AS licenses
FROM q"""


LICENSE_SQL = _sql()
