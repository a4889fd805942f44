"""License scans: known sentences, then ordered rules over the sequence of their identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, pick

#: (identifier, pattern over a normalised sentence), first match wins.
SENTENCES = (
    ("LGPL3Ref", r"\b(gnu )?(lesser|library) general public license\b.*\b(version|v)? ?3\b|\blgpl ?v?3\b"),
    ("LGPL2Ref", r"\b(gnu )?(lesser|library) general public license\b.*\b(version|v)? ?2(\.[01])?\b|\blgpl ?v?2\b"),
    ("AGPL3Ref", r"\b(gnu )?affero general public license\b|\bagpl ?v?3\b"),
    ("GPL3Ref", r"\b(gnu )?general public license\b.*\b(version|v) ?3\b|\bgpl ?v?3\b"),
    ("GPL2Ref", r"\b(gnu )?general public license\b.*\b(version|v) ?2\b|\bgpl ?v?2\b"),
    ("GPLAnyRef", r"\b(licensed|distributed|released|available) under\b.*\bgeneral public license\b|\bterms of the gnu general public license\b"),
    ("LaterVersion", r"^(or )?(at your option )?any later version$"),
    ("Apache2Ref", r"\bapache license,? version 2(\.0)?\b|\bapache ?2\.0\b"),
    ("ApacheUse", r"^you may not use this (file|software) except in compliance with the license$"),
    ("ApacheCopy", r"^you may obtain a copy of the license at\b"),
    ("AsIsLicense", r"\bunder the license is distributed on an as is basis\b"),
    ("MITRef", r"\b(licensed|released|distributed|available) under (the )?(terms of the )?mit license\b|^(the )?mit license$"),
    ("MITGrant", r"^permission is hereby granted,? free of charge,? to any person obtaining a copy of this software\b"),
    ("MITNotice", r"^the above copyright notice and this permission notice shall be included\b"),
    ("ISCGrant", r"^permission to use,? copy,? modify,? (and/or|and or|and) distribute this software for any purpose\b"),
    ("BSDGrant", r"^redistribution and use in source and binary forms,? with or without modification,? are permitted\b"),
    ("BSDSource", r"^redistributions of source code must retain\b"),
    ("BSDBinary", r"^redistributions in binary form must reproduce\b"),
    ("BSDEndorse", r"^neither the name of\b.*\bmay be used to endorse or promote\b"),
    ("BSDRef", r"\b(licensed|released|distributed) under (the )?(terms of the )?([23]-clause )?bsd license\b"),
    ("CCByNcSa", r"\bcc[ -]by-nc-sa\b|\bcreative commons attribution-noncommercial-sharealike\b"),
    ("CCByNcNd", r"\bcc[ -]by-nc-nd\b|\bcreative commons attribution-noncommercial-noderiv"),
    ("CCByNc", r"\bcc[ -]by-nc\b|\bcreative commons attribution-noncommercial\b"),
    ("CCBySa", r"\bcc[ -]by-sa\b|\bcreative commons attribution-sharealike\b"),
    ("CCByNd", r"\bcc[ -]by-nd\b|\bcreative commons attribution-noderiv"),
    ("CCBy", r"\bcc[ -]by\b|\bcreative commons attribution\b"),
    ("CC0", r"\bcc0\b|\bcreative commons zero\b"),
    ("MPL2Ref", r"\bmozilla public license\b.*\b2(\.0)?\b|\bmpl ?2\.0\b"),
    ("UnlicenseRef", r"^this is free and unencumbered software released into the public domain$"),
    ("PublicDomain", r"\b(released into|in|dedicated to) the public domain\b"),
    ("AllRights", r"\ball rights reserved\b"),
    ("AsIs", r"\bprovided as is\b.*\bwithout warrant"),
    ("CopyrightLine", r"^(copyright|\(c\)) .*\b[12][0-9]{3}\b"),
)
#: (license, pattern over the remaining identifiers, each between commas); tried in order, what
#: matches is used up, so a later and weaker rule can't name the same sentences again.
RULES = (
    ("BSD-3-Clause", r",BSDGrant,BSDSource,BSDBinary,BSDEndorse,"),
    ("BSD-2-Clause", r",BSDGrant,BSDSource,BSDBinary,"),
    ("Apache-2.0", r",Apache2Ref,ApacheUse,ApacheCopy,(Apache2Ref,)?(AsIsLicense,)?"),
    ("Apache-2.0", r",Apache2Ref,(ApacheUse,)?"),
    ("MIT", r",MITRef,MITGrant,MITNotice,(AsIs,)?"),
    ("MIT", r",MITGrant,MITNotice,(AsIs,)?"),
    ("MIT", r",MITRef,"),
    ("ISC", r",ISCGrant,(AsIs,)?"),
    ("LGPL-3.0-or-later", r",LGPL3Ref,LaterVersion,"),
    ("LGPL-3.0-only", r",LGPL3Ref,"),
    ("LGPL-2.1-or-later", r",LGPL2Ref,LaterVersion,"),
    ("LGPL-2.1-only", r",LGPL2Ref,"),
    ("AGPL-3.0", r",AGPL3Ref,(LaterVersion,)?"),
    ("GPL-3.0-or-later", r",GPL3Ref,LaterVersion,"),
    ("GPL-3.0-only", r",GPL3Ref,"),
    ("GPL-2.0-or-later", r",GPL2Ref,LaterVersion,"),
    ("GPL-2.0-only", r",GPL2Ref,"),
    ("GPL", r",GPLAnyRef,"),
    ("BSD", r",BSDRef,"),
    ("CC-BY-NC-SA", r",CCByNcSa,"),
    ("CC-BY-NC-ND", r",CCByNcNd,"),
    ("CC-BY-NC", r",CCByNc,"),
    ("CC-BY-SA", r",CCBySa,"),
    ("CC-BY-ND", r",CCByNd,"),
    ("CC-BY", r",CCBy,"),
    ("CC0-1.0", r",CC0,"),
    ("MPL-2.0", r",MPL2Ref,"),
    ("Unlicense", r",UnlicenseRef,"),
    ("Public-domain", r",PublicDomain,"),
    ("Proprietary", r",CopyrightLine,AllRights,|,AllRights,"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[ \t\n\x0b\f\r]"
#: What a sentence must hold to be looked up at all; anything but letters and digits may stand between words.
HINT = "licen|copyright|permission|redistribution|public domain|warrant|rights reserved|lgpl|gpl|cc0|cc by|creative commons|apache|mpl|later version|neither the name|obtain a copy".replace(" ", "[^a-z0-9]+") + r"|\(c\)"
#: What comments begin and end their lines with.
LEADER = r"^[ \t]*(?:/\*+|\*+/|//+|#+|\*+|--+|;+|%+)[ \t]*"
#: Lines that are sentences of their own: a title, a copyright line with its year.
ALONE = r"^[ \t#*/-]*(?:(?:the )?mit license|all rights reserved\.?|(?:copyright|\(c\))[^\n]*\b[12][0-9]{3}\b[^\n]*)[ \t\r]*$"
#: A single line end is white space, as texts are wrapped, except before what begins a known sentence.
STARTS = (r"[ \t\r#*/-]*(?:\d+[.)][ \t]+)?(?:permission (?:is hereby granted|to use)|redistributions? (?:and use|of source|in binary)|neither the name of"
          r"|the above copyright notice and|you may (?:not use|obtain)|this is free and unencumbered|all rights reserved|(?:or )?(?:\(?at your option\)? )?any later version)")
#: "or any later version" is a sentence of its own.
LATER = rf"or{_SPACE}+(?:\(?at{_SPACE}+your{_SPACE}+option\)?{_SPACE}+)?any{_SPACE}+later{_SPACE}+version"
BREAK = rf"\n[ \t\r]*\n{_SPACE}*|[.!?]{_SPACE}+|\n(?={STARTS})|,?{_SPACE}+(?={LATER})"


def _normal(s: Column) -> Column:
    """One space between words; brackets go, but for (c)."""
    s = F.regexp_replace(s, r"[^a-z0-9.,()/+ -]+|\((?!c\))|(?<!\(c)\)", " ")
    return F.regexp_replace(F.regexp_replace(s, r" +", " "), r"^[ .,]+|[ .,]+$", "")


def scan(docs: DataFrame, sentences=SENTENCES, rules=RULES) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids (in order, comma-joined) and licenses, for every row.

    Licenses are in the order of the rules, comma-joined, each once; empty where no rule matches. Only A-Z are lower-cased. Null and empty
    texts have no sentences; repeated rows give repeated results; no rows give none. The tables of sentences
    and rules are constants of the plan, and every step is one narrow projection.
    """
    def known(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(sentences):
            out = F.when(s.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    def ids(t: Column) -> Column:
        found = F.filter(F.split(F.regexp_replace(F.regexp_replace(t, "(?md)" + LEADER, ""), "(?md)" + ALONE, "\n\n$0\n\n"), BREAK), lambda s: s.rlike(HINT))
        return F.filter(F.transform(F.transform(found, _normal), known), lambda x: x.isNotNull())

    def apply(x: Column) -> Column:
        table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in rules])
        # double commas let neighbours match one after another
        start = F.struct(F.concat(F.lit(","), F.array_join(x, ","), F.lit(",")).alias("q"), F.array().cast("array<string>").alias("found"))
        step = lambda a, r: F.when(F.regexp_like(a["q"], r["p"]), F.struct(
            F.regexp_replace(a["q"], r["p"], F.lit(",")).alias("q"), F.concat(a["found"], F.array(r["n"])).alias("found"))).otherwise(a)
        return F.when(F.size(x) > 0, F.array_join(F.array_distinct(F.aggregate(table, start, step, lambda a: a["found"])), ",")).otherwise("")

    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    low = F.when(F.col("text").rlike("(?i)" + HINT), text).otherwise("")
    return pick(docs, "doc_id", "text").select("doc_id", let(low, lambda t: let(ids(t), lambda x: F.struct(
        F.size(x).cast("long").alias("n_sentences"), F.array_join(x, ",").alias("sentence_ids"), apply(x).alias("licenses")))).alias("s")).select("doc_id", "s.*")


def _sql() -> str:
    """The same for an engine whose patterns look neither ahead nor behind: breaks become a mark, one kind after another, with what follows put back."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    mark, keep = "chr(57344)", "chr(57345)"
    marked = f"regexp_replace(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), {q('(?m)' + LEADER)}, '', 'g'), {q('(?m)' + ALONE)}, chr(10) || chr(10) || '\\0' || chr(10) || chr(10), 'g')"
    for pattern, back in ((rf",?{_SPACE}+({LATER})", True), (rf"\n({STARTS})", True), (rf"\n[ \t\r]*\n{_SPACE}*", False), (rf"[.!?]{_SPACE}+", False)):
        marked = f"regexp_replace({marked}, {q(pattern)}, {mark}{back and " || '\\1'" or ''}, 'g')"
    plain = f"regexp_replace(replace(s, '(c)', {keep}), '[^a-z0-9.,/+ \\x{{E001}}-]+', ' ', 'g')"
    normal = f"regexp_replace(regexp_replace(replace({plain}, {keep}, '(c)'), ' +', ' ', 'g'), '^[ .,]+|[ .,]+$', '', 'g')"
    known = "CASE " + " ".join(f"WHEN regexp_matches(s, {q(p)}) THEN {q(n)}" for n, p in SENTENCES) + " END"
    steps, last = [], "r0"
    for k, (name, p) in enumerate(RULES):
        steps.append(f"r{k + 1} AS (SELECT r, CASE WHEN regexp_matches(q, {q(p)}) THEN list_append(found, {q(name)}) ELSE found END AS found, regexp_replace(q, {q(p)}, ',', 'g') AS q FROM {last})")
        last = f"r{k + 1}"
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS MATERIALIZED (SELECT r, string_split({marked}, {mark}) AS ss FROM t WHERE regexp_matches(text, {q('(?i)' + HINT)})),
s AS (SELECT r, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM m),
n AS (SELECT r, i, {normal} AS s FROM s WHERE regexp_matches(s, {q(HINT)})),
k AS MATERIALIZED (SELECT r, list(id ORDER BY i) AS ids FROM (SELECT r, i, {known} AS id FROM n) WHERE id IS NOT NULL GROUP BY r),
r0 AS (SELECT r, CAST([] AS VARCHAR[]) AS found, ',' || array_to_string(ids, ',') || ',' AS q FROM k),
{", ".join(steps)},
l AS (SELECT r, string_agg(x, ',' ORDER BY i) AS licenses FROM (SELECT r, x, min(i) AS i FROM (SELECT r, unnest(found) AS x, generate_subscripts(found, 1) AS i FROM {last}) GROUP BY r, x) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM t LEFT JOIN k USING (r) LEFT JOIN l USING (r)"""


SQL = _sql()
