import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from framesift.llm import licenses, queries

WRAPPED = {
    "MIT": 'MIT License\n\nCopyright (c) 2020 A Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.',
    "BSD-3-Clause": "Copyright (c) 2020, A Person\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions.\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products.",
    "ISC": "Copyright 2020 A Person\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrapped_texts(docs_of, name):
    rows = [(1, WRAPPED[name]), (2, WRAPPED[name].replace("\n", "\r\n")), (3, "\n".join(" * " + x for x in WRAPPED[name].split("\n")))]
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(docs_of(rows)).collect()} == {1: name, 2: name, 3: name}


def test_hints_are_no_filter(docs_of):
    rows = [(1, "All  rights\u00a0reserved"), (2, "Creative\u00a0Commons Attribution 4.0"), (3, "dedicated to the public\tdomain"), (4, "some words\nCopyright 2020 A\nmore words")]
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in licenses.scan(docs_of(rows)).collect()}
    assert got == {1: ("AllRights", "Proprietary"), 2: ("CCBy", "CC-BY"), 3: ("PublicDomain", "Public-domain"), 4: ("CopyrightLine", "")}


APACHE = """Copyright 2021 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
BSD2 = WRAPPED["BSD-3-Clause"].split("3. Neither")[0]


@pytest.mark.parametrize("name,text", [("Apache-2.0", APACHE), ("LGPL-2.1-or-later", LGPL), ("BSD-2-Clause", BSD2), ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy.")])
def test_more_wrapped_texts(docs_of, name, text):
    rows = [(1, text), (2, text.replace("\n", "\r\n")), (3, "\n".join("# " + x for x in text.split("\n"))), (4, "\n".join("// " + x for x in text.split("\n")))]
    got = {r["doc_id"]: set(r["licenses"].split(",")) for r in licenses.scan(docs_of(rows)).collect()}
    assert all(name in x for x in got.values()), got


def test_sql_on_wrapped_and_odd_texts(compare, odd, tmp_path):
    texts = [*WRAPPED.values(), APACHE, LGPL, BSD2]
    texts += [f(t) for t in texts for f in (lambda t: t.replace("\n", "\r\n"), lambda t: "\n".join(" * " + x for x in t.split("\n")), lambda t: t.replace(" ", "  "), lambda t: t.replace("\n", " "), str.upper)]
    texts += ["((c)) 2020 a (c) b(c))", "(c) 2020\u2028x\x0bAll rights reserved.\fnext", "one.\nor any later version, or\nany later version! MIT License", "a\n1. Redistributions of source code must retain x\n2) Redistributions in binary form must reproduce y"]
    rows = list(enumerate(texts + odd)) + [(None, APACHE), (3, "x"), (3, "x")]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), str(tmp_path / "documents.parquet"))
    compare(queries.QUERIES["op1_license_scan"], queries.ORACLES["op1_license_scan"], str(tmp_path))


def test_empty_table_repeated_rows_and_a_very_long_text(spark, docs_of):
    assert licenses.scan(docs_of([])).count() == 0
    long = "word " * 200_000 + "\n\n" + WRAPPED["MIT"] + "\n\n" + "word " * 200_000
    got = sorted((str(r["doc_id"]), r["licenses"]) for r in licenses.scan(docs_of([(1, long), (1, long), (None, WRAPPED["ISC"]), (2, None)])).collect())
    assert got == [("1", "MIT"), ("1", "MIT"), ("2", ""), ("None", "ISC")]
    clash = spark.createDataFrame([(1, WRAPPED["ISC"], "x", "y")], "doc_id long, text string, licenses string, s string")
    assert licenses.scan(clash).first()["licenses"] == "ISC"
