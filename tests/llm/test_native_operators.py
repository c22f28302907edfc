"""Sharding, quality rules, line deduplication and licence scans: against SQL, and their edges."""

from __future__ import annotations

import re
import zlib

import duckdb
import pytest

from jobloom.llm import quality_rules
from jobloom.llm.licences import ALONE, ANCHOR, KNOWN, LICENCES, NAMES, RULES
from jobloom.llm.license_scan import scan_licenses
from jobloom.llm.line_dedup import dedup_lines
from jobloom.llm.queries import ORACLES, QUERIES
from jobloom.llm.quality_rules import ablations, apply_policies, keep_good, rule_ledger
from jobloom.llm.sharding import assign_shards


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for name_ in ("documents", "benchmark", "embeddings"):
        db.sql(f"CREATE VIEW {name_} AS SELECT * FROM '{sf_dir}/{name_}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(x[i] for i in at) for x in rel.fetchall()), key=repr)


ROWS = [(1, None, 5), (2, "", 5), (3, "a " * 30_000, 5), (3, "a " * 30_000, 5), (None, "x\ny\nz", 5), (4, "x\ny\nz\nw", 5), (5, "é!", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, fail_bits int")


@pytest.mark.parametrize("group", [1, 3, 65_536])
def test_shards(docs, group):
    rows = assign_shards(docs, slot_group=group).collect()
    assert len(rows) == len(ROWS)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert {(r.size, r.text_crc32) for r in rows} == {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in ROWS}
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert assign_shards(docs.limit(0)).count() == 0


def test_equal_rows_are_split(spark):
    """Thousands of rows of one key and text get slots of their own, in groups of at most slot_group."""
    docs = spark.createDataFrame([(7, "same")] * 1000 + [(None, None)] * 300 + [(i, "x") for i in range(10, 110)], "doc_id long, text string")
    rows = assign_shards(docs, slot_group=64).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 1400 and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sum(r.doc_id == 7 for r in rows) == 1000 and sum(r.doc_id is None for r in rows) == 300


def test_weights(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    counts = {r["shard"]: r["count"] for r in assign_shards(docs, weights=(1.0, 3.0)).groupBy("shard").count().collect()}
    assert 2.6 < counts[1] / counts[0] < 3.4
    before = {r.doc_id: r.shard for r in assign_shards(docs, weights=(1.0, 1.0, 1.0)).collect()}
    after = {r.doc_id: r.shard for r in assign_shards(docs, weights=(1.0, 1.0, 1.0, 1.0)).collect()}
    moved = [d for d in before if before[d] != after[d]]
    assert all(after[d] == 3 for d in moved) and 800 < len(moved) < 1200
    with pytest.raises(ValueError):
        assign_shards(docs, weights=(1.0, 0.0))


def test_ledger(docs):
    ledger = rule_ledger(docs)
    rows = ledger.collect()
    assert len(rows) == len(ROWS) and all(r.fail_bits & 1 for r in rows if r.n_words < 50)
    assert {r.n_repeat_words for r in rows if r.doc_id == 3} == {30_000}
    assert set(apply_policies(ledger, {"base": "base-1", "none": []}).columns) >= {"base", "none"}
    found = {r.rule: (r.n_fail, r.n_only, r.n_kept_without) for r in ablations(ledger, "base-1").collect()}
    assert found == {"few_words": (5, 5, 5), "repeated_windows": (2, 2, 2)}
    kept = keep_good(docs, ["repeated_windows"])
    assert kept.columns == docs.columns and kept.count() == 5
    assert rule_ledger(docs.limit(0)).count() == 0 and keep_good(docs.limit(0)).count() == 0
    assert quality_rules.mask_of(ledger, "base-1") == 3
    assert [tuple(r) for r in ablations(ledger.limit(0), "base-1").orderBy("rule").collect()] == [("few_words", 0, 0, 0), ("repeated_windows", 0, 0, 0)]


def test_ledger_of_other_rules(docs, tmp_path):
    """Bits mean what the ledger says, whatever other rules there are, also after it was stored."""
    rules = [quality_rules.Rule("any_word", "n_words > 0"), quality_rules.RULES[0]]
    ledger = quality_rules.store_ledger(rule_ledger(docs, rules=rules), str(tmp_path / "ledger"))
    again = quality_rules.read_ledger(ledger.sparkSession, str(tmp_path / "ledger"))
    assert quality_rules.rule_names(again) == ["any_word", "few_words"] and quality_rules.mask_of(again, ["few_words"]) == 2
    got = sorted((r.n_words > 0, r.n_words < 50, r.a, r.b) for r in apply_policies(again, {"a": ["any_word"], "b": ["few_words"]}).collect())
    assert len(got) == len(ROWS) and all(a == (not some) and b == (not few) for some, few, a, b in got)
    with pytest.raises(ValueError):
        quality_rules.passes(again, "base-1")
    with pytest.raises(ValueError):
        rule_ledger(docs, rules=[rules[0], rules[0]])


def test_line_windows(spark):
    rows = [(2, "h\na\nb\nc\nd\nz", 1), (1, "a\n b\n\nc\nd", 1), (3, None, 1), (4, "", 1), (None, "a\nb\nc", 1), (5, "q\nq\nq\nq", 1), (1, "a\n b\n\nc\nd", 1)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_units_removed int"))
    assert out.columns == ["doc_id", "text", "n_units_removed", "_n_units_removed"]
    got = sorted((repr(r.doc_id), r.text, r[3]) for r in out.collect() if r.text is not None)
    assert got == sorted([("2", "h\nz", 4), ("1", "a\n b\n\nc\nd", 0), ("1", "a\n b\n\nc\nd", 0), ("4", "", 0), ("None", "a\nb\nc", 0), ("5", "q", 3)])
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_long_lines(spark):
    """A paragraph of over 50 words that repeats goes, as a line of its own or inside one, with or without sentences."""
    flat = " ".join(f"w{i}" for i in range(60))
    told = "It begins here, as it must. " + " ".join(f"v{i}" for i in range(40)) + ". It goes on! And then, after that, it ends?"
    rows = [(1, flat), (2, told), (3, f"Own words.\n{flat}\nMore."), (4, flat), (5, f"{told} A tail of its own. {told}"), (6, "short\nlines"), (7, "short\nlines"), (8, " ".join(f"x{i}" for i in range(70)))]
    out = {r.doc_id: (r.text, r.n_units_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == (flat, 0) and out[2] == (told, 0) and out[8] == (rows[7][1], 0)
    assert out[3] == ("Own words.\nMore.", 4) and out[4] == ("", 4)
    assert out[5][0].strip() == "A tail of its own."
    assert out[6] == out[7] == ("short\nlines", 0)


def test_rows_that_share_an_id(spark):
    rows = [(1, f"a\nb\nc\n{x}") for x in "pqrs"] + [(0, "z\na\nb\nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in dedup_lines(docs).collect())
    assert got == [(0, "z\na\nb\nc", 0), *((1, x, 3) for x in "pqrs")]
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    same = db.sql(ORACLES["op9_window_line_dedup"].replace("md5(coalesce(text, ''))", "text")).fetchall()
    assert sorted((d, t, n) for d, n, t in same) == got


def test_licences(spark):
    text = "Prose.\nLicensed under the MIT License. More prose.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    rows = [(1, text, 0), (2, None, 0), (3, "", 0), (4, "license " * 20_000, 0), (1, text, 0)]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, licenses int"))
    assert out.columns == ["doc_id", "text", "licenses", "license_sentence_ids", "_licenses"]
    got = {r.doc_id: (r.license_sentence_ids, r._licenses) for r in out.collect()}
    assert got == {1: ([2, 16], ["MIT"]), 2: ([], []), 3: ([], []), 4: ([], [])} and out.count() == 5


BSD = """Copyright (c) 2020, A. Author

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful.

You should have received a copy of the GNU
General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
WIDE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not
use this file except in compliance with the License. You may obtain a copy of
the License at
http://www.apache.org/licenses/LICENSE-2.0"""
LAYOUTS = {
    "plain": lambda t: t,
    "indented": lambda t: "\n".join("    " + x for x in t.split("\n")),
    "starred": lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */\nint main",
    "hashed": lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")) + "\nimport os",
    "slashed": lambda t: "\n".join(f"// {x}" for x in t.split("\n")),
    "semicolons": lambda t: "\n".join(f"; {x}" for x in t.split("\n")),
    "framed": lambda t: "\n".join(f" * {x:<90} *" for x in t.split("\n")),
    "windows": lambda t: t.replace("\n", "\r\n"),
}


def test_published_licences_in_every_layout(spark):
    expected = {
        "BSD": (BSD, [16, 17, 18, 19], ["BSD-3-Clause"]),
        "BSD2": (BSD[: BSD.index("3. ")], [16, 17, 18], ["BSD-2-Clause"]),
        "GPL": (GPL, [10, 11], ["GPL-3.0-or-later"]),
        "MIT": (MIT, [3, 4], ["MIT"]),
        "APACHE": (APACHE, [6, 7, 8], ["Apache-2.0"]),
        "WIDE": (WIDE, [6, 7, 8], ["Apache-2.0"]),
        "APACHE and GPL": (APACHE + "\n\n" + GPL, [6, 7, 8, 10, 11], ["Apache-2.0", "GPL-3.0-or-later"]),
    }
    rows = [(f"{name} {how}", lay(text)) for name, (text, _, _) in expected.items() for how, lay in LAYOUTS.items()]
    rows += [("none", "Licensed under. The MIT License."), ("blank", "Licensed under the\n\nMIT License."), ("inside", "It is not released under the MIT License today."), ("long", "; " * 50_000 + "\n" * 50_000 + "*" * 50_000 + " license")]
    got = {r.name: (r.license_sentence_ids, r.licenses) for r in scan_licenses(spark.createDataFrame(rows, "name string, text string")).collect()}
    for name, (_, ids, licenses) in expected.items():
        for how in LAYOUTS:
            assert got[f"{name} {how}"] == (ids, licenses), (name, how)
    assert all(got[x] == ([], []) for x in ("none", "blank", "inside", "long"))


NOTICES = {
    "// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;": ["Apache-2.0", "MIT"],
    "/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */": ["GPL-2.0-or-later"],
    "Copyright 2020, A. Author. All rights reserved.": [ALONE],
    "All rights reserved.\n\nLicense: BSD-3-Clause": ["BSD-3-Clause"],
    "Released under the MIT License.\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": ["ISC", "MIT"],
    "This project is licensed under the terms of the GNU Lesser General Public License v3.0 or later.": ["LGPL-3.0-or-later"],
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.": ["GPL-2.0-or-later"],
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1 of the License.": ["LGPL-2.1-only"],
    "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
    "This work is available under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": ["CC-BY-SA-3.0"],
    "This is free and unencumbered software released into the public domain.": ["Unlicense"],
    "Licensed under CC0 1.0 Universal.": ["CC0-1.0"],
    "He is licensed under the influence of MIT License holders.": [],
}


def test_notices_and_tags(spark):
    assert len(LICENCES) >= 100 and all(any(re.search(ANCHOR, t) for t, i in KNOWN.items() if i in seq) for _, seq in RULES)
    rows = [*NOTICES, *(f"Licensed under the {name}." for name in NAMES), *(f"SPDX-License-Identifier: {x}" for x in LICENCES)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(NOTICES))] == list(NOTICES.values())
    assert [got[len(NOTICES) + i] for i in range(len(NAMES))] == [[LICENCES[i - 1000]] for i in NAMES.values()]
    assert [got[len(NOTICES) + len(NAMES) + i] for i in range(len(LICENCES))] == [[x] for x in LICENCES]


def test_licences_like_sql_in_every_layout(spark):
    texts = [lay(x) for x in (BSD, GPL, MIT, APACHE, WIDE, APACHE + "\n\n" + GPL, *NOTICES) for lay in LAYOUTS.values()]
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (-1, "")], "doc_id long, text string")
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    want = sorted(((None if d is None or d != d else int(d), n, ids, names) for d, n, ids, names in db.sql(ORACLES["op10_license_rules"]).fetchall()), key=repr)
    got = sorted(((r.doc_id, len(r.license_sentence_ids), ",".join(map(str, r.license_sentence_ids)), ",".join(r.licenses)) for r in scan_licenses(docs).collect()), key=repr)
    assert got == want
