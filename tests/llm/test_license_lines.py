"""Licence lines as they stand in documents, short forms included."""

from __future__ import annotations

from shelflink.llm.licenses import license_scan

LINES = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "licensed under CC BY 4.0": "cc-by",
    "Text is available under the Creative Commons Attribution-ShareAlike License": "cc-by-sa",
    "(CC BY-ND 3.0)": "cc-by-nd",
    "CC-BY-NC-SA-4.0": "cc-by-nc-sa",
    "// SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by-sa",
    "# SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "/* SPDX-License-Identifier: MIT */": "mit",
    "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0",
    "This file is released under CC0.": "cc0",
}
OTHERS = ["please cc by Monday", "cc by noon 5 people", "mit 2 0", "Apache 2.0 helicopters", "spdx license"]


def test_short_forms(docs_of):
    rows = [(i, f"Some words before.\n{line}\nand after") for i, line in enumerate(LINES)]
    rows += [(100 + i, text) for i, text in enumerate(OTHERS)]
    got = {r.doc_id: r for r in license_scan(docs_of(rows)).collect()}
    for i, (line, label) in enumerate(LINES.items()):
        assert (got[i].labels, got[i].score) == (label, 1.0), line
    assert all(got[100 + i].labels == "" and got[100 + i].score == 0.0 for i in range(len(OTHERS)))


def test_licence_lines_of_the_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"licensed under cc by-nc 4.0": "cc-by-nc", "licensed under the apache license, version 2.0": "apache-2.0"}
    texts = {r.doc_id: r.text.lower() for r in docs.where("text IS NOT NULL").collect()}
    got = {r.doc_id: r.labels.split(",") for r in license_scan(docs).collect()}
    for line, label in lines.items():
        held = [d for d, text in texts.items() if line in text]
        assert held and all(label in got[d] for d in held)
