from __future__ import annotations

from sievecraft.llm import licences as li


def test_known_texts_in_many_guises(documents):
    mit = li.LICENCES["MIT"]
    docs = [
        (1, mit, "en", "s"),
        (2, mit.upper().replace("<YEAR> <COPYRIGHT HOLDERS>", "2019 Jane Doe"), "en", "s"),
        (3, mit.replace("Copyright (c) <year> <copyright holders>", "© 1999 A\n Copyright 2000-2004 B, all rights reserved\nAll rights reserved."), "en", "s"),
        (4, mit.replace('"', "“").replace("\n\n", "\n   ").replace("sublicense", "sublicence"), "en", "s"),
        (5, mit.partition("\n")[2], "en", "s"),
        (6, mit + " And one more duty.", "en", "s"),
        (7, "Some text\n" + mit, "en", "s"),
        (8, li.LICENCES["Zlib"].replace("acknowledgment", "acknowledgement"), "en", "s"),
        (9, "released under the MIT  licence", "en", "s"),
        (10, "Copyright 2020 nobody\n", "en", "s"),
    ]
    got = {r["doc_id"]: r for r in li.scan_licences(documents(docs)).collect()}
    assert {k: r["licence"] for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: "MIT", 6: None, 7: None, 8: "Zlib", 9: "MIT-notice", 10: None}
    assert got[10]["digest"] is None


def test_common_licences_are_known(documents):
    names = ["Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
    assert "3. Neither the name" in li.LICENCES["BSD-3-Clause"]
    got = {r["doc_id"]: r["licence"] for r in li.scan_licences(documents([(k, li.LICENCES[n], "en", "s") for k, n in enumerate(names)])).collect()}
    assert got == dict(enumerate(names))


def test_known_texts_wrapped_at_any_width(documents):
    import textwrap

    rows = []
    for name, text in li.LICENCES.items():
        for width in (*range(40, 121, 1 if len(text) < 3000 else 16),):
            lines = [textwrap.fill(x, width, break_long_words=False) if x.strip() else "" for x in text.split("\n")]
            rows.append((f"{name} at {width}", "\n".join(lines)))
    got = li.scan_licences(documents([(k, t, "en", "s") for k, (_, t) in enumerate(rows)])).collect()
    assert {rows[r["doc_id"]][0] for r in got if r["licence"] != rows[r["doc_id"]][0].split(" at ")[0]} == set()


def test_holder_with_and_without_a_gap(documents):
    grant = li.LICENCES["MIT"].split("\n\n", 2)[2]
    heads = ["MIT License\n\nCopyright (c) 2019 The Very Long Company Name and\nmany contributors\n\n", "Copyright 2001-2003, 2007 Jane\n", "Copyright © Jane\n\nCopyright: 2020 Joe\nAll rights reserved.\n\n", ""]
    got = li.scan_licences(documents([(k, h + grant, "en", "s") for k, h in enumerate(heads)])).collect()
    assert {r["doc_id"]: r["licence"] for r in got} == dict.fromkeys(range(len(heads)), "MIT")


def test_column_and_python_normalisation_agree(spark, documents):
    texts = [*li.LICENCES.values(), "Per cent of the licence; authorised WHILE © x\ncopyright line\n (C) me\nrest ", "", "ÄÖ 漢", "a_b-c"]
    table = documents([(k, t, "en", "s") for k, t in enumerate(texts)])
    got = {r["doc_id"]: r["n"] for r in table.select("doc_id", li.normalise(table.text).alias("n")).collect()}
    assert got == {k: li.normalise_text(t) for k, t in enumerate(texts)}


def test_known_digests_are_distinct():
    found = li.digests(li.LICENCES)
    assert set(found.values()) == set(li.LICENCES)


def test_odd_rows_and_empty_tables(odd, empty):
    out = li.scan_licences(odd).collect()
    assert len(out) == odd.count() and {r["licence"] for r in out} == {None}
    assert li.scan_licences(empty).count() == 0 and li.scan_licences(odd, {}).where("licence is not null").count() == 0
