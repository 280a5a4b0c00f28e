import duckdb

from lifelog.llm import licenses


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.licenses, r.extent) for r in sorted(licenses.license_scan(df).collect())]


def wrapped(name, width):
    import textwrap

    return "\n".join(textwrap.wrap(" ".join(licenses.SENTENCES[name][0].split()), width))


def test_query_against_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(db.execute(licenses.ORACLE["op3_licenses"]).fetchall())
    got = sorted(map(tuple, licenses.op3_licenses(spark, sf).collect()))
    assert got == want and any(r[3] for r in got)


def test_every_known_sentence_holds_a_trigger():
    assert all(any(t in s for t in licenses.TRIGGERS) for s in licenses.KNOWN)


def test_full_texts_and_notices(spark):
    mit = "MIT License\n\n" + "\n\n".join(wrapped(n, 72) for n in ("mit-grant", "mit-condition", "mit-warranty")).replace("FITNESS", "FITNESS") + "."
    mit = mit.replace("the\nSoftware\n\n", "the Software.\n\n").replace("portions of the\nSoftware", "portions of the\nSoftware.")
    bsd = "\n\n".join(wrapped(n, 60) + ("" if n == "bsd-grant" else ".") for n in ("bsd-grant", "bsd-source", "bsd-binary"))
    got = scan(spark, mit, bsd, bsd + "\n\n" + wrapped("bsd-endorse", 60) + ".", "Prose. Released under the MIT License.",
               "released UNDER the mit license", "a mit license thing", "The above copyright notice and this permission notice shall be "
               "included in all copies or substantial portions of the Software.", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", None, "")
    assert got == [("MIT", "text"), ("BSD-2-Clause", "text"), ("BSD-3-Clause", "text"), ("MIT", "notice"), ("MIT", "notice"), ("", "none"),
                   ("", "partial"), ("CC-BY-4.0,CC-BY-NC-4.0", "notice"), ("", "none"), ("", "none")]


def full(name, width=72):
    return wrapped(name, width) + ("" if licenses.SENTENCES[name][0].strip().endswith(":") else ".")


def test_both_readings_count(spark):
    mit = "\n\n".join(full(n) for n in ("mit-grant", "mit-condition", "mit-warranty"))
    notices = "SPDX-License-Identifier: CC0-1.0\nAll rights reserved\nLicensed under CC BY 4.0\nMIT License\nAll rights reserved\n"
    between = full("mit-grant") + "\n\nAll rights reserved.\n\n" + full("mit-condition") + "\n\n" + full("mit-warranty")
    assert scan(spark, mit, notices + "\n" + mit, between) == [
        ("MIT", "text"), ("MIT,CC-BY-4.0,CC0-1.0,Proprietary", "text"), ("MIT,Proprietary", "text")]


def test_every_licence_has_a_notice_and_its_text(spark):
    for name in ("ISC", "Unlicense", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "EPL-2.0", "MPL-2.0"):
        assert any(n == name and extent == "notice" for n, extent, _ in licenses.RULES)
    spdx = ["ISC", "Unlicense", "LGPL-2.1-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "EPL-2.0", "MPL-2.0"]
    got = scan(spark, *[f"SPDX-License-Identifier: {i}\ncode" for i in spdx])
    assert got == [(i.replace("-only", "").replace("-or-later", ""), "notice") for i in spdx]
    texts = {r[0]: r[2] for r in licenses.RULES if r[1] == "text"}
    got = scan(spark, *["\n\n".join(full(i, 50) for i in rule) for rule in texts.values()])
    assert [(n in g[0].split(","), g[1]) for n, g in zip(texts, got)] == [(True, "text")] * len(texts)


def test_order_counts(spark):
    grant, warranty, details = (" ".join(licenses.SENTENCES[n][0].split()) + "." for n in ("gpl3-grant", "gpl-warranty", "gpl-details"))
    assert scan(spark, f"{grant} {warranty} {details}", f"{details} {warranty} {grant}") == [("GPL-3.0", "text"), ("GPL-3.0", "notice")]


def test_odd_rows(spark, odd, empty):
    rows = licenses.license_scan(odd).collect()
    assert len(rows) == odd.count() and {r.extent for r in rows} == {"none"}
    assert licenses.license_scan(empty).count() == 0
