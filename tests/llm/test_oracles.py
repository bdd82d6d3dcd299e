import re

import pytest

from fieldglass.llm.encoding import UTF8_MISREAD_AS, repair_documents
from fieldglass.llm.queries import ORACLES, QUERIES
from fieldglass.sources.tables import table
from tests.compare import canonical, oracle

#: Queries that SQL cannot express, with the test that checks them.
PROPERTIES = {"p8_found": "test_restored_texts_are_what_plain_decoding_gives", "p8_mappings": "test_restored_texts_are_what_plain_decoding_gives"}


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_its_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert name in PROPERTIES and len(got)
        return
    want = oracle(sf, ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def plainly_decoded(text, encoding):
    """Every stretch outside ASCII that is UTF-8 when written back in the encoding, decoded, as often as that goes."""
    table = {bytes([b]).decode(encoding, "ignore") or chr(b): b for b in range(128, 256)}
    if encoding not in ("cp437", "mac_roman", "cp850", "cp852", "cp866", "koi8-r"):  # decoders differ in what they make of bytes 0x80 to 0x9f
        table = {chr(b): b for b in range(128, 160)} | table

    def read(m):
        try:
            return bytes(table[c] for c in m.group()).decode()
        except (KeyError, UnicodeDecodeError):
            return m.group()

    while True:
        new = re.sub("[^\x00-\x7f]+", read, text)
        if new == text:
            return text
        text = new


def test_restored_texts_are_what_plain_decoding_gives(spark):
    """Of texts damaged by one UTF-8 misreading; the queries count the same documents."""
    base = "/root/testdata/sf0.01"
    documents = table(spark, base, "documents")
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    repaired = repair_documents(documents).collect()
    checked = 0
    for r in repaired:
        assert r.mappings or "�" in texts[r.doc_id]
        assert r.restorable == ("�" not in r.restored_text)
        if len(r.mappings) == 1 and r.mappings[0].removeprefix("utf-8 read as ") in UTF8_MISREAD_AS:
            assert r.restored_text == plainly_decoded(texts[r.doc_id], r.mappings[0].removeprefix("utf-8 read as "))
            checked += 1
    assert checked > 30
    assert sorted(r.doc_id for r in QUERIES["p8_found"](spark, base).collect()) == sorted(r.doc_id for r in repaired)
    assert sum(r.n_documents for r in QUERIES["p8_mappings"](spark, base).collect()) == len(repaired)
