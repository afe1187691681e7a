import re

from sparkrisk.llm import licenses as L
from sparkrisk.llm.queries import QUERIES

SCAN = L.Scanner()
TEXT = {name: ".\n".join(L.SENTENCES[s] for s in ids) + "." for name, _, ids in L.RULES}


def rules(text):
    return [m[1] for m in SCAN.matches(text)]


def test_every_rule_is_found_in_its_text():
    for name, text in TEXT.items():
        assert rules(text) == [name]
        assert rules("Some prose before it.\n" + text + "\nAnd after it.") == [name]
        assert rules(text.upper()) == [name]


def test_wrapped_lines_and_numbering():
    wrapped = re.sub(r" (\w+) (\w+) ", r" \1\n\2 ", TEXT["mit-text"])
    assert rules(wrapped) == ["mit-text"]
    numbered = "\n".join(f"{i}. {L.SENTENCES[s]}." for i, s in enumerate(("bsd-use", "bsd-source", "bsd-binary", "bsd-names")))
    assert rules(numbered) == ["bsd-3-clause-text"]


def test_order_and_gaps_matter():
    grant, keep, warranty = (L.SENTENCES[s] for s in ("mit-grant", "mit-keep", "mit-warranty"))
    assert rules(f"{keep}.\n{grant}.\n{warranty}.") == []
    assert rules(f"{grant}.\n" + "Other.\n" * (L.GAP + 1) + f"{keep}.\n{warranty}.") == []
    assert rules(f"{grant}.\n" + "Other.\n" * L.GAP + f"{keep}.\n{warranty}.") == ["mit-text"]


def test_only_whole_sentences_count():
    assert rules("Not released under the MIT License today.") == []
    assert rules("x released under the MIT License.") == []
    assert rules("Released under the MIT License 2.") == []
    assert rules("Released under the MIT License!") == ["mit-notice"]


def test_several_in_a_text():
    text = "\n".join([TEXT["mit-notice"], "words", TEXT["gpl-3.0-notice"], TEXT["mit-notice"]])
    assert rules(text) == ["mit-notice", "gpl-3.0-notice", "mit-notice"]


def test_odd_rows(spark, odd_docs, no_docs):
    assert L.found_licenses(odd_docs).count() == 0 == L.found_licenses(no_docs).count()
    rows = [(1, TEXT["mit-notice"], "x", 1), (1, TEXT["mit-notice"], "x", 1), (None, "z\n" * 30_000 + TEXT["cc-by-4.0-notice"], None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, license string, rule int")
    out = sorted((str(r.doc_id), r.license, r.first_unit) for r in L.found_licenses(df).collect())
    assert out == [("1", "MIT", 0), ("1", "MIT", 0), ("None", "CC-BY-4.0", 30_000)]


def test_query_equals_line_search(spark):
    """The table's notices are single lines or sentences, so a plain search for whole ones finds the same."""
    sf = "/root/testdata/sf0.01"
    single = {" ".join(L.normal_words(L.SENTENCES[ids[0]])): name for name, _, ids in L.RULES if len(ids) == 1}
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for unit in re.split(r"\n|(?<=[.!?;:])\s+", r.text or ""):
            name = single.get(" ".join(L.normal_words(unit)))
            if name:
                want.append((r.doc_id, name))
    got = [(r.doc_id, r.rule) for r in QUERIES["op6_license_scan"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
