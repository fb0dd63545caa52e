"""Personal data: rules of each kind, overlaps, offsets, masking, the tagger."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.operators import pii
from chunkloom.operators.assets import run_tagger
from chunkloom.operators.chunking import fixed_size_chunks
from chunkloom.sources.chunk_table import ChunkTable

# text -> accepted (category, value)
CASES = [
    (None, []),
    ("", []),
    ("write to a.b+c@mail.example.com, or a..b@x.org; x@y", [("email", "a.b+c@mail.example.com"), ]),
    ("é@b.com ä.x@b.com", [("email", "x@b.com")]),
    ("card 4111 1111 1111 1111 and 4111-1111-1111-1112", [("card", "4111 1111 1111 1111")]),
    ("41111111111111111111111111", []),
    ("host 192.168.0.1, 256.1.1.1, 1.2.3.4.5 and 10.0.0.255.", [("ip", "192.168.0.1"), ("ip", "10.0.0.255")]),
    ("DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 or DE89370400440532013001", [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]),
    ("call +1 (743) 555-3824 or (030) 901 820 or 555-1234", [("phone", "+1 (743) 555-3824"), ("phone", "(030) 901 820")]),
    ("on 2024-01-05 or 05.01.2024 at 12 30", []),
    ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', [("secret", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff')]),
    ("password: onlylettersinthisone", []),
    ("token=4111111111111111a1", [("secret", "token=4111111111111111a1")]),
    ("\U0001F600\U0001F600 a@b.org \U0001F600 10.1.1.1", [("email", "a@b.org"), ("ip", "10.1.1.1")]),
    ("x" * 100000 + " a@b.org " + "1" * 50000 + " 10.1.1.1 " + "a." * 50000, [("email", "a@b.org"), ("ip", "10.1.1.1")]),
]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(2, CASES[2][0])]
    return spark.createDataFrame(rows, "id long, text string").withColumns({"start": F.lit(7), "s": F.lit("x"), "category": F.lit("y")})


@pytest.fixture(scope="module")
def found(frame):
    out = {}
    for r in pii.pii_spans(frame, "id").collect():
        out.setdefault(r.id, []).append(r)
    return out


@pytest.mark.parametrize("i", [i for i in range(len(CASES)) if i != 2])
def test_case(found, i):
    text, want = CASES[i]
    rows = sorted(found.get(i, []), key=lambda r: r.start)
    assert [(r.category, r.value) for r in rows] == want
    assert all(text[r.start : r.end] == r.value for r in rows)


def test_repeated_rows_count_each(found):
    assert [r.value for r in found[2]] == ["a.b+c@mail.example.com"] * 2


def test_masks_keep_offsets(frame):
    shown = frame.withColumn("spans", pii.spans(F.col("text"))).withColumn("masked", pii.masked(F.col("text"), F.col("spans"), "#"))
    for r in shown.collect():
        assert (r.masked is None) == (r.text is None)
        if r.text:
            inside = {p for s in r.spans for p in range(s.start, s.end)}
            assert r.masked == "".join("#" if p in inside else c for p, c in enumerate(r.text))
            # Nothing is found a second time.
            assert pii.find_spans(r.masked) == [] or r.id in (2,)


@given(st.text("ab1234567890.@-+() :=/'\"tokenDE8937", max_size=80))
def test_spans_are_apart_and_in_order(text):
    spans = pii.find_spans(text)
    assert all(a["end"] <= b["start"] for a, b in zip(spans, spans[1:]))
    assert all(pii.RULES[s["category"]](text[s["start"] : s["end"]]) for s in spans)


def test_check_numbers():
    assert pii.passes_luhn("79927398713") and not pii.passes_luhn("79927398710")
    assert pii.passes_mod97("GB82 WEST 1234 5698 7654 32") and not pii.passes_mod97("GB82 WEST 1234 5698 7654 33")


def test_tagger_writes_both_columns(spark, folder):
    table = ChunkTable(spark, folder, buckets=2)
    docs = spark.createDataFrame([(1, 1, "mail a@b.org or 10.0.0.1"), (2, 1, "nothing here")], "source_id long, source_collection_id long, text string")
    table.replace_rows(fixed_size_chunks(docs))
    run_tagger(table, "attr_pii")
    got = {r.source_id: (r.attr_pii_has_pii, r.attr_pii_categories) for r in table.read().collect()}
    assert got == {1: (True, ["email", "ip"]), 2: (False, [])}
    assert pii.tag_pii(table.read()).columns == ["chunk_id", "attr_pii_has_pii", "attr_pii_categories"]
