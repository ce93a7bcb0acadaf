import base64
import hashlib
import io
import random

import pytest

from quayside.llm import warc
from quayside.session import scratch


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            payload = (html or "").encode()
            first[payload] = min(first.get(payload, page_id), page_id)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        copy_of = first.get(payload)
        kind, to = ("response", None) if copy_of in (None, page_id) else ("revisit", copy_of)
        yield page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, to


def result(spark, rows, schema="page_id long, url string, html string"):
    found = warc.archived_pages(spark, spark.createDataFrame(rows, schema), scratch(spark, "warc"))
    return sorted((tuple(r)[:5] for r in found.collect()), key=str)


def test_round_trip_with_nulls_ties_and_long_texts(spark):
    rng = random.Random(1)
    rows = [
        (5, "http://a/ b\r\nX: y", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (2, "u", ""), (2, "u", ""),
        (None, "u", "<p>é</p>"), (None, "v", "alone"), (None, "w", "alone"), (7, "x", "\r\n\r\nWARC/1.1\r\n\r\n"),
        (8, "long", "".join(rng.choices("abc <>/\n", k=3_000_000))), (10, "zeros", "\0" * 2_000_000),
    ]
    assert result(spark, rows) == sorted(expected(rows), key=str)


def test_hot_payload(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 3 else f"other {i}") for i in range(600)]
    assert result(spark, rows) == sorted(expected(rows), key=str)


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, []) == []
    schema = "page_id long, url string, html string, digest string, first_id long, file string"
    assert result(spark, [(1, "u", "a", "d", 4, "f")], schema) == list(expected([(1, "u", "a")]))


def test_the_reader_finds_damage():
    good = warc.page_record(1, "u", b"payload" * 100, None) + warc.page_record(2, "u", b"x", 1)
    rows = list(warc.records(io.BytesIO(good), "f"))
    assert [r["verified"] for r in rows] == [True, True] and rows[0]["payload"] == b"payload" * 100
    assert rows[1]["offset"] == len(warc.page_record(1, "u", b"payload" * 100, None))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(good[:-9]), "f"))
    wrong = warc.record("response", "<urn:x-page:1>", b"HTTP/1.1 200 OK\r\n\r\nab", "application/http", WARC_Payload_Digest="sha1:AAAA")
    assert [r["verified"] for r in warc.records(io.BytesIO(wrong), "f")] == [False]


def test_small_payloads_can_be_left_as_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    firsts = {r.page_id: r.first_id for r in warc.with_first_copy(pages, revisit_from=3).collect()}
    assert firsts == {1: None, 2: None, 3: None, 4: 3}
