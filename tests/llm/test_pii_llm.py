"""Personal data: places, long texts without spaces, hand-labelled sentences that the field hasn't seen."""

from __future__ import annotations

import time

import pytest

from quarry.llm import pii

#: Not in the training table. {kind|text} marks an entity.
HELD_OUT = (
    "Mail {email|lucia.brandt(at)nordwind.se} with the dates.",
    "You can find him at {email|paul at greenfield dot com} most days.",
    "Ring {phone|(617) 555-0171} or {phone|617-555-0109} today.",
    "{phone|+33 1 70 18 99 00} is our number in Paris.",
    "Charged to {card|4012 8888 8888 1881} on Monday.",
    "Host {ip|172.16.254.1} and {ip|fe80:0:0:0:200:f8ff:fe21:67cf} are up.",
    "In 2003 2004 and 2005 we sold 12 000 000 units.",
    "Book at table dot net prices rose.",
    "The ratio 3.14159265 is well known.",
    "Invoice 20240131-0042 is due on 2024-02-28.",
    "At 10:15:30 the train left.",
    "Ticket 9876543210987654321098 was lost.",
    "Number 1111222233334445 fails its check.",
    "The address 300.1.2.3 is none.",
    "Try {email|info [at] seaside [dot] org}, please.",
    "Fax: {phone|+1 (303) 555-0199}.",
)


def test_hand_labelled_sentences():
    w, right, found, gold_count = pii.weights(), 0, 0, 0
    for text, tokens, gold in pii.labelled(HELD_OUT):
        got = set(pii.viterbi(text, tokens, w))
        right, found, gold_count = right + len(got & gold), found + len(got), gold_count + len(gold)
    assert right / found >= 0.9 and right / gold_count >= 0.9


def test_written_out_addresses_in_any_case():
    w = pii.weights()
    for a in ("at", "(at)", "[at]", "AT", "(AT)"):
        for b in ("dot", "(dot)", "[dot]", "DOT"):
            got = pii.field_spans(f"write to john.doe {a} mail {b} com today", w)
            assert got and got[0][0] == "email", (a, b)


LONG = {
    "letters": "12 " + "n" * 1_000_000,
    "ideographs": "\u4e2d" * 1_000_000 + " a@b.cn",
    "dots": "a." * 500_000,
    "digits": "1" * 1_000_000,
    "ats": "a@" * 500_000,
    "glued": "(at)" * 250_000,
    "dotdot": "x at " + "dot" * 300_000 + "~",
    "hex": "ab:" * 300_000,
    "mails": "x@y.zz " * 20_000,
}


@pytest.mark.parametrize("name", list(LONG))
def test_long_texts_take_linear_time(name):
    w, text = pii.weights(), LONG[name]
    begin = time.perf_counter()
    spans = pii.all_spans(text, pii.base_spans(text), w)
    assert time.perf_counter() - begin < 4
    assert len(spans) == {"ideographs": 1, "mails": 20_000}.get(name, 0)


def test_field_spans_beside_base_spans():
    text = "a@b.cc 10.0.0.1 call 415-555-0132 or x(at)y.org"
    base = pii.base_spans(text)
    spans = pii.all_spans(text, base, pii.weights())
    assert set(base) <= set(spans) and {("phone", 21, 33), ("email", 37, 47)} <= set(spans)
    assert all(s in base or not any(s[1] < b[2] and b[1] < s[2] for b in base) for s in spans)


def test_spans_are_counted(spark):
    docs = spark.createDataFrame([(1, "a@b.cc or x(at)y.org"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_email, r.n_spans, r.spans) for r in pii.find(docs).collect()}
    assert got == {1: (1, 2, "email:0:6,email:10:20"), 2: (0, 0, ""), 3: (0, 0, "")}
