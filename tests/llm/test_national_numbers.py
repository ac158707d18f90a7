"""National phone numbers whose digits look like a card's run."""

import pytest

from arborframe.llm import pii

NUMBERS = ["555-123-4567", "555 123 4567", "030 12345678", "(030) 1234567890", "020 7946 0958"]


@pytest.mark.parametrize("number", NUMBERS)
def test_national_numbers_are_found_and_masked(spark, number):
    text = f"please ring {number} today"
    df = spark.createDataFrame([(1, text), (2, f"ring {number} 2024-01-02 or so"), (3, f"both {number}, or {number}. Thanks")], "doc_id long, text string")
    at = lambda t: [(m, 3, m + len(number)) for m in range(len(t)) if t.startswith(number, m)]
    found = {r.doc_id: [(x.s, x.k, x.e) for x in r.spans] for r in pii.detect(df, pii.trained()).collect()}
    assert found[1] == at(text) and found[3] == at(f"both {number}, or {number}. Thanks")
    masked = {r.doc_id: r.text for r in pii.mask(df, pii.trained()).collect()}
    assert masked[1] == "please ring <phone> today" and masked[3] == "both <phone>, or <phone>. Thanks"
    if number == NUMBERS[0]:
        assert masked[2] == "ring <phone> 2024-01-02 or so"


def test_failed_cards_and_numbers_that_are_no_phones_stay():
    text = "card 4111-1111-1111-1112 and 4111 1111 1111 1112, on 2024-01-02, isbn 1-23-45678-901 x"
    base, tried = pii.patterns(text)
    assert not base and pii.added([text], [tried], pii.trained())[0] == []
