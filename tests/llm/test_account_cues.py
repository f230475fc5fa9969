"""Cue-based identifiers in texts whose lower case is longer, and IBANs with groups of letters."""

import pytest

from recallgrid.llm import pii


def accounts(text):
    return [text[a:b] for a, b, k in pii.find_spans(text) if k == "account"]


def test_cues_beside_a_dotted_capital_i():
    assert accounts("SSN: 123-45-6789 İstanbul PASSPORT no X1234567") == ["123-45-6789", "X1234567"]
    assert pii.masked("İİ Account: 12345678.") == "İİ Account: [ACCOUNT]."


@pytest.mark.parametrize("iban", [
    "GB29 NWBK 6016 1331 9268 19", "NL91 ABNA 0417 1643 00", "IE29 AIBK 9311 5212 3456 78", "MU17 BOMM 0101 1010 3030 0200 000M UR",
    "GB29 NWBK 6016 1331 9268 20", "DE89 3704 0044 0532 0130 00", "GB29-NWBK-6016-1331-9268-19", "DE89370400440532013000", "gb29 nwbk 6016 1331 9268 19"])
def test_printed_iban(iban):
    for after in ("", ".", " by Monday", " from me"):
        assert accounts(f"IBAN: {iban}{after}") == [iban]


def test_words_after_an_identifier_stay():
    assert accounts("account AB12 next year 2020 over") == []
    assert accounts("account 12345678 NEXT YEAR") == ["12345678"]
