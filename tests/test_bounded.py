import pytest

from heddle.sources.bounded import refusal


@pytest.mark.parametrize(
    "text,want",
    [('{"a":[1,"x"]}', None), ('{"a":1,"a":2}', "DUPLICATE_KEY"), ("[NaN]", "NOT_A_NUMBER"), ("[" * 65 + "]" * 65, "TOO_DEEP"), ('["' + "[" * 70 + '"]', None), ("﻿{}", "BYTE_ORDER_MARK"), ("{", "MALFORMED"), (None, "MISSING"), ('["\\"["]', None), ('["' + "x" * (1 << 20) + 'y"]', "TOO_LONG")],
)
def test_refusal(text, want):
    assert refusal(text) == want
