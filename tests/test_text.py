from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orderloom.functions import text as t

MONEY = {
    "$1,234.50": "1234.5", "1.234,50 €": "1234.5", "(12.00)": "-12", "10-20": "1020", "5 EA": "5", "2,000": "2000", "0,123": "123", "12,5": "12.5", "1.234.567": "1234567",
    "1.234": "1.234", "1'234.5": "1234.5", "1 234,5": "1234.5", "1 234": "1234", "-5": "-5", "7-": "-7", "+3": "3", "1e5": "15",
}


def test_parse_decimal_vectors(apply):
    found = apply(t.parse_decimal, list(MONEY))
    assert [x.normalize() for x in found] == [Decimal(v).normalize() for v in MONEY.values()]
    assert apply(t.parse_decimal, [None, "", "  ", "19%", "abc", "-", "1/2", "à 5"]) == [None] * 8


def test_parse_decimal_inverts_formatting(apply):
    @settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.lists(st.decimals(min_value=0, max_value=10**9, places=2), min_size=20, max_size=40))
    def check(numbers):
        us = [f"{n:,.2f}" for n in numbers]
        eu = [u.translate(str.maketrans(",.", ".,")) for u in us]
        swiss = [u.replace(",", "'") for u in us]
        assert apply(t.parse_decimal, us + eu + swiss) == numbers * 3

    check()


def test_whitespace(apply):
    assert apply(t.clean_text, ["a  b\r\n\n  c\t d \n", " \n", "", None, "x  y"]) == ["a b\nc d", None, None, None, "x y"]
    assert apply(t.clean_inline, [" a \n b ", " ", None]) == ["a b", None, None]


def test_emails(apply):
    assert apply(t.normalize_email, ["Call A.B@X.org or c@d.de", "none", None]) == ["a.b@x.org", None, None]
    assert apply(t.find_emails, ["b@x.de A@x.de B@X.de", None]) == [["b@x.de", "a@x.de"], []]


def test_small_parsers(apply):
    assert apply(t.parse_int, ["#7", " 12. ", "1234567", "x", None]) == [7, 12, None, None, None]
    assert apply(t.detect_currency, ["Total USD 5", "eur and usd", "in £", "$5", "¥ 9", None]) == ["USD", "EUR", "GBP", None, None, None]
    assert apply(t.norm_key, ["Müller & Co.", None]) == ["mllerco", ""]


def test_long_text_stays_whole(apply):
    long = "word " * 200_000
    assert apply(t.clean_inline, [long]) == [long.strip()]
