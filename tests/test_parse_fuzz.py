"""Arbitrary message text never fails the parse path and gives what a plain
Python reading of the format gives (SURVEY section 5, test 5)."""

import re
import struct

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from storepulse.operators.purchases import message_purchases
from storepulse.sources.logs import parse_messages

FIELD = st.text(alphabet=st.sampled_from(list("0123456789.-BUYEabxz")), max_size=10)
LINE = st.one_of(
    st.lists(FIELD, min_size=0, max_size=8).map(";".join),
    st.builds(lambda ts, p, price: f"{ts};s;User;u;CLICK;BUY-{p}-{price}.\n", FIELD, FIELD, FIELD),
)


def _f32(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def expected(line: str):
    """(product, price) for a purchase line, None otherwise."""
    fields = line.rstrip("\n").split(";")
    details = fields[5] if len(fields) > 5 else ""
    if line.endswith("\n") and len(fields) == 6:
        details = details + "\n"
    if not details.startswith("BUY"):
        return None
    parts = details.split("-")
    product = parts[1] if len(parts) > 1 and parts[1] != "" else (None if len(parts) <= 1 else "")
    raw = re.sub(r"[\s.]+$", "", parts[2]) if len(parts) > 2 else None
    try:
        price = _f32(float(raw)) if raw else None
    except ValueError:
        price = None
    return product, price


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINE, min_size=1, max_size=30))
def test_parse_matches_plain_reading(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, message string")
    got = {r.id: (r.product_id, r.price) for r in message_purchases(parse_messages(df)).collect()}
    want = {i: e for i, e in enumerate(map(expected, lines)) if e is not None}
    assert set(got) == set(want)
    for i, (product, price) in want.items():
        assert got[i][1] == price
        assert (got[i][0] or "") == (product or "")
