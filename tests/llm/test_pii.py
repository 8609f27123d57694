import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import pii

# The contract's patterns, applied as they stand.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    n = [int(c) for c in d[::-1]]
    return (sum(n[::2]) + sum(sum(divmod(2 * c, 10)) for c in n[1::2])) % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and plain_luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


pieces = st.lists(
    st.sampled_from(["a", "b.c", "@", "@x.y", "é", " ", "-", ".", "+", "1", "255", "256", "10.0.0.1", "4111 1111 1111 1111", "4111-1111", "(", ")", "+1 (555) 555-0199", "\n", "user@mail.example.com", "a@b", "..", "%", "007", "DE89370400440532013000", "078-05-1120", "ssn "]),
    max_size=14,
).map("".join)


@settings(max_examples=500, deadline=None)
@given(pieces)
def test_base_spans_equal_the_patterns(text):
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE] == plain(text)


def test_checksums_and_context():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("iban DE89 3704 0044 0532 0130 00 here") == ["iban"]
    assert "iban" not in kinds("iban DE88 3704 0044 0532 0130 00 here")
    assert "ssn" in kinds("my social security number is 078-05-1120") and "ssn" not in kinds("part 078-05-1120 of")
    assert "routing" in kinds("bank routing 021000021") and "routing" not in kinds("count 021000021") and "routing" not in kinds("bank routing 021000022")


def test_very_long_runs_are_quick():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" * 100_000, "@" * 100_000, "a@" * 100_000, "1 " * 100_000, "A1" * 100_000, "+1" + " " * 200_000):
        pii.find_spans(text)


def test_odd_rows(odd_docs, no_docs):
    rows = pii.digest(pii.detect(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.n_email == r.n_ip == r.n_card == r.n_phone == 0 and r.spans == "" for r in rows)
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.digest(pii.detect(no_docs)).collect() == []
    assert pii.redact(odd_docs).columns == odd_docs.columns and pii.redact(no_docs).collect() == []
    assert sorted(map(repr, pii.redact(odd_docs).collect())) == sorted(map(repr, odd_docs.collect()))


def test_digest_and_redaction(spark):
    text = "é mail bob@x.org, ip 10.0.0.1, card 4111 1111 1111 1111; iban DE89370400440532013000"
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    row = pii.digest(pii.detect(docs)).first()
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text))
    assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and row.spans.startswith(base) and "iban" in row.spans
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 0)
    clean = pii.redact(docs).first()
    assert clean.text == "é mail [EMAIL], ip [IP], card [CARD]; iban [IBAN]" and clean.n_chars == len(clean.text)


def test_overlapping_spans_become_one():
    assert [s[0] for s in pii.find_spans("call +3782 822463 10005 now")] == ["card", "phone"]
    assert pii.redacted("call +3782 822463 10005 now") == "call [PHONE] now"
