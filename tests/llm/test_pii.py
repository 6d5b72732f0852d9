from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa

from gaugelab.llm import pii

SMALL_DIR = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(text: str) -> list[tuple[str, int, int]]:
    """The plain patterns, straight from their definition."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1])))


def test_plain_spans_on_random_text():
    draw = random.Random(3)
    for _ in range(30000):
        text = "".join(draw.choice(["a", "B", "9", "12", "4111 1111 1111 1111", "@", "@@", ".", "..", "-", "+", " ", "(", "255", "256", "1.2.3.4", "é", "a@b.c", "%"]) for _ in range(draw.randint(0, 14)))
        assert pii.listed(pii.detect(text)) == joined(brute(text)), repr(text)


def only(text: str) -> list[tuple[str, str]]:
    base, more = pii.find(text)
    return [(k, text[a:b]) for k in pii.KINDS for a, b in more[k]]


def test_disguises():
    assert only("write jane.doe [at] example [dot] com now") == [("email", "jane.doe [at] example [dot] com")]
    assert only("write jane(at)example.org now") == [("email", "jane(at)example.org")]
    assert only("mail bob at example dot com please") == [("email", "bob at example dot com")]
    assert only("mail jane dot doe at mail dot example dot org please") == [("email", "jane dot doe at mail dot example dot org")]
    assert only("mail jоhn@example.com x") == [("email", "jоhn@example.com")]
    assert only("mail ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ x") == [("email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ")]
    assert only("call plus four four two zero seven nine four six zero nine five eight ok") == [("phone", "plus four four two zero seven nine four six zero nine five eight")]
    card = "four one one one one one one one one one one one one one one one"
    assert only(f"pay {card} today") == [("card", card)]
    assert only("pay 4111 1111 llll 1111 now") == [("card", "4111 1111 llll 1111")]
    assert only("host one nine two dot one six eight dot zero dot one up") == [("ip", "one nine two dot one six eight dot zero dot one")]
    assert only("host 192 dot 168 dot 0 dot 1 up") == [("ip", "192 dot 168 dot 0 dot 1")]
    assert only("host １９２．１６８．０．１ up") == [("ip", "１９２．１６８．０．１")]
    assert only("call +1​ 415 555 0100 x") == [("phone", "+1​ 415 555 0100")]


def test_more_disguises():
    assert only("x john_at_example_dot_com y") == [("email", "john_at_example_dot_com")]
    assert only("x john-at-mail-dot-example-dot-org y") == [("email", "john-at-mail-dot-example-dot-org")]
    assert only("x john&#64;example&#46;com y") == [("email", "john&#64;example&#46;com")]
    assert only("x john @ example . com y") == [("email", "john @ example . com")]
    assert only("x JOHN AT EXAMPLE DOT COM y") == [("email", "JOHN AT EXAMPLE DOT COM")]
    assert only("x 192[.]168[.]1[.]20 y 10(dot)0(dot)0(dot)7 z") == [("ip", "192[.]168[.]1[.]20"), ("ip", "10(dot)0(dot)0(dot)7")]
    assert only("x + 4 4 two zero y") == []
    assert only("x @ home . De la y, a@b.co. De la") == []


def test_clean_text_is_left_alone():
    for text in ["We met at noon. The dot com years (at least) were one or two.", "one two three", "look at this dot", "Take one at a time; two, three.", "a (at) b", "", "1.2.3 and 12/12/2024"]:
        assert only(text) == [], text
        assert pii.covered(text, *pii.find(text)) == text


def test_no_span_without_hint():
    draw = random.Random(9)
    parts = ["jane", "doe", " at ", "(at)", " [AT] ", "@", " @ ", " dot ", ".", "example", "com", "org", " ", "four ", "FÜNF ", "zéro-", "nine ", "plus ", "4111", "1", "l", "O", " ", "192", "168", "о", "１", "+", "​", "-", "text ", "_at_", "_dot_", "&#64;", "&#46;", " . "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 16))) for _ in range(20000)]
    for text, (base, more) in zip(texts, pii.spans(pa.array(texts))):
        want_base, want_more = pii.find(text)
        assert (base, more) == (want_base, want_more), repr(text)


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL_DIR}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.report(docs).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == s[0] for s in want) for k in pii.KINDS)
        assert set(joined(want).split(",")) - {""} <= set(r.spans.split(","))


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "a@b.co", None), (2, "a@b.co", None), (3, "x@y.zz " * 20000, "z")], "doc_id long, text string, spans string")
    rows = pii.report(docs).collect()
    assert [r.n_email for r in rows] == [0, 0, 1, 1, 20000] and rows[2] == rows[3]
    back = pii.redact(docs)
    assert back.columns == docs.columns
    assert [r.text for r in back.collect()] == [None, "", "[EMAIL]", "[EMAIL]", "[EMAIL] " * 20000]
    assert pii.report(docs.limit(0)).count() == 0


def test_no_span_without_hint_between_groups_and_signs():
    lost = ["192.168.O.1", "4111-1111-llll-1111", "+41 44 OOO 12 34", "joe@mail . com", "joe at firma.ch", "joe @ firma . ch", "joe at a-b-c-d-e-f-g-h-i-j-k-l.com", "«joe at firma.com»", "x O.1.1.1"]
    for text, (_, more) in zip(lost, pii.spans(pa.array(lost))):
        assert any(more.values()) and more == pii.find(text)[1], text
    draw = random.Random(10)
    parts = ["O", "l", "I|", "o", "oO", "1", "12", "4111", "192", "168", "+41", "44", " ", " ", ".", "-", "f", "of", "a", " at ", "«", "»", "é", "joe", "firma", ".ch", " . ", "@", "one", "ı", " vier "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(40000)]
    for text, found in zip(texts, pii.spans(pa.array(texts))):
        assert found == pii.find(text), repr(text)


def test_endings_of_domains():
    assert only("x joe at firma.ch y") == [("email", "joe at firma.ch")]
    assert only("x JOE AT FIRMA.NL y") == [("email", "JOE AT FIRMA.NL")]
    assert only("x joe@mail . com y") == [("email", "joe@mail . com")]
    assert only("x joe @ firma . studio y") == [("email", "joe @ firma . studio")]
    for text in ["We met at noon.Then we left.", "look at index.html and at Node.js", "open at 10.am or at 5.pm", "we looked at noon.NATO came", "see at home. then go", "x @ home . Then we", "it is at 3.5 or at a.b", "a | 3963522770391943 | b"]:
        assert only(text) == [], text


def test_bare_at_needs_evidence():
    for text in ["we met at noon.then left", "arrived at london.we ate", "look at page.home today", "meet at st.james park", "WE MET AT NOON.THEN LEFT", "he sat at home.it rained", "5 at noon.then", "emails came; we sat for a very long time indeed at noon.then"]:
        assert only(text) == [], text
        assert pii.covered(text, *pii.find(text)) == text
    assert only("x jane.doe at firma.studio y") == [("email", "jane.doe at firma.studio")]
    assert only("x joe42 at firma.studio y") == [("email", "joe42 at firma.studio")]
    assert only("x joe at firma.pl y") == [("email", "joe at firma.pl")]
    assert only("please mail joe at firma.studio now") == [("email", "joe at firma.studio")]
    assert only("e-mail: joe at firma.studio") == [("email", "joe at firma.studio")]
    assert only("x joe [at] firma.studio y") == [("email", "joe [at] firma.studio")]
    assert only("x joe at firma dot studio y") == [("email", "joe at firma dot studio")]
