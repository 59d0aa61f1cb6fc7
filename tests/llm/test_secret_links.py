"""Links of weak spans to their complementary parts: past overlapping rows and across the whole paragraph."""

import random

from skyloom.llm import secrets

ACCESS = "AKIA" + "Q7" * 8
URL = "https://h/?token=aaaaaa&secret=bbbbbb"
PART = "aB3" + "x" * 37


def _kinds(text):
    return [s.split(":")[0] for s in secrets.scan_text(text)[4].split(",") if s]


def test_rows_within_an_endpoint_do_not_hide_the_next():
    assert "endpoint" in _kinds(f"{ACCESS} {URL} password=cccccc")
    assert "endpoint" not in _kinds(f"{ACCESS} {URL}")


def test_the_paragraph_is_the_only_bound():
    far = "word " * 200
    assert "secret_part" in _kinds(f"{ACCESS} {far}{PART}")
    assert "secret_part" not in _kinds(f"{ACCESS} {far}\n\n{PART}")


def test_links_equal_brute_force():
    rng = random.Random(2)
    pieces = [ACCESS, URL, PART, "https://x.org/a", "password=cccccc", "token=dddddd", "0123456789abcdef" * 2, "\n\n", "word"]
    for _ in range(400):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        base, weak = secrets.base_spans(text), secrets.weak_spans(text)
        cuts = [m.start() for m in secrets.BREAK.finditer(text)]
        scope = lambda s: sum(c < s for c in cuts)
        want = []
        for s, e, kind in weak:
            near = [k for a, b, k in base + weak if (b <= s or a >= e) and scope(a) == scope(s)]
            secret = [k for k in near if k in ("hex", "assign", "secret_part")]
            if kind == "secret_part":
                ok = "access" in near or ("endpoint" in near and ("assign" in near or "hex" in near))
            else:
                ok = ("access" in near and secret) or ("assign" in near and len(secret) > 1)
            if ok:
                want.append((s, e, kind))
        assert secrets.link(text, base, weak) == (want if base else [])
