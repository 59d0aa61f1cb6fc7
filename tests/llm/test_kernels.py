"""Kernels against brute force."""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skyloom.llm import audio, eliasfano, language, packing, secrets, simhash, tokens, toxicity, warc
from skyloom.llm.queries import word_tokenizer
from skyloom.llm.wordpieces import encoder

ODD = ["", None, "a", "A b  c\n\td", "É é <|endoftext|> don't WE'LL ''s 's 12²", "日本 語", "x\x1cy", "the quick brown fox " * 50]


def test_word_hashes_agree_with_words():
    h, first = tokens.word_hashes(pa.array(ODD))
    seen = {}
    for i, t in enumerate(ODD):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        own = h[first[i] : first[i + 1]].tolist()
        assert len(own) == len(words)
        for w, x in zip(words, own):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_chunks_keep_all_rows():
    batch = pa.record_batch([pa.array(ODD), pa.array(range(len(ODD)))], ["text", "n"])
    got = [r for b in tokens.text_chunks([batch, batch.slice(3)], limit=10) for r in b.column("n").to_pylist()]
    assert got == [*range(len(ODD)), *range(3, len(ODD))]


def test_token_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(word_tokenizer())
    rng = np.random.default_rng(5)
    signs = [*map(chr, range(0, 256)), *"'sdmtrevl ÀÉéß" * 9]
    texts = ODD + ["".join(rng.choice(signs, rng.integers(0, 50))) for _ in range(3000)]
    flat, cut = encoder(word_tokenizer()).encode(pa.array(texts))
    want = plain.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [flat[a:b].tolist() for a, b in zip(cut, cut[1:])] == [e.ids for e in want]


def test_hilbert_neighbours_touch():
    grid = np.array(list(itertools.product(range(4), repeat=3)))
    walk = grid[np.argsort(packing.hilbert_key(grid, 2))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_thresholds_are_complete_and_least():
    rng = np.random.default_rng(6)
    costs = np.cumsum(rng.random((40, 4, 5)), axis=2)
    costs[:, :, 0] = 0
    got = simhash.allocate(costs, 0)
    assert (got.sum(1) == 0).all() and got.min() >= -1
    every = [t for t in itertools.product(range(-1, 4), repeat=4) if sum(t) == 0]
    for row, t in zip(costs, got):
        total = lambda t, row=row: sum(row[g, x + 1] for g, x in enumerate(t))
        assert abs(total(t) - min(map(total, every))) < 1e-9


def test_maximal_segments_equal_brute_force():
    rng = np.random.default_rng(7)

    def brute(s, at):
        """The best-scoring run, shortest first among equals, then both sides of it."""
        best = max(((s[i:j].sum(), -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        i, j = best[3:]
        return [*brute(s[:i], at), (at + i, at + j), *brute(s[j:], at + j)]

    for _ in range(200):
        s = rng.normal(-0.2, 1, rng.integers(0, 14))
        assert [(a, b) for _, a, b in toxicity.maximal_segments(s)] == brute(s, 0)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(8)
    first = np.array([0, 3, 3, 8])
    score = rng.normal(size=(8, 3))
    got = language.viterbi(score, first, 0.7)
    for a, b in ((0, 3), (3, 8)):
        value = lambda p, a=a: sum(score[a + i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:]))
        assert abs(value(got[a:b].tolist()) - max(map(value, itertools.product(range(3), repeat=b - a)))) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 5000])
def test_elias_fano(n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate((rng.integers(0, 10**12, n), rng.integers(10**6, 10**6 + n, n // 2))))[:n]
    byte = rng.integers(0, 256, len(keys)).astype(np.uint8)
    cut = len(keys) // 2
    parts = [(int(k[0]), len(k), np.frombuffer(eliasfano.encode(k, b), np.uint8)) for k, b in ((keys[:cut], byte[:cut]), (keys[cut:], byte[cut:])) if len(k)]
    level = eliasfano.Level(parts)
    ask = np.unique(np.concatenate((keys, keys + 1, [0, 10**13])))
    at, found = level.successor(ask)
    assert (at == np.searchsorted(keys, ask)).all() and (found == np.isin(ask, keys)).all()
    assert (level.payload(0, np.arange(len(keys))) == byte).all()
    assert (np.concatenate([p.access(np.arange(p.n)) for p in level.parts]) == keys).all()


def test_secret_base_spans():
    text = 'x password="abc" secret=token:abcdefgh Token = Zz09+/_.=- api_key:123456 AKIA' + "A1" * 8 + " " + "0f" * 12 + " ſecret=abcdefg"
    got = secrets.base_spans(text)
    want = [(m.start(), m.end(), "assign") for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    want += [(m.start(), m.end(), k) for k, p, n in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)) for m in re.finditer(p, text) if len(m.group()) >= n]
    assert sorted(got) == sorted(want) and len(got) == 4
    assert secrets.scan_text(None) == secrets.scan_text("") and secrets.redact_text(None) is None


def test_weak_parts_need_their_complement():
    part = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dF3hJ5kL7n"
    key = "AKIA" + "ABCD" * 4
    assert "secret_part" not in secrets.scan_text(f"alone {part} here")[4]
    assert "secret_part" in secrets.scan_text(f"id {key} and {part} here")[4]
    assert "secret_part" not in secrets.scan_text(f"id {key}\n\nfar scope {part} here")[4]
    assert secrets.redact_text(f"id {key} and {part}.") == "id [access] and [secret_part]."


def test_warc_record_round_trip():
    raw = warc.record(7, "http://www.Ex.com:80/a b?q", "é\r\n\r\nx".encode(), None)
    got = warc.parse(raw)
    assert got["payload_bytes"] == 7 and got["record_type"] == "response" and got["refers_to"] is None
    again = warc.parse(warc.record(5, None, b"abc", 7))
    assert again == {"page_id": 5, "payload_bytes": 3, "payload_digest": warc.digest(b"abc"), "record_type": "revisit", "refers_to": 7}
    assert warc.surt("http://www.Ex.com:80/a b?q") == "com,ex:80)/a%20b?q" and warc.surt(None) == ""


def test_recordings():
    rng = np.random.default_rng(9)
    v = rng.normal(0, 0.12, 64)
    a = audio.fingerprint(audio.melody(v))
    assert len(a) > 30 and (audio.fingerprint(audio.melody(v)) == a).all()
    b = audio.fingerprint(audio.melody(rng.normal(0, 0.12, 64)))
    assert np.bitwise_count(a ^ b).mean() / 32 > 0.2
    assert len(audio.fingerprint(None)) == len(audio.fingerprint(b"RIFFx")) == 0


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
