"""Secret scans with multipart credential linking.

Base kinds are found by pattern and always stay. Weak candidates (long mixed tokens, endpoints) are no finding by
themselves: spans are interval-joined within scopes, and a weak candidate is reported only where a complementary part
stands in the same scope. Null text is empty. Rows are independent: repeated rows give repeated results,
extra columns are left alone, an empty table gives an empty result. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm.tokens import text_chunks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WEAK = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
#: A host name is tried only from its run's start, so that long dotted or hyphened runs stay linear.
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|(?<![a-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:amazonaws|internal|cloud)\.?[a-z]*\b")
BREAK = re.compile(r"\n[\x20\t]*\n")
#: Kinds in the order in which equal starts are listed. The last two are only reported when linked.
KINDS = ("assign", "access", "hex", "secret_part", "endpoint")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Starts, ends and kinds of the base findings. A run of 24 hex digits or 20 key characters is the same whether its
    length is asked for in the pattern or after it; an assignment's value is measured after the match."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def weak_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates for a secret part (mixed case and a digit) or an endpoint."""
    out = []
    for m in WEAK.finditer(text):
        s = m.group()
        if any(c.isupper() for c in s) and any(c.islower() for c in s) and any(c.isdigit() for c in s):
            out.append((*m.span(), "secret_part"))
    return out + ([(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)] if "http" in text or "." in text else [])


def link(text: str, base: list, weak: list) -> list[tuple[int, int, str]]:
    """The weak spans that complement another part in the same scope (paragraph), however far apart.

    A secret part needs an access identifier, or an endpoint together with a base finding; an endpoint needs both an
    identifier (access or assign) and another span that is a secret (hex, assign or secret part). Parts that overlap the
    weak span do not count. Interval join by sorted starts and ends: the spans of a kind do not overlap one another, so
    those of a scope less those that overlap are counted by bisection.
    """
    if not base or not weak:
        return []
    cuts = [m.start() for m in BREAK.finditer(text)]
    starts: dict[str, list[int]] = {k: [] for k in KINDS}
    ends: dict[str, list[int]] = {k: [] for k in KINDS}
    for s, e, kind in sorted(base + weak):
        starts[kind].append(s)
        ends[kind].append(e)

    def apart(kind: str, s: int, e: int) -> int:
        scope = bisect_left(cuts, s)
        lo = bisect_right(starts[kind], cuts[scope - 1]) if scope else 0
        hi = bisect_right(starts[kind], cuts[scope]) if scope < len(cuts) else len(starts[kind])
        over, past = max(lo, bisect_right(ends[kind], s)), min(hi, bisect_left(starts[kind], e))
        return hi - lo - max(0, past - over)

    out = []
    for s, e, kind in weak:
        has = {k: apart(k, s, e) for k in KINDS}
        if kind == "secret_part" and (has["access"] or (has["endpoint"] and (has["assign"] or has["hex"]))):
            out.append((s, e, kind))
        elif kind == "endpoint":
            secret = has["hex"] or has["secret_part"]
            if (has["access"] and (secret or has["assign"])) or (has["assign"] and (secret or has["assign"] > 1)):
                out.append((s, e, kind))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as in KINDS, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, the SHA-256 of the listed base spans, and all spans listed."""
    text = text or ""
    base = base_spans(text)
    found = base + link(text, base, weak_spans(text)) if base else base
    n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
    return (*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs."""

    def run(batches):
        for batch in text_chunks(batches):
            rows = [scan_text(t) for t in batch.column("text").to_pylist()]
            cols = list(zip(*rows))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact_text(text: str | None) -> str | None:
    """The text with each reported span replaced by its kind; spans that overlap are replaced as one."""
    if not text:
        return text
    base = base_spans(text)
    if not base:
        return text
    out, at = [], 0
    merged: list[list] = []
    for s, e, kind in sorted(base + link(text, base, weak_spans(text)), key=lambda x: (x[0], KINDS.index(x[2]))):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, kind])
    for s, e, kind in merged:
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text replaced. All columns stay; n_chars, where there, follows the new text."""
    names = docs.columns

    def run(batches):
        for batch in text_chunks(batches):
            old = batch.column("text").to_pylist()
            new = [redact_text(t) for t in old]
            cols = {c: batch.column(c) for c in names} | {"text": pa.array(new, batch.schema.field("text").type)}
            if "n_chars" in names and any(a != b for a, b in zip(old, new)):
                n = batch.column("n_chars").to_pylist()
                cols["n_chars"] = pa.array([len(b) if a != b else k for a, b, k in zip(old, new, n)], batch.schema.field("n_chars").type)
            yield pa.record_batch([cols[c] for c in names], names)

    return docs.mapInArrow(run, docs.schema)
