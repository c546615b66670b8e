"""Secret scans: three plain patterns, plus spans whose structure is confirmed by decoding them.

Base kinds: ``assign`` (a keyword, a separator and a value of six or more characters),
``access`` (AKIA and 16 or more of A-Z0-9) and ``hex`` (24 or more hex digits). Structural
kinds: a base64 or hex candidate counts only when its decoded bytes parse, as

* ``jwt``: three dot-separated base64url parts whose first decodes to a JSON object with "alg";
* ``der``: a DER SEQUENCE whose nested lengths fill it exactly and which holds an INTEGER or OID;
* ``ssh``: an OpenSSH private key (its magic) or a public key blob whose length-prefixed fields fill it.

Hex is decoded in either case. Lines of PEM armour, and lines that wrap one base64 run (all but
the first and the last of one width), are joined before decoding. Scanning is on UTF-8 bytes;
offsets are reported in code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from candlespark.llm.common import map_arrow

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der", "ssh")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_BASE64 = 6, 20, 24, 40

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_STEMS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{%d,}" % MIN_HEX)
_ANY_HEX = re.compile(rb"[0-9A-Fa-f]{%d,}" % MIN_HEX)
#: A lookahead, as the part before a token may look like a header; {"alg":""} has 14 characters.
_JWT = re.compile(rb"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{14,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*))")
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]{3,40})-----([A-Za-z0-9+/=\s]{%d,}?)-----END \1-----" % MIN_BASE64)
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
#: The end of a line that may begin a wrapped key: a DER SEQUENCE, the magic of OpenSSH or a length begins with M, b or A.
_WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[MbA][A-Za-z0-9+/_-]{15,}(?=[ \t\r]*\n)")
_NEXT_LINE = re.compile(rb"[ \t\r]*\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
_SSH_MAGIC = b"openssh-key-v1\x00"


def _from_base64(run: bytes) -> bytes | None:
    run = run.translate(bytes.maketrans(b"-_", b"+/")).rstrip(b"=")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, its end) of the DER value at ``at``."""
    if at + 2 > len(data):
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= len(data) else None


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills ``data``, whose values fill it in turn, with an INTEGER or OID near its top."""
    top = _der_header(data, 0)
    if top is None or top[0] != 0x30 or top[2] != len(data) or len(data) < 24:
        return False
    seen, stack = set(), [(top[1], top[2], 0)]
    while stack:
        at, end, depth = stack.pop()
        while at < end:
            value = _der_header(data, at)
            if value is None or value[2] > end:
                return False
            tag, start, stop = value
            if tag & 0x1F == 0x1F or tag == 0:
                return False
            seen.add(tag)
            if tag & 0x20 and depth < 16:
                stack.append((start, stop, depth + 1))
            at = stop
    return bool(seen & {0x02, 0x06})


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or a public blob: length-prefixed fields that fill it, the first naming its algorithm."""
    if data.startswith(_SSH_MAGIC):
        return True
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if size > len(data) - at - 4:
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and re.fullmatch(rb"(?:sk-)?(?:ssh|ecdsa)-[a-z0-9@.-]+", fields[0]) is not None


def _is_signed_header(part: bytes) -> bool:
    raw = _from_base64(part)
    try:
        header = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _confirmed(data: bytes | None) -> str | None:
    if not data:
        return None
    return "ssh" if is_ssh_key(data) else "der" if is_der_key(data) else None


def _wrapped_spans(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """Keys in base64 that is wrapped over lines without armour."""
    done = 0
    for seed in _WRAPPED.finditer(raw):
        if seed.start() < done:
            continue
        runs, width = [seed.span()], None
        while m := _NEXT_LINE.match(raw, runs[-1][1]):
            size = m.end(1) - m.start(1)
            if len(runs) > 1 and size > width:
                break
            runs.append(m.span(1))
            if width is not None and size < width:
                break
            width = size
        # the last run, or the last two, may be words of the text that follows
        for n in range(len(runs), max(1, len(runs) - 3), -1):
            joined = b"".join(raw[s:e] for s, e in runs[:n])
            if len(joined) >= MIN_BASE64 and (kind := _confirmed(_from_base64(joined))):
                yield kind, runs[0][0], runs[n - 1][1]
                done = runs[n - 1][1]
                break
        else:
            if len(runs) > 2 and seed.end() - seed.start() == width:
                done = runs[-2][1]  # the inside of a block of another kind


def _covers(spans: list[tuple[int, int]]) -> Callable[[int], bool]:
    """Whether a place lies in one of the spans, by binary search."""
    spans = sorted(spans)
    starts, reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    return lambda at: bool(k := bisect_right(starts, at)) and at < reach[k - 1]


def byte_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of every base and structural secret of a UTF-8 text."""
    found: list[tuple[str, int, int]] = []
    folded = raw.lower()
    if any(s in folded for s in _STEMS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(raw) if len(m[1]) >= MIN_VALUE]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", *m.span()) for m in _HEX.finditer(raw)]
    for start, end in {m.span() for rx in (_HEX, _ANY_HEX) for m in rx.finditer(raw)}:
        if (end - start) % 2 == 0 and (kind := _confirmed(bytes.fromhex(raw[start:end].decode()))):
            found.append((kind, start, end))
    if b"." in raw:
        found += [("jwt", m.start(1), m.end(3)) for m in _JWT.finditer(raw) if _is_signed_header(m[1]) and _from_base64(m[2]) is not None]
    armoured = []
    if b"-----BEGIN " in raw:
        for m in _PEM.finditer(raw):
            if kind := _confirmed(_from_base64(re.sub(rb"\s+", b"", m[2]))):
                found.append((kind, *m.span()))
                armoured.append(m.span())
    within = _covers(armoured)
    wrapped = [x for x in _wrapped_spans(raw) if not within(x[1])]
    found += wrapped
    within = _covers(armoured + [x[1:] for x in wrapped])
    for m in _BASE64.finditer(raw):
        if not within(m.start()) and (kind := _confirmed(_from_base64(m[0]))):
            found.append((kind, *m.span()))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda x: (x[1], rank[x[0]], x[2]))


def spans(text: str | bytes | None) -> list[tuple[str, int, int]]:
    """As :func:`byte_spans`, in code points."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    found = byte_spans(raw)
    if not found or raw.isascii():
        return found
    point, at, out = {}, 0, 0
    for edge in sorted({e for _, s, t in found for e in (s, t)}):
        piece = raw[at:edge]
        out += len(piece.decode("utf-8", "replace"))
        at = edge
        point[edge] = out
    return [(k, point[s], point[e]) for k, s, e in found]


def scan_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: all) with n_assign, n_access, n_hex, base_sha256 and spans.

    A null text counts as empty: no spans, and the digest of nothing. Rows are independent, so
    ties and repeated rows each get their own answer; an empty table gives an empty table.
    Input columns with the names of output columns are replaced.
    """
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    source = docs.select(*dict.fromkeys([*keep, text]))
    schema = source.select(*keep).schema
    for name in names:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for value in batch.column(text).cast(pa.large_binary()):
                found = spans(value.as_py())
                base = [f"{k}:{s}:{e}" for k, s, e in found if k in BASE_KINDS]
                for k, kind in enumerate(BASE_KINDS):
                    out[k].append(sum(x[0] == kind for x in found))
                out[3].append(hashlib.sha256(",".join(base).encode()).hexdigest())
                out[4].append(",".join(f"{k}:{s}:{e}" for k, s, e in found))
            columns = [batch.column(c) for c in keep] + [pa.array(v, pa.int64() if n.startswith("n_") else pa.string()) for n, v in zip(names, out)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    return map_arrow(source, answer, schema)
