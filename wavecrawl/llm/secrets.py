"""Secret scans: pattern candidates, and spans confirmed by decoding them.

Three plain patterns (``assign``, ``access``, ``hex``) give the base spans. On top of
them, candidates in base64, base64url or hex are decoded and reported only when the
decoded bytes have the structure of a credential:

- ``jwt``: header and payload are JSON objects, the header names an algorithm, and the
  signature part is base64url (may be empty only for ``"alg": "none"``);
- ``der``: base64 or hex of a DER private key (PKCS#1, PKCS#8, SEC1): every nested
  length must fit its parent exactly;
- ``pem``: an armoured private key whose body decodes to such a DER key, to an OpenSSH
  key, or to an encrypted body announced by its header lines;
- ``ssh``: base64 or hex of an ``openssh-key-v1`` private key whose length-prefixed
  fields fill it exactly.

Lines of base64 or hex that follow each other, by real or escaped line ends, are read as one.
A key may begin anywhere in them; its own lengths say where it ends.

Offsets are code points, ends exclusive. Null texts count as empty, and give no spans.
Every span is found in the whole text; repeated secrets are reported at each place.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, table

#: Order of kinds where spans start at the same place (fixed values).
KINDS = ("assign", "access", "hex", "jwt", "der", "pem", "ssh")
BASE_KINDS = KINDS[:3]
_RANK = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(
    r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# Runs shorter than the limits match nothing, and a longer run is taken whole: the same spans
# as matching with + and dropping the short ones.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([^-]*(?:-[^-]+)*)-----END \1-----")
_LINE_END = r"(?:(?:\\+r)?\\+n|\r?\n)[ \t]*"
_ENDS = re.compile(_LINE_END)
_B64 = re.compile(rf"[A-Za-z0-9+/_-]{{44,}}(?:{_LINE_END}[A-Za-z0-9+/_-]+)*={{0,2}}")
_LONG_HEX = re.compile(rf"[0-9A-Fa-f]{{64,}}(?:{_LINE_END}[0-9A-Fa-f]+)*")
# How the first bytes of a DER sequence of 32 bytes or more, and of the magic text, look when encoded.
_B64_START = re.compile(r"(?=M[B-I]|b3BlbnNzaC1rZXktdjE)")
_HEX_START = re.compile(r"(?i)(?=30(?:1[ef]|[2-7][0-9a-f]|8[1-4])|6f70656e7373682d6b65792d763100)")
_SSH_MAGIC = b"openssh-key-v1\0"


def _b64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _unhex(s: str) -> bytes:
    return bytes.fromhex(s[: len(s) // 2 * 2])


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER items that fill data[at:end] exactly, else None."""
    items = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 0x80 or n >> (8 * (k - 1)) == 0:  # DER wants the shortest form
                return None
        if at + n > end:
            return None
        items.append((tag, at, at + n))
        at += n
    return items


def _lengths_fit(data: bytes) -> bool:
    """Whether every constructed item, at any depth, is filled exactly by its children."""
    todo = [(0, len(data))]
    while todo:
        items = _children(data, *todo.pop())
        if items is None:
            return False
        todo += [(a, b) for tag, a, b in items if tag & 0x20]
    return True


def is_private_der(data: bytes) -> bool:
    """PKCS#1 RSA, DSA, SEC1 EC or PKCS#8 (plain or encrypted) private key, lengths exact."""
    if len(data) < 32 or data[0] != 0x30 or not _lengths_fit(data):
        return False
    top = _children(data, 0, len(data))
    if len(top) != 1:
        return False
    inner = _children(data, *top[0][1:])
    tags = [t for t, _, _ in inner]
    if tags[:1] == [0x02]:
        version = data[inner[0][1] : inner[0][2]]
        if version in (b"\0", b"\1") and len(tags) in (6, 9) and set(tags) == {0x02}:
            return True  # DSA, RSA: integers only
        if version == b"\1" and tags[1:2] == [0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]):
            return True  # SEC1
        if version in (b"\0", b"\1") and tags[1:3] == [0x30, 0x04]:
            algorithm = _children(data, *inner[1][1:])
            return bool(algorithm) and algorithm[0][0] == 0x06
    if tags == [0x30, 0x04]:  # EncryptedPrivateKeyInfo
        algorithm = _children(data, *inner[0][1:])
        return len(algorithm) == 2 and algorithm[0][0] == 0x06 and algorithm[1][0] == 0x30
    return False


def _ssh_size(data: bytes) -> int | None:
    """Length of the ``openssh-key-v1`` key that ``data`` begins with: cipher, kdf, options, key count, public keys, private block."""
    if not data.startswith(_SSH_MAGIC):
        return None
    at = len(_SSH_MAGIC)

    def field() -> int | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return n

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return None
    (keys,) = struct.unpack_from(">I", data, at)
    at += 4
    if not keys or any(field() is None for _ in range(keys)):
        return None
    return at if field() else None


def is_openssh_key(data: bytes) -> bool:
    """Whether an ``openssh-key-v1`` key fills ``data``."""
    return _ssh_size(data) == len(data)


def _der_size(head: bytes) -> int | None:
    """Length of the DER sequence that begins so, if its first item can be that of a private key."""
    if len(head) < 8 or head[0] != 0x30:
        return None
    n, at = head[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4:
            return None
        n, at = int.from_bytes(head[2 : 2 + k], "big"), 2 + k
    return at + n if head[at] in (0x02, 0x30) else None


def _keys_in(run: str, start: re.Pattern, decode, chars: int, size: int) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the keys in an encoded run; ``chars`` characters stand for ``size`` bytes."""
    found, done = [], 0
    for m in start.finditer(run):
        at = m.start()
        if at < done:
            continue
        head = decode(run[at : at + 12 * chars // size]) or b""
        if head.startswith(_SSH_MAGIC[: len(head)]):
            whole = (len(run) - at) // chars * chars
            tail = decode(run[at:]) or decode(run[at : at + whole]) or b""
            n, kind = _ssh_size(tail), "ssh"
        else:
            n, kind = _der_size(head), "der"
        end = at + -(-(n or 0) * chars // size)
        if n and end <= len(run) and (kind == "ssh" or is_private_der(decode(run[at:end]) or b"")):
            found.append((at, end, kind))
            done = end
    return found


def _encoded(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of keys in runs of base64 or hex, of one line or several."""
    found = []
    for pattern, start, decode, chars, size in ((_B64, _B64_START, _b64, 4, 3), (_LONG_HEX, _HEX_START, _unhex, 2, 1)):
        for m in pattern.finditer(text):
            run, places, at = [], [], m.start()  # places: joined length before a line, and the line's offset
            length = 0
            for e in [*_ENDS.finditer(text, m.start(), m.end()), None]:
                line = text[at : e.start() if e else m.end()]
                if not e:
                    line = line.rstrip("=")
                places.append((length, at))
                run.append(line)
                length += len(line)
                at = e.end() if e else at
            for a, b, kind in _keys_in("".join(run), start, decode, chars, size):
                x, y = (places[bisect.bisect_right(places, (i, len(text))) - 1] for i in (a, b - 1))
                end = y[1] + b - y[0]
                pad = -(b - a) % 4 if chars == 4 else 0
                while pad and text[end : end + 1] == "=":
                    end, pad = end + 1, pad - 1
                found.append((x[1] + a - x[0], end, kind))
    return found


def is_jwt(header: str, payload: str, signature: str) -> bool:
    """Header and payload are JSON objects in base64url; the header names an algorithm."""
    parts = []
    for part in (header, payload):
        raw = _b64(part)
        try:
            value = json.loads(raw.decode("utf-8")) if raw else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict):
            return False
        parts.append(value)
    algorithm = parts[0].get("alg")
    if not isinstance(algorithm, str) or not algorithm:
        return False
    if not signature:
        return algorithm.lower() == "none"
    return _b64(signature) is not None


def _pem_ok(body: str) -> bool:
    lines = [x.strip() for x in _ENDS.sub("\n", body).strip().splitlines()]
    headers = [x for x in lines if ":" in x]
    raw = _b64("".join("".join(x for x in lines if ":" not in x).split()))
    if not raw:
        return False
    if any(x.startswith("Proc-Type:") and "ENCRYPTED" in x for x in headers):
        return len(raw) >= 32
    return is_private_der(raw) or is_openssh_key(raw)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three base patterns."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose decoded structure holds."""
    found = [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_jwt(m[1], m[2], m[3])]
    if "-----BEGIN " in text:
        found += [(m.start(), m.end(), "pem") for m in _PEM.finditer(text) if _pem_ok(m[2])]
    return found + _encoded(text)


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind; confirmed spans inside an armoured key are part of it."""
    extra = confirmed_spans(text)
    armour = [(a, b) for a, b, k in extra if k == "pem"]
    extra = [x for x in extra if x[2] == "pem" or not any(a <= x[0] and x[1] <= b for a, b in armour)]
    return sorted(set(base_spans(text) + extra), key=lambda x: (x[0], _RANK[x[2]], x[1]))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping spans replaced by ``mark``."""
    out, at, end = [], 0, -1
    for a, b, _ in scan(text):
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out.append(mark)
            at = end
        out.append(text[at:a])
        end = b
    if end >= 0:
        out.append(mark)
        at = end
    return "".join(out) + text[at:]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _digest(text: str) -> tuple:
    spans = scan(text)
    base = [x for x in spans if x[2] in BASE_KINDS]
    count = {k: 0 for k in KINDS}
    for _, _, k in spans:
        count[k] += 1
    return (*(count[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))


_SCHEMA = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``secrets``: counts by kind, base digest, all spans.

    Map only: no shuffle, one text in memory at a time besides its Arrow batch. A column
    named ``secrets`` in the input is replaced.
    """
    return docs.withColumn("secrets", per_text(F.col(text_col), _digest, _SCHEMA))


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``[SECRET]``; null texts stay null, other columns as they are."""
    mark = per_text(F.col(text_col), lambda t: (redact(t),), "text string")["text"]
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), mark))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: one row per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = [f"n_{k}" for k in BASE_KINDS] + ["base_sha256", "spans"] + [f"n_{k}" for k in KINDS[3:]]
    return scan_secrets(docs).select("doc_id", *(F.col(f"secrets.{n}").alias(n) for n in names))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced; ``n_chars`` follows the new text."""
    clean = redact_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return clean.select(*docs.columns)
