"""Secrets in texts: keyword automaton, anchored patterns near its hits, checksums inside the secret.

One Aho-Corasick automaton runs over each whole text (with A-Z lower-cased).
It holds the words that start a secret (``password``, ``akia``, ``ghp_``, ...)
and every run of four hexadecimal digits, since a hex secret has no word of its
own: each run of four or more digits begins with a hit.  Only at a hit is the
pattern of its kind tried, anchored there; a hit inside the kind's last match is
passed over, so the matches are the leftmost ones that do not overlap, as a scan
of the whole text by that pattern gives.

Base kinds (a match that is too short takes its place in the text but is dropped):

* ``assign``: a name, ``:`` or ``=``, and a value of six characters or more;
* ``access``: ``AKIA`` and capitals or digits, twenty characters or more;
* ``hex``: twenty-four lower-case hexadecimal digits or more.

Added kinds count only if the checksum they carry is right:

* ``github`` and ``npm``: 30 characters, then their CRC-32 as six base-62 digits;
* ``bip32``: an extended private key in base 58 with the first four bytes of a double SHA-256;
* ``age``: a secret key in Bech32 with its BCH checksum.

The work is one map over the rows; nothing is shuffled and a task holds one
Arrow batch.  Defined results: a NULL or empty text has no spans; rows that
repeat stay rows of their own; a NULL id stays; other columns are not read by
``find`` and pass through ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from sardonyx.llm.common import LOWER_ASCII, arrow_map, texts_of

SPANS = "array<struct<kind:string,start:int,stop:int>>"
BASE_KINDS = ("assign", "access", "hex")

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
#: The generator of the Bech32 checksum.
_BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
#: Fixed value: the version bytes of an extended private key.
_XPRV_VERSION = bytes.fromhex("0488ade4")


def crc62_ok(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of those between the prefix and them, in base 62."""
    body, want = match.group(1)[:-6], match.group(1)[-6:]
    value = 0
    for ch in want:
        value = value * 62 + _BASE62.index(ch)
    return value == zlib.crc32(body.encode())


def base58_ok(match: re.Match) -> bool:
    """An extended private key whose last four bytes are the double SHA-256 of the 78 before."""
    value = 0
    for ch in match.group():
        value = value * 58 + _BASE58.index(ch)
    if value >= 1 << 656:
        return False
    raw = value.to_bytes(82, "big")
    digest = hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()
    return raw[:4] == _XPRV_VERSION and digest[:4] == raw[78:]


def bech32_ok(match: re.Match) -> bool:
    """The Bech32 checksum over the part before the last ``1`` and the data after it."""
    human, _, data = match.group().lower().rpartition("1")
    values = [ord(c) >> 5 for c in human] + [0] + [ord(c) & 31 for c in human] + [_BECH32.index(c) for c in data]
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for k, g in enumerate(_BECH32_GENERATOR):
            if top >> k & 1:
                check ^= g
    return check == 1


class Kind(NamedTuple):
    name: str
    words: tuple[str, ...]       # lower case; empty: four hexadecimal digits
    pattern: re.Pattern
    lowered: bool                # the pattern is for the lower-cased text
    valid: Callable[[re.Match], bool]


KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""),
         True, lambda m: len(m.group(1)) >= 6),
    Kind("access", ("akia",), re.compile("AKIA[A-Z0-9]+"), False, lambda m: m.end() - m.start() >= 20),
    Kind("hex", (), re.compile("[0-9a-f]+"), False, lambda m: m.end() - m.start() >= 24),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
         re.compile("gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), False, crc62_ok),
    Kind("npm", ("npm_",), re.compile("npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), False, crc62_ok),
    Kind("bip32", ("xprv",), re.compile(f"xprv[{_BASE58}]{{107}}(?![A-Za-z0-9])"), False, base58_ok),
    Kind("age", ("age-secret-key-1",), re.compile("AGE-SECRET-KEY-1[AC-HJ-NP-Z02-9]{58}(?![A-Z0-9])"), False, bech32_ok),
)


@lru_cache(maxsize=1)
def _automaton():
    """The words of all kinds and all runs of four hexadecimal digits; built once per worker."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, kind in enumerate(KINDS):
        for word in kind.words or map("".join, product("0123456789abcdef", repeat=4)):
            found.add_word(word, k << 8 | len(word))
    found.make_automaton()
    return found


def scan(raw: bytes) -> list[tuple[int, int, int]]:
    """``start, kind number, stop`` (code points, stop exclusive) of the secrets of one text, in order."""
    text, lowered = raw.decode(), raw.translate(LOWER_ASCII).decode()
    done = [0] * len(KINDS)
    spans = []
    for last, value in _automaton().iter(lowered):
        k, start = value >> 8, last + 1 - (value & 255)
        if start < done[k]:
            continue
        kind = KINDS[k]
        match = kind.pattern.match(lowered if kind.lowered else text, start)
        if match:
            done[k] = match.end()
            if kind.valid(match):
                spans.append((start, k, match.end()))
    return sorted(spans)


def _span_array(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat, ends = [s for spans in rows for s in spans], [0]
    for spans in rows:
        ends.append(ends[-1] + len(spans))
    entries = pa.StructArray.from_arrays(
        [pa.array([KINDS[k].name for _, k, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int32()),
         pa.array([b for _, _, b in flat], pa.int32())], ["kind", "start", "stop"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: the secrets of every row of ``docs`` by start, then kind as listed."""
    def work(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            spans = _span_array([scan(t) for t in texts_of(b)])
            yield pa.RecordBatch.from_arrays([b.column(0), spans], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), work, f"doc_id {kind}, spans {SPANS}")


def mask(raw: bytes) -> str:
    """The text with each stretch of secrets (overlapping spans are one) as ``[SECRET]``."""
    text, out, at = raw.decode(), [], 0
    for start, _, stop in scan(raw):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked; all other columns as they are, NULL stays NULL."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            there = b.column(at).is_valid().to_pylist()
            texts = pa.array([mask(t) if ok else None for t, ok in zip(texts_of(b), there)], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), texts)

    return arrow_map(docs, work, docs.schema)
