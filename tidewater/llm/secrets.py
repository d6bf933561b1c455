"""Secret scans: fixed patterns, and zstandard novelty against the text around a candidate.

Patterns (assign, access, hex) are matched from left to right over whole texts. Novelty looks at strings
of letters and digits after a sensitive word that no pattern has found. A zstandard compressor is primed
with a dictionary, which holds the text's own identifiers, the fixed words of CODE_WORDS and the text on
both sides of the candidate; the candidate's marginal compressed bytes, as a share of its length, are its
novelty. What follows from its surroundings compresses; what is random does not, and is reported. As zstandard
codes the letters of long strings by their frequency, a long candidate is also judged by each WINDOW of its
characters, which are too few for that.

Each text is scanned by itself, so memory is that of one Arrow batch and nothing is shuffled.

Defined cases: a null text is empty; an empty text has no spans and the checksum of the empty string;
repeated rows are scanned each by itself; a candidate that overlaps a pattern's span is left to it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .shared import arrow_mapped, table, turned

# The patterns of the contract, with the least length of what they find.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

# Words that make what follows them sensitive, and words common in code.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "private_key", "credential", "bearer", "authorization", "access_key")
CODE_WORDS = "abstract array auth base64 boolean client config const default double encode export float function header host import integer key length module name null object package password path private public request response return secret select server session static string token type undefined user value version"

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}")
#: How far after a sensitive word a candidate may start, and how much text on each side primes the compressor.
REACH, AROUND = 48, 2048
NOVELTY = 0.85
#: Characters of a long candidate that are judged at once.
WINDOW = 32
#: Other letters stay: the sensitive words are of a-z, and lower() may lengthen a text.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _assignments(text: str, lower: str) -> list[tuple[int, str, int]]:
    if not any(w in lower for w in ("passw", "secret", "token", "api")):
        return []
    return [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]


def base_spans(text: str, lower: str | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, by start, then by kind."""
    found = _assignments(text, _lower(text) if lower is None else lower)
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def _lower(text: str) -> str:
    """text with A-Z in lower case and every character in its place."""
    return text.lower() if text.isascii() else text.translate(LOWER)


def _is_novel(candidate: str, before: str, after: str, identifiers: str = "") -> bool:
    """Whether the marginal compressed bytes of the candidate, or of a window of it, reach NOVELTY for each byte, given what stands around it."""
    primed = f"{CODE_WORDS} {identifiers} {after} {before}".encode()
    how = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=19, dict_data=how, write_content_size=False, write_checksum=False, write_dict_id=False)
    empty = len(press.compress(b""))
    parts = [candidate]
    if len(candidate) > WINDOW:
        starts = [*range(0, len(candidate) - WINDOW, WINDOW), len(candidate) - WINDOW]
        parts += [w for w in (candidate[i : i + WINDOW] for i in starts) if _mixed(w)]
    return any(len(press.compress(p.encode())) - empty >= NOVELTY * len(p) for p in parts)


class _Identifiers:
    """The distinct identifiers of a text, found by the runs of three characters that they hold: zstandard matches no fewer."""

    def __init__(self, text: str):
        found = [(m.start(), m[0]) for m in IDENTIFIER.finditer(text)]
        self.starts, self.names = [at for at, _ in found], [n for _, n in found]
        self.count = Counter(self.names)
        self.holders: dict[str, list[str]] = defaultdict(list)
        for n in self.count:
            for run in {n[i : i + 3] for i in range(len(n) - 2)}:
                self.holders[run].append(n)

    def like(self, candidate: str, start: int, end: int) -> str:
        """Those that share three characters in a row with the candidate and occur outside it, in an order that is always the same."""
        inside = Counter(self.names[bisect_left(self.starts, start) : bisect_left(self.starts, end)])
        near = {n: None for i in range(len(candidate) - 2) for n in self.holders.get(candidate[i : i + 3], ())}
        return " ".join(n for n in near if self.count[n] > inside[n])


def _mixed(candidate: str) -> bool:
    """Letters and digits, several of both: a long word or a long number alone is no secret."""
    digits = sum(c.isdigit() for c in candidate)
    letters = sum(c.isalpha() for c in candidate)
    return digits >= 3 and letters >= 3 and len(set(candidate)) >= 8


def novel_spans(text: str, taken: list[tuple[int, str, int]], lower: str | None = None) -> list[tuple[int, str, int]]:
    lower = _lower(text) if lower is None else lower
    if not any(w in lower for w in SENSITIVE):
        return []
    found, names = [], None
    for m in CANDIDATE.finditer(text):
        if not _mixed(m[0]) or any(s < m.end() and m.start() < e for s, _, e in taken):
            continue
        if not any(w in lower[max(0, m.start() - REACH) : m.start()] for w in SENSITIVE):
            continue
        if names is None:
            names = _Identifiers(text)
        own = names.like(m[0], m.start(), m.end())
        before, after = text[max(0, m.start() - AROUND) : m.start()], text[m.end() : m.end() + AROUND]
        if _is_novel(m[0], before, after, own):
            found.append((m.start(), "novel", m.end()))
    return found


def find_spans(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The patterns' spans, and all spans, each by start, then kind."""
    text = text or ""
    lower = _lower(text)
    base = base_spans(text, lower)
    more = novel_spans(text, base, lower)
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, str, int]], mark: str = "[REDACTED]") -> str:
    """text, with mark in place of each run of overlapping spans."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                base, spans = find_spans(text)
                counts = [sum(k == kind for _, k, _ in spans) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield [batch["doc_id"], *turned(rows, 6)]

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return arrow_mapped(docs.select("doc_id", "text"), run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs, whatever its columns, with all spans of text replaced and n_chars, where there is one, counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at, found = names.index("text"), [t if t is None else redacted(t, find_spans(t)[1]) for t in batch["text"].to_pylist()]
            text = pa.array(found, batch.schema.field(at).type)
            batch = batch.set_column(at, batch.schema.field(at), text)
            if "n_chars" in names:
                field = batch.schema.field("n_chars")
                counted = pc.if_else(pc.is_null(text), batch["n_chars"], pc.utf8_length(text).cast(field.type))
                batch = batch.set_column(names.index("n_chars"), field, counted)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
