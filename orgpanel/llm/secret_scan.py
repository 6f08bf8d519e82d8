"""Secret scan by dictionary-primed compression novelty.

Base kinds (assign, access, hex) are what their patterns match. A further candidate is a run of 16 or more token characters with a letter
and a digit, cut at ``=`` between name and value, that starts within ``context`` characters after a word such as key, token or credential or has one in its name. For each candidate, zstandard compresses the text
around it after a dictionary of identifiers and that text's own words, with and without the candidate; the bytes that the candidate adds are its novelty. Names, paths and
repeated strings add few, random strings about as many as they have bits. Candidates of at
least ``novelty`` bytes a character that no base span covers are reported as kind ``novel``; base spans carry their novelty as well.

One pass over whole texts without a shuffle; a candidate's window is bounded, so long texts cost in proportion.

Edge cases: null and empty texts have no spans; positions count code points; rows that repeat a doc_id keep their own
rows; a null doc_id is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: a run of fewer than 24 fails as a whole, so runs of 24 or more are the same matches
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: what stands between equals signs, and those at its end if nothing of the run follows
PART = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")
LONGEST = len("credential")
WORD = re.compile(r"key|token|secret|passw|credential|auth|bearer|private|signature", re.I | re.A)

# Identifiers that are common in code and settings.
IDENTIFIERS = b"""password passwd secret token api_key apiKey access_key accessKeyId secretAccessKey client_id client_secret
authorization bearer credentials private_key public_key signature session_id user_name username hostname localhost
example placeholder changeme your_token_here import export return function const string integer boolean default
config configuration environment production development database connection https http www index main value name
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890abcdef 0000000000000000 xxxxxxxxxxxxxxxx"""


@dataclass(frozen=True)
class SecretConfig:
    context: int = 48
    window: int = 512
    novelty: float = 0.8


class Novelty:
    """Bytes that a string adds to the compressed text around it, a character."""

    def __init__(self, cfg: SecretConfig):
        import zstandard

        self.z, self.cfg = zstandard, cfg

    def __call__(self, text: str, start: int, end: int) -> float:
        around = (text[max(0, start - self.cfg.window) : start] + " " + text[end : end + self.cfg.window]).encode("utf-8", "replace")
        primed = self.z.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=self.z.DICT_TYPE_RAWCONTENT)
        pack = self.z.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        near = text[max(0, start - 16) : start].encode("utf-8", "replace")
        return (len(pack.compress(near + text[start:end].encode("utf-8", "replace"))) - len(pack.compress(near))) / max(1, end - start)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank, kind, end) of the base kinds, in order."""
    low, out = text.lower(), []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, cfg: SecretConfig) -> Iterator[tuple[int, int]]:
    """(start, end) of each run, or part of a run between equals signs, after a sensitive word; padding stays with its run."""
    if not WORD.search(text):
        return
    for run in RUN.finditer(text):
        name = run.start()
        for m in PART.finditer(text, run.start(), run.end()):
            start, end = m.span()
            first, name = min(name, start - cfg.context), start
            if end - start >= 16 and any(w.end() >= first for w in WORD.finditer(text, max(0, first - LONGEST), start)):
                yield start, end


def novel_spans(text: str, base: list[tuple[int, int, str, int]], novelty: Novelty, cfg: SecretConfig) -> list[tuple[int, int, str, int]]:
    """Incompressible runs in a sensitive context that no base span meets."""
    out = []
    for start, end in candidates(text, cfg):
        run = text[start:end]
        if run.isalpha() or not re.search("[0-9]", run) or not re.search("[A-Za-z]", run):
            continue
        if all(end <= s or e <= start for s, _, _, e in base) and novelty(text, start, end) >= cfg.novelty:
            out.append((start, 3, "novel", end))
    return out


def find_secrets(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """doc_id, spans (start, kind, end, novelty) for every row of docs, in order of start and kind."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(cfg)
        for b in batches:
            rows = []
            for cell in b.column("text"):
                text = cell.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base, novelty, cfg))
                rows.append([{"start": s, "kind": k, "end": e, "novelty": novelty(text, s, e)} for s, _, k, e in spans])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return made.mapInArrow(run, "doc_id long, spans array<struct<start:long,kind:string,end:long,novelty:double>>")


def secret_digests(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """The contract of op9, with the novelty of all spans."""
    base = f"filter(spans, x -> x.kind in {BASE})"
    joined = lambda spans: f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    digest = F.sha2(F.expr(joined(base)).cast("binary"), 256).alias("base_sha256")
    return find_secrets(docs, cfg).select("doc_id", *counts, digest, F.expr(joined("spans")).alias("spans"), F.expr("array_join(transform(spans, x -> format_number(x.novelty, 3)), ',')").alias("novelties"))
