"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

Fixed patterns give the base spans. The method adds strings that no pattern names: each
candidate string in a sensitive context is compressed together with the code around it
by a zstandard compressor primed with dictionaries of identifiers; what it adds to the
compressed size, per byte, is its novelty. Identifiers, words and repeats cost little;
keys cost nearly their whole length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from episcope.llm.common import unused_name

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

# Words that make the text after them a sensitive context.
SENSITIVE = (
    "access", "api", "auth", "bearer", "cert", "credential", "encrypt", "key", "login", "passphrase",
    "passwd", "password", "private", "pwd", "salt", "secret", "session", "signature", "token",
)
# Common identifiers and words of source code and configuration files.
CODE_WORDS = (
    "abstract address algorithm application argument array async attribute author authorization base64 "
    "boolean branch buffer build bytes callback catch certificate channel char class client code column "
    "command comment commit config configuration connection const constructor container content context "
    "controller cookie count create credentials crypto database date debug decode default define delete "
    "description digest directory document domain double element email encode endpoint engine enum "
    "environment error event example exception export extends false file filter final finally float "
    "format function global group handler hash header host identifier image implements import include "
    "index instance integer interface internal json key language length library license link list local "
    "localhost login logger manager message method model module name namespace network null number object "
    "operator option override package parameter parent parse password path pattern payload permission "
    "port prefix print private process profile project property protected protocol provider public query "
    "random reader record reference register release remote request resource response result return "
    "schema secret server service session signature source static status storage stream string struct "
    "suffix switch system table template thread time timeout timestamp title token transaction true type "
    "undefined update upload user username value variable version virtual void width window writer"
).split()
IDENTIFIERS = "".join(f" {w} _{w} {w.capitalize()}" for w in CODE_WORDS)
ALPHABETS = "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef"


@dataclass(frozen=True)
class NoveltyScan:
    """Parameters of the novelty method.

    ``min_length``: shortest candidate; ``context``: characters on either side that are
    compressed with it; ``sensitive_before``: how far before a candidate a sensitive
    word may stand; ``min_novelty``: added compressed bytes per byte of the candidate;
    ``dictionaries``: identifier texts that prime the compressor.
    """

    min_length: int = 16
    context: int = 256
    sensitive_before: int = 48
    min_novelty: float = 0.55
    dictionaries: Sequence[str] = field(default=(IDENTIFIERS, ALPHABETS))

    def scanner(self, copies_in_context: bool = True):
        """A function from text and taken spans to the novel spans ``(start, end)``.

        Unless ``copies_in_context``, what the context holds of the candidate itself
        (whole, or a part of ``min_length`` characters) is blanked before measuring, so a
        key that stands twice is as novel as one that stands once.
        """
        primed = zstandard.ZstdCompressionDict("".join(self.dictionaries).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False)
        candidate = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % self.min_length)
        sensitive = re.compile("(?ai:" + "|".join(SENSITIVE) + ")")

        def size(text: str) -> int:
            return len(compressor.compress(text.encode("utf-8", "surrogatepass")))

        # A copy that the context's far end cuts in two is seen as far as it takes to know it.
        beyond = 0 if copies_in_context else self.min_length - 1

        def without(own: str, around: str) -> str:
            if copies_in_context:
                return around
            out, n = list(around), self.min_length
            for k in range(len(around) - n + 1):
                if around[k:k + n] in own:
                    out[k:k + n] = " " * n
            return "".join(out)

        def scan(text: str, taken: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
            found = []
            for m in candidate.finditer(text):
                a, b = m.span()
                if any(s < b and a < e for s, e in taken):
                    continue
                if not sensitive.search(text, max(0, a - self.sensitive_before), a):
                    continue
                first = max(0, a - self.context)
                left = without(m[0], text[max(0, first - beyond):a])[-(a - first):]
                right = without(m[0], text[b:b + self.context + beyond])[:self.context]
                added = size(left + m[0] + right) - size(left + right)
                if added >= self.min_novelty * (b - a):
                    found.append((a, b))
            return found

        return scan


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of the fixed patterns, leftmost and not overlapping per kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


RESULT = "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, text: str = "text", novelty: NoveltyScan = NoveltyScan()) -> DataFrame:
    """Every row of ``docs`` without its text, with the secrets found in the whole text.

    Adds the number of spans per kind, ``spans`` (all spans as ``kind:start:end`` by start,
    then by kind as listed in ``KINDS``, comma-joined; code points, end exclusive) and
    ``base_sha256`` (SHA-256 of the base spans joined likewise). NULL text counts as empty:
    no span, an empty list. Result columns replace input columns of the same name.
    """
    added = T.StructType.fromDDL(RESULT)
    kept = [c for c in docs.columns if c != text and c not in added.names]
    schema = T.StructType([docs.schema[c] for c in kept] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = novelty.scanner(copies_in_context=False)
        for batch in batches:
            out = {n: [] for n in added.names}
            for value in batch.column(0):
                whole = value.as_py() or ""
                base = base_spans(whole)
                novel = [(a, 3, b) for a, b in scan(whole, [(a, b) for a, _, b in base])]
                name = lambda s: f"{KINDS[s[1]]}:{s[0]}:{s[2]}"
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[1] == k for s in base + novel))
                out["base_sha256"].append(hashlib.sha256(",".join(map(name, base)).encode()).hexdigest())
                out["spans"].append(",".join(map(name, sorted(base + novel))))
            columns = batch.columns[1:] + [
                pa.array(out[f.name], pa.int64() if f.dataType == T.LongType() else pa.string()) for f in added]
            yield pa.RecordBatch.from_arrays(columns, names=kept + added.names)

    return docs.select(docs[f"`{text}`"].alias(unused_name(kept, "text")), *[docs[f"`{c}`"] for c in kept]).mapInArrow(run, schema)
