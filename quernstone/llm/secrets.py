"""Secret scans (operator 8): sliding-window Shannon entropy, beside three fixed patterns.

Candidates are long strings of the base64 alphabet. Each belongs to a class of characters (hex digits, letters and digits
of one case, of both cases, the whole alphabet). A window of fixed length slides over a candidate; counts of its
characters change by one in and one out, and with them the sum of c log c, so each step takes constant time. A candidate
whose window reaches the entropy asked of its class is a secret, unless the allow list explains all of it: words and
names made of words, numbers, UUIDs, paths and addresses, dates and versions. Runs and sequences are taken out of a
candidate first, and it goes only if what is left is shorter than LEFT: a key that happens to hold `0000` is still one.

Spans of the base patterns always stay. An entropy span that one of them covers is not told again. Time is in proportion
to the length of a text: both lists come by start and are merged.

Defined cases: a null or empty text has no spans, and the hash of an empty string; places are code points, ends exclusive;
repeated rows give repeated rows; a null doc_id stays null; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import bounded_batches, columns_of, documents, id_and_text

#: The base patterns, in the order of their kinds. A match counts from so many characters (of group 2 for the first).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of the window, and the entropy in bits that its candidates' classes must reach: what nearly all windows of
#: random characters of the class do.
WINDOW = 20
LEAST = {"hex": 3.0, "one case": 3.5, "both cases": 3.65, "all": 3.7}
#: Characters that must be left of a candidate without its runs and sequences.
LEFT = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Marks that join words, and what else the allow list knows, as patterns of whole candidates.
MARKS = str.maketrans("", "", "+/_=-")
ALLOWED = (
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"/?(?:[A-Za-z_-]+[0-9]{0,4}/)+[A-Za-z_-]*[0-9]{0,4}/?"),
    re.compile(r"(?:[A-Za-z]+[-_=])*[A-Za-z]*[0-9]{1,4}(?:[-_=][A-Za-z]+)*"),
    re.compile(r"v?[0-9]{1,4}(?:[-_/][0-9]{1,4})+(?:[-_][A-Za-z]+)*"),
)
#: Sequences that look random only to a count, and runs of one character.
SEQUENCES = re.compile(r"0123456789|abcdefghijklmnopqrstuvwxyz|qwertyuiop|asdfghjkl|example|(.)\1{3,}", re.I)

#: c log2 c for the counts of a window, and of one character more.
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def max_entropy(s: str) -> float:
    """The greatest Shannon entropy, in bits for each character, of the windows of s."""
    count: dict[str, int] = {}
    total = 0.0
    n = min(WINDOW, len(s))
    least = math.inf
    for i, c in enumerate(s):
        k = count.get(c, 0)
        total += _CLOG[k + 1] - _CLOG[k]
        count[c] = k + 1
        if i >= n:
            old = s[i - n]
            k = count[old]
            total += _CLOG[k - 1] - _CLOG[k]
            count[old] = k - 1
        if i >= n - 1:
            least = min(least, total)
    return math.log2(n) - least / n if n else 0.0


def kind_of(s: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    if re.fullmatch(r"[0-9a-z]+|[0-9A-Z]+", s):
        return "one case"
    return "both cases" if s.isalnum() else "all"


def is_name(s: str) -> bool:
    """Letters alone, beside joining marks, of one case or with at most a third of them large: a word, or a name made of words."""
    letters = s.translate(MARKS)
    large = sum(map(str.isupper, letters))
    return not letters or letters.isalpha() and (large == len(letters) or 3 * large <= len(letters))


def allowed(s: str) -> bool:
    """Whether words, numbers and the like explain all of a candidate, or runs and sequences all but a short rest."""
    return is_name(s) or any(p.fullmatch(s) for p in ALLOWED) or len(SEQUENCES.sub("", s)) < LEFT


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in that order."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The candidates that are secrets and lie in no base span. base comes by start, as do candidates."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while i < len(base) and base[i][0] <= m.start():
            reach = max(reach, base[i][2])
            i += 1
        s = m[0]
        if m.end() > reach and not allowed(s) and max_entropy(s) >= LEAST[kind_of(s)]:
            out.append((m.start(), 3, m.end()))
    return out


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in columns_of(batches, "doc_id", "text"):
        out = []
        for i, t in zip(ids, texts, strict=True):
            base = base_spans(t)
            more = entropy_spans(t, base)
            n = [sum(k == x for _, k, _ in base) for x in range(3)]
            out.append((i, *n, hashlib.sha256(told(base).encode()).hexdigest(), told(sorted(base + more)), len(more)))
        cols = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if k == "string" else pa.int64()) for c, k in zip(cols, (x.split()[1] for x in FOUND.split(", ")), strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])


def secrets(docs: DataFrame) -> DataFrame:
    """The spans of secrets in every text."""
    bounded_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_rows, FOUND)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))
